"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors are lifted so that the inner product orders like a distance: with M the largest length, x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), and |q - x|^2 = |q|^2 + M^2 - 2 q.x. A few pivots cut the space
into Voronoi cells. From summaries of the cells follows for each cell of queries how far the k nearest can be at most;
a row is sent to a group of queries only if its distance to one of the group's pivots allows that. Groups are solved
locally with whole numbers, a group's rows in as many parts as it takes, and the parts' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import stored

SLACK = 1e-6


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: Column) -> Column:
    """False for null vectors and those that hold null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def padded(vectors: pd.Series, dim: int) -> np.ndarray:
    """One row of longs each, zeros after the end of shorter vectors."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """rows as floats with the component that makes all lengths the root of top."""
    rows = rows.astype(float)
    return np.hstack([rows, np.sqrt(np.maximum(0, top - (rows * rows).sum(axis=1, keepdims=True)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)))


def tour(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest one left."""
    apart = distances(pivots, pivots)
    left, at, out = set(range(len(pivots))), 0, []
    while left:
        out.append(at)
        left.discard(at)
        if left:
            at = min(left, key=lambda j: apart[out[-1], j])
    return out


#: No score: of a query with itself.
NONE = np.iinfo(np.int64).min


def top_k(
    data: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "vector",
    n_pivots: int | None = None, group: int = 512, part: int = 2048,
) -> DataFrame:
    """(query_id, rank, id, score): for each query the k rows of data with the largest inner product, all if fewer.

    Both tables have longs id and arrays of longs; a query's own id is no candidate, ties go to the smaller id, and the
    shorter of two vectors counts as padded with zeros. Null ids and null vectors take no part. Rows of data that share an id
    count each, as often as they are there; of queries with equal ids, the one with the largest vector counts. Components must be below 2^26 or so, so
    that products stay within a long. Other columns aren't read. No queries or no data give no rows. n_pivots: by default
    one for 256 queries, from 64 to 1024.
    """
    keep = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    data, queries = keep(data), keep(queries).groupBy("id").agg(F.max("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    seen = data.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    shape = queries.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim, top = max(seen["dim"] or 0, shape["dim"] or 0, 1), float(seen["top"] or 0.0)
    spark = data.sparkSession
    result = "query_id long, rank int, id long, score long"
    if seen["dim"] is None or not shape["n"]:
        return spark.createDataFrame([], result)
    n_pivots = n_pivots or min(1024, max(64, shape["n"] // 256))
    chosen = data.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(n_pivots).toPandas()  # the pivots: a bounded sample
    pivots = lifted(padded(chosen["v"], dim), top)
    apart = distances(pivots, pivots)

    # Summaries: of the data, the k + 1 rows nearest to each pivot in its cell, by distinct id (one may be the query's own);
    # of the queries, how many a cell has and how far the farthest is.
    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = distances(lifted(padded(batch["v"], dim), top), pivots)
            rows = pd.DataFrame({"cell": d.argmin(1).astype("int32"), "far": d.min(1), "id": batch["id"]}).sort_values(["far", "id"])
            yield rows.drop_duplicates(["cell", "id"]).groupby("cell").head(k + 1)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = padded(batch["v"], dim)
            d = distances(np.hstack([rows.astype(float), np.zeros((len(rows), 1))]), pivots)
            yield pd.DataFrame({"cell": d.argmin(1).astype("int32"), "far": d.min(1), "id": batch["id"], "q": [r.tobytes() for r in rows]})

    near = data.mapInPandas(nearest, "cell int, far double, id long").groupBy("cell", "id").agg(F.min("far").alias("far"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("far", "id"))).where(F.col("nth") <= k + 1)
    heads = near.select("cell", "far", "id").toPandas()  # pivots times k + 1 rows
    at_cell = stored(queries.mapInPandas(placed, "cell int, far double, id long, q binary"))
    cells = at_cell.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas().set_index("cell")

    head_cell, head_far, head_id = heads["cell"].to_numpy(), heads["far"].to_numpy(), heads["id"].to_numpy()
    limit = {}
    for cell, far in cells["far"].items():
        reach = apart[cell, head_cell] + head_far
        order = np.argsort(reach, kind="stable")
        ids = np.sort(np.unique(head_id[order], return_index=True)[1])  # where each id comes first
        # no query of the cell has its k nearest, other than its own id, beyond this
        limit[cell] = far + (float(reach[order[ids[k]]]) if len(ids) > k else np.inf)
    # Groups of neighbouring cells with about `group` queries; a cell with more is split into blocks.
    groups: list[list[int]] = []
    blocks_of: dict[int, tuple[int, int]] = {}
    held = 0
    for cell in tour(pivots):
        n = int(cells["n"].get(cell, 0))
        if not n:
            continue
        blocks = -(-n // group)
        if blocks > 1 or not groups or held + n > group:
            groups.append([])
            held = 0
        if blocks > 1:
            blocks_of[cell] = len(groups) - 1, blocks
            groups[-1].append(cell)
            groups += [[cell] for _ in range(blocks - 1)]
            held = group
        else:
            blocks_of[cell] = len(groups) - 1, 1
            groups[-1].append(cell)
            held += n
    first = F.element_at(F.array(*[F.lit(blocks_of.get(c, (0, 1))[0]) for c in range(len(pivots))]), F.col("cell") + 1)
    many = F.element_at(F.array(*[F.lit(blocks_of.get(c, (0, 1))[1]) for c in range(len(pivots))]), F.col("cell") + 1)
    at_group = at_cell.withColumn("grp", (first + F.pmod(F.xxhash64("id"), many.cast("long"))).cast("int"))
    packed = at_group.groupBy("grp").agg(F.collect_list(F.struct("id", "q")).alias("qs"))  # about `group` queries each

    # Each cell's bound is tested once for all its blocks: the groups' cells lie side by side, those of a split cell once.
    used = list(dict.fromkeys(cell for own in groups for cell in own))
    reach = np.array([cells["far"][c] + limit[c] * (1 + SLACK) + SLACK for c in used])
    distinct = list(dict.fromkeys(tuple(own) for own in groups))
    starts = np.cumsum([0] + [len(own) for own in distinct[:-1]])
    column_of = {own: n for n, own in enumerate(distinct)}
    columns = [column_of[tuple(own)] for own in groups]

    def needed_by(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(group, which rows) for the groups that need some of them: |q - x| >= |pivot - x| - |pivot - q|."""
        within = distances(lifted(rows, top), pivots)[:, used] <= reach
        needed = np.logical_or.reduceat(within, starts, axis=1)
        some = needed.any(axis=0)
        for g, column in enumerate(columns):
            if some[column]:
                yield g, needed[:, column]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(groups), np.int64)
        for batch in batches:
            for g, needed in needed_by(padded(batch["v"], dim)):
                sums[g] += needed.sum()
        some = np.flatnonzero(sums)
        yield pd.DataFrame({"grp": some.astype(np.int32), "n": sums[some]})

    # Each group's rows in as many parts as their number takes: a group that the bound spares most rows is copied to few.
    sizes = data.mapInPandas(tally, "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect()  # a row a group
    parts = np.ones(len(groups), np.int64)
    for row in sizes:
        parts[row["grp"]] = -(-row["n"] // part)

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = padded(batch["v"], dim)
            blobs, ids = np.array([r.tobytes() for r in rows], object), batch["id"].to_numpy()
            dealt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for g, needed in needed_by(rows):
                at = (dealt[needed] % np.uint64(parts[g])).astype(np.int32)
                yield pd.DataFrame({"grp": np.int32(g), "part": at, "id": ids[needed], "x": blobs[needed]})

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, qs in zip(batch["grp"], batch["qs"]):
                for at in range(parts[g]):
                    yield pd.DataFrame({"grp": np.int32(g), "part": np.int32(at), "qs": [qs]})

    sent = data.mapInPandas(replicate, "grp int, part int, id long, x binary")
    asked = packed.mapInPandas(copied, "grp int, part int, qs array<struct<id:bigint,q:binary>>")

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        right = right.sort_values("id")
        ids = right["id"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(right["x"]), np.int64).reshape(-1, dim)
        found = []
        for block in left["qs"]:
            own = np.array([r["id"] for r in block], np.int64)
            q = np.frombuffer(b"".join(bytes(r["q"]) for r in block), np.int64).reshape(-1, dim)
            largest = float(np.abs(q).max(initial=1)) * float(np.abs(x).max(initial=1)) * dim
            score = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if largest < 2**53 else q @ x.T
            score[own[:, None] == ids[None, :]] = NONE
            least = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            i, j = np.nonzero((score >= least[:, None]) & (score > NONE))  # the best of each query, and what ties with the last of them
            order = np.lexsort((j, -score[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append(pd.DataFrame({"query_id": own[i[first]], "id": ids[j[first]], "score": score[i[first], j[first]]}))
        return pd.concat(found)

    local = asked.groupBy("grp", "part").cogroup(sent.groupBy("grp", "part")).applyInPandas(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
