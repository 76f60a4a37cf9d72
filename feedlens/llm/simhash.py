"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are cut into tiles of equal population count. A tile pair is compared only if the counts differ by at
most the radius (two words at Hamming distance d differ by at most d in population count); inside a pair the same
test on the low halves narrows the ranges that numpy compares by exclusive-or and bit counts. Each pair gives back a
spanning forest of its links, never all of them, so a large group of near copies costs one row a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from feedlens.llm.common import SMALL, byte_words, lookup, shingle_bounds, stored
from feedlens.llm.components import components, forest
from feedlens.llm.substrings import mixed
from feedlens.llm.substrings import shingle_hashes as rolling_hashes

LOW_HALF = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    joined, starts, ends = shingle_bounds(byte_words(text), words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash as a signed long; a bit is 1 if set in over half the shingle hashes, repeats included. No words: 0."""
    return print_of(shingle_hashes(text, words, seed))


def print_of(hashes: np.ndarray) -> int:
    return prints_of(hashes[:, None])[0]


def prints_of(hashes: np.ndarray) -> list[int]:
    """The SimHash of each column of hashes, as a signed long; 0 without rows."""
    n, columns = hashes.shape
    if not n:
        return [0] * columns
    of_bytes, ones = np.ascontiguousarray(hashes).view(np.uint8).reshape(n, 8 * columns), np.zeros(64 * columns, np.int64)
    for at in range(0, n, 255):  # sums of 255 bits fit a byte
        ones += np.unpackbits(of_bytes[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) for each row of docs."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("fp"))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes into a and b, and distances, of all pairs within the radius. b is sorted by its low half's bit count."""
    low_a, low_b = np.bitwise_count(a & LOW_HALF).astype(int), np.bitwise_count(b & LOW_HALF).astype(int)
    for at in range(0, len(a), block):
        part = a[at : at + block]
        lo = np.searchsorted(low_b, low_a[at : at + block].min() - radius, "left")
        hi = np.searchsorted(low_b, low_a[at : at + block].max() + radius, "right")
        if lo < hi:
            apart = np.bitwise_count(part[:, None] ^ b[None, lo:hi])
            i, j = np.nonzero(apart <= radius)
            yield i + at, j + lo, apart[i, j]


def by_low_half(values: np.ndarray) -> np.ndarray:
    return values[np.argsort(np.bitwise_count(values & LOW_HALF), kind="stable")]


def _tiles(fps: DataFrame, tile: int) -> DataFrame:
    """(pc, part, n_parts, fps array): tiles of about `tile` fingerprints of one population count."""
    counts = {r["pc"]: r["n"] for r in fps.groupBy(F.bit_count("fp").alias("pc")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    parts = F.array(*[F.lit(max(1, -(-counts.get(pc, 0) // tile))) for pc in range(65)])
    tiles = (
        fps.select("fp", F.bit_count("fp").alias("pc"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.element_at(parts, F.col("pc") + 1).cast("long")).cast("int"))
        .groupBy("pc", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )
    return tiles, counts, parts


def tile_pairs(fps: DataFrame, radius: int, tile: int = 2048) -> DataFrame:
    """(a array, b array or null): every pair of tiles whose population counts differ by the radius at most, once each.

    b is null where a tile meets itself. fps has distinct fingerprints in column fp.
    """
    tiles, counts, parts = _tiles(fps, tile)
    tiles = stored(tiles)
    mine = F.struct(F.col("pc"), F.col("part"))
    others = F.flatten(
        F.transform(
            F.sequence(F.col("pc"), F.least(F.col("pc") + radius, F.lit(64))),
            lambda pc: F.transform(
                F.sequence(F.lit(0), F.element_at(parts, pc + 1) - 1), lambda part: F.struct(pc.alias("pc"), part.alias("part"))
            ),
        )
    )
    lower = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.col("pc") - radius, F.lit(0)), F.col("pc")),
            lambda pc: F.transform(
                F.sequence(F.lit(0), F.element_at(parts, pc + 1) - 1), lambda part: F.struct(pc.alias("pc"), part.alias("part"))
            ),
        )
    )
    left = tiles.select(mine.alias("k"), F.col("fps").alias("a"), F.explode(others).alias("o")).where("o > k")
    right = tiles.select(mine.alias("o"), F.col("fps").alias("b"), F.explode(lower).alias("k")).where("o > k")
    own = tiles.select(F.col("fps").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    return left.join(right, ["k", "o"]).select("a", "b").union(own)


def links(fps: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b) longs: for each tile pair a spanning forest of the links within the radius."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                a = by_low_half(np.asarray(a).astype(np.int64).view(np.uint64))
                own = b is None
                b = a if own else by_low_half(np.asarray(b).astype(np.int64).view(np.uint64))
                found = [(i, j) for i, j, _ in close_pairs(a, b, radius)]
                if not found:
                    continue
                i, j = (np.concatenate(x) for x in zip(*found))
                if own:
                    i, j = i[i < j], j[i < j]
                nodes = a if own else np.concatenate([a, b])
                root = forest(len(nodes), i, j if own else j + len(a))
                linked = np.flatnonzero(root != np.arange(len(nodes)))
                yield pd.DataFrame({"a": nodes[linked].view(np.int64), "b": nodes[root[linked]].view(np.int64)})

    return tile_pairs(fps, radius, tile).mapInPandas(solve, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, tile: int = 2048, seed: int = 42
) -> DataFrame:
    """(id, fingerprint hex string, component_id): documents whose fingerprints are within the radius are linked.

    component_id is the least id that can be reached, the document's own included. Null and empty texts, and texts of
    blanks, have fingerprint zero and are linked like any other. Repeated rows give repeated rows. A row with a null id
    takes part, but never names a component unless all its members have null ids (then null). Other columns of docs
    are not read. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words, seed))
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = stored(components(links(distinct.select("fp"), radius, tile))).withColumnRenamed("node", "fp")
    named = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stored(lookup(named.select("fp", "root"), least, "root").select("fp", "component_id"))
    return lookup(prints, named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def spanning_pairs(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a spanning forest of the links i-j between nodes 0..n-1, the closest links first."""
    root, chosen_i, chosen_j = np.arange(n), [], []
    for distance in np.unique(apart):
        at = apart == distance
        a, b = i[at], j[at]
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            open_ = low != high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            if not len(a):
                break
            hooked, first = np.unique(high, return_index=True)  # each component hooks onto a lower one: no cycles
            chosen_i.append(a[first]), chosen_j.append(b[first])
            root[hooked] = low[first]
            while not np.array_equal(root, again := root[root]):
                root = again
    none = np.empty(0, np.int64)
    return np.concatenate([none, *chosen_i]), np.concatenate([none, *chosen_j])


#: Fingerprints of near_copies: four of 64 bits. Sets at a Jaccard similarity of 0.8 differ in 9.7 bits of 64 and 38.8 of 256
#: on average, with deviations of 2.9 and 5.7; independent ones in 32 and 128, with deviations of 4 and 8.
PRINTS, FIRST_RADIUS, RADIUS = 4, 22, 64
NUMBERS = ["node", "n", "label", *(f"f{k}" for k in range(PRINTS))]


SALTS = mixed(np.arange(1, PRINTS + 1, dtype=np.uint64))


def wide_print(shingles: np.ndarray) -> list[int]:
    """PRINTS SimHashes of 64 bits of a set of shingle hashes, as signed longs."""
    return prints_of(mixed(shingles[:, None] ^ SALTS))


def _profile(rows: DataFrame, words: int) -> DataFrame:
    """(id, node, n, f0, ...): the number of distinct shingles and the fingerprints of each row's text."""

    @pandas_udf("n long, " + ", ".join(f"f{k} long" for k in range(PRINTS)))
    def of(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            own = byte_words(text)
            distinct = shingle_set(own, words) if own else np.empty(0, np.uint64)
            found.append((len(distinct), *wide_print(distinct)))
        return pd.DataFrame(found, columns=["n", *(f"f{k}" for k in range(PRINTS))]).astype("int64")

    return rows.select("id", "node", of("text").alias("p")).select("id", "node", "p.*")


def _sized_pairs(texts: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Pairs of tiles whose numbers of shingles can have the similarity: lists of texts' columns of a, and of b or null."""
    columns, step = texts.columns, float(-np.log(similarity))
    bucket = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / step).cast("int")
    sized = texts.withColumn("bucket", bucket)
    counts = {r["bucket"]: r["c"] for r in sized.groupBy("bucket").agg(F.count("*").alias("c")).collect()}  # one row for each step of the logarithm
    parts = F.array(*[F.lit(max(1, -(-counts.get(k, 0) // tile))) for k in range(max(counts, default=0) + 2)])
    tiles = sized.withColumn("part", F.pmod(F.xxhash64("node"), F.element_at(parts, F.col("bucket") + 1).cast("long")).cast("int"))
    tiles = stored(tiles.groupBy("bucket", "part").agg(*[F.collect_list(c).alias(f"{c}_a") for c in columns]))
    mine = F.struct("bucket", "part")
    near = lambda lo, hi: F.flatten(
        F.transform(
            F.sequence(lo, hi),
            lambda k: F.transform(F.sequence(F.lit(0), F.element_at(parts, k + 1) - 1), lambda p: F.struct(k.alias("bucket"), p.alias("part"))),
        )
    )
    left = tiles.select("*", mine.alias("k"), F.explode(near(F.col("bucket"), F.col("bucket") + 1)).alias("o")).where("o > k")
    right = tiles.select(
        *[F.col(f"{c}_a").alias(f"{c}_b") for c in columns], mine.alias("o"),
        F.explode(near(F.greatest(F.col("bucket") - 1, F.lit(0)), F.col("bucket"))).alias("k"),
    ).where("o > k")
    names = [f"{c}_{s}" for s in "ab" for c in columns]
    own = tiles.select(*names[: len(columns)], *[F.lit(None).cast(tiles.schema[f"{c}_a"].dataType).alias(f"{c}_b") for c in columns])
    return left.join(right, ["k", "o"]).select(*names).union(own)


def _near_in_tiles(row: tuple, width: int, similarity: float):
    """(columns of a, columns of b, i, j, bits apart, whether a is b) of the pairs with different labels in a pair of tiles.

    The columns are NUMBERS, and the sets where width is one more. Pairs within FIRST_RADIUS in the first fingerprint are
    compared in all of them.
    """
    own, k = row[width] is None, len(NUMBERS)
    side = lambda at: [np.asarray(x, np.int64) if c < k else np.array(x, object) for c, x in enumerate(row[at : at + width])]

    def ordered(columns: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(np.bitwise_count(columns[3].view(np.uint64) & LOW_HALF), kind="stable")
        return [c[order] for c in columns]

    a = ordered(side(0))
    b = a if own else ordered(side(width))
    none = np.empty(0, np.int64)
    kept = [(none, none, none)]
    for i, j, apart in close_pairs(a[3].view(np.uint64), b[3].view(np.uint64), FIRST_RADIUS):
        n, m = a[1][i], b[1][j]
        ok = (np.minimum(n, m) >= similarity * np.maximum(n, m)) & (a[2][i] != b[2][j])
        ok &= (i < j) if own else True
        i, j, apart = i[ok], j[ok], apart[ok].astype(np.int64)
        for f in range(4, k):
            apart += np.bitwise_count((a[f][i] ^ b[f][j]).view(np.uint64))
        ok = apart <= RADIUS
        kept.append((i[ok], j[ok], apart[ok]))
    i, j, apart = (np.concatenate(x) for x in zip(*kept))
    return a, b, i, j, apart, own


def _forest_rows(a: list, b: list, i: np.ndarray, j: np.ndarray, apart: np.ndarray, own: bool) -> pd.DataFrame:
    nodes = a[0] if own else np.concatenate([a[0], b[0]])
    i, j = spanning_pairs(len(nodes), i, j if own else j + len(a[0]), apart)
    return pd.DataFrame({"a": nodes[i], "b": nodes[j]})


def _candidates(texts: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(a, b) nodes: of the texts with different labels within the radius, a spanning forest for each pair of tiles."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield _forest_rows(*_near_in_tiles(row, len(NUMBERS), similarity))

    return _sized_pairs(texts.select(*NUMBERS), similarity, tile).mapInPandas(solve, "a long, b long")


def overlaps(one: list[bytes], many: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of each packed set of `one` with each of `many`."""
    sets = [np.frombuffer(x, np.uint64) for x in (*one, *many)]
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(at, np.cumsum([len(x) for x in sets])[:-1])
    other = np.concatenate(parts[len(one) :])
    begins = np.cumsum([0] + [len(x) for x in parts[len(one) : -1]])
    out, mark = np.empty((len(one), len(many)), np.int64), np.zeros(len(names), np.int64)
    for n, own in enumerate(parts[: len(one)]):
        mark[own] = 1
        out[n] = np.add.reduceat(mark[other], begins)
        mark[own] = 0
    return out


def _dealt(texts: DataFrame, tile: int, tile_bytes: int = 1 << 22) -> DataFrame:
    """texts with the number of tiles of its family, and its own: one tile, more if the family has more than `tile` texts
    or tile_bytes of sets."""
    sizes = stored(
        texts.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") * 8 / tile_bytes), F.lit(1)).cast("int").alias("parts"))
    )
    return lookup(texts, sizes, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))


def _verified_in_tiles(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) nodes: of the texts of one family with different labels within the radius whose shingle sets have the
    similarity, a spanning forest for each pair of tiles. No pair leaves its task before it is verified.

    texts: NUMBERS, set (packed shingle hashes), family, and part of so many parts. Most families have one part,
    so most sets move once; the parts of a large one go to as many tasks.
    """
    columns = [*NUMBERS, "set"]
    width = len(columns)
    tiles = stored(texts.repartition("family", "part").groupBy("family", "part", "parts").agg(*[F.collect_list(c).alias(f"{c}_a") for c in columns]))
    several = tiles.where("parts > 1")
    left = several.where("part < parts - 1").select("family", F.col("part").alias("k"), F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("o"), *[f"{c}_a" for c in columns])
    right = several.where("part > 0").select("family", F.col("part").alias("o"), F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("k"), *[F.col(f"{c}_a").alias(f"{c}_b") for c in columns])
    names = [f"{c}_{s}" for s in "ab" for c in columns]
    own = tiles.select(*names[:width], *[F.lit(None).cast(tiles.schema[f"{c}_a"].dataType).alias(f"{c}_b") for c in columns])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                a, b, i, j, apart, own = _near_in_tiles(row, width, similarity)
                if not len(i):
                    continue
                rows, cols = np.unique(i), np.unique(j)
                both = overlaps([a[-1][x] for x in rows], [b[-1][x] for x in cols])[np.searchsorted(rows, i), np.searchsorted(cols, j)]
                size = lambda side, at: np.array([len(x) // 8 for x in side[-1]])[at]
                ok = both >= similarity * (size(a, i) + size(b, j) - both)
                if ok.any():
                    found.append(_forest_rows(a, b, i[ok], j[ok], apart[ok], own))
            if found:
                yield pd.concat(found)

    pairs = left.join(right, ["family", "k", "o"]).select(*names)
    return pairs.union(own).mapInPandas(solve, "a long, b long")


def jaccard(one: str | None, two: str | None, words: int) -> float:
    x, y = (shingle_set(byte_words(t), words) for t in (one, two))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def shingle_set(own: list[bytes], words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer words the hash of them all."""
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(own), 3)], np.uint64)
    return np.unique(rolling_hashes(own, words))


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node, id), each once; where those are few, no other text is shuffled."""
    asked = F.broadcast(nodes) if nodes.count() <= SMALL else nodes
    return rows.join(asked, ["id", "node"]).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, words_of: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts' shingle sets have that Jaccard similarity."""

    @pandas_udf("boolean")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, words) >= similarity for x, y in zip(one, two)])

    with_a = pairs.join(words_of.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(words_of.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.where(alike("ta", "tb")).select("a", "b")


#: Sets of at most so many shingles are linked exactly: beside them, few bits stand for a shingle, and radii lose links.
SMALL_SET = 11


def small_links(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of the texts (node, text) of at most SMALL_SET shingles: links that join just those with the similarity.

    Sets of similarity s are what is left of both after each lost a few elements, at most the (1 - s)th part. So each set is filed
    under what is left of it by each such loss. Of the sets with the same rest that with the fewest others leads; if two of them are
    similar by their common rest, both are similar to it.
    """

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, text in zip(batch["node"], batch["text"]):
                own = shingle_set(byte_words(text), words)
                if not byte_words(text) or len(own) > SMALL_SET:
                    continue
                whole = mixed(own).sum(dtype=np.uint64)
                for lost in range(len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1):
                    for some in combinations(mixed(own).tolist(), lost):
                        out.append((int(whole) - sum(some), len(own) - lost, node, lost))
            keys, rest, nodes, lost = (np.array(x, object) for x in zip(*out)) if out else ([],) * 4
            keys = np.array([k % (1 << 64) for k in keys], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": keys, "rest": np.array(rest, np.int64), "node": np.array(nodes, np.int64), "lost": np.array(lost, np.int64)})

    rows = stored(texts.select("node", "text").mapInPandas(filed, "key long, rest long, node long, lost long"))
    leads = rows.groupBy("key", "rest").agg(F.min(F.struct("lost", "node")).alias("lead"), F.count("*").alias("m")).where("m > 1").select(F.struct("key", "rest").alias("of"), "lead")
    met = lookup(rows.withColumn("of", F.struct("key", "rest")), stored(leads), "of").where("node <> lead.node")
    return met.where(F.col("rest") >= similarity * (F.col("rest") + F.col("lost") + F.col("lead.lost")) - 1e-9).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tile: int = 2048, family_tile: int = 256,
) -> DataFrame:
    """(id, text_hash, component_id, first): groups of texts whose word shingles have a Jaccard similarity of at least `similarity`.

    Equal texts are one node, named by text_hash (xxhash64, a null text counting as empty); component_id is the smallest id
    of the group, and first says whether the row's id, then text_hash, is the group's least. Texts without words are alike.
    Rows that share an id are told apart by their texts; repeated rows are repeated; rows with a null id are left out;
    other columns aren't read; an empty table gives no rows.

    Candidates lie within a quarter of the 256 bits of four fingerprints of the distinct shingles (and 22 of the first 64) and
    have numbers of shingles that allow the similarity. Sets of more than SMALL_SET shingles at a similarity of just 0.8 differ in more with a
    probability of 0.00002, of 12 to 60 shingles 0.0002 at most, more similar ones more seldom, and independent ones in no more with one of 1e-15, so few links
    get lost and chance ones don't grow with the corpus. Sets of at most SMALL_SET shingles are linked exactly (small_links). All other links are verified on the shingles themselves: first each pair of tiles gives a
    spanning forest of its candidates, closest first. Texts that then have candidates in another group are compared
    again, all of these candidates, with their shingle sets, family by family; no list of all pairs is ever written.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"),
    )
    profile = stored(_profile(rows, words))
    numbers = [c for c in NUMBERS if c not in ("node", "label")]
    texts = stored(profile.groupBy("node").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in numbers]))
    named = texts.select("node", "id")

    def among(found: DataFrame, *columns: str) -> DataFrame:
        nodes = found.select(F.col(columns[0]).alias("node"))
        for c in columns[1:]:
            nodes = nodes.union(found.select(c))
        return _texts_of(rows, stored(named.join(nodes.distinct(), "node", "left_semi")))

    pairs = stored(_candidates(texts.withColumn("label", F.col("node")), similarity, tile).distinct())
    tiny = stored(named.join(texts.where(F.col("n") <= SMALL_SET).select("node"), "node", "left_semi"))
    links_ = stored(_verified(pairs, among(pairs, "a", "b"), words, similarity).union(small_links(_texts_of(rows, tiny), words, similarity)))
    groups = stored(components(links_))
    labelled = stored(texts.join(groups, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    # Texts whose candidates belong to other groups, by family: the candidates of a text are all in its family.
    families = stored(components(_candidates(labelled, similarity, tile))).withColumnRenamed("root", "family")

    @pandas_udf("binary")
    def packed(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(byte_words(t), words).tobytes() for t in batch], dtype=object)

    members = stored(labelled.select(*NUMBERS).join(families, "node"))
    if members.limit(1).count():
        dealt = stored(_dealt(members, family_tile))
        sets = dealt.join(among(dealt, "node"), "node").select(*dealt.columns, packed("text").alias("set"))
        rest = stored(_verified_in_tiles(sets, similarity))
        if rest.limit(1).count():
            groups = stored(components(links_.union(rest)))
    grouped = stored(texts.join(groups, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")))
    least = stored(grouped.groupBy("root").agg(F.min(F.struct("id", "node")).alias("least")).select("root", F.col("least.id").alias("component_id"), F.col("least.node").alias("first_node")))
    of_node = stored(lookup(grouped.select("node", "root"), least, "root"))
    found = lookup(profile.select("id", "node"), of_node.select("node", "component_id", "first_node"), "node")
    return found.select(
        F.col("id").alias(id_col), F.col("node").alias("text_hash"), "component_id", ((F.col("id") == F.col("component_id")) & (F.col("node") == F.col("first_node"))).alias("first"),
    )
