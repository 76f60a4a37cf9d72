"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles has a signature of CHUNKS * WIDTH symbols, each the b lowest of a min-hash's middle bits (b = 16);
two sets of similarity s differ in a symbol with a probability of 1 - s, independently. The signature is split into chunks. By the
pigeonhole principle two signatures within CHUNKS * (ERRORS + 1) - 1 symbols of each other have a chunk within ERRORS of
theirs, so each text files itself under every chunk with each choice of ERRORS symbols left open: all such pairs meet
under one key. Pairs further apart meet as well unless every chunk has more errors; at a similarity of just 0.85 that has a
probability of 9.5e-7 (0.283 to the 11th), and less above it.

A key's texts aren't compared with each other. The first leads, every text is verified against the closest of its leaders,
and what is linked counts as one from then on. Only keys whose texts then belong to different groups are left. Texts that such
keys join are a family; families are compared in tiles, group against group, by signature and then by the whole sets, and
give back spanning forests. No list of pairs of one group is ever made, and no link between different groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from feedlens.llm.common import SMALL, byte_words, lookup, small_batches, stored
from feedlens.llm.components import components, forest
from feedlens.llm.simhash import overlaps, shingle_set
from feedlens.llm.substrings import mixed

CHUNKS, WIDTH, ERRORS = 11, 7, 1
SYMBOLS = CHUNKS * WIDTH
SALTS = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) << np.uint64(32))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Signatures further apart than this aren't verified; sets at a similarity of 0.85 are with a probability of 1e-8.
FAR = 30
#: Which symbols of a chunk a key leaves open.
OPEN = list(combinations(range(WIDTH), ERRORS))


def signature(shingles: np.ndarray, block: int = 512) -> bytes:
    """SYMBOLS min-hashes of a set of shingle hashes, 16 bits each, packed."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        x = shingles[at : at + block, None] ^ SALTS
        x *= _M1
        x ^= x >> np.uint64(32)
        x *= _M2
        np.minimum(least, x.min(axis=0), out=least)
    return (least >> np.uint64(24)).astype(np.uint16).tobytes()


def symbols(packed: pd.Series | list) -> np.ndarray:
    """Signatures as rows of numbers."""
    return np.frombuffer(b"".join(packed), np.uint16).reshape(len(packed), SYMBOLS)


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """The keys of each signature: a hash of each chunk without each choice of open symbols."""
    terms = mixed((sigs.astype(np.uint64) << np.uint64(8)) ^ SALTS).reshape(len(sigs), CHUNKS, WIDTH)
    whole = terms.sum(axis=2, dtype=np.uint64)
    names = mixed(np.arange(CHUNKS * len(OPEN), dtype=np.uint64) ^ _M2).reshape(CHUNKS, len(OPEN))
    keys = np.stack([whole - terms[:, :, list(o)].sum(axis=2, dtype=np.uint64) for o in OPEN], axis=2)
    return mixed(keys ^ names).reshape(len(sigs), CHUNKS * len(OPEN))


def alike(both: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m that share `both` have at least that Jaccard similarity, in whole numbers."""
    return 100 * both >= percent * (n + m - both)


def _profile(rows: DataFrame, words: int) -> DataFrame:
    """(id, node, n, sig): the number of distinct shingles and the signature of each row's text; no words: 0 and null."""

    @pandas_udf("n long, sig binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            own = byte_words(text)
            shingles = shingle_set(own, words) if own else ()
            found.append((len(shingles), signature(shingles) if own else None))
        return pd.DataFrame(found, columns=["n", "sig"])

    return rows.select("id", "node", of("text").alias("p")).select("id", "node", "p.*")


def _filed(nodes: DataFrame) -> DataFrame:
    """(key, node): every node under all its keys."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                keys = chunk_keys(symbols(part["sig"].tolist()))
                yield pd.DataFrame({"key": keys.reshape(-1).view(np.int64), "node": np.repeat(part["node"].to_numpy(), keys.shape[1])})

    return nodes.select("node", "sig").mapInPandas(solve, "key long, node long")


def _meetings(nodes: DataFrame) -> DataFrame:
    """(key, node, lead): the nodes of every key that has several, with the least of them. Keys of very many are looked up by broadcast."""
    filed = stored(_filed(nodes))
    shared = stored(filed.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("m")).where("lead < last"))
    bound = max(64, filed.count() // 4096)  # so 4096 keys at most are above it
    heavy, light = shared.where(F.col("m") > bound).select("key", "lead"), shared.where(F.col("m") <= bound).select("key", "lead")
    return filed.join(F.broadcast(heavy), "key").union(filed.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key"))


def _closest(meetings: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node b with the closest of its leaders a, where its signature and size allow the similarity."""

    @pandas_udf("int")
    def apart(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series((symbols(one.tolist()) != symbols(two.tolist())).sum(axis=1), dtype="int32") if len(one) else pd.Series([], dtype="int32")

    pairs = stored(meetings.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    with_a = stored(lookup(pairs, nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a"))
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    near = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", apart("sa", "sb").alias("apart")).where(F.col("apart") <= FAR)
    return near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""

    @pandas_udf("boolean")
    def same(one: pd.Series, two: pd.Series) -> pd.Series:
        held, out = (None, None), []
        for x, y in zip(one, two):
            if x is not held[0]:
                held = x, shingle_set(byte_words(x), words)
            other = shingle_set(byte_words(y), words)
            both = len(np.intersect1d(held[1], other, assume_unique=True))
            out.append(bool(alike(both, len(held[1]), len(other), percent)))
        return pd.Series(out, dtype="bool")

    with_a = lookup(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").where(same("ta", "tb")).select("a", "b")


TILE = ["family", "wide", "own", "part"]


def _tiled(members: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """members (node, n, label, family, ...) with the tile each belongs to, of about `tile` texts or tile_bytes of sets.

    A label that fills a tile has tiles of its own (wide), whose texts needn't be compared with each other; the other labels of a family share theirs.
    """
    sizes = members.groupBy("family", "label").agg(F.count("*").alias("m"), (F.sum("n") * 8).alias("bytes"))
    wide = (F.col("m") > tile) | (F.col("bytes") > tile_bytes)
    sizes = stored(sizes.select("family", "label", "m", "bytes", wide.alias("wide"), F.when(wide, F.col("label")).otherwise(F.col("family")).alias("own")))
    parts = sizes.groupBy("family", "wide", "own").agg(F.greatest(F.ceil(F.sum("m") / tile), F.ceil(F.sum("bytes") / tile_bytes)).cast("int").alias("parts"))
    sizes = stored(sizes.join(parts, ["family", "wide", "own"]).select(F.struct("family", "label").alias("of"), "wide", "own", "parts"))
    dealt = lookup(members.withColumn("of", F.struct("family", "label")), sizes, "of").drop("of")
    return dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")).drop("parts")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): of the texts of one family with different labels whose sets have the similarity, a spanning forest for each pair of tiles.

    members: node, n, label, sig, set (packed shingle hashes) and the columns of TILE. Tiles of one wide label don't meet.
    """
    columns = ["node", "n", "label", "sig", "set"]
    tiles = stored(members.groupBy(*TILE).agg(*[F.collect_list(c).alias(c) for c in columns]))
    key = F.struct(*TILE[1:])
    names = tiles.select("family", key.alias("k"))
    own = names.where("not k.wide").select("family", "k", F.col("k").alias("o"))
    met = names.join(names.withColumnRenamed("k", "o"), "family").where("k < o and not (k.wide and o.wide and k.own = o.own)")
    left = tiles.select("family", key.alias("k"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = tiles.select("family", key.alias("o"), *[F.col(c).alias(f"{c}_b") for c in columns])
    pairs = own.union(met).join(left, ["family", "k"]).join(right, ["family", "o"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                (na, ca, la, ga, sa), (nb, cb, lb, gb, sb) = row[:5], row[5:]
                ga, gb = symbols(ga), symbols(gb)
                close = np.zeros((len(na), len(nb)), bool)
                for x in range(len(na)):
                    close[x] = np.count_nonzero(ga[x] != gb, axis=1) <= FAR
                close &= np.asarray(la)[:, None] != np.asarray(lb)[None, :]
                rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if not len(rows):
                    continue
                both = overlaps([sa[x] for x in rows], [sb[x] for x in cols])
                ok = close[np.ix_(rows, cols)] & alike(both, np.asarray(ca)[rows, None], np.asarray(cb)[None, cols], percent)
                i, j = np.nonzero(ok)
                nodes, at = np.unique(np.concatenate([np.asarray(na)[rows[i]], np.asarray(nb)[cols[j]]]), return_inverse=True)
                root = forest(len(nodes), at[: len(i)], at[len(i) :])
                linked = np.flatnonzero(root != np.arange(len(nodes)))
                yield pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})

    return pairs.select(*[f"{c}_{s}" for s in "ab" for c in columns]).mapInPandas(solve, "a long, b long")


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, tile: int = 256, tile_bytes: int = 1 << 22,
) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents whose sets of word shingles have a Jaccard similarity of at least percent / 100 are linked.

    A-Z are lower-cased; a text of fewer than `words` words is one shingle; one without words (null, empty, blanks) has an empty set,
    and is linked with nothing, its own component. component_id is the least id that can be reached, the document's own
    included, and kept says that it is the document's own. Equal texts are worked on once; repeated rows give repeated rows, and rows that
    share an id differ by their texts. A row with a null id takes part but never names a component unless all its members have null
    ids; that one is null, and its rows are kept. Other columns of docs aren't read. An empty table gives no rows.

    Similarities below 0.85 are found with less certainty (the module says how much less): a set at 0.8 from another meets it with a
    probability of 0.9999.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("node"))
    profile = stored(_profile(rows, words))
    nodes = stored(profile.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    def among(asked: DataFrame) -> DataFrame:
        """(node, text) of the asked nodes, from the rows with their least ids; where those are few, no other text is shuffled."""
        wanted = stored(nodes.join(asked.distinct(), "node", "left_semi").select(F.col("node").alias("of"), F.col("id").alias("least")))
        wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
        return rows.join(wanted, (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"])

    meetings = stored(_meetings(nodes))
    pairs = stored(_closest(meetings, nodes, percent))
    links = stored(_linked(pairs, among(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), words, percent))
    groups = stored(components(links))

    # Keys whose texts belong to different groups; all they join, directly or not, is a family.
    label = F.coalesce("root", "node").alias("label")
    named = stored(meetings.join(groups, "node", "left").select("key", "node", "lead", label))
    open_keys = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    stars = stored(named.join(open_keys, "key", "left_semi").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    families = stored(components(stars)).withColumnRenamed("root", "family")
    members = stored(nodes.join(families, "node").join(groups, "node", "left").select("node", "n", "sig", "family", label))

    @pandas_udf("binary")
    def packed(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(byte_words(t), words).tobytes() for t in batch], dtype=object)

    if members.limit(1).count():
        dealt = stored(_tiled(members, tile, tile_bytes))
        sets = dealt.join(among(dealt.select("node")), "node").select(*dealt.columns, packed("text").alias("set"))
        rest = stored(_across(sets, percent))
        if rest.limit(1).count():
            groups = stored(components(links.union(rest)))
    grouped = stored(nodes.join(groups, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root")))
    least = stored(grouped.groupBy("root").agg(F.min("id").alias("component_id")))
    of_node = stored(lookup(grouped.select("node", "root"), least, "root").select("node", "component_id"))
    full = lookup(profile.where("n > 0").select("id", "node", "n"), of_node, "node").select("id", "n", "component_id")
    found = full.union(profile.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
