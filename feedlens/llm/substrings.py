"""Near-duplicate passages by compact windows.

A document is the sequence of its five-word shingles. Under a hash function the Cartesian tree of the sequence's hashes
has a node (l, c, r) for every set of subsequences [i, j], l <= i <= c <= j <= r, whose min-hash is the one at c. Each
node thus groups a run of the windows of `seed` shingles; the runs of two functions are joined as intervals, and the
windows of a joined run share their signature: both min-hashes and the distance between their places. Two passages that
are near-duplicates hold an exact run of `seed` shingles (seed_places says how long it is), whose windows have equal
signatures wherever they are.

Of the places with one signature the first (least document, then least place) leads, and each other place is compared
with it: intervals of a document pair that meet are joined, and verified on the words. A leader may have a signature but
not the passage. So places that stay unfound are grouped again by two and by four signatures in a row, under new leaders,
and what may be an exact repeat is searched by the hashes of whole passages (left_over, exact_repeats). What is found depends
neither on partitions nor on batches.

Places of one signature in one chunk of text meet there; the first of them alone goes to the signature's task, so a
passage that a third of all documents share costs that task a row a chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import SMALL, WORD, byte_words, heavy_keys, one_text, shingle_bounds, stored

WORDS = re.compile(WORD)

SHINGLE = 5
_MUL = 0x100000001B3 | 1
_INV = np.uint64(pow(_MUL, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A run of windows in one long: first window, number of further windows, places from the first window to its pivot.
RUN_BITS = 10
RUN_MOST = (1 << RUN_BITS) - 1
PLACES = "k long, doc long, at long, bdoc long, bat long, several boolean"
INTERVALS = "doc long, s long, e long, rdoc long, rs long, re long"
FOUND = "doc long, start int, end int, rdoc long, rstart int, rend int, jaccard double, text_hash long"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, position by position."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def of_function(hashes: np.ndarray, f: int) -> np.ndarray:
    return mixed(hashes ^ np.uint64((f + 1) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of `size` words; none for fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    joined, starts, ends = shingle_bounds(words, size)
    data = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _MUL, np.uint64)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INV, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * powers[:-1], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def seed_places(least: int, similarity: float) -> int:
    """How many shingles in a row two near-duplicates of at least `least` shingles share exactly, whatever words were replaced.

    e replaced words leave n - 5e of n shingles shared in n + 5e, so the similarity bounds e; they part the words into
    e + 1 runs, and the longest is no shorter than the average. One place is left for words added or taken out.
    """
    found = least
    for e in range(1, least + 1):
        n = max(least, ceil(SHINGLE * e * (1 + similarity) / (1 - similarity) - 1e-9)) if similarity < 1 else 0
        if not n:
            break
        found = min(found, ceil((n + SHINGLE - 1 - e) / (e + 1)) - SHINGLE + 1 - 1)
    return max(2, min(found, RUN_MOST))


def pivots(keys: np.ndarray, least: int) -> np.ndarray:
    """For each window of `least` keys the smallest key."""
    out, width = keys, 1
    while width * 2 <= least:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (least - width)], out[least - width :]) if least > width else out


def compact_windows(hashes: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r), inclusive, of the Cartesian tree's nodes of at least `least` places, for documents laid end to end.

    doc: each place's document, whose places lie together. Of equal hashes the leftmost is the smaller one.
    """
    empty = np.empty(0, np.int64)
    if len(hashes) < least:
        return empty, empty, empty
    # The hash's upper bits with the place below them: minima come with their places.
    bits = np.uint64(max(1, int(len(hashes) - 1).bit_length()))
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    inside = doc[: len(doc) - least + 1] == doc[least - 1 :]
    least_of = pivots(keys, least)[inside]
    if not len(least_of):
        return empty, empty, empty
    found = least_of[np.flatnonzero(np.diff(least_of, prepend=least_of[0] ^ np.uint64(1)) != 0)]
    at = (found & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Nodes of that width have all their ancestors among them, so the nearest smaller place is one of them or the end.
    first = np.searchsorted(doc, doc[at], "left")
    last = np.searchsorted(doc, doc[at], "right") - 1
    left, right = first.copy(), last.copy()
    stack: list[int] = []
    owner, values, places = doc[at].tolist(), found.tolist(), at.tolist()
    for n, (d, value) in enumerate(zip(owner, values)):
        if stack and owner[stack[-1]] != d:
            stack = []
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = places[n] - 1
        if stack:
            left[n] = places[stack[-1]] + 1
        stack.append(n)
    return at, left, right


def signature_runs(hashes: np.ndarray, doc: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, first, last, pivot): runs of windows of `seed` places with the same compact window under both of two
    functions, for documents laid end to end. pivot is the first function's; equal windows have equal signatures."""
    sides = []
    for f in range(2):
        own = of_function(hashes, f)
        c, left, right = compact_windows(own, doc, seed)
        sides.append((own, c, np.maximum(left, c - seed + 1), np.minimum(c, right - seed + 1)))
    if not len(sides[0][1]):
        return (np.empty(0, np.int64),) * 4
    # Both functions' runs part the same windows, so every run of the join begins where one of them does.
    first = np.union1d(sides[0][2], sides[1][2])
    at = [np.searchsorted(s[2], first, "right") - 1 for s in sides]
    last = np.minimum(sides[0][3][at[0]], sides[1][3][at[1]])
    one, two = (s[1][n] for s, n in zip(sides, at))
    key = mixed(sides[0][0][one] ^ mixed(sides[1][0][two] + (two - one).astype(np.int64).view(np.uint64)))
    return key.view(np.int64), first, last, one


def chunk_places(k: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """PLACES: the first of the chunk's places with each key stands for it; the others name it in bdoc and bat."""
    order = np.lexsort((at, doc, k))
    k, doc, at = k[order], doc[order], at[order]
    starts = np.diff(k, prepend=k[:1] ^ 1) != 0
    begin = np.flatnonzero(starts)
    group = np.cumsum(starts) - 1
    first, last = begin[group], np.append(begin[1:], len(k))[group] - 1
    named = lambda x: pd.arrays.IntegerArray(x[first], starts)
    return pd.DataFrame({"k": k, "doc": doc, "at": at, "bdoc": named(doc), "bat": named(at), "several": doc[first] != doc[last]})


def led(places: DataFrame) -> DataFrame:
    """(k, doc, at, ldoc, lat) of the PLACES whose key two documents have; the leader is the key's least (doc, at)."""
    deal = F.when(F.col("bdoc").isNull(), F.col("k")).otherwise(F.xxhash64("k", "bdoc", "bat"))
    over = Window.partitionBy("__p", F.col("bdoc").isNull())
    rows = places.withColumn("__p", deal).withColumns({"lead": F.min(F.struct("doc", "at")).over(over), "high": F.max("doc").over(over)})
    rows = rows.where("bdoc is not null or several or lead.doc < high")
    kept = stored(rows.select("k", "doc", "at", "bdoc", "bat", F.col("lead.doc").alias("ldoc"), F.col("lead.at").alias("lat")))
    own, others = kept.where("bdoc is null"), kept.where("bdoc is not null").drop("ldoc", "lat")
    firsts = own.select("k", F.col("doc").alias("bdoc"), F.col("at").alias("bat"), "ldoc", "lat")
    columns = ["k", "doc", "at", "ldoc", "lat"]
    return own.select(*columns).union(others.join(firsts, ["k", "bdoc", "bat"]).select(*columns))


def _first(at: Column) -> Column:
    return F.shiftright(at, 2 * RUN_BITS)


def _more(at: Column) -> Column:
    return F.shiftright(at, RUN_BITS).bitwiseAND(RUN_MOST)


def _ahead(at: Column) -> Column:
    return at.bitwiseAND(RUN_MOST)


def signatures(texts: DataFrame, seed: int, chunk: int = 1 << 19) -> DataFrame:
    """PLACES of the signature runs of texts (id, text)."""

    def runs(ids: list[int], hashes: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(h) for h in hashes], np.int64)
        begin = np.cumsum(sizes) - sizes
        k, i, j, c = signature_runs(np.concatenate(hashes), np.repeat(np.arange(len(ids)), sizes), seed)
        d = np.searchsorted(begin, i, "right") - 1
        at = (i - begin[d]) << 2 * RUN_BITS | (j - i) << RUN_BITS | (c - i)
        return chunk_places(k, np.array(ids, np.int64)[d], at)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, hashes, held = [], [], 0
        for batch in batches:
            for row, text in zip(batch["id"], batch["text"]):
                own = shingle_hashes(byte_words(text))
                if len(own) >= seed:
                    ids.append(row), hashes.append(own)
                    held += len(own)
                if held >= chunk:
                    yield runs(ids, hashes)
                    ids, hashes, held = [], [], 0
        if ids:
            yield runs(ids, hashes)

    return texts.select("id", "text").mapInPandas(of, PLACES)


def joined_intervals(rows: pd.DataFrame, slack: int, gap: int) -> pd.DataFrame:
    """Intervals of each document pair that meet, or nearly so, at about the same shift, as one."""
    rows = rows.sort_values(["doc", "rdoc", "s", "e", "rs"], kind="stable")
    d, r, s, e, rs, re_ = (rows[x].to_numpy() for x in ("doc", "rdoc", "s", "e", "rs", "re"))
    apart = np.ones(len(d), bool)
    if len(d) > 1:
        same = (d[1:] == d[:-1]) & (r[1:] == r[:-1])
        shift = np.abs((s - rs)[1:] - (s - rs)[:-1]) <= slack
        # the furthest end so far in the pair
        pair = np.cumsum(np.concatenate([[True], ~same]))
        span = int(e.max()) + 2
        reach = np.maximum.accumulate(pair * span + e) - pair * span
        apart[1:] = ~(same & shift & (s[1:] <= reach[:-1] + gap))
    first = np.flatnonzero(apart)
    if not len(first):
        return rows.iloc[:0]
    return pd.DataFrame({"doc": d[first], "s": s[first], "e": np.maximum.reduceat(e, first), "rdoc": r[first], "rs": np.minimum.reduceat(rs, first), "re": np.maximum.reduceat(re_, first)})


def intervals(places: DataFrame, seed: int) -> DataFrame:
    """INTERVALS, in shingles, ends inclusive: where a document (doc) may repeat the leaders (rdoc) of its signatures."""
    begin, lbegin = -_ahead(F.col("at")), -_ahead(F.col("lat"))
    low, high = F.greatest(begin, lbegin), F.least(begin + _more(F.col("at")), lbegin + _more(F.col("lat")))
    pivot, lpivot = _first(F.col("at")) + _ahead(F.col("at")), _first(F.col("lat")) + _ahead(F.col("lat"))
    met = places.where("ldoc < doc").select("doc", pivot.alias("c"), F.col("ldoc").alias("rdoc"), lpivot.alias("rc"), low.alias("low"), high.alias("high")).where("low <= high")
    rows = met.select(
        "doc", (F.col("c") + F.col("low")).alias("s"), (F.col("c") + F.col("high") + seed - 1).alias("e"),
        "rdoc", (F.col("rc") + F.col("low")).alias("rs"), (F.col("rc") + F.col("high") + seed - 1).alias("re"),
    )

    def join_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch])
            last = batch["doc"].iloc[-1] if len(batch) else None
            rest = batch[batch["doc"] == last]
            yield joined_intervals(batch[batch["doc"] != last], 8, seed + 2 * SHINGLE)
        if rest is not None and len(rest):
            yield joined_intervals(rest, 8, seed + 2 * SHINGLE)

    return rows.repartition("doc").sortWithinPartitions("doc").mapInPandas(join_up, INTERVALS)


def partners(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether b has a's value, where): for each place of a the place of b with its value nearest to place + shift."""
    if not len(b):
        return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    values, rank = np.unique(b, return_inverse=True)
    mine = np.minimum(np.searchsorted(values, a), len(values) - 1)
    match = values[mine] == a
    n = len(b)
    held = np.sort(rank * n + np.arange(n))
    wish = np.clip(np.arange(len(a)) + shift, 0, n - 1)
    at = np.searchsorted(held, mine * n + wish)
    before, after = held[np.maximum(at - 1, 0)], held[np.minimum(at, n - 1)]
    near = lambda x: np.where(x // n == mine, np.abs(x % n - wish), n + 1)
    return match, np.where(near(before) <= near(after), before, after) % n


def similar_runs(a: np.ndarray, b: np.ndarray, least: int, similarity: float, shift: int = 0) -> Iterator[tuple[int, int, int, int, float]]:
    """(s, e, rs, re, Jaccard), ends exclusive, in shingles: runs of a that are near-duplicates of a run of b.

    Of places of b with one value that nearest to the shift counts. A run that is not similar is parted at its widest gap.
    """
    match, partner = partners(a, b, shift)
    todo = [np.flatnonzero(match)]
    while todo:
        places = todo.pop()
        if len(places) < similarity * least or places[-1] - places[0] + 1 < least:
            continue
        s, e = int(places[0]), int(places[-1]) + 1
        others = np.sort(partner[places])
        middle = int(others[len(others) // 2])
        near = others[np.abs(others - middle) <= 2 * (e - s)]
        rs, re_ = int(near[0]), int(near[-1]) + 1
        x, y = np.unique(a[s:e]), np.unique(b[rs:re_])
        both = len(np.intersect1d(x, y, assume_unique=True))
        jaccard = both / (len(x) + len(y) - both)
        if jaccard >= similarity:
            yield s, e, rs, re_, jaccard
            continue
        gaps = np.diff(places)
        steps = np.abs(np.diff(partner[places] - places))
        if gaps.max(initial=1) > 1:
            cut = int(gaps.argmax()) + 1
        elif steps.max(initial=0) > 0:
            cut = int(steps.argmax()) + 1
        else:
            continue
        todo += [places[:cut], places[cut:]]


def verified(pairs: DataFrame, texts: DataFrame, least: int, similarity: float, margin: int) -> DataFrame:
    """FOUND: the near-duplicates in the intervals and up to `margin` shingles around them. pairs is read several times.

    The words of the document's side are sliced where its text is, then compared where the leader's text is. Leaders of
    more than a 4096th of the pairs (so 4096 at most) are copied, and their pairs dealt out among the copies.
    """

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cache, out = (None, []), []
            for row, text, s, e in zip(batch["doc"], batch["text"], batch["s"], batch["e"]):
                if cache[0] != row:
                    cache = row, byte_words(text)
                out.append(b" ".join(cache[1][max(0, s - margin) : e + margin + SHINGLE]))
            batch = batch.drop(columns=["text"])
            batch["passage"] = out
            yield batch

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cache, out = (None, []), []
            for doc, s, rdoc, rs, re_, passage, text, named in zip(*(batch[c] for c in ("doc", "s", "rdoc", "rs", "re", "passage", "text", "text_hash"))):
                if cache[0] != rdoc:
                    cache = rdoc, byte_words(text)
                shift, s, rs = rs - s, max(0, s - margin), max(0, rs - margin)
                a = shingle_hashes(bytes(passage).split(b" "))
                b = shingle_hashes(cache[1][rs : re_ + margin + SHINGLE])
                for x, y, rx, ry, jaccard in similar_runs(a, b, least, similarity, shift + s - rs):
                    out.append((doc, s + x, s + y + SHINGLE - 1, rdoc, rs + rx, rs + ry + SHINGLE - 1, jaccard, named))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    def passages(some: DataFrame) -> DataFrame:
        return some.join(texts, F.col("doc") == F.col("id")).drop("id").mapInPandas(sliced, INTERVALS + ", text_hash long, passage binary")

    plain = texts.select("id", "text", "text_hash")
    heavy = heavy_keys(pairs, "rdoc", least=1024)
    if heavy is None:
        return passages(pairs).join(plain.drop("text_hash"), F.col("rdoc") == F.col("id")).drop("id").mapInPandas(compare, FOUND)
    light = passages(pairs.join(F.broadcast(heavy), "rdoc", "left_anti").select(*pairs.columns))
    light = light.join(plain.drop("text_hash"), F.col("rdoc") == F.col("id")).drop("id")
    parts = heavy.withColumn("parts", F.ceil(F.col("n") / 512).cast("int"))
    dealt = pairs.join(F.broadcast(parts), "rdoc").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts").cast("long")).cast("int")).select(*pairs.columns, "part")
    with_part = dealt.join(texts, F.col("doc") == F.col("id")).drop("id").mapInPandas(sliced, INTERVALS + ", part int, text_hash long, passage binary")
    copies = texts.drop("text_hash").join(F.broadcast(parts), F.col("id") == F.col("rdoc")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("rdoc", "part", "text")
    many = with_part.join(copies, ["rdoc", "part"]).select(*light.columns)
    return light.union(many).mapInPandas(compare, FOUND)


LEFT_OVER = "kind int, follows boolean, first long, last long, " + PLACES


def left_over(places: DataFrame, found: DataFrame, seed: int, least: int) -> DataFrame:
    """What the found passages leave, in one pass over the places: rows of two kinds.

    Kind 0 has PLACES: runs that follow a leader and of which no window lies in a found passage, under their signatures and
    under those and the distances of two and of four shared runs of the document in a row. The leader that failed isn't among them,
    so the next document leads; and a longer agreement has other leaders still.
    Kind 1 has k, doc, first, last: windows of `least` shingles, by the run that they begin in, all of whose signatures two
    documents have, in documents that follow, and that no found passage holds.
    """
    rows = places.select("doc", F.lit(1).alias("t"), F.col("at").alias("a"), F.col("k").alias("b"), (F.col("doc") > F.col("ldoc")).alias("follows"))
    spans = found.select("doc", F.lit(0).alias("t"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), F.lit(False).alias("follows"))

    def of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        batch = batch.sort_values(["doc", "t", "a"], kind="stable")
        doc, a, b, is_run = (batch[x].to_numpy() for x in ("doc", "a", "b", "t"))
        is_run = is_run == 1
        number = np.cumsum(np.diff(doc, prepend=doc[:1] - 1) != 0) - 1
        at, k, follows, doc = a[is_run], b[is_run].view(np.uint64), batch["follows"].to_numpy()[is_run], doc[is_run]
        if not len(at):
            return
        first = at >> 2 * RUN_BITS
        last = first + (at >> RUN_BITS & RUN_MOST)
        # documents laid end to end, far enough apart
        span = int(max(last.max(), b[~is_run].max(initial=0))) + 2 * least + SHINGLE
        first, last = first + number[is_run] * span, last + number[is_run] * span
        start, reach = a[~is_run] + number[~is_run] * span, np.maximum.accumulate(b[~is_run] + number[~is_run] * span)

        def held(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Whether a passage that starts at begin or before ends at end or later."""
            n = np.searchsorted(start, begin, "right") - 1
            return (n >= 0) & (reach[n] >= end) if len(start) else np.zeros(len(begin), bool)

        alone = follows & ~held(last, first + seed + SHINGLE - 1)
        for runs in (1, 2, 4):
            n = len(at) - runs + 1
            if n < 1:
                continue
            joint = mixed(k[:n] + np.uint64(runs))
            for t in range(1, runs):
                joint = mixed(joint ^ mixed(k[t : t + n] + (first[t : t + n] - first[:n]).view(np.uint64)))
            use = np.flatnonzero(alone[:n] & (doc[:n] == doc[runs - 1 :]))
            if len(use):
                yield chunk_places(joint[use].view(np.int64), doc[use], at[use]).assign(kind=0, follows=True, first=0, last=0)
        # The last run of each chain without gaps says how far windows of `least` can go.
        chain = np.append(np.flatnonzero(first[1:] != last[:-1] + 1), len(first) - 1)
        to = np.minimum(last, last[chain[np.searchsorted(chain, np.arange(len(first)))]] - (least - seed))
        some = np.flatnonzero(to >= first)
        if not len(some):
            return
        sizes = to[some] - first[some] + 1
        begins = np.cumsum(sizes) - sizes
        x = np.repeat(first[some] - begins, sizes) + np.arange(sizes.sum())
        free = ~held(x, x + least + SHINGLE - 1) & np.repeat(follows[some], sizes)
        low = np.minimum.reduceat(np.where(free, x, np.iinfo(np.int64).max), begins)
        high = np.maximum.reduceat(np.where(free, x, -1), begins)
        keep = high >= low
        some, offset = some[keep], number[is_run][some[keep]] * span
        yield pd.DataFrame({"kind": 1, "follows": follows[some], "first": low[keep] - offset, "last": high[keep] - offset, "k": k[some].view(np.int64), "doc": doc[some], "at": 0, "bdoc": None, "bat": None, "several": False})

    def by_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, names = None, [c.split()[0] for c in LEFT_OVER.split(", ")]
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch])
            mark = batch["doc"] == batch["doc"].iloc[-1]
            rest = batch[mark]
            if not mark.all():
                for out in of(batch[~mark]):
                    yield out[names]
        if rest is not None:
            for out in of(rest):
                yield out[names]

    return rows.union(spans).repartition("doc").sortWithinPartitions("doc").mapInPandas(by_document, LEFT_OVER)


def asked_texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the documents of the pairs; where those are few, the rest isn't shuffled."""
    ids = stored(pairs.select(F.col("doc").alias("id")).union(pairs.select("rdoc")).distinct())
    return texts.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= SMALL else texts


def _marked(ranges, n: int) -> np.ndarray:
    """For each of n places, whether one of the ranges (first, last) holds it."""
    on = np.zeros(n + 1, np.int64)
    for i, j in ranges:
        if i < n and 0 <= j and i <= j:
            on[max(i, 0)] += 1
            on[min(j + 1, n)] -= 1
    return np.cumsum(on)[:-1] > 0


def exact_repeats(texts: DataFrame, places: DataFrame, left: DataFrame, least_words: int) -> DataFrame | None:
    """FOUND, jaccard 1: runs of at least least_words words, beginning in the windows left (kind 1 of left_over), that a document
    with a smaller id has; of equal runs the first leads. None where there are none.

    Any document that has a window's signature may lead, whether its own passage was found or not."""
    asked, asking = stored(left.select("k").distinct()), stored(left.select("doc").distinct())
    first = _first(F.col("at"))
    holders = places.select("k", "doc", "at").join(asked, "k", "left_semi").select("doc", first.alias("first"), (first + _more(F.col("at"))).alias("last"))
    wanted = stored(left.select("doc", "first", "last").union(holders).groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("ranges")))
    n = wanted.count()
    if not n:
        return None
    if n <= SMALL:  # ids alone
        texts = texts.join(F.broadcast(wanted.select(F.col("doc").alias("id"))), "id", "left_semi")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w, d, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row, text, ranges in zip(batch["id"], batch["text"], batch["ranges"]):
                every = shingle_hashes(byte_words(text), least_words).view(np.int64)
                at = np.flatnonzero(_marked(((x["first"], x["last"]) for x in ranges), len(every)))
                w.append(every[at]), d.append(np.full(len(at), row, np.int64)), c.append(at)
            w, d, c = (np.concatenate(x) for x in (w, d, c))
            if len(w):
                yield chunk_places(w, d, c)

    rows = texts.join(wanted, F.col("id") == F.col("doc")).select("id", "text", "ranges").mapInPandas(windows, PLACES)
    met = led(rows).where("ldoc < doc").join(asking, "doc", "left_semi").select("doc", F.col("at").alias("c"), F.col("ldoc").alias("rdoc"), F.col("lat").alias("rc"))
    shift = F.col("c") - F.col("rc")
    place = F.row_number().over(Window.partitionBy("doc", "rdoc", shift).orderBy("c"))
    joined = met.withColumn("run", F.col("c") - place).groupBy("doc", "rdoc", shift.alias("shift"), "run")
    joined = joined.agg(F.min("c").alias("s"), F.max("c").alias("e"), F.min("rc").alias("rs"), F.max("rc").alias("re"))
    hashed = texts.select("id", "text_hash").join(wanted.select("doc"), F.col("id") == F.col("doc")).select("doc", "text_hash")
    return joined.join(hashed, "doc").select(
        "doc", F.col("s").cast("int").alias("start"), (F.col("e") + least_words).cast("int").alias("end"), "rdoc",
        F.col("rs").cast("int").alias("rstart"), (F.col("re") + least_words).cast("int").alias("rend"), F.lit(1.0).alias("jaccard"), "text_hash",
    )


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """(id, start, end, other_id, other_start, other_end, jaccard, text_hash), in words, ends exclusive: passages of at least
    least_words words that are near-duplicates (Jaccard of five-word shingles) of one in a document with a smaller id.

    The copies of a passage link to the first document that has the signature, not to each other, and the document with the smallest
    id to none. All exact repeats are found. A near-duplicate (Jaccard under 1) is missed only if each of the signatures that it
    shares with another document, alone and in a row, is led by a third that has the signatures but not the passage, and by a fourth
    among those that the third leaves unfound. The rows are the same however
    docs is partitioned. Words are lower case in A-Z. Null ids, null texts and texts of fewer words take no part. Of rows that share an id the
    least text counts (equal rows are one), and passages inside one text are not reported. text_hash is xxhash64 of
    the document's text. Other columns aren't read; an empty table gives no rows.
    """
    least = least_words - SHINGLE + 1
    seed = min(seed_places(least, similarity), least)
    texts = one_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    places = led(signatures(texts, seed))
    pairs = stored(intervals(places, seed))
    found = stored(verified(pairs, texts, least, similarity, seed + SHINGLE).distinct())
    left = stored(left_over(places, found, seed, least))
    again = stored(intervals(led(left.where("kind = 0")), seed))
    if again.limit(1).count():
        found = found.union(verified(again, asked_texts(texts, again), least, similarity, seed + SHINGLE))
    more = exact_repeats(texts, places, left.where("kind = 1"), least_words)
    if more is not None:
        found = found.unionByName(more)
    found = found.distinct()
    return found.select(
        F.col("doc").alias(id_col), "start", "end", F.col("rdoc").alias(f"other_{id_col}"),
        F.col("rstart").alias("other_start"), F.col("rend").alias("other_end"), "jaccard", "text_hash",
    )


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, end exclusive) and the blanks after them; the rest as it was."""
    spans = sorted(spans)
    places = [m.span() for m in WORDS.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        start, end = max(start, 0), min(end, len(places))
        if start >= end:
            continue
        begin, stop = places[start][0], places[end][0] if end < len(places) else len(text)
        if begin > at:
            out.append(text[at:begin])
        at = max(at, stop)
    out.append(text[at:])
    return "".join(out)


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that repeat one of a document with a smaller id; documents of which nothing is left go.

    A row is cut if its id and text_hash are a passage's, so of rows that share an id only those with the text that was
    searched are. Columns and other rows stay as they were, rows with a null id or text among them.
    """
    spans = passages.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))

    @F.pandas_udf("string")
    def shorter(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_words(t, [(x["start"], x["end"]) for x in s]) if s is not None and t is not None else t for t, s in zip(texts, spans)], dtype=object)

    # The texts stream by the spans of their partition; a sort would hold them in memory.
    joined = docs.join(spans.hint("shuffle_hash"), (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(shorter(F.col(text_col), F.col("__spans")))
    done = joined.withColumn("__text", text).where(F.col("__spans").isNull() | (F.trim(F.col("__text")) != ""))
    return done.withColumn(text_col, F.col("__text")).select(*docs.columns)
