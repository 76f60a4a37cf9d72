"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs with at most k edits shares at least m - q + 1 - k*q of its q-grams with the place
where it occurs, and all of them on k + 1 neighbouring diagonals. So shared q-grams are counted in overlapping bands of
diagonals, bands that reach the bound are kept, and a banded alignment decides. Texts and items are compared in lower
case with runs of ASCII characters other than letters and digits as one blank, as UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.common import stored

_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SPREAD, PLACES = np.uint64(0x9E3779B97F4A7C15), 19
FOUND = "item_id long, n_edits int, item_chars int, start int, end int"


def folded(text: str | None) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) if text else b""


def codes_of(data: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place as a number (q of 8 at most), put together from q-grams of half the length."""
    n = max(0, len(data) - q + 1)
    code, width = data, 1
    for wider in (np.uint16, np.uint32, np.uint64):
        if width * 2 > q:
            break
        code = code[:-width].astype(wider) << wider(8 * width) | code[width:]
        width *= 2
    rest = np.uint64(q - width)
    if not rest:
        return code[:n].astype(np.uint64)
    mask = (np.uint64(1) << np.uint64(8) * rest) - np.uint64(1)
    return code[:n].astype(np.uint64) << np.uint64(8) * rest | (code[int(rest) : int(rest) + n].astype(np.uint64) & mask)


def align(item: np.ndarray, region: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of item in region, both free at its ends, if within k edits."""
    m, n = len(item), len(region)
    at = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, np.int64), at.copy()
    # cost * BIG + begin travels as one number, so the start of the best path comes along
    big = n + 2
    row = cost * big + begin
    for i in range(m):
        step = np.empty(n + 1, np.int64)
        step[0] = row[0] + big
        step[1:] = np.minimum(row[:-1] + big * (region != item[i]), row[1:] + big)
        row = np.minimum.accumulate(step - at * big) + at * big
        if row.min() // big > k:
            return None
    end = int(row.argmin())
    edits, start = divmod(int(row[end]), big)
    return (edits, start, end) if edits <= k else None


class Screen:
    """A block of benchmark items, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int, str]], q: int = 7, max_error: float = 0.12, common: int = 64):
        self.q, kept = q, []
        for item_id, text in items:
            data = folded(text)
            if len(data) >= q:
                kept.append((item_id, np.frombuffer(data, np.uint8)))
        self.ids, self.items = [i for i, _ in kept], [d for _, d in kept]
        self.sizes = np.array([len(d) for d in self.items], np.int64)
        self.edits = np.minimum((max_error * self.sizes).astype(np.int64), (self.sizes - q) // q)
        self.bound = self.sizes - q + 1 - self.edits * q
        self.width = int(max(self.edits.max(initial=0), 8)) + 1
        self.margin = 2 * (q + self.width) + int(self.sizes.max(initial=0))
        grams = [codes_of(d, q) for d in self.items]
        code = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        # An item needn't count its q-grams that many places of the items hold, if it is left with half its bound without them:
        # each q-gram place that isn't counted lowers the bound by one, so no occurrence is lost.
        names, at, times = np.unique(code, return_inverse=True, return_counts=True)
        hot = times[at] > common
        hot_places = np.bincount(owner[hot], minlength=len(grams)) if len(grams) else np.empty(0, np.int64)
        spared = self.bound - hot_places >= np.maximum(1, self.bound // 2)
        self.bound = np.where(spared, self.bound - hot_places, self.bound)
        counted = ~(hot & spared[owner]) if len(owner) else np.empty(0, bool)
        code, owner, place = code[counted], owner[counted], place[counted]
        order = np.argsort(code, kind="stable")
        self.code, first, count = np.unique(code[order], return_index=True, return_counts=True)
        self.first, self.count, self.owner, self.place = first, count, owner[order], place[order]
        self.seen = np.zeros(1 << PLACES, bool)
        self.seen[(self.code * SPREAD) >> np.uint64(64 - PLACES)] = True

    def hits(self, data: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(place, index into self.code) of the q-grams of data that an item counts, block by block."""
        places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for begin in range(0, len(data), block):
            codes = codes_of(data[begin : begin + block + self.q - 1], self.q)
            hit = np.flatnonzero(self.seen[(codes * SPREAD) >> np.uint64(64 - PLACES)])
            at = np.minimum(np.searchsorted(self.code, codes[hit]), len(self.code) - 1)
            true = self.code[at] == codes[hit]
            places.append(hit[true] + begin), found.append(at[true])
        return np.concatenate(places), np.concatenate(found)

    def search(self, texts: list[bytes], piece: int = 1 << 21, most: int = 1 << 22) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item id, edits, item length, start, end) of the best occurrence of each item in each folded text.

        Texts longer than a piece are searched in pieces that overlap by all that an occurrence can span, so memory is
        bounded by a piece, and by the places of the items that share q-grams with one.
        """
        if not len(self.code) or not texts:
            return
        pieces = []
        for n, text in enumerate(texts):
            for at in range(0, max(1, len(text) - self.margin), piece):
                pieces.append((n, at, text if len(text) <= piece else text[at : at + piece + self.margin]))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        gap = b"\x00" * (self.q + self.width)
        data = np.frombuffer(gap.join(p[2] for p in pieces), np.uint8)
        starts = np.cumsum([0] + [len(p[2]) + len(gap) for p in pieces[:-1]])
        hit, at = self.hits(data)
        doc = np.searchsorted(starts, hit, "right") - 1
        # whole pieces, as many at once as share about `most` places with items
        shared = np.cumsum(np.bincount(doc, self.count[at], minlength=len(pieces)).astype(np.int64)) if len(hit) else np.zeros(len(pieces), np.int64)
        begin = 0
        while begin < len(pieces):
            end = max(begin + 1, int(np.searchsorted(shared, (shared[begin - 1] if begin else 0) + most, "right")))
            lo, hi = np.searchsorted(doc, begin), np.searchsorted(doc, end)
            for d, i, found in self._banded(pieces, starts, len(gap), hit[lo:hi], at[lo:hi], doc[lo:hi]):
                key = pieces[d][0], i
                found = found[0], found[1] + pieces[d][1], found[2] + pieces[d][1]
                if found < best.get(key, (1 << 30, 0, 0)):
                    best[key] = found
            begin = end
        for (n, i), (edits, start, end) in sorted(best.items()):
            yield n, self.ids[i], edits, int(self.sizes[i]), start, end

    def _banded(self, pieces: list, starts: np.ndarray, gap: int, hit: np.ndarray, at: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        if not len(hit):
            return
        n_items = len(self.items)
        times = self.count[at]
        spot = np.repeat(self.first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item = self.owner[spot]
        # A piece that has fewer shared q-grams than an item's bound in all has no band that reaches it.
        pair = np.repeat(doc - doc[0], times) * n_items + item
        if (int(doc[-1] - doc[0]) + 1) * n_items > 8 * len(pair):
            pair = np.unique(pair, return_inverse=True)[1]
        keep = np.bincount(pair)[pair] >= self.bound[item]
        if not keep.any():
            return
        item = item[keep]
        diagonal = np.repeat(hit, times)[keep] - self.place[spot[keep]]
        base = 2 * gap + int(self.sizes.max())
        band = (diagonal + base) // self.width
        bands = int(band.max()) + 2
        key, n = np.unique(np.concatenate([item * bands + band, item * bands + band - 1]), return_counts=True)
        key = key[n >= self.bound[key // bands]]
        if not len(key):
            return
        run = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        for lo, hi in zip(key[run].tolist(), key[np.append(run[1:], len(key)) - 1].tolist()):
            i = lo // bands
            begin, end = lo % bands * self.width - base, (hi % bands + 2) * self.width - base + int(self.sizes[i] + self.edits[i])
            least = max(0, int(np.searchsorted(starts, max(begin, 0), "right") - 1))
            for d in range(least, int(np.searchsorted(starts, max(end, 0), "left"))):  # a run can span many texts
                text = pieces[d][2]
                a, b = max(0, begin - int(starts[d])), min(len(text), end - int(starts[d]))
                if b - a < self.sizes[i] - self.edits[i]:
                    continue
                found = self._verify(i, text[a:b])
                if found:
                    yield d, i, (found[0], found[1] + a, found[2] + a)

    def _verify(self, i: int, region: bytes) -> tuple[int, int, int] | None:
        exact = region.find(self.items[i].tobytes())
        if exact >= 0:
            return 0, exact, exact + int(self.sizes[i])
        return align(self.items[i], np.frombuffer(region, np.uint8), int(self.edits[i]))


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    q: int = 7, max_error: float = 0.12, chunk: int = 1 << 21, block_chars: int = 1 << 22,
) -> DataFrame:
    """(id, item_id, n_edits, item_chars, start, end): the best occurrence of each benchmark item in each document.

    An item may have max_error of its length as edits, fewer if it is so short that the lemma would ask for no shared
    q-gram. Ties go to the first place; start and end count bytes of the folded text. Items that fold to less than q bytes, null ones
    among them, match nothing; null and empty texts hold nothing. Repeated rows give repeated rows. The items go to
    the tasks in blocks of about block_chars characters, each a pass over the documents, so what travels is bounded by a block.
    Texts of any length are searched whole, in overlapping pieces. Other columns aren't read.
    """
    total = benchmark.agg(F.sum(F.length(item_text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    out = None
    for block in range(blocks):
        some = benchmark.where(F.col(item_text_col).isNotNull()).where(F.pmod(F.xxhash64(F.col(item_text_col)), F.lit(blocks)) == block)
        items = sorted({(r[0], r[1]) for r in some.select(F.col(item_col).cast("long"), item_text_col).collect()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))

        def scan(batches: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            screen = Screen(items, q, max_error)
            for batch in batches:
                ids, texts, held = [], [], 0
                for row, text in zip(batch["row_id"], batch["text"]):
                    ids.append(row), texts.append(folded(text))
                    held += len(texts[-1])
                    if held >= chunk:
                        yield frame(ids, screen.search(texts))
                        ids, texts, held = [], [], 0
                yield frame(ids, screen.search(texts))

        def frame(ids, found) -> pd.DataFrame:
            rows = [(ids[d], *rest) for d, *rest in found]
            return pd.DataFrame(rows, columns=["row_id", "item_id", "n_edits", "item_chars", "start", "end"])

        part = docs.select(F.col(id_col).cast("string").alias("row_id"), F.col(text_col).alias("text")).mapInPandas(scan, "row_id string, " + FOUND)
        if blocks > 1:
            part = stored(part)  # so the driver holds one block's items at a time
        out = part if out is None else out.unionByName(part)
    return out.withColumn("row_id", F.col("row_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("row_id", id_col)
