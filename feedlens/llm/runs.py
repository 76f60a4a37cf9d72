"""Periodic runs of words by Lyndon words under both orders, without a suffix array.

A run is a longest stretch of words with a smallest period that fits in it twice. Every run holds, under one of the two
orders of the words, a Lyndon word of the length of its period that is the longest one to begin where it does. So the
words are scanned right to left with a stack of Lyndon words: one that begins with a smaller suffix than the next takes
that one in. The longest Lyndon word at each place gives a period to try; how far it holds to both sides is found by
binary search over rolling hashes (the first words are compared as they are). What is found is verified word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51
#: Words that are compared one by one before hashes are.
FIRST = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

Extent = Callable[[int, int], int]


def extents(ids: list[int]) -> tuple[Extent, Extent]:
    """Two functions of places i < j: how many words are the same from i and j on, and how many before them."""
    n, held = len(ids), []

    def hashes() -> tuple[list[int], list[int]]:
        if not held:  # most texts never need them
            held.append(list(accumulate(ids, lambda h, x: (h * BASE + x + 1) % PRIME, initial=0)))
            held.append(list(accumulate(repeat(BASE, n), lambda h, x: h * x % PRIME, initial=1)))
        return held[0], held[1]

    def after(i: int, j: int) -> int:
        most = n - j
        for k in range(min(FIRST, most)):
            if ids[i + k] != ids[j + k]:
                return k
        if most <= FIRST:
            return most
        sums, powers = hashes()
        low, high, a, b = FIRST, most, sums[i], sums[j]
        while low < high:
            k = (low + high + 1) >> 1
            if (sums[i + k] - sums[j + k] - (a - b) * powers[k]) % PRIME:
                high = k - 1
            else:
                low = k
        return low

    def before(i: int, j: int) -> int:
        for k in range(min(FIRST, i)):
            if ids[i - k - 1] != ids[j - k - 1]:
                return k
        if i <= FIRST:
            return i
        sums, powers = hashes()
        low, high, a, b = FIRST, i, sums[i], sums[j]
        while low < high:
            k = (low + high + 1) >> 1
            if (a - b - (sums[i - k] - sums[j - k]) * powers[k]) % PRIME:
                high = k - 1
            else:
                low = k
        return low

    return after, before


def lyndon_lengths(ids: list[int], after: Extent) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; a suffix is greater than what it begins with."""
    n = len(ids)
    lengths, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        own, j = ids[i], stack[-1]
        while j < n:
            other = ids[j]
            if own == other:
                k = after(i, j)
                if j + k == n or ids[i + k] > ids[j + k]:
                    break
            elif own > other:
                break
            stack.pop()
            j = stack[-1]
        lengths[i] = j - i
        stack.append(i)
    return lengths


def _scanned(ids: list[int], start: int, stop: int, period: int) -> tuple[int, int]:
    """The longest stretch around start..stop with that period, word by word."""
    end = start + period
    while end < len(ids) and ids[end] == ids[end - period]:
        end += 1
    while start and ids[start - 1] == ids[start - 1 + period]:
        start -= 1
    return start, end


def periodic_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words and twice its period, by start, then period."""
    names: dict = {}
    ids = [names.setdefault(w, len(names)) for w in words]
    n = len(ids)
    if len(names) == n or n < least:
        return []
    after, before = extents(ids)
    found: set[tuple[int, int, int]] = set()
    for order in (ids, [-x for x in ids]):
        latest: dict[int, tuple[int, int]] = {}  # by period, the run met last
        for i, p in enumerate(lyndon_lengths(order, after)):
            j = i + p
            if not (j < n and ids[i] == ids[j] or i and ids[i - 1] == ids[j - 1]):
                continue
            start, end = latest.get(p, (0, 0))
            if start <= i and j <= end:
                continue
            start, end = i - before(i, j), j + (after(i, j) if j < n else 0)
            if end - start >= max(least, 2 * p):
                if ids[start : end - p] != ids[start + p : end]:  # two hashes met
                    start, end = _scanned(ids, i, j, p)
                    if end - start < max(least, 2 * p):
                        continue
                latest[p] = start, end
                found.add((start, end - start, p))
    return sorted((s, length, p) for s, length, p in found)


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: all that lie in a run behind its first period."""
    out, at = [], 0
    for start, end in sorted((s + p, s + length) for s, length, p in runs):
        if start > at:
            out.append(words[at:start])
        at = max(at, end)
    return list(chain.from_iterable([*out, words[at:]]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words, runs array of (start, length, period), collapsed): the runs of each row's text, and the text without repeats.

    Words are what ASCII blanks part, upper and lower case apart, numbered from 0. runs is sorted by start, then period. collapsed
    has the kept words joined by single blanks. Null and empty texts, and texts of blanks, have no words, no runs and an
    empty collapsed text. A row gives a row, so repeated rows and null ids are kept; other columns aren't read; an empty table gives
    no rows. Each text is worked on whole, alone, in memory in proportion to its length; nothing is shuffled.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for text in part["text"]:
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    runs = periodic_runs(words, least)
                    rows.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed_words(words, runs)).decode("utf-8", "replace")))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part["id"], *[pa.array(c, FOUND.field(k + 1).type) for k, c in enumerate(columns)]], schema=FOUND)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(solve, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
