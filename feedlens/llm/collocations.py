"""Phrase collocations: n-grams counted per language, every cut scored exactly, parts of longer phrases left out.

Each place of a piece of text gives a row for each n-gram that begins there, from one word up to `longest`; hash aggregation
(in the batch, in the task, then by language and phrase) leaves counts. Most long n-grams occur once, and shuffling all of them
takes more than ten times the text. So they are counted by length, and an n-gram is given out only if both its
parts that are one word shorter may occur often enough: a bit table of bounded size, sent to the tasks, says so for all that do and
for some that don't. Nothing is lost by that, and the counts are exact. Parts' counts are then joined to the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import lookup, small_batches, stored
from feedlens.llm.substrings import mixed

#: Marks and line ends part a text into pieces; they all become line feeds.
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
_ENDS = bytes.maketrans(MARKS, b"\n" * len(MARKS))
#: Words that are counted together in a task before rows are given out.
CHUNK = 1 << 19
#: Tasks that each language's phrases are ranked in before the last ranking, which sees the best of each.
RANKERS = 64


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int], list[str]]]:
    """The words of texts, A-Z in lower case, the lengths of the pieces that they make up, and the pieces' languages; CHUNK words or somewhat more at once."""
    words, lengths, langs = [], [], []
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            for piece in text.as_py().encode("utf-8", "surrogatepass").lower().translate(_ENDS).split(b"\n"):
                if own := piece.split():
                    words += own
                    lengths.append(len(own))
                    langs.append(lang)
            if len(words) >= CHUNK:
                yield words, lengths, langs
                words, lengths, langs = [], [], []
    if words:
        yield words, lengths, langs


def _hashes(words: np.ndarray, at: np.ndarray, size: int, salt: np.ndarray) -> np.ndarray:
    """A hash of the `size` words from each place on, by the words' own hashes."""
    out = salt
    for k in range(size):
        out = mixed(out ^ words[at + k])
    return out


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in words.cast(pa.binary()).to_pylist()], np.uint64)


def bit_table(frequent: DataFrame, size: int, most: int = 27) -> np.ndarray:
    """A bit for each hash of (lang, phrase), packed in bytes: as many bits as 16 times the phrases, 2 ** most at most.

    A set bit may be another phrase's, so the table lets some phrases through that it need not, but keeps none out.
    """
    bits = min(most, max(15, int(16 * frequent.count()).bit_length()))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.compute.split_pattern(batch["phrase"], " ").flatten()
            hashed = _hashes(_word_hashes(words), np.arange(batch.num_rows) * size, size, _word_hashes(batch["lang"]))
            yield pa.RecordBatch.from_arrays([pa.array((hashed & np.uint64((1 << bits) - 1)).astype(np.int64) + 1)], ["x"])

    rows = frequent.select("lang", "phrase").mapInArrow(solve, "x long")
    rows = rows.groupBy(F.bitmap_bucket_number("x").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.collect():  # 4 KB each, 2 ** (most - 15) rows at most
        table[(row["page"] - 1) * 4096 : row["page"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def ngrams(rows: DataFrame, size: int, table: np.ndarray | None) -> DataFrame:
    """(lang, phrase, c): counts, added up over CHUNK words, of the n-grams of `size` words of rows (lang, text).

    An n-gram occurs no more often than its first and its last size - 1 words. So where table is given, those n-grams are left out
    of which it lacks one of these.
    """
    mask = None if table is None else np.uint64(len(table) * 8 - 1)

    def held(hashes: np.ndarray) -> np.ndarray:
        at = (hashes & mask).astype(np.int64)
        return table[at >> 3] >> (at & 7) & 1 == 1

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, langs in pieces(batches):
            own, lang = pa.array(words, pa.binary()).dictionary_encode(), pa.array(langs).dictionary_encode()
            codes, lang_codes = own.indices.to_numpy().astype(np.int64), lang.indices.to_numpy()
            lengths = np.array(counts)
            begins = (lengths - size + 1).clip(0)
            at = np.arange(begins.sum()) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(begins) - begins), begins)
            of = np.repeat(lang_codes, begins)
            if size == 1:
                key = of * np.int64(len(own.dictionary)) + codes[at]
            else:
                hashed, salts = _word_hashes(own.dictionary)[codes], _word_hashes(lang.dictionary)
                for shift in (0, 1):
                    keep = held(_hashes(hashed, at + shift, size - 1, salts[of]))
                    of, at = of[keep], at[keep]
                key = _hashes(hashed, at, size, salts[of]).view(np.int64)
            # One place stands for all that have its key.
            found = pa.table({"key": key, "at": np.arange(len(key))}).group_by("key", use_threads=False).aggregate([("at", "min"), ("at", "count")])
            first = found["at_min"].to_numpy()
            phrase = own.dictionary.take(pa.array(codes[at[first]]))
            for k in range(1, size):
                phrase = pa.compute.binary_join_element_wise(phrase, own.dictionary.take(pa.array(codes[at[first] + k])), b" ")
            out = pa.table({"lang": lang.dictionary.take(pa.array(of[first])), "phrase": phrase.cast(pa.string()), "c": found["at_count"]})
            yield from out.to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(solve, "lang string, phrase string, c long")


def _key(lang: str, phrase: str | Column) -> Column:
    """One text for a language and a phrase; phrases hold no line feeds."""
    return F.concat_ws("\n", F.col(lang), phrase)


def with_counts(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of the phrase in column `part`; parts that many cuts share are looked up by broadcast."""
    return lookup(cuts.withColumn("key", _key("lang", F.col(part))), counts.select(_key("lang", F.col("phrase")).alias("key"), F.col("a").alias(name)), "key").drop("key")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, contained: int = 80, top: int = 2000, scale: int = 2_000_000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words that occur `least` times or more.

    A-Z become lower case; phrases lie within pieces between marks and line ends. a is the phrase's count, overlaps included, n
    the language's words. Each cut of a phrase into two parts, of counts l and r, has floor(scale * a / (l + r)); the phrase's score
    is its least, of equal ones that of the shortest first part. A phrase that lies in a longer candidate, dropped or not, with
    100 * its count >= contained * a is left out: it is enough to look at those a word longer, as a still longer one
    holds one of these that occurs no less often. Ranks go by score, then a, then the phrase's bytes.

    Sums and products are decimals of 38 digits, and quotients whole numbers, so nothing is rounded. A null language is `und`;
    null and empty texts, and texts of marks and blanks, give nothing; repeated rows count as often as they are there; other
    columns aren't read; an empty table gives no rows. A text is taken apart whole, in memory in proportion to its length.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    levels, table = [], None
    for size in range(1, longest + 1):
        counts = ngrams(texts, size, table).groupBy("lang", "phrase").agg(F.sum("c").alias("a")).withColumn("size", F.lit(size))
        # All single words stay for the languages' totals.
        counts = stored(counts.where(F.col("a") >= least) if size > 1 else counts)
        if size == 1:
            totals = stored(counts.groupBy(F.col("lang").alias("of")).agg(F.sum("a").alias("n")))
        levels.append(counts.where(F.col("a") >= least))
        if size < longest:
            table = bit_table(levels[-1], size)
    counts = reduce(DataFrame.union, levels)
    found = counts.where("size > 1")

    words = F.split("phrase", " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({
        "first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " "),
    })
    cuts = stored(with_counts(stored(cuts), counts, "first", "l"))
    cuts = with_counts(cuts, counts, "rest", "r")
    score = F.expr(f"(cast({scale} as decimal(18, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    ends = F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    longer = found.where("size > 2").select("lang", F.explode(ends).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {contained}")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKERS)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = stored(parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top))
    named = lookup(ranked.withColumn("of", F.col("lang")), totals, "of")
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
