"""Dictionary substitution outside tags, and fuzzy URL matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def localize(text: Column, words: dict[str, str]) -> Column:
    """Replaces words, longest first, in one pass outside tags, so no replacement is replaced again."""
    ordered = sorted(words, key=len, reverse=True)
    pattern = re.compile("(<[^>]*>)|(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts if pattern is None else pd.Series([None if t is None else pattern.sub(lambda m: m[1] or words[m[2]], t) for t in texts], dtype=object)

    return of(text)


def glossary(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """(tw, hk): built-in words, those of users over them, without what users switched off."""
    merged = builtin.join(own.select("tw", F.col("hk").alias("own_hk"), "enabled"), "tw", "full_outer")
    return merged.where("coalesce(enabled, 1) = 1").select("tw", F.coalesce("own_hk", "hk").alias("hk"))


def fuzzy_urls(left: DataFrame, right: DataFrame, group: str, least: float = 0.72, margin: float = 0.06, shortest: int = 24) -> DataFrame:
    """(group, url, match, ratio): for each url of left its closest one of right in the group, if close and clearly closer than the next.

    A group is a page, so its pairs are bounded. Pairs whose lengths alone rule the ratio out are left out before they are compared; equal urls count
    once, so a repeated one is no rival. Urls under `shortest` characters match nothing; nulls neither.
    """

    @pandas_udf("double")
    def ratio(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(one, two)], dtype="float64")

    asked = left.where(F.length("url") >= shortest).select(group, "url").distinct()
    pairs = asked.join(right.where("url IS NOT NULL").select(group, F.col("url").alias("match")).distinct(), group)
    a, b = F.length("url"), F.length("match")
    # No pair can have more in common than its shorter url; a rival a margin below the least ratio decides nothing.
    near = pairs.where(2 * F.least(a, b) >= (least - margin) * (a + b) - 1e-9).withColumn("ratio", ratio("url", "match"))
    best = near.groupBy(group, "url").agg(F.max(F.struct("ratio", "match")).alias("first"), F.slice(F.sort_array(F.collect_list("ratio"), asc=False), 2, 1).alias("next"))
    found = best.where((F.col("first.ratio") >= least) & (F.coalesce(F.get("next", 0), F.lit(-1.0)) <= F.col("first.ratio") - margin))
    return found.select(group, "url", F.col("first.match").alias("match"), F.col("first.ratio").alias("ratio"))
