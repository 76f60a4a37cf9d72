"""Decay, saturation, costs and times, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(age_days: Column, half_life: float = 90.0) -> Column:
    return F.when((age_days <= 0) | F.lit(half_life <= 0), 1.0).otherwise(F.pow(F.lit(0.5), age_days / (half_life or 1.0)))


def saturate(tally: Column, cap: float, k: float) -> Column:
    return cap * F.tanh(tally / k) if k > 0 else F.lit(0.0)


def exposure_penalty(count: Column, hours: Column, weight: float = 1.0) -> Column:
    """Grows with the times shown, fades with the hours since; none if never shown or the time is unknown."""
    shown = -weight * (1 - F.exp(-count / 2.0)) * F.exp(-F.greatest(F.lit(0.0), hours) / 48.0)
    return F.when((count <= 0) | count.isNull() | hours.isNull(), 0.0).otherwise(shown)


def freshness(percentile: Column) -> Column:
    return F.exp(-3.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(percentile, F.lit(0.5)))))


def clamp(x: Column, limit) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(float(limit))
    return F.greatest(-limit, F.least(limit, x))


def age_days(at: Column, as_of: Column) -> Column:
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.coalesce(seconds / 86400e6, F.lit(0.0))


def deepseek_cost(hit: Column, miss: Column, completion: Column) -> Column:
    """CNY by the million: 0.5 for cached, 2 for other prompt tokens, 8 for completions."""
    return (hit * 0.5 + miss * 2.0 + completion * 8.0) / 1_000_000


def qwen_cost(prompt: Column, completion: Column) -> Column:
    return (prompt * 0.16 + completion * 0.49) / 1_000_000 * 7.1


def retry_hours(n: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), n - 1), F.lit(24.0))


def cooldown_seconds(n: Column, first: int = 900, most: int = 7200) -> Column:
    return F.least(first * F.pow(F.lit(2.0), n - 1), F.lit(float(most)))


def parse_time(text: Column) -> Column:
    """Naive time from text with a blank or T, with or without seconds and Z; null if unreadable."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), "Z$", ""), "T", " ")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])


def bucket_minutes(hours: int) -> int:
    return 10 if hours <= 1 else 60 if hours <= 24 else 360


def bucket_start(at: Column, minutes: int) -> Column:
    seconds = F.unix_seconds(at.cast("timestamp"))
    return F.timestamp_seconds(seconds - seconds % (minutes * 60)).cast("timestamp_ntz")


def relative_age(at: Column, as_of: Column) -> Column:
    """now, minutes, hours, days or weeks since, whole ones."""
    m = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))) / 60).cast("long")
    whole = lambda n, unit: F.concat(F.floor(m / n).cast("string"), F.lit(unit))
    return F.when(m < 1, "now").when(m < 60, whole(1, "m")).when(m < 1440, whole(60, "h")).when(m < 10080, whole(1440, "d")).otherwise(whole(10080, "w"))
