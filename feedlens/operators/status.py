"""The translation status report: providers, outcomes, and series with empty buckets filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import numbers, text


def impressions(events: DataFrame) -> DataFrame:
    """(article_id, n, last_seen_at) of impression events."""
    return events.where("event_type = 'impression'").groupBy("article_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen_at"))


def providers(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """rows: created_at, updated_at, badge (the text after 'Translated by '); costs: provider, cost. Waits in minutes, never negative."""
    wait = (F.unix_seconds(F.col("updated_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 60.0
    told = rows.select(
        text.badge_provider(F.col("badge")).alias("provider"), text.badge_is_fallback(F.col("badge")).alias("fb"), F.greatest(F.lit(0.0), wait).alias("w")
    ).where("provider IS NOT NULL AND provider <> ''")
    out = told.groupBy("provider").agg(
        F.count("*").alias("articles"), F.count_if("fb").alias("fallbacks"), F.round(F.avg("w"), 1).alias("avg_wait_min"), F.round(F.max("w"), 1).alias("max_wait_min")
    )
    return out.join(costs, "provider", "left").select(*out.columns, F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost_cny"))


def outcomes(rows: DataFrame, failed: Column, badged: Column, pending: Column) -> DataFrame:
    """One row of counts. An error counts before a badge, a badge before waiting; what waits isn't settled."""
    kind = F.when(failed, "failed").when(badged, "ok").when(pending, "queued").otherwise("unbadged")
    n = lambda k: F.count_if(F.col("kind") == k)
    return rows.select(kind.alias("kind")).agg(
        F.count("*").alias("needed"), n("ok").alias("succeeded"), n("failed").alias("failed"), n("queued").alias("queued"), n("unbadged").alias("unbadged"),
        F.round(F.try_divide(n("ok"), n("ok") + n("failed") + n("unbadged")), 4).alias("success_rate"),
    )


def series(rows: DataFrame, at: str, hours: int, as_of: str) -> DataFrame:
    """(bucket, arrived) of each bucket of the last hours, zeros included; the buckets start at the epoch."""
    step = numbers.bucket_minutes(hours)
    now = F.to_timestamp_ntz(F.lit(as_of))
    begin = numbers.bucket_start(now - F.make_dt_interval(F.lit(0), F.lit(hours)), step)
    grid = rows.sparkSession.range(1).select(F.explode(F.sequence(begin, numbers.bucket_start(now, step), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(step)))).alias("bucket"))
    counts = rows.where((F.col(at) >= begin)).groupBy(numbers.bucket_start(F.col(at), step).alias("bucket")).agg(F.count("*").alias("n"))
    return grid.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("arrived"))


#: The votes there are.
VOTES = ("show_more", "show_less")


def recorded_votes(articles: DataFrame, votes: DataFrame, batch: DataFrame) -> DataFrame:
    """(kind, article_id, value, topic): the votes, events and read states that a batch of votes leaves, from one reading of it.

    articles: article_id, primary_topic, is_read. votes: article_id, vote. batch: n (a unique number), article_id, vote. A null vote takes a vote
    back; votes that aren't one of VOTES, and votes on unknown articles, are refused.
    """
    valid = batch.where(F.col("vote").isNull() | F.col("vote").isin(*VOTES)).join(articles.select("article_id", F.col("primary_topic").alias("topic")), "article_id")
    events = valid.where("vote is not null").select(F.lit("event").alias("kind"), "article_id", F.col("vote").alias("value"), "topic")
    last = valid.groupBy("article_id").agg(F.max_by(F.coalesce("vote", F.lit("")), "n").alias("last"), (F.count("vote") > 0).alias("voted"))
    state = articles.join(votes, "article_id", "left").join(last, "article_id", "left").withColumnRenamed("primary_topic", "topic")
    now = state.select(F.lit("vote").alias("kind"), "article_id", F.nullif(F.coalesce("last", "vote"), F.lit("")).alias("value"), "topic").where("value is not null")
    read = state.select(F.lit("read").alias("kind"), "article_id", F.when(F.col("voted"), 1).otherwise(F.col("is_read")).cast("string").alias("value"), "topic")
    return now.unionByName(events).unionByName(read)
