"""Votes that wait to be sent: the last for each article counts, and a pass stops at the first that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlens.operators import relational as rel
from feedlens.streaming import versions

WAITING = "user_id long, article_id long, vote string, queued_at timestamp_ntz, sent boolean"


def flush(queued: DataFrame, state: str, number: int, fails: Column) -> None:
    """One pass: what waited before and what was queued since, (user_id, article_id, vote, queued_at), is sent in the order of the articles.

    Of a reader's votes on an article the last one waits, of equal times the greater vote. A reader's pass stops at the first vote for which
    `fails` holds (a condition on the columns and on number); it and all behind it wait for the next pass. The pass is a
    version with all its votes and whether they were sent. Rows with null ids are left out.
    """
    spark = queued.sparkSession
    before = [n for n in versions.numbers(spark, state) if n < number]
    left = versions.read(spark, state, WAITING, before[-1:]).where("not sent").drop("sent")
    rows = left.unionByName(queued.where("user_id IS NOT NULL AND article_id IS NOT NULL").select(*left.columns))
    last = rel.last_write(rows, ["user_id", "article_id"], [F.col("queued_at"), F.col("vote")], ["vote", "queued_at"]).withColumn("number", F.lit(number))
    stops = last.where(fails).groupBy("user_id").agg(F.min("article_id").alias("stop"))
    sent = F.col("stop").isNull() | (F.col("article_id") < F.col("stop"))
    versions.write(last.join(stops, "user_id", "left").select("user_id", "article_id", "vote", "queued_at", sent.alias("sent")), state, number)


def flush_queued(stream: DataFrame, state: str, checkpoint: str, fails: Column) -> StreamingQuery:
    """A pass for each micro-batch of queued votes; the versions are kept, for what was sent and when."""
    return stream.writeStream.foreachBatch(lambda batch, number: flush(batch, state, number, fails)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def passes(spark: SparkSession, state: str) -> DataFrame:
    """WAITING and `number` of every pass."""
    done = versions.numbers(spark, state)
    rows = [versions.read(spark, state, WAITING, [n]).withColumn("number", F.lit(n).cast("long")) for n in done]
    out = rows[0] if rows else spark.createDataFrame([], f"{WAITING}, number long")
    for more in rows[1:]:
        out = out.union(more)
    return out
