"""An order that stays as it was dealt: what has a place keeps it, newcomers come behind, in a random order of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlens.operators import relational as rel
from feedlens.streaming import versions

PLACES = "id long, list string, place long"


def places(spark: SparkSession, state: str) -> DataFrame:
    """PLACES of everything that was dealt so far."""
    return versions.read(spark, state, PLACES, versions.numbers(spark, state))


def deal(items: DataFrame, state: str, number: int, seed: str) -> None:
    """Gives those of items (id, list) that have no place in their list one behind all others there, by a hash of seed, number and id.

    Each deal is a version that holds the new places alone, so no place is ever written again; a deal that runs again gives the same. Repeated
    items count once; an item may have a place in each of several lists. Null ids are left out; a null list is one.
    """
    spark = items.sparkSession
    before = versions.read(spark, state, PLACES, [n for n in versions.numbers(spark, state) if n < number])
    rows = items.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("list").cast("string").alias("list")).distinct()
    same = lambda a, b: a["list"].eqNullSafe(b["list"])
    fresh = rows.join(before, (rows["id"] == before["id"]) & same(rows, before), "left_anti")
    fresh = fresh.withColumn("key", F.md5(F.concat_ws("-", F.lit(seed), F.lit(number), F.col("id"))))
    dealt = rel.numbered(fresh, ["list"], [F.col("key"), F.col("id")], "n")
    last = before.groupBy("list").agg(F.max("place").alias("last"))  # a row a list
    placed = dealt.join(last, same(dealt, last), "left").select("id", dealt["list"], (F.col("n") + F.coalesce("last", F.lit(0))).cast("long").alias("place"))
    versions.write(placed, state, number)


def deal_arrivals(stream: DataFrame, state: str, checkpoint: str, seed: str) -> StreamingQuery:
    """A deal for each micro-batch of arriving items."""
    return stream.writeStream.foreachBatch(lambda batch, number: deal(batch, state, number, seed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_order(items: DataFrame, state: str) -> DataFrame:
    """items (id, list, ...) with their places; what was dealt but isn't among the items any more leaves a gap, and nothing moves up."""
    held = places(items.sparkSession, state)
    return items.join(held, (items["id"] == held["id"]) & items["list"].eqNullSafe(held["list"])).select(*[items[c] for c in items.columns], held["place"])
