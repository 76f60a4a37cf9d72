"""Structured Streaming over landed event files: ingest with labels, counters by merge, windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlens.operators import relational as rel
from feedlens.operators import status

EVENTS = "id long, article_id long, user_id long, event_type string, dwell_seconds long, created_at timestamp_ntz"


def events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet event files as a stream, under a fixed schema."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def labelled(stream: DataFrame, articles: DataFrame) -> DataFrame:
    """Events with their article's labels: a stream-static left join, read anew each batch."""
    labels = articles.select(F.col("id").alias("article_id"), "source_id", "primary_topic", "region", "article_type")
    return stream.join(labels, "article_id", "left")


def ingest(stream: DataFrame, articles: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends labelled events, an exactly-once file sink; ends when all landed files are in."""
    out = labelled(stream, articles).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()


BUCKETS = 64


def _versions(spark: SparkSession, state: str) -> dict[int, list[tuple[int, str]]]:
    """For each bucket of articles its versions, (batch, path), the newest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/v*/bucket=*")
    found: dict[int, list[tuple[int, str]]] = {}
    for entry in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ():
        path = entry.getPath()
        found.setdefault(int(path.getName()[7:]), []).append((int(path.getParent().getName()[1:]), path.toString()))
    return {k: sorted(v, reverse=True) for k, v in found.items()}


COUNTERS = "article_id long, n long, last_seen_at timestamp_ntz"


def counters(spark: SparkSession, state: str) -> DataFrame:
    """The counters as of the last batch: the newest version of each bucket."""
    paths = [v[0][1] for v in _versions(spark, state).values()]
    return spark.read.schema(COUNTERS).parquet(*paths) if paths else spark.createDataFrame([], COUNTERS)


def count_impressions(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Impression counters, merged batch by batch, in BUCKETS buckets of articles.

    A batch writes only the buckets that it touches, each as a version named by the batch's number, from the newest version before
    it; so a batch that runs again writes the same. Versions before that one are removed.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = status.impressions(batch).withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(BUCKETS)).cast("int")).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        versions = _versions(spark, state)
        before = {k: next((path for n, path in versions.get(k, ()) if n < number), None) for k in touched}
        old = [path for path in before.values() if path]
        merged = new.drop("bucket")
        if old:
            count = F.coalesce(F.col("old.n"), F.lit(0)) + F.coalesce(F.col("new.n"), F.lit(0))
            merged = rel.upsert(spark.read.schema(COUNTERS).parquet(*old), merged, ["article_id"], {"n": count, "last_seen_at": F.greatest("old.last_seen_at", "new.last_seen_at")})
        merged = merged.withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(BUCKETS)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/v{number}")
        new.unpersist()
        for k in touched:
            for n, path in versions.get(k, ()):
                if n < number and path != before[k]:
                    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(stream: DataFrame, width: str = "6 hours", lateness: str = "1 day") -> DataFrame:
    """Counts of event types in tumbling windows; events later than the watermark are left out."""
    timed = stream.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))


def once_a_session(stream: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """One impression for each user and article within the watermark."""
    timed = stream.where("event_type = 'impression'").withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", lateness)
    return timed.dropDuplicatesWithinWatermark(["user_id", "article_id"])
