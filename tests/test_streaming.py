from pyspark.sql import functions as F

from feedlens.operators import status
from feedlens.streaming import ingest


def events(spark, n, start):
    return spark.range(start, start + n).select(
        "id", (F.col("id") % 7).alias("article_id"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "impression").otherwise("open").alias("event_type"),
        (F.col("id") % 9).alias("dwell_seconds"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).cast("timestamp_ntz").alias("created_at"),
    )


def test_stream_equals_batch(spark, tmp_path):
    landed = str(tmp_path / "in")
    for k in range(3):
        events(spark, 50, 50 * k).coalesce(1).write.mode("append").parquet(landed)
    articles = spark.createDataFrame([(i, i % 2, "T", "R", "News") for i in range(5)], "id long, source_id long, primary_topic string, region string, article_type string")
    stream = ingest.events(spark, landed, 1)
    ingest.ingest(stream, articles, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    whole = spark.read.schema(ingest.EVENTS).parquet(landed)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, ingest.labelled(whole, articles).select(got.columns).collect()), key=str)
    ingest.count_impressions(stream, str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination(120)
    assert sorted(map(tuple, ingest.counters(spark, str(tmp_path / "state")).collect())) == sorted(map(tuple, status.impressions(whole).collect()))
    left = {}
    for path in (tmp_path / "state").glob("v*/bucket=*"):
        left.setdefault(path.name, []).append(path.parent.name)
    assert max(map(len, left.values())) <= 2


def test_windows_and_dedupe_run(spark, tmp_path):
    landed = str(tmp_path / "in")
    events(spark, 60, 0).write.parquet(landed)
    stream = ingest.events(spark, landed)
    for name, frame, mode in (("w", ingest.windows(stream), "complete"), ("d", ingest.once_a_session(stream), "append")):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 60
    assert spark.table("d").groupBy("user_id", "article_id").count().where("count > 1").count() == 0
