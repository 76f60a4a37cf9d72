"""Values that come late, written back into a table in partitions: only the partitions that they touch are written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlens.sources.shared import settled

#: Batches that a long list is worked off in, about; each costs the same to plan, commit and list the table's partitions, whatever it holds.
MOST_BATCHES = 24


def fill(spark: SparkSession, target: str, schema: str, part: str, late: DataFrame, key: str, values: list[str], over: bool = False) -> int:
    """Puts late's values (key, *values) into all rows of the table at target with that key, and says how many partitions were written.

    Where late has the column `part` too, only rows of that partition are meant, and no other is read.
    Only null values are filled, unless `over`; so a batch that runs again changes nothing and writes nothing. Of several late rows for a key those
    with the greatest values count; null keys, unknown keys and null values do nothing. The new rows are settled before the partitions are replaced,
    each as a whole, when all of them are written.
    """
    table = spark.read.schema(schema).parquet(target)
    on = [key, part] if part in late.columns else [key]
    last = late.where(F.col(key).isNotNull()).groupBy(*on).agg(*[F.max(c).alias(f"__{c}") for c in values])
    given = [F.col(f"__{c}").isNotNull() & (~F.col(c).eqNullSafe(F.col(f"__{c}")) if over else F.col(c).isNull()) for c in values]
    changes = F.lit(False)
    for g in given:
        changes = changes | g
    touched = settled(table.join(last, on).where(changes).select(part).distinct(), "touched")
    n = touched.count()
    if n:
        rows = table.join(F.broadcast(touched) if n <= 10_000 else touched, part, "left_semi").join(last, on, "left")
        filled = rows.select(*[F.when(given[values.index(c)], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
        settled(filled, "filled").repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(target)
    return n


def fill_arrivals(stream: DataFrame, target: str, schema: str, part: str, key: str, values: list[str], checkpoint: str, over: bool = False) -> StreamingQuery:
    """Late rows as a stream: what has landed is written back, one micro-batch after the other."""
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda batch, _: fill(spark, target, schema, part, batch, key, values, over)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fill_missing(spark: SparkSession, target: str, schema: str, part: str, key: str, made: dict[str, Column], work: str, rows_a_batch: int = 200) -> StreamingQuery:
    """Computes what rows lack, in batches until none is left: made gives each column from the others of its row.

    The rows that lack one are listed first, in files of rows_a_batch rows; a stream takes a file a batch and remembers how far it came,
    so a pass that stops goes on where it was, and contents are read for listed rows alone. Of a list of more than MOST_BATCHES files a batch
    takes as many as bring the batches down to that number: they grow with the list, not their number.
    """
    table = spark.read.schema(schema).parquet(target)
    lacking = F.lit(False)
    for c in made:
        lacking = lacking | F.col(c).isNull()
    listed, listing = f"{work}/listed", f"{key} {table.schema[key].dataType.simpleString()}, {part} {table.schema[part].dataType.simpleString()}"
    table.where(lacking).select(key, part).repartitionByRange(part, key).sortWithinPartitions(part, key).write.mode("ignore").option("maxRecordsPerFile", rows_a_batch).parquet(listed)
    files_a_batch = max(1, -(-len(spark.read.schema(listing).parquet(listed).inputFiles()) // MOST_BATCHES))
    stream = spark.readStream.schema(listing).option("maxFilesPerTrigger", files_a_batch).parquet(listed)

    def batch(rows: DataFrame, _: int) -> None:
        late = spark.read.schema(schema).parquet(target).join(F.broadcast(rows) if files_a_batch * rows_a_batch <= 100_000 else rows, [key, part], "left_semi")
        fill(spark, target, schema, part, settled(late.select(key, part, *[c.alias(n) for n, c in made.items()]), "made"), key, list(made))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
