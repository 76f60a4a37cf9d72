"""State in numbered versions: a batch writes its own number, from what lower numbers left, so a batch that runs again is harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, text: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The versions that are complete, in order. A version that a lost driver began has no mark of success."""
    at, files = _path(spark, f"{folder}/v*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in files.globStatus(at) or ())


def write(rows: DataFrame, folder: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/v{number}")


def read(spark: SparkSession, folder: str, schema: str, some: list[int]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{folder}/v{n}" for n in some]) if some else spark.createDataFrame([], schema)


def remove(spark: SparkSession, folder: str, some: list[int]) -> None:
    for n in some:
        at, files = _path(spark, f"{folder}/v{n}")
        files.delete(at, True)
