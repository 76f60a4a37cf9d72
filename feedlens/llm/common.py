"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of one word: anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a path with its scheme: spark.checkpoint.dir.

    Where that is unset, a folder of our own, on a single machine only (tests); elsewhere it is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-checkpoint-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return qualified(spark, found.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark reads it by, so that no task takes it for a folder of its own machine."""
    if "://" in path:
        return path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return re.sub(r"^file:/+", "file:///", at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back: later jobs neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The folders that stored() has written in this process, for tidy().
_written: list[str] = []


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What stored() writes inside is deleted at the end, so nothing may read it then: results are written inside too."""
    before = len(_written)
    try:
        yield
    finally:
        files = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written[before:]:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(files).delete(at, True)
        del _written[before:]


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: as cut(), but compressed, read by column and of known size.

    The folder stays until the tidy() around it ends; without one it is the caller's to clear.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """From now on the session's Arrow batches have at most so many rows and bytes, fewer where it asks for fewer.

    A batch of 10,000 texts is in memory several times over, outside the JVM's heap and in each Python worker; a small one costs little more time.
    """
    for name, most in ((ARROW_ROWS, rows), (ARROW_BYTES, size)):
        given = re.match(r"-?\d+", spark.conf.get(name, None) or "")
        if not given or not 0 < int(given[0]) <= most:
            spark.conf.set(name, str(most))


def one_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, text): one row for each id, of rows that share it the least text. Null ids and null texts are left out."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not several.limit(1).count():
        return rows
    least = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return rows.join(several, "id", "left_anti").union(least)


def heavy_keys(rows: DataFrame, key: str, least: int = 1, share: int = 4096) -> DataFrame | None:
    """(key, n) of the keys with more than `least` rows and more than 1 / share of all, so `share` keys at most; None if none."""
    bound = max(least, rows.count() // share)
    found = stored(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > bound))
    return found if found.limit(1).count() else None


def lookup(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """rows with the columns of names, which has one row a key; rows is read several times.

    Keys with more than a 4096th of the rows, 4096 at most, are looked up by broadcast, the others by a shuffled join.
    """
    heavy = heavy_keys(rows, key)
    if heavy is None:
        return rows.join(names, key)
    keys = F.broadcast(heavy.select(key))
    light = rows.join(keys, key, "left_anti").join(names.join(keys, key, "left_anti"), key)
    return light.unionByName(rows.join(F.broadcast(names.join(keys, key, "left_semi")), key))


#: Rows of a few numbers each that may be broadcast.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that the held-out contracts name. A null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def byte_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, as UTF-8; bytes.split() splits at exactly the ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_bounds(words: list[bytes], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each run of `size` words starts and ends in that.

    Fewer words make one run of all; no words make none.
    """
    joined = b" ".join(words)
    if not words:
        return joined, np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(size, len(words)) - 1
    return joined, starts[: len(words) - last], ends[last:]
