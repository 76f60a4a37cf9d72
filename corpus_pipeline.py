"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

All stages take empty tables, null and empty texts, and further columns. A null text counts as empty for toxicity and near
copies, and holds no passages and no benchmark item. Each stage says what it does with null ids and repeated ones.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import decontaminate, queries, simhash, substrings, toxicity
from feedlens.llm.common import WORD, shared_dir, small_batches, stored, table, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half; every row is scored by its own text, whatever its id."""
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model, score_col="__score").where("__score < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id.

    Of rows that share it, that with the least text hash stays, once if it is repeated. Rows with a null id stay as they are.
    """
    groups = simhash.near_copies(docs, "doc_id", "text")
    gone = groups.where("not first").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__of", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = hashed.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("__gone")) & (F.col("__of") == F.col("__hash")), "left_anti")
    again = stored(groups.where("first").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id"))
    if again.limit(1).count():
        once = kept.join(again, F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "__of"])
        kept = kept.join(again, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(once)
    return kept.drop("__of")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat one of a document with a smaller id are cut out.

    Documents of which nothing is left go. Rows with a null id stay as they are; of rows that share an id and differ in text, those
    with the least text are compared and cut.
    """
    return substrings.cut_passages(docs, substrings.near_passages(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; rows go by their texts, so equal ones go together, with a null id too."""
    hashed = docs.withColumn("__of", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = decontaminate.find_benchmark(hashed.select("__of", "text"), table(spark, sf_dir, "benchmark"), id_col="__of")
    gone = found.select(F.col("__of").alias("__gone")).distinct()
    return hashed.join(gone.hint("shuffle_hash"), F.col("__of") == F.col("__gone"), "left_anti").drop("__of")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each epoch that takes a document, with the text that it takes.

    Whole epochs take the whole text, the last one, partial, the first part_tokens words, joined by single blanks; so the
    rows' texts have the budgeted tokens, n_tokens each, and n_chars is their length. epoch counts from 1, and domain is the
    document's. Columns of these names are replaced. Equal rows, and rows with a null id, are rows like any other. Of rows with the same id,
    text, language and source as many are taken as the budget says, all with the further columns of one of them. Texts without words are in no epoch.
    """
    keyed = docs.drop("domain", "epoch", "n_tokens").withColumn("__key", F.concat_ws("-", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    columns = {"doc_id": "__id", "domain": "__domain", "lang": "__lang", "source": "__source", "n_tokens": "__n_tokens", "epochs": "__epochs", "part_tokens": "__part_tokens"}
    taken = stored(queries.mixed(keyed.drop("doc_id").withColumnRenamed("__key", "doc_id")).select(*[F.col(c).alias(n) for c, n in columns.items()]))
    several = stored(taken.groupBy("__id").agg(F.count("*").alias("__m")).where("__m > 1").select(F.col("__id").alias("__several")))
    taken = taken.where("__epochs > 0 or __part_tokens > 0")
    same = F.col("__key") == F.col("__id")
    if several.limit(1).count():
        # Rows that are alike are taken by their number: each task's count of each share, for one row that stands for them.
        repeated = F.col("__id") == F.col("__several")
        counts = taken.join(several, repeated, "left_semi").groupBy(*taken.columns, F.spark_partition_id().alias("__task")).agg(F.count("*").alias("__m"))
        one = keyed.join(several, F.col("__key") == F.col("__several"), "left_semi").dropDuplicates(["__key", "lang", "source"])
        alike = one.join(counts.hint("shuffle_hash"), same & F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")))
        alike = alike.withColumn("__m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m")))).drop("__m", "__task")
        rows = keyed.join(taken.join(several, repeated, "left_anti").hint("shuffle_hash"), same).unionByName(alike)
    else:
        rows = keyed.join(taken.hint("shuffle_hash"), same)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__epochs") + (F.col("__part_tokens") > 0).cast("long"))))
    partial = F.col("epoch") > F.col("__epochs")
    prefix = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("__part_tokens").cast("int")), " ")
    rows = rows.withColumns({
        "text": F.when(partial, prefix).otherwise(F.col("text")), "domain": F.col("__domain"), "n_tokens": F.when(partial, F.col("__part_tokens")).otherwise(F.col("__n_tokens")),
    })
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).drop("__key", *columns.values())


def light(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with small Arrow batches, which stay set: what a stage returns is worked on after it has returned."""

    @functools.wraps(stage)
    def of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return of


STAGES = [
    ("toxicity", light(drop_toxic)),
    ("simhash", light(drop_near_copies)),
    ("substrings", light(cut_repeats)),
    ("decontaminate", light(drop_contaminated)),
    ("mix", light(mix_sources)),
]

#: Neither the fitted classifier nor the passage search can be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with tidy(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
