"""The review of labels for people: every axis, its labels by share, with examples, as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.operators import relational as rel

#: Fixed column names of the review sheet. The last two are for the reader to fill in.
COLUMNS = ("Axis", "Name", "Sample_Count", "Est_Daily_Flow_Articles", "Est_Share_Pct", "Example_Headlines", "Evaluation (more/less/depends)", "User_Comments")


def review_rows(articles: DataFrame, axes: dict[str, str], days: int, examples: int = 5) -> DataFrame:
    """COLUMNS and `order`: a row for each label of each axis; axes gives each axis' name to a column of articles (id, title, ...).

    Shares are of the axis' articles with a label, in percent; the flow is articles a day. Examples are the titles of the smallest ids.
    order is the place in the axis, by share, then name. Null labels and titles are left out.
    """
    labels = [c for c in axes.values()]
    long = articles.select("id", "title", *labels).unpivot(["id", "title"], labels, "column", "Name").where("Name IS NOT NULL")
    axis = F.element_at(F.create_map(*[F.lit(x) for name, c in axes.items() for x in (c, name)]), F.col("column"))
    long = long.select(axis.alias("Axis"), "Name", "id", "title")
    counts = long.groupBy("Axis", "Name").agg(F.count("*").alias("n"))
    totals = counts.groupBy("Axis").agg(F.sum("n").alias("total"))  # a row an axis
    first = rel.top_per_group(long.where("title IS NOT NULL"), ["Axis", "Name"], [F.col("id")], examples)
    first = first.groupBy("Axis", "Name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda x: x["title"]), " | ").alias("Example_Headlines"))
    rows = rel.numbered(counts.join(F.broadcast(totals), "Axis"), ["Axis"], [F.desc("n"), F.col("Name")], "order").join(first, ["Axis", "Name"], "left")
    share = F.format_string("%.1f%%", F.col("n") * 100.0 / F.col("total"))
    return rows.select("Axis", "Name", F.col("n").alias("Sample_Count"), F.round(F.col("n") / F.lit(float(days)), 1).alias("Est_Daily_Flow_Articles"), share.alias("Est_Share_Pct"), F.coalesce("Example_Headlines", F.lit("")).alias("Example_Headlines"), F.lit("").alias(COLUMNS[6]), F.lit("").alias(COLUMNS[7]), "order")


CSV = {"header": "true", "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def write_review(rows: DataFrame, folder: str, rows_a_file: int = 100_000) -> None:
    """CSV files below folder/Axis=<axis>, in order within and between them; an axis of many labels has several."""
    ordered = rows.repartitionByRange("Axis", "order").sortWithinPartitions("Axis", "order")
    ordered.drop("order").write.partitionBy("Axis").options(**CSV, maxRecordsPerFile=str(rows_a_file)).csv(folder)


def read_review(spark, folder: str) -> DataFrame:
    kinds = {"Sample_Count": "long", "Est_Daily_Flow_Articles": "double"}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in (*COLUMNS[1:], "Axis"))
    return spark.read.schema(schema).options(**CSV).csv(folder).select(*COLUMNS)
