"""Relational operators, DataFrame to DataFrame. Every order ends in a unique key, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.sources.shared import settled


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle as well as after it."""
    by = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= n).drop("__n")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def where_all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """df under those conditions that are given."""
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """old, and the first row of new for each key that old doesn't have."""
    fresh = top_per_group(new.join(old.select(*key), key, "left_anti"), key, order)
    return old.unionByName(fresh.select(*old.columns))


def last_write(df: DataFrame, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """For each key the columns of its last row; one hash aggregate, no sort."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], merge: dict[str, Column]) -> DataFrame:
    """Full outer merge by key; merge gives each column from old.<c> and new.<c>."""
    a, b = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key]
    keys = [F.coalesce(F.col(f"old.{k}"), F.col(f"new.{k}")).alias(k) for k in key]
    return a.join(b, on, "full_outer").select(*keys, *[c.alias(n) for n, c in merge.items()])


def without(df: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return df.join(gone.select(*key), key, "left_anti")


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most most_rows rows, as it is beyond. The count runs df's plan: give it a settled df."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Rows of a group that one task may order by itself.
ONE_TASK = 1_000_000


def _ordered_in_a_task(df: DataFrame, group: list[str]) -> bool:
    return (df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) <= ONE_TASK


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, total: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """df with `name`: 1, 2, ... in each group by order, however large a group is.

    Rows are dealt out in ranges of group and order, so a large group takes several tasks; a range's rows are numbered by
    themselves and moved on by the rows of the ranges before it. total: also the group's number of rows. sums: for
    {name: column} also the sum of the column over the rows before, and under name + "_all" over the group. The order must end in
    a key that is unique in the group. Null groups are a group. Where no group has more than ONE_TASK rows, which a count tells, each is
    numbered in one task, to the same numbers; that saves writing the rows.
    """
    sums = sums or {}
    if _ordered_in_a_task(df, group):
        by, ordered = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(*order)
        out = {name: F.row_number().over(ordered).cast("long")}
        if total:
            out[total] = F.count("*").over(by)
        for n, c in sums.items():
            out[n] = F.coalesce(F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            out[f"{n}_all"] = F.sum(c).over(by)
        return df.withColumns(out).select(*df.columns, *out)
    placed = settled(df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("__p", F.spark_partition_id()), "order")
    parts = placed.groupBy(*group, "__p").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = parts.select(
        *[F.col(c).alias(f"__g_{c}") for c in group], F.col("__p").alias("__q"), zero(F.sum("__n").over(before)).alias("__o"), F.sum("__n").over(whole).alias("__t"),
        *[zero(F.sum(f"__s_{n}").over(before)).alias(f"__o_{n}") for n in sums], *[F.sum(f"__s_{n}").over(whole).alias(f"__t_{n}") for n in sums],
    )  # a row a group and range
    on = F.col("__p") == F.col("__q")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    local = Window.partitionBy(*group, "__p").orderBy(*order)
    found = placed.join(offsets, on)
    out = {name: F.row_number().over(local) + F.col("__o")}
    if total:
        out[total] = F.col("__t")
    for n, c in sums.items():
        out[n] = F.col(f"__o_{n}") + zero(F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, -1)))
        out[f"{n}_all"] = F.col(f"__t_{n}")
    return found.withColumns(out).select(*df.columns, *out)


def neighbours(df: DataFrame, group: list[str], order: list[Column], key: str, steps: int) -> DataFrame:
    """(group, key, before1, ..., after1, ...): the keys of the rows up to `steps` before and after each row of its group."""
    if _ordered_in_a_task(df, group):
        by, sides = Window.partitionBy(*group).orderBy(*order), range(1, steps + 1)
        return df.select(*group, key, *[F.lag(key, k).over(by).alias(f"before{k}") for k in sides], *[F.lead(key, k).over(by).alias(f"after{k}") for k in sides])
    rows = settled(numbered(df.select(*group, key, *[c for c in df.columns if c not in (*group, key)]), group, order, "__i").select(*group, key, "__i"), "places")
    # every row is sent to the places around its own, where the row that stands there gathers them
    step = F.explode(F.array(*[F.lit(k) for k in range(-steps, steps + 1)])).alias("__d")
    sent = rows.select(*group, key, "__i", step).withColumn("__at", F.col("__i") - F.col("__d"))
    at = lambda k, n: F.max(F.when(F.col("__d") == k, F.col(key))).alias(n)
    found = sent.groupBy(*group, "__at").agg(at(0, key), *[at(-k, f"before{k}") for k in range(1, steps + 1)], *[at(k, f"after{k}") for k in range(1, steps + 1)])
    return found.where(F.col(key).isNotNull()).drop("__at")


def rank_share(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Place in the group from 0 to 1: (row - 1) / max(1, rows - 1). Unlike percent_rank, ties get different places."""
    rows = numbered(df, group, order, "__i", "__c")
    return rows.withColumn(name, (F.col("__i") - 1) / F.greatest(F.lit(1), F.col("__c") - 1)).drop("__i", "__c")
