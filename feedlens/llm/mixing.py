"""Mixing sources to target weights: hierarchical budgets over domain, language and source, and seeded epochs.

A token budget flows down the tree. At each node the children share it by weight, none above what its subtree can
give (its tokens times max_epochs); what one cannot take goes to its siblings, and only what no sibling can take was
never given to their parent, whose own siblings get it. A leaf then takes whole epochs, and of the next epoch, in a
seeded order, a prefix of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.llm.common import WORD, cut

MISSING = "\x00"


def n_tokens(text: Column) -> Column:
    """Words of the whole text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    """The integer weight of a node's name, 1 where none is given."""
    out = F.lit(1)
    for key, weight in weights.items():
        out = F.when(name == key, weight).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """nodes (parent columns, key, weight, cap, budget of the parent) with `given`: water-filling among siblings.

    Siblings in the order of cap to weight are filled up while they stay below the level that the rest would have.
    All whole numbers; a share is rounded down, so at most a token a sibling stays unspent.
    """
    by = Window.partitionBy(*parent)
    before = by.orderBy(F.col("cap") / F.col("weight"), "cap", key).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumns(
        {
            "__left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "__rest": F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    full = F.col("cap").cast("decimal(38,0)") * F.col("__rest") <= F.col("__left").cast("decimal(38,0)") * F.col("weight")
    level = F.struct(F.col("__rest").alias("rest"), F.col("__left").alias("left"))
    out = out.withColumn("__full", full)
    out = out.withColumn("__level", F.max(F.when(~F.col("__full"), level)).over(by))
    part = F.floor(F.col("__level.left").cast("decimal(38,0)") * F.col("weight") / F.col("__level.rest")).cast("long")
    given = F.when(F.col("__full") | F.col("__level").isNull(), F.col("cap")).otherwise(F.least("cap", part))
    return out.withColumn("given", F.greatest(F.lit(0), given).cast("long")).drop("__left", "__rest", "__full", "__level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float) -> DataFrame:
    """leaves (level columns, tokens, cap) with `given`; share: of all tokens, what there is to give."""
    parents = None
    for depth, level in enumerate(levels):
        up, here = levels[:depth], levels[: depth + 1]
        nodes = leaves.groupBy(*here).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        if up:
            nodes = nodes.join(parents, up)
        else:  # the root's children, a few rows, share its budget
            all_of = lambda c: F.sum(c).over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.least(F.floor(all_of("tokens") * F.lit(share)).cast("long"), all_of("cap")))
        nodes = share_out(nodes, up or [F.lit(0)], level)
        parents = nodes.select(*here, F.col("given").alias("budget"))
    return nodes.select(*levels, "tokens", "cap", "given")


def prefix_shares(rows: DataFrame, leaf: list[str]) -> DataFrame:
    """rows (leaf, order: hex string, id, tokens, rest) with `taken`: tokens of each row in the leaf's prefix of `rest`.

    The running sum is taken over the first two hex digits, then the next two, then the rows of such a group, so no
    task orders a whole leaf.
    """
    rows = rows.withColumns({"__a": F.substring("order", 1, 2), "__b": F.substring("order", 3, 2)})
    rows = rows.repartition(*[F.col(c) for c in [*leaf, "__a", "__b"]])  # else a partitioning by leaf alone would do for the windows below
    sums = rows.groupBy(*leaf, "__a", "__b").agg(F.sum("tokens").alias("__n"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upper = sums.groupBy(*leaf, "__a").agg(F.sum("__n").alias("__m"))
    upper = upper.withColumn("__p", F.coalesce(F.sum("__m").over(before(leaf, ["__a"])), F.lit(0))).drop("__m")
    lower = sums.withColumn("__q", F.coalesce(F.sum("__n").over(before([*leaf, "__a"], ["__b"])), F.lit(0))).drop("__n")
    starts = lower.join(upper, [*leaf, "__a"]).select(*leaf, "__a", "__b", (F.col("__p") + F.col("__q")).alias("__s"))
    own = F.coalesce(F.sum("tokens").over(before([*leaf, "__a", "__b"], ["order", "id", "tokens"])), F.lit(0))
    rows = rows.withColumn("__own", own).join(starts, [*leaf, "__a", "__b"])
    taken = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("__s") - F.col("__own")))
    return rows.withColumn("taken", taken.cast("long")).drop("__a", "__b", "__own", "__s")


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float = 0.6, max_epochs: int = 3,
    id_col: str = "doc_id", text_col: str = "text", seed: str = "mix-1",
) -> DataFrame:
    """One row for each row of docs: id, the levels, n_tokens, epochs (whole ones), part_tokens, taken_tokens.

    The budget is `share` of all tokens. A text's tokens are its words; in the partial epoch the first part_tokens
    of them are taken. A missing level is a node of its own, returned as null. Null ids and repeated rows are rows like
    any other, ordered after their order hash by id and length. Texts without words take nothing. Other columns aren't read.
    """
    names = list(levels)
    keys = {f"__k{n}": F.coalesce(c.cast("string"), F.lit(MISSING)) for n, c in enumerate(levels.values())}
    rows = cut(docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in keys.items()], n_tokens(F.col(text_col)).alias("tokens")))
    leaves = rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
    named = {f"__k{n}": weights.get(name, {}) for n, name in enumerate(names)}
    given = cut(leaf_budgets(leaves, list(keys), named, float(share)))
    given = given.withColumns(
        {
            "epochs": F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(F.lit(0)).cast("long"),
            "rest": F.when(F.col("tokens") > 0, F.col("given") % F.col("tokens")).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("tokens", "cap", "given")
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = prefix_shares(rows.join(given, list(keys)).withColumn("order", order), list(keys))
    return rows.select(
        F.col("id").alias(id_col),
        *[F.nullif(F.col(k), F.lit(MISSING)).alias(n) for k, n in zip(keys, names)],
        F.col("tokens").alias("n_tokens"),
        F.when(F.col("tokens") > 0, F.col("epochs")).otherwise(0).cast("long").alias("epochs"),
        F.col("taken").alias("part_tokens"),
        (F.col("epochs") * F.col("tokens") + F.col("taken")).alias("taken_tokens"),
    )
