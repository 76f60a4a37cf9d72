"""Article scores as one Catalyst plan: weights joined to labels, a sum of named terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import numbers, text
from feedlens.operators.relational import rank_share, small

#: Fixed values of the score.
REGION_FACTOR, SECONDARY_FACTOR, SECONDARY_CAP = 0.3, 0.3, 1.0
VOTE_PENALTY = -4.0
TARGET_FLOOR = 0.02


def scores(articles: DataFrame, weights: DataFrame, votes: DataFrame, shown: DataFrame, as_of: Column) -> DataFrame:
    """(id, topic, type, region, secondary, fresh, vote_penalty, exposure, score) of each article.

    weights: axis, label, effective; shown: article_id, n, last_seen_at. Labels without weight count 0; saved articles
    have no exposure. The weights are one row a label, broadcast while they are small.
    """
    known = small(weights.select("axis", "label", "effective"))
    narrow = articles.select("id", "source_id", "pub_date", "primary_topic", "region", "article_type", "is_saved")
    ranked = rank_share(narrow, ["source_id"], [F.desc("pub_date"), F.desc("id")], "pct")
    for axis, column in (("topic", "primary_topic"), ("type", "article_type"), ("region", "region")):
        own = known.where(F.col("axis") == axis).select(F.col("label").alias(column), F.col("effective").alias(f"w_{axis}"))
        ranked = ranked.join(own, column, "left").fillna(0.0, [f"w_{axis}"])
    labels = articles.select("id", F.explode(F.transform(text.labels_of(F.col("secondary_topics")), text.canonical_label)).alias("label"))
    secondary = known.where("axis = 'secondary'").select("label", "effective")
    subtotal = labels.join(secondary, "label").groupBy("id").agg(F.sum("effective").alias("raw_secondary"))
    page = ranked.join(subtotal, "id", "left").join(votes.select(F.col("article_id").alias("id"), "vote"), "id", "left")
    page = page.join(shown.select(F.col("article_id").alias("id"), F.col("n").alias("times"), "last_seen_at"), "id", "left")
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))) / 3600e6
    secondary_score = numbers.clamp(SECONDARY_FACTOR * F.coalesce("raw_secondary", F.lit(0.0)), F.greatest(F.lit(SECONDARY_CAP), F.abs("w_topic")))
    out = page.select(
        "id", "source_id", "primary_topic", "region", "article_type", "vote", "times",
        F.col("w_topic").alias("t_topic"), F.col("w_type").alias("t_type"), (REGION_FACTOR * F.col("w_region")).alias("t_region"),
        secondary_score.alias("t_secondary"), numbers.freshness(F.col("pct")).alias("t_fresh"),
        F.when(F.col("vote") == "show_less", VOTE_PENALTY).otherwise(0.0).alias("t_vote"),
        F.when(F.col("is_saved") == 1, 0.0).otherwise(numbers.exposure_penalty(F.col("times"), hours)).alias("t_exposure"),
    )
    terms = [c for c in out.columns if c.startswith("t_")]
    return out.withColumn("score", sum((F.col(c) for c in terms), F.lit(0.0)))


def terms(scored: DataFrame) -> DataFrame:
    """(id, term, contribution): the score taken apart; contributions of an article add up to it."""
    names = [c for c in scored.columns if c.startswith("t_")]
    return scored.unpivot(["id"], names, "term", "contribution").withColumn("term", F.substring("term", 3, 20))


def target_distribution(weights: DataFrame, floor: float = TARGET_FLOOR) -> DataFrame:
    """(axis, label, share): softmax of the effective weights within an axis, no label below the floor, renormalised."""
    by = Window.partitionBy("axis")
    p = F.exp("effective") / F.sum(F.exp("effective")).over(by)
    out = weights.withColumn("p", p).withColumn("p", F.greatest(F.col("p"), F.lit(floor)))
    return out.select("axis", "label", (F.col("p") / F.sum("p").over(by)).alias("share"))
