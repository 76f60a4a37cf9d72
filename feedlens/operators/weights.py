"""Label weights learned from votes and reading: decayed tallies, saturation, priors.

Everything is grouped sums over (axis, label): map-side sums, one shuffle of label rows, small joins after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import numbers, text

#: Fixed values of the preference model.
HALF_LIFE_DAYS = 90.0
EXPLICIT = {"secondary": (1.2, 6.0)}
EXPLICIT_CAP, EXPLICIT_K = 4.0, 17.0
BEHAVIOUR_CAP, BEHAVIOUR_CAP_SECONDARY = 1.0, 0.3
SIGNALS = {"open": 1.0, "hover": 0.6, "skip": -0.4, "read_no_vote": -0.1}
READ_COMPLETE = 0.5
PRIOR_FACTOR, PRIOR_FADE = 0.35, 3.0
EFFECTIVE_CAP = 5.5
AXES = ("topic", "secondary", "region", "type")


def usable(label: Column) -> Column:
    return label.isNotNull() & ~label.isin("", "unknown")


def axes(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with labels (primary_topic, secondary_topics, region, article_type), one row for each (axis, label)."""
    secondary = F.array_distinct(F.transform(text.labels_of(F.col("secondary_topics")), text.canonical_label))
    one = lambda axis, c: F.array(F.struct(F.lit(axis).alias("axis"), F.col(c).alias("label")))
    pairs = F.concat(
        one("topic", "primary_topic"), one("region", "region"), one("type", "article_type"),
        F.transform(secondary, lambda s: F.struct(F.lit("secondary").alias("axis"), s.alias("label"))),
    )
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.axis", "p.label").where(usable(F.col("label")))


def cooccurrence(articles: DataFrame) -> DataFrame:
    """(label, topic, n): articles that carry both, each counted once."""
    labels = F.array_distinct(F.transform(text.labels_of(F.col("secondary_topics")), text.canonical_label))
    rows = articles.where(usable(F.col("primary_topic"))).select(F.col("primary_topic").alias("topic"), F.explode(labels).alias("label"))
    return rows.where(F.col("label") != "").groupBy("label", "topic").agg(F.count("*").alias("n"))


def vote_tally(votes: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """(axis, label, tally, votes): show_more counts +1, anything else -1, halved every half-life."""
    labels = articles.select(F.col("id").alias("article_id"), "primary_topic", "secondary_topics", "region", "article_type")
    rows = axes(votes.join(labels, "article_id"), "vote", "updated_at")
    value = F.when(F.col("vote") == "show_more", 1.0).otherwise(-1.0) * numbers.decay(numbers.age_days(F.col("updated_at"), as_of), HALF_LIFE_DAYS)
    return rows.groupBy("axis", "label").agg(F.sum(value).alias("tally"), F.count("*").alias("votes"))


def completion_tally(events: DataFrame, votes: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """(axis, label, tally): the earliest completion of each article that has no vote, half a vote each."""
    first = events.where("event_type = 'read_complete'").groupBy("article_id").agg(F.min("created_at").alias("at"))
    first = first.join(votes.select("article_id"), "article_id", "left_anti")
    labels = articles.select(F.col("id").alias("article_id"), "primary_topic", "secondary_topics", "region", "article_type")
    value = READ_COMPLETE * numbers.decay(numbers.age_days(F.col("at"), as_of), HALF_LIFE_DAYS)
    return axes(first.join(labels, "article_id"), "at").groupBy("axis", "label").agg(F.sum(value).alias("tally"))


def behavioural_tally(events: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """(axis, label, behaviour): opens, hovers and skips; a skip counts from a second of dwelling on."""
    value = F.lit(0.0)
    for kind, weight in SIGNALS.items():
        hit = F.col("event_type") == kind
        value = F.when(hit & (F.col("dwell_seconds") >= 1) if kind == "skip" else hit, weight).otherwise(value)
    labels = articles.select(F.col("id").alias("article_id"), "primary_topic", "secondary_topics", "region", "article_type")
    decayed = value * numbers.decay(numbers.age_days(F.col("created_at"), as_of), HALF_LIFE_DAYS)
    # Summed by article first: an article has a few labels, but any number of events.
    per_article = events.groupBy("article_id").agg(F.sum(decayed).alias("v")).where("v <> 0")
    return axes(per_article.join(labels, "article_id"), "v").groupBy("axis", "label").agg(F.sum("v").alias("behaviour"))


def saturated(axis: Column, tally: Column) -> Column:
    cap, k = EXPLICIT["secondary"]
    return F.when(axis == "secondary", numbers.saturate(tally, cap, k)).otherwise(numbers.saturate(tally, EXPLICIT_CAP, EXPLICIT_K))


def saturated_behaviour(axis: Column, tally: Column) -> Column:
    _, k = EXPLICIT["secondary"]
    return F.when(axis == "secondary", numbers.saturate(tally, BEHAVIOUR_CAP_SECONDARY, k)).otherwise(numbers.saturate(tally, BEHAVIOUR_CAP, EXPLICIT_K))


def label_weights(votes: DataFrame, events: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """(axis, label, votes, explicit, behavioural, prior, effective, contested)."""
    explicit = vote_tally(votes, articles, as_of)
    read = completion_tally(events, votes, articles, as_of).withColumnRenamed("tally", "read")
    behaved = behavioural_tally(events, articles, as_of)
    joined = explicit.join(read, ["axis", "label"], "full_outer").join(behaved, ["axis", "label"], "full_outer").fillna(0.0)
    joined = joined.select(
        "axis", "label", F.coalesce("votes", F.lit(0)).alias("votes"), F.col("tally"),
        saturated(F.col("axis"), F.col("tally") + F.col("read")).alias("explicit"), saturated_behaviour(F.col("axis"), F.col("behaviour")).alias("behavioural"),
    )
    topics = joined.where("axis = 'topic'").select(F.col("label").alias("topic"), numbers.clamp(F.col("explicit") + F.col("behavioural"), EFFECTIVE_CAP).alias("te"))
    shared = cooccurrence(articles).join(topics, "topic", "left")
    priors = shared.groupBy("label").agg((PRIOR_FACTOR * F.sum(F.col("n") * F.coalesce("te", F.lit(0.0))) / F.sum("n")).alias("raw"))
    priors = priors.select(F.lit("secondary").alias("axis"), "label", "raw")
    out = joined.join(priors, ["axis", "label"], "full_outer").fillna(0.0, ["tally", "explicit", "behavioural", "raw"]).fillna(0, ["votes"])
    out = out.withColumn("prior", F.col("raw") * (PRIOR_FADE / (F.col("votes") + PRIOR_FADE)))
    return out.select(
        "axis", "label", "votes", "explicit", "behavioural", "prior",
        numbers.clamp(F.col("prior") + F.col("explicit") + F.col("behavioural"), EFFECTIVE_CAP).alias("effective"),
        ((F.col("votes") >= 8) & (F.abs(F.col("tally")) / F.greatest(F.lit(1), F.col("votes")) < 0.25)).alias("contested"),
    )
