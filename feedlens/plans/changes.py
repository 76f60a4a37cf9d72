"""Inserts, upserts, deletes, state changes and delta reads, each as a DataFrame of the new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.operators import relational as rel
from feedlens.operators import status
from feedlens.plans.registry import query
from feedlens.sources.shared import settled
from feedlens.sources.tables import Reader

LATE = "TIMESTAMP '2024-01-20 00:00:00'"


def late():
    return F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))


@query("U03", """
WITH o AS (SELECT source_id, url, id FROM feed_articles WHERE created_at < TIMESTAMP '2024-01-20 00:00:00'), n AS (SELECT source_id, url, min(id) AS id FROM feed_articles WHERE (source_id, url) NOT IN (SELECT (source_id, url) FROM o) GROUP BY 1, 2)
SELECT * FROM o UNION ALL SELECT * FROM n""")
def insert_ignore_new_urls(r: Reader) -> DataFrame:
    rows = r.feed_articles.select("source_id", "url", "id", "created_at")
    old = rows.where(F.col("created_at") < late()).drop("created_at")
    arrived = rows.drop("created_at").unionByName(rows.drop("created_at"))  # what is known already, and everything twice
    return rel.insert_ignore(old, arrived, ["source_id", "url"], [F.col("id")])


@query("U04 A09", f"""
SELECT article_id, count(*) AS n, max(created_at) AS last_seen_at FROM user_article_events WHERE event_type = 'impression' GROUP BY 1""")
def impression_upsert(r: Reader) -> DataFrame:
    """The counters after a second batch, merged into those after the first."""
    events = r.user_article_events
    old = status.impressions(events.where(F.col("created_at") < late()))
    new = status.impressions(events.where(F.col("created_at") >= late()))
    count = F.coalesce(F.col("old.n"), F.lit(0)) + F.coalesce(F.col("new.n"), F.lit(0))
    return rel.upsert(old, new, ["article_id"], {"n": count, "last_seen_at": F.greatest("old.last_seen_at", "new.last_seen_at")})


@query("K11", """
WITH v AS (SELECT event_id AS n, event_id % (SELECT count(*) + 20 FROM feed_articles) AS article_id, CASE event_id % 5 WHEN 0 THEN 'show_less' WHEN 1 THEN NULL WHEN 2 THEN 'maybe' ELSE 'show_more' END AS vote FROM events WHERE event_id % 3 = 0),
ok AS (SELECT v.* FROM v JOIN feed_articles a ON a.id = v.article_id WHERE vote IS NULL OR vote IN ('show_more', 'show_less')),
l AS (SELECT article_id, arg_max(coalesce(vote, ''), n) AS vote, count(vote) > 0 AS voted FROM ok GROUP BY 1),
a AS (SELECT id, primary_topic, is_read FROM feed_articles)
SELECT 'vote' AS kind, CAST(a.id AS BIGINT) AS article_id, coalesce(nullif(l.vote, ''), o.vote) AS value, a.primary_topic AS topic FROM a LEFT JOIN article_votes o ON o.article_id = a.id LEFT JOIN l ON l.article_id = a.id WHERE l.vote <> '' OR (l.vote IS NULL AND o.vote IS NOT NULL)
UNION ALL SELECT 'event', article_id, vote, primary_topic FROM ok JOIN a ON a.id = ok.article_id WHERE vote IS NOT NULL
UNION ALL SELECT 'read', a.id, CAST(CASE WHEN l.voted THEN 1 ELSE a.is_read END AS VARCHAR), a.primary_topic FROM a LEFT JOIN l ON l.article_id = a.id""")
def recorded_votes(r: Reader) -> DataFrame:
    """A batch of votes as one write: the votes, the events and the read states after it.

    A vote of none takes the vote back and leaves no event; other unknown values and unknown articles are refused; the last
    vote of an article counts, each one is an event, and any marks the article read. Labels come from the article.
    """
    n = r.feed_articles.count() + 20
    key = F.col("event_id")
    given = F.element_at(F.array(F.lit("show_less"), F.lit(None), F.lit("maybe"), F.lit("show_more"), F.lit("show_more")), (key % 5 + 1).cast("int"))
    batch = r.events.where(key % 3 == 0).select(key.alias("n"), (key % n).alias("article_id"), given.alias("vote"))
    return status.recorded_votes(r.feed_articles.select(F.col("id").alias("article_id"), "primary_topic", "is_read"), r.article_votes.select("article_id", "vote"), batch)


@query("U05", """
WITH o AS (SELECT article_id, vote, CASE WHEN article_id % 2 = 0 THEN 'kept' END AS topic FROM article_votes WHERE article_id % 3 < 2), n AS (SELECT article_id, 'show_less' AS vote, CASE WHEN article_id % 4 = 0 THEN 'new' END AS topic FROM article_votes WHERE article_id % 3 > 0)
SELECT article_id, coalesce(n.vote, o.vote) AS vote, coalesce(n.topic, o.topic) AS topic FROM o FULL JOIN n USING (article_id)""")
def vote_upsert(r: Reader) -> DataFrame:
    key = F.col("article_id")
    old = r.article_votes.where(key % 3 < 2).select(key, "vote", F.when(key % 2 == 0, "kept").alias("topic"))
    new = r.article_votes.where(key % 3 > 0).select(key, F.lit("show_less").alias("vote"), F.when(key % 4 == 0, "new").alias("topic"))
    return rel.upsert(old, new, ["article_id"], {c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")) for c in ("vote", "topic")})


@query("U06 U13 T12", """
SELECT user_id, article_id, arg_max(event_type, (created_at, id)) AS state, max(created_at) AS changed FROM user_article_events GROUP BY 1, 2""")
def last_state(r: Reader) -> DataFrame:
    last = rel.last_write(r.user_article_events, ["user_id", "article_id"], [F.col("created_at"), F.col("id")], ["event_type", "created_at"])
    return last.select("user_id", "article_id", F.col("event_type").alias("state"), F.col("created_at").alias("changed"))


@query("T12", """
WITH o AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS place, id % 97 = 96 AS fails FROM user_article_events WHERE event_type IN ('open', 'read_complete')),
f AS (SELECT user_id, min(place) AS stop FROM o WHERE fails GROUP BY 1)
SELECT id, user_id, place < coalesce(stop, place + 1) AS sent FROM o LEFT JOIN f USING (user_id)""")
def offline_flush(r: Reader) -> DataFrame:
    """Each reader's waiting actions in order: those before the first that fails are sent, it and all after it stay."""
    waiting = r.user_article_events.where(F.col("event_type").isin("open", "read_complete")).select("id", "user_id", "created_at", (F.col("id") % 97 == 96).alias("fails"))
    order = lambda: F.struct("created_at", "id")
    stops = waiting.where("fails").groupBy("user_id").agg(F.min(order()).alias("stop"))
    return waiting.join(stops, "user_id", "left").select("id", "user_id", (F.col("stop").isNull() | (order() < F.col("stop"))).alias("sent"))


@query("U07", """
SELECT 'article' AS kind, id FROM feed_articles WHERE source_id NOT IN (3, 5) UNION ALL SELECT 'event', id FROM user_article_events""")
def delete_cascade(r: Reader) -> DataFrame:
    gone = r.feed_sources.where(F.col("id").isin(3, 5)).select(F.col("id").alias("source_id"))
    kept = rel.without(r.feed_articles, gone, ["source_id"]).select(F.lit("article").alias("kind"), "id")
    return kept.unionByName(r.user_article_events.select(F.lit("event").alias("kind"), "id"))


@query("U08", f"""
SELECT id, CASE WHEN source_id = 4 OR (created_at <= {LATE} AND source_id IN (SELECT id FROM feed_sources WHERE category_id = 2)) THEN 1 ELSE is_read END AS is_read FROM feed_articles""")
def mark_read(r: Reader) -> DataFrame:
    sources = r.feed_sources.where("category_id = 2").select(F.col("id").alias("source_id"), F.lit(True).alias("mine"))
    rows = r.feed_articles.select("id", "source_id", "created_at", "is_read").join(sources, "source_id", "left")
    hit = (F.col("source_id") == 4) | ((F.col("created_at") <= late()) & F.coalesce("mine", F.lit(False)))
    return rows.select("id", F.when(hit, 1).otherwise(F.col("is_read")).alias("is_read"))


@query("U09 U10 U12", """
SELECT id, CASE WHEN parse_status = 'failed' THEN 'pending' ELSE parse_status END AS parse_status, CASE WHEN parse_status = 'failed' THEN 0 ELSE retry_count END AS retry_count, 1 - is_saved AS is_saved FROM feed_articles""")
def reset_failed(r: Reader) -> DataFrame:
    failed = F.col("parse_status") == "failed"
    return r.feed_articles.select(
        "id", F.when(failed, "pending").otherwise(F.col("parse_status")).alias("parse_status"), F.when(failed, 0).otherwise(F.col("retry_count")).alias("retry_count"), (1 - F.col("is_saved")).alias("is_saved")
    )


@query("U01 U02", """
(SELECT primary_topic AS label FROM feed_articles UNION SELECT region FROM feed_articles) EXCEPT SELECT article_type FROM feed_articles""")
def label_set_algebra(r: Reader) -> DataFrame:
    labels = lambda c: r.feed_articles.select(F.col(c).alias("label"))
    return labels("primary_topic").union(labels("region")).distinct().exceptAll(labels("article_type").distinct())


@query("S16", """
WITH o AS (SELECT id, content FROM feed_articles WHERE id % 3 < 2), n AS (SELECT id, CASE WHEN id % 2 = 0 THEN title END AS content FROM feed_articles WHERE id % 3 > 0)
SELECT id, coalesce(n.content, o.content) AS content FROM o FULL JOIN n USING (id)""")
def client_store_merge(r: Reader) -> DataFrame:
    old = r.feed_articles.where("id % 3 < 2").select("id", "content")
    new = r.feed_articles.where("id % 3 > 0").select("id", F.when(F.col("id") % 2 == 0, F.col("title")).alias("content"))
    return rel.upsert(old, new, ["id"], {"content": F.coalesce(F.col("new.content"), F.col("old.content"))})


@query("S17", "SELECT id, event_type FROM (SELECT * FROM user_article_events ORDER BY created_at DESC, id DESC LIMIT 50) WHERE id > 100")
def activity_ring(r: Reader) -> DataFrame:
    return r.user_article_events.orderBy(F.desc("created_at"), F.desc("id")).limit(50).where("id > 100").select("id", "event_type")


@query("S14", """
SELECT a.id AS article_id, 'read_complete' AS event_type FROM feed_articles a WHERE is_read = 1 AND NOT EXISTS (SELECT 1 FROM user_article_events e WHERE e.article_id = a.id AND e.event_type = 'read_complete')""")
def seed_events(r: Reader) -> DataFrame:
    read = r.feed_articles.where("is_read = 1").select(F.col("id").alias("article_id"))
    done = r.user_article_events.where("event_type = 'read_complete'").select("article_id")
    return read.join(done, "article_id", "left_anti").withColumn("event_type", F.lit("read_complete"))


@query("S08 T04", f"SELECT id, title, created_at FROM feed_articles WHERE created_at >= {LATE}")
def delta_sync(r: Reader) -> DataFrame:
    return r.feed_articles.where(F.col("created_at") >= late()).select("id", "title", "created_at")


@query("T06", """
WITH q AS (SELECT id, source_id, created_at, id % 4 <> 0 AS done, length(content) / 100.0 AS cost, row_number() OVER w AS place, coalesce(sum(length(content)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100.0 AS spent
 FROM feed_articles WHERE parse_status = 'pending' WINDOW w AS (PARTITION BY source_id ORDER BY created_at DESC, id DESC)),
t AS (SELECT *, max(CASE WHEN done THEN place ELSE 0 END) OVER (PARTITION BY source_id ORDER BY place) AS last_done FROM q),
s AS (SELECT source_id, min(place) AS stop FROM t WHERE place - last_done >= 3 GROUP BY 1)
SELECT id, source_id, place, CASE WHEN place > coalesce(stop, place) OR spent > 1200 THEN 'queued' WHEN done THEN 'done' ELSE 'failed' END AS outcome FROM t LEFT JOIN s USING (source_id)""")
def deferred_queue(r: Reader) -> DataFrame:
    """A pass over each source's queue: it ends when its time is spent, or after three failures in a row; what it doesn't reach
    stays queued. Text length stands for an article's time, and every fourth article fails."""
    waiting = r.feed_articles.where("parse_status = 'pending'").select("id", "source_id", "created_at", (F.col("id") % 4 != 0).alias("done"), F.length("content").cast("long").alias("size"))
    queue = settled(rel.numbered(waiting, ["source_id"], [F.desc("created_at"), F.desc("id")], "place", sums={"spent": "size"}), "queue")
    # three failures in a row: a failure at this place and the two before it
    bad = queue.where("not done").select("source_id", F.explode(F.array(*[F.col("place") + k for k in range(3)])).alias("stop"))
    stops = bad.groupBy("source_id", "stop").agg(F.count("*").alias("n")).where("n = 3")
    stops = stops.join(queue.where("not done").select("source_id", F.col("place").alias("stop")), ["source_id", "stop"]).groupBy("source_id").agg(F.min("stop").alias("stop"))
    late_ = (F.col("place") > F.coalesce("stop", "place")) | (F.col("spent") / 100 > 1200)
    outcome = F.when(late_, "queued").when(F.col("done"), "done").otherwise("failed")
    return queue.join(stops, "source_id", "left").select("id", "source_id", "place", outcome.alias("outcome"))


@query("T07", """
SELECT source_id, CASE WHEN ok = 0 THEN 'red' WHEN bad * 2 > ok THEN 'yellow' ELSE 'green' END AS status, least(pow(2.0, bad - 1), 24.0) AS wait_hours
FROM (SELECT source_id, count(*) FILTER (WHERE parse_status = 'success') AS ok, count(*) FILTER (WHERE parse_status = 'failed') AS bad FROM feed_articles GROUP BY 1)""")
def source_refresh_state(r: Reader) -> DataFrame:
    n = r.feed_articles.groupBy("source_id").agg(F.count_if(F.col("parse_status") == "success").alias("ok"), F.count_if(F.col("parse_status") == "failed").alias("bad"))
    state = F.when(F.col("ok") == 0, "red").when(F.col("bad") * 2 > F.col("ok"), "yellow").otherwise("green")
    return n.select("source_id", state.alias("status"), F.least(F.pow(F.lit(2.0), F.col("bad") - 1), F.lit(24.0)).alias("wait_hours"))


@query("T14", """
SELECT id, CASE WHEN event_type IN ('open', 'skip') THEN CASE WHEN dwell_seconds >= 5 THEN 'open' ELSE 'skip' END ELSE event_type END AS kind FROM user_article_events""")
def dwell_kind(r: Reader) -> DataFrame:
    told = F.when(F.col("dwell_seconds") >= 5, "open").otherwise("skip")
    return r.user_article_events.select("id", F.when(F.col("event_type").isin("open", "skip"), told).otherwise(F.col("event_type")).alias("kind"))


@query("T16", """
WITH s AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, id FROM user_article_events),
g AS (SELECT user_id, created_at, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, min(created_at) AS began, count(*) AS events FROM g GROUP BY user_id, n""")
def reading_sessions(r: Reader) -> DataFrame:
    at = F.col("created_at").cast("timestamp")
    found = r.user_article_events.groupBy("user_id", F.session_window(at, "6 hours")).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("began"), "events")


@query("T16 F38", """
SELECT time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM user_article_events GROUP BY 1, 2""")
def event_windows(r: Reader) -> DataFrame:
    at = F.col("created_at").cast("timestamp")
    found = r.user_article_events.groupBy(F.window(at, "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n")


@query("T13", """
WITH s AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id, article_id ORDER BY created_at, id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM user_article_events WHERE event_type = 'impression'),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, article_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT min(id) AS id, user_id, article_id FROM g GROUP BY user_id, article_id, n""")
def impression_dedupe(r: Reader) -> DataFrame:
    shown = r.user_article_events.where("event_type = 'impression'")
    first = shown.groupBy("user_id", "article_id", F.session_window(F.col("created_at").cast("timestamp"), "30 minutes")).agg(F.min("id").alias("id"))
    return first.select("id", "user_id", "article_id")


@query("X04", """
WITH b AS (SELECT p_partkey AS k, p_name AS hk FROM part WHERE p_partkey % 3 < 2), o AS (SELECT p_partkey AS k, p_brand AS hk, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS enabled FROM part WHERE p_partkey % 3 > 0)
SELECT CAST(k AS VARCHAR) AS tw, coalesce(o.hk, b.hk) AS hk FROM b FULL JOIN o USING (k) WHERE coalesce(enabled, 1) = 1""")
def glossary_merge(r: Reader) -> DataFrame:
    from feedlens.operators.localize import glossary

    key = F.col("p_partkey")
    builtin = r.part.where(key % 3 < 2).select(key.cast("string").alias("tw"), F.col("p_name").alias("hk"))
    own = r.part.where(key % 3 > 0).select(key.cast("string").alias("tw"), F.col("p_brand").alias("hk"), F.when(key % 5 == 0, 0).otherwise(1).alias("enabled"))
    return glossary(builtin, own)


@query("X05", """
SELECT id, CASE WHEN primary_topic = 'Gaming' AND region = 'Germany' THEN 0.5 WHEN primary_topic = 'Travel' AND article_type = 'Deal' THEN -0.5 ELSE 0.0 END AS boost FROM feed_articles""")
def interaction_pairs(r: Reader) -> DataFrame:
    pairs = [("Gaming", "region", "Germany", 0.5), ("Travel", "article_type", "Deal", -0.5)]
    boost = sum((F.when((F.col("primary_topic") == t) & (F.col(c) == v), b).otherwise(0.0) for t, c, v, b in pairs), F.lit(0.0))
    return r.feed_articles.select("id", boost.cast("double").alias("boost")).fillna(0.0, ["boost"])


@query("T01", """
SELECT e.article_id, count(*) AS n, max(e.created_at) AS last_seen_at FROM user_article_events e WHERE e.event_type = 'impression' GROUP BY 1""")
def stream_ingest(r: Reader) -> DataFrame:
    """Impression counters kept by a stream over the event files, up to what has landed."""
    from feedlens.sources.shared import scratch
    from feedlens.streaming import ingest

    folder, n = scratch(r.spark, "ingest"), r.documents.count()
    raw = r.spark.readStream.schema(r.events.schema).parquet(f"{r.sf_dir}/events.parque[t]")  # a pattern, as a stream takes a file by pattern only
    kind = F.when(F.col("event_type") == "view", "impression").otherwise(F.col("event_type"))
    events = raw.select((F.col("event_id") % n).alias("article_id"), kind.alias("event_type"), F.col("ts").alias("created_at"))
    ingest.count_impressions(events, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return ingest.counters(r.spark, f"{folder}/state")
