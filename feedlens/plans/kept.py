"""State that is carried from batch to batch: orders, cards, outboxes, and values that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.plans.registry import query
from feedlens.sources.shared import scratch
from feedlens.sources.tables import Reader
from feedlens.streaming import backfill, cards, deals, outbox

MIDDLE = "created_at < TS '2024-01-16 00:00:00'"


@query("W09", f"""
WITH a AS (SELECT id, source_id, {MIDDLE.replace('TS', 'TIMESTAMP')} AS early FROM feed_articles WHERE is_read = 0),
one AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY md5('visit-0-' || id), id) AS place FROM a WHERE early),
two AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY md5('visit-1-' || id), id) + (SELECT count(*) FROM one WHERE one.source_id = a.source_id) AS place FROM a WHERE NOT early AND id % 10 <> 3)
SELECT * FROM one WHERE id % 10 <> 3 UNION ALL SELECT * FROM two""")
def kept_order(r: Reader) -> DataFrame:
    """Unread articles of each source, dealt twice: those of the month's first half, then all but a tenth. Places of the first deal stay."""
    folder = scratch(r.spark, "deals")
    unread = r.feed_articles.where("is_read = 0").select("id", F.col("source_id").cast("string").alias("list"), "created_at")
    now = unread.where("id % 10 <> 3")
    for number, items in enumerate((unread.where(MIDDLE.replace("TS", "TIMESTAMP_NTZ")), now)):
        items.select("id", "list").write.mode("append").parquet(f"{folder}/landed")
        stream = r.spark.readStream.schema("id long, list string").parquet(f"{folder}/landed")
        deals.deal_arrivals(stream, f"{folder}/state", f"{folder}/checkpoint", "visit").awaitTermination()
    return deals.in_order(now.select("id", "list"), f"{folder}/state").select("id", F.col("list").cast("long").alias("source_id"), "place")


@query("K12 W04", """
WITH RECURSIVE a AS (SELECT source_id || '-' || (id // 1000) AS session, id, CASE WHEN id % 17 <> 16 THEN (id * 37 % 101) / 100.0 END AS s0, CASE WHEN id % 17 <> 16 THEN ((id * 53 + 7) % 101) / 100.0 END AS s1, id % 3 <> 0 AS has_image FROM feed_articles),
r AS (SELECT session, 0 AS render, id, s0 AS score, has_image, false AS small FROM a WHERE id % 2 = 0 UNION ALL SELECT session, 1, id, s1, has_image, id % 11 = 0 FROM a UNION ALL SELECT session, 2, id, s0, has_image, false FROM a),
p AS (SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY session ORDER BY render, id % 2, id) AS n FROM r WINDOW w AS (PARTITION BY session, render ORDER BY id % 2, id)),
t AS (SELECT session, render, list_sort(list(score) FILTER (WHERE score IS NOT NULL), 'DESC') AS scores FROM p GROUP BY ALL),
q AS MATERIALIZED (SELECT p.*, scores[greatest(1, CAST(ceil(len(scores) * 0.1) AS BIGINT))] AS threshold FROM p JOIN t USING (session, render)),
s AS (SELECT session, 0::BIGINT AS n, 0 AS render, 0::BIGINT AS place, 0::BIGINT AS id, false AS featured, 4 AS since, []::BIGINT[] AS decided, []::BIGINT[] AS large FROM q WHERE n = 1
 UNION ALL
 SELECT session, n, render, place, id, f, CASE WHEN f THEN 0 ELSE since + 1 END, list_append(decided, id), CASE WHEN f THEN list_append(large, id) ELSE list_filter(large, lambda x: x <> id) END FROM (
  SELECT q.session, q.n, q.render, q.place, q.id, CASE WHEN q.place = 1 THEN 4 ELSE s.since END AS since, decided, large,
   NOT small AND CASE WHEN list_contains(decided, q.id) THEN list_contains(large, q.id) ELSE (q.place = 1 OR s.since >= 4) AND coalesce(score >= threshold, false) AND has_image END AS f
  FROM s JOIN q ON q.session = s.session AND q.n = s.n + 1))
SELECT session, CAST(render AS BIGINT) AS render, place, id, featured FROM s WHERE n > 0""")
def session_cards(r: Reader) -> DataFrame:
    """Sessions that render their list three times: half of it, all of it under other scores, all of it under the first scores again. Some
    images turn out small the second time. Each time a stream takes up what has landed, with the decisions of the times before."""
    folder, key = scratch(r.spark, "cards"), F.col("id")
    a = r.feed_articles.select(F.concat_ws("-", "source_id", F.expr("id div 1000")).alias("session"), "id", (key % 3 != 0).alias("has_image"))
    scored = lambda n: F.when(key % 17 != 16, n / 100)
    lists = ((a.where("id % 2 = 0"), scored(key * 37 % 101), F.lit(False)), (a, scored((key * 53 + 7) % 101), key % 11 == 0), (a, scored(key * 37 % 101), F.lit(False)))
    for number, (rows, score, small) in enumerate(lists):
        # half the list keeps its places, the other half comes behind: a session's places are those of its even ids, then of its odd ones
        before = rows.groupBy("session").agg(F.array_sort(F.collect_list(F.struct((key % 2).alias("odd"), "id"))).alias("ids"))
        placed = before.select("session", F.posexplode("ids").alias("at", "x")).select("session", (F.col("at") + 1).cast("long").alias("place"), F.col("x.id").alias("id"))
        shown = placed.join(rows, ["session", "id"]).select("session", F.lit(number).cast("long").alias("render"), "place", "id", score.cast("double").alias("score"), "has_image", small.alias("small"))
        shown.write.mode("append").parquet(f"{folder}/landed")
        stream = r.spark.readStream.schema(shown.schema).parquet(f"{folder}/landed")
        cards.show(stream, f"{folder}/shown", f"{folder}/checkpoint").awaitTermination()
    return r.spark.read.schema(cards.SHOWN).parquet(f"{folder}/shown")


OUTBOX_PASS = """
w{0} AS (SELECT user_id, article_id, arg_max(vote, (queued_at, vote)) AS vote, max(queued_at) AS queued_at FROM (SELECT user_id, article_id, vote, queued_at FROM q WHERE k = {0}{1}) GROUP BY 1, 2),
f{0} AS (SELECT user_id, min(article_id) AS stop FROM w{0} WHERE (article_id + {0} * 7) % 23 = 5 GROUP BY 1),
s{0} AS (SELECT w{0}.*, stop IS NULL OR article_id < stop AS sent FROM w{0} LEFT JOIN f{0} USING (user_id))"""


@query("T11", f"""
WITH q AS (SELECT user_id, article_id, CASE WHEN dwell_seconds % 2 = 0 THEN 'show_more' ELSE 'show_less' END AS vote, created_at AS queued_at, id % 3 AS k FROM user_article_events WHERE event_type IN ('open', 'read_complete')),
{",".join(OUTBOX_PASS.format(k, f" UNION ALL SELECT user_id, article_id, vote, queued_at FROM s{k - 1} WHERE NOT sent" if k else "") for k in range(3))}
{" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS number, user_id, article_id, vote, queued_at, sent FROM s{k}" for k in range(3))}""")
def vote_outbox(r: Reader) -> DataFrame:
    """Votes queued in three turns, a pass after each; what fails differs from pass to pass."""
    folder = scratch(r.spark, "outbox")
    queued = r.user_article_events.where(F.col("event_type").isin("open", "read_complete"))
    queued = queued.select("user_id", "article_id", F.when(F.col("dwell_seconds") % 2 == 0, "show_more").otherwise("show_less").alias("vote"), F.col("created_at").alias("queued_at"), "id")
    for turn in range(3):
        queued.where(F.col("id") % 3 == turn).drop("id").write.mode("append").parquet(f"{folder}/landed")
        stream = r.spark.readStream.schema("user_id long, article_id long, vote string, queued_at timestamp_ntz").parquet(f"{folder}/landed")
        outbox.flush_queued(stream, f"{folder}/state", f"{folder}/checkpoint", F.expr("(article_id + number * 7) % 23 = 5")).awaitTermination()
    return outbox.passes(r.spark, f"{folder}/state").select("number", "user_id", "article_id", "vote", "queued_at", "sent")


LABELLED = "id long, article_id long, event_type string, primary_topic string, region string, day date"


@query("T02 J07", """
SELECT e.id, e.article_id, e.event_type, CASE WHEN a.id % 5 < 4 THEN primary_topic END AS primary_topic, CASE WHEN a.id % 5 < 4 THEN region END AS region, CAST(e.created_at AS DATE) AS day
FROM user_article_events e LEFT JOIN feed_articles a ON a.id = e.article_id""")
def late_labels(r: Reader) -> DataFrame:
    """Events by day, stored before their articles have labels; these come in two turns, and a fifth of them never."""
    folder, parts = scratch(r.spark, "labels"), r.feed_articles.select(F.col("id").alias("article_id"), "primary_topic", "region")
    none = F.lit(None).cast("string")
    events = r.user_article_events.select("id", "article_id", "event_type", none.alias("primary_topic"), none.alias("region"), F.to_date("created_at").alias("day"))
    events.repartition("day").write.partitionBy("day").parquet(f"{folder}/events")
    for turn in ("article_id % 5 < 2", "article_id % 5 in (2, 3)"):
        parts.where(turn).write.mode("append").parquet(f"{folder}/landed")
        stream = r.spark.readStream.schema(parts.schema).parquet(f"{folder}/landed")
        backfill.fill_arrivals(stream, f"{folder}/events", LABELLED, "day", "article_id", ["primary_topic", "region"], f"{folder}/checkpoint").awaitTermination()
    return r.spark.read.schema(LABELLED).parquet(f"{folder}/events")


SNIPPETS = "id long, content string, snippet string, block long"


@query("T09 J11", r"""
SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN 'kept ' || id END, trim(substr(regexp_replace(content, '\s+', ' ', 'g'), 1, 160))) AS snippet FROM feed_articles""")
def snippet_backfill(r: Reader) -> DataFrame:
    """Snippets of the articles that have none, made from their contents in batches until none is left."""
    folder = scratch(r.spark, "snippets")
    kept = F.when(F.col("id") % 3 > 0, F.concat(F.lit("kept "), F.col("id").cast("string")))
    rows = r.feed_articles.select("id", "content", kept.alias("snippet"), F.expr("id div 5000").alias("block"))
    rows.repartition("block").write.partitionBy("block").parquet(f"{folder}/articles")
    made = F.trim(F.substring(F.regexp_replace("content", r"\s+", " "), 1, 160))
    backfill.fill_missing(r.spark, f"{folder}/articles", SNIPPETS, "block", "id", {"snippet": made}, f"{folder}/work", rows_a_batch=2000).awaitTermination()
    return r.spark.read.schema(SNIPPETS).parquet(f"{folder}/articles").select("id", "snippet")
