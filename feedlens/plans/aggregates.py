"""Grouped statistics, windows and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import numbers, text
from feedlens.operators import relational as rel
from feedlens.operators import status
from feedlens.plans.registry import query
from feedlens.sources.tables import Reader


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query("A01", "SELECT parse_status, count(*) AS n FROM feed_articles GROUP BY 1")
def article_status_counts(r: Reader) -> DataFrame:
    return r.feed_articles.groupBy("parse_status").agg(F.count("*").alias("n"))


@query("A02", """
SELECT coalesce(provider, 'unknown') AS provider, coalesce(kind, 'translation') AS kind, count(*) AS calls, sum(cache_miss_tokens)::BIGINT AS miss, sum(completion_tokens)::BIGINT AS completion, round(sum(cost_cny), 6) AS cost
FROM translation_usage GROUP BY 1, 2""")
def usage_by_provider(r: Reader) -> DataFrame:
    return r.translation_usage.groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("kind", F.lit("translation")).alias("kind")).agg(
        F.count("*").alias("calls"), F.sum("cache_miss_tokens").alias("miss"), F.sum("completion_tokens").alias("completion"), r6(F.sum("cost_cny"), "cost")
    )


@query("A03", """
SELECT CAST(created_at AS DATE) AS day, coalesce(provider, 'unknown') AS provider, kind, count(*) AS calls, round(sum(cost_cny), 6) AS cost FROM translation_usage GROUP BY 1, 2, 3""")
def usage_daily(r: Reader) -> DataFrame:
    return r.translation_usage.groupBy(F.to_date("created_at").alias("day"), F.coalesce("provider", F.lit("unknown")).alias("provider"), "kind").agg(
        F.count("*").alias("calls"), r6(F.sum("cost_cny"), "cost")
    )


@query("A04", """
SELECT u.source_id, s.name, count(*) AS calls, round(sum(u.cost_cny), 6) AS cost FROM translation_usage u LEFT JOIN feed_sources s ON s.id = u.source_id
GROUP BY 1, 2 ORDER BY round(sum(u.cost_cny), 6) DESC, u.source_id LIMIT 10""")
def usage_top_sources(r: Reader) -> DataFrame:
    top = r.translation_usage.groupBy("source_id").agg(F.count("*").alias("calls"), r6(F.sum("cost_cny"), "cost")).orderBy(F.desc("cost"), "source_id").limit(10)
    return top.join(r.feed_sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left").select("source_id", "name", "calls", "cost")


@query("A05 A29", "SELECT source_id, count(*) AS calls, round(sum(cost_cny), 6) AS cost, sum(cache_miss_tokens)::BIGINT AS miss FROM translation_usage GROUP BY 1")
def usage_by_source(r: Reader) -> DataFrame:
    return r.translation_usage.groupBy("source_id").agg(F.count("*").alias("calls"), r6(F.sum("cost_cny"), "cost"), F.sum("cache_miss_tokens").alias("miss"))


@query("A06", "SELECT coalesce(provider, 'unknown') AS provider, round(sum(cost_cny), 6) AS cost FROM translation_usage WHERE kind IN ('translation', 'ondemand') GROUP BY 1")
def cost_by_kind(r: Reader) -> DataFrame:
    return r.translation_usage.where(F.col("kind").isin("translation", "ondemand")).groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(r6(F.sum("cost_cny"), "cost"))


@query("A07", """
SELECT a.source_id, any_value(s.name) AS name, any_value(s.translator) AS translator, count(*) AS n, min(a.created_at) AS oldest FROM feed_articles a JOIN feed_sources s ON s.id = a.source_id
WHERE a.parse_status = 'pending' GROUP BY 1""")
def queue_by_feed(r: Reader) -> DataFrame:
    waiting = r.feed_articles.where("parse_status = 'pending'").groupBy("source_id").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))
    return waiting.join(r.feed_sources.select(F.col("id").alias("source_id"), "name", "translator"), "source_id").select("source_id", "name", "translator", "n", "oldest")


@query("A08", """
SELECT a.primary_topic, count(*) AS n FROM user_article_events e JOIN feed_articles a ON a.id = e.article_id WHERE e.event_type = 'impression' AND e.created_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1""")
def impressions_by_topic(r: Reader) -> DataFrame:
    seen = r.user_article_events.where((F.col("event_type") == "impression") & (F.col("created_at") >= F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))))
    per_article = seen.groupBy("article_id").agg(F.count("*").alias("k"))
    topics = r.feed_articles.select(F.col("id").alias("article_id"), "primary_topic")
    return per_article.join(topics, "article_id").groupBy("primary_topic").agg(F.sum("k").alias("n"))


@query("A09", "SELECT article_id, count(*) AS n, max(created_at) AS last_seen_at FROM user_article_events WHERE event_type = 'impression' GROUP BY 1")
def impression_counts(r: Reader) -> DataFrame:
    return status.impressions(r.user_article_events)


@query("A10", "SELECT count(*) AS n, max(created_at) AS last, count(*) FILTER (WHERE is_read = 0) AS unread, sum(is_saved)::BIGINT AS saved FROM feed_articles")
def scalar_totals(r: Reader) -> DataFrame:
    return r.feed_articles.agg(F.count("*").alias("n"), F.max("created_at").alias("last"), F.count_if(F.col("is_read") == 0).alias("unread"), F.sum("is_saved").alias("saved"))


@query("A11 A31", """
SELECT s.category_id, count(*) FILTER (WHERE a.is_read = 0) AS unread, grouping(s.category_id)::BIGINT AS is_total FROM feed_articles a JOIN feed_sources s ON s.id = a.source_id GROUP BY ROLLUP (s.category_id)""")
def unread_rollup(r: Reader) -> DataFrame:
    sources = r.feed_sources.select(F.col("id").alias("source_id"), "category_id")
    joined = r.feed_articles.select("source_id", "is_read").join(sources, "source_id")
    return joined.rollup("category_id").agg(F.count_if(F.col("is_read") == 0).alias("unread"), F.grouping("category_id").cast("long").alias("is_total"))


@query("A26", "SELECT DISTINCT article_id FROM user_article_events WHERE event_type = 'open'")
def seeded_articles(r: Reader) -> DataFrame:
    return r.user_article_events.where("event_type = 'open'").select("article_id").distinct()


@query("A27", """
SELECT source_id, block, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT id, source_id, CAST(floor((row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) / 500) AS BIGINT) AS block
 FROM feed_articles WHERE is_saved = 1) GROUP BY 1, 2""")
def saved_by_source(r: Reader) -> DataFrame:
    """Saved ids by source, in rows of up to 500 ids, so no source's list grows without bound."""
    saved = rel.numbered(r.feed_articles.where("is_saved = 1").select("id", "source_id"), ["source_id"], [F.col("id")], "i")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return saved.groupBy("source_id", F.floor((F.col("i") - 1) / 500).alias("block")).agg(F.count("*").alias("n"), ids.alias("ids"))


@query("A32", """
SELECT source_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE round(count(*) / greatest(epoch(max(created_at) - min(created_at)) / 86400.0, 0.05), 6) END AS per_day FROM feed_articles GROUP BY 1""")
def feed_rate(r: Reader) -> DataFrame:
    seconds = F.unix_seconds(F.max("created_at").cast("timestamp")) - F.unix_seconds(F.min("created_at").cast("timestamp"))
    rate = F.when(F.count("*") < 2, 1.0).otherwise(F.round(F.count("*") / F.greatest(seconds / 86400.0, F.lit(0.05)), 6))
    return r.feed_articles.groupBy("source_id").agg(rate.alias("per_day"))


@query("A33", """
WITH n AS (SELECT coalesce(primary_topic, 'none') AS label, count(*) AS k FROM feed_articles GROUP BY 1),
e AS (SELECT coalesce(primary_topic, 'none') AS label, id, row_number() OVER (PARTITION BY coalesce(primary_topic, 'none') ORDER BY id) AS p FROM feed_articles)
SELECT n.label, n.k, round(n.k * 100.0 / (SELECT sum(k) FROM n), 6) AS share, (SELECT string_agg(CAST(id AS VARCHAR), ';' ORDER BY id) FROM e WHERE e.label = n.label AND p <= 5) AS examples FROM n""")
def label_shares(r: Reader) -> DataFrame:
    rows = r.feed_articles.select("id", F.coalesce("primary_topic", F.lit("none")).alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("k"))
    counts = counts.withColumn("share", F.round(F.col("k") * 100.0 / F.sum("k").over(Window.partitionBy(F.lit(0))), 6))  # a row a label
    first = rel.top_per_group(rows, ["label"], [F.col("id")], 5).groupBy("label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ";").alias("examples")
    )
    return counts.join(first, "label").select("label", "k", "share", "examples")


@query("A24", """
WITH s AS (SELECT id, source_id, primary_topic, round_even(o.o_totalprice / 100000, 0) AS b FROM feed_articles a JOIN orders o ON o.o_orderkey = a.id)
SELECT CAST(b AS BIGINT) AS bucket, count(*) AS n, count(DISTINCT source_id) AS feeds, count(DISTINCT primary_topic) AS topics FROM s GROUP BY 1""")
def score_buckets(r: Reader) -> DataFrame:
    prices = r.orders.select(F.col("o_orderkey").alias("id"), F.bround(F.col("o_totalprice") / 100000, 0).cast("long").alias("bucket"))
    return r.feed_articles.join(prices, "id").groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("feeds"), F.count_distinct("primary_topic").alias("topics"))


@query("A25", """
WITH n AS (SELECT region, primary_topic AS t, count(*) AS k, sum(is_read)::DOUBLE AS x FROM feed_articles WHERE primary_topic IS NOT NULL GROUP BY 1, 2)
SELECT region, round(sum(k * x) / sum(k), 6) AS mean, round(sum(k * x * x) / sum(k) - (sum(k * x) / sum(k)) * (sum(k * x) / sum(k)), 4) AS variance, arg_max(t, (k, t)) AS modal, round(max(k) / sum(k), 6) AS modal_share FROM n GROUP BY 1""")
def weighted_moments(r: Reader) -> DataFrame:
    n = r.feed_articles.where("primary_topic IS NOT NULL").groupBy("region", F.col("primary_topic").alias("t")).agg(F.count("*").alias("k"), F.sum("is_read").cast("double").alias("x"))
    mean = F.sum(F.col("k") * F.col("x")) / F.sum("k")
    return n.groupBy("region").agg(
        r6(mean, "mean"), F.round(F.sum(F.col("k") * F.col("x") * F.col("x")) / F.sum("k") - mean * mean, 4).alias("variance"),
        F.max_by("t", F.struct("k", "t")).alias("modal"), r6(F.max("k") / F.sum("k"), "modal_share"),
    )


@query("A36", """
SELECT l_returnflag AS mode, round(avg(abs(l_discount - l_tax)), 6) AS mean_error, max(abs(l_discount - l_tax)) AS max_error, count(*) FILTER (WHERE abs(l_discount - l_tax) > 0.05) AS outliers, bool_and(abs(l_discount - l_tax) < 0.2) AS accepted
FROM lineitem GROUP BY 1""")
def error_report(r: Reader) -> DataFrame:
    e = F.abs(F.col("l_discount") - F.col("l_tax"))
    return r.lineitem.groupBy(F.col("l_returnflag").alias("mode")).agg(
        r6(F.avg(e), "mean_error"), F.max(e).alias("max_error"), F.count_if(e > 0.05).alias("outliers"), F.bool_and(e < 0.2).alias("accepted")
    )


@query("A22 A37", """
WITH t AS (SELECT count(*) AS n, sum(length(html)) AS bytes FROM pages), s AS (SELECT unnest([10, 100, 1000]) AS slots)
SELECT slots::INTEGER AS slots, round(coalesce(bytes / nullif(n, 0), 0), 6) AS per_article, round(slots * coalesce(bytes / nullif(n, 0), 0) * 0.533, 4) AS projected FROM t, s""")
def storage_projection(r: Reader) -> DataFrame:
    each = F.coalesce(F.try_divide(F.col("bytes"), F.col("n")), F.lit(0.0))
    totals = r.pages.agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("bytes"))
    return totals.select(F.explode(F.array(F.lit(10), F.lit(100), F.lit(1000))).alias("slots"), r6(each, "per_article"), each.alias("e")).select(
        "slots", "per_article", F.round(F.col("slots") * F.col("e") * 0.533, 4).alias("projected")
    )


@query("A38", """
SELECT source_id, count(*) AS retained, count(*) FILTER (WHERE content IS NOT NULL AND length(content) >= 200) AS complete FROM feed_articles
WHERE is_saved = 1 OR created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1""")
def cache_completeness(r: Reader) -> DataFrame:
    kept = r.feed_articles.where((F.col("is_saved") == 1) | (F.col("created_at") >= r.as_of - F.expr("INTERVAL 14 DAYS")))
    return kept.groupBy("source_id").agg(F.count("*").alias("retained"), F.count_if(F.col("content").isNotNull() & (F.length("content") >= 200)).alias("complete"))


@query("W01", """
SELECT id, source_id, round((row_number() OVER (PARTITION BY source_id ORDER BY pub_date DESC, id DESC) - 1) / greatest(1, count(*) OVER (PARTITION BY source_id) - 1), 6) AS pct FROM feed_articles""")
def feed_age_percentile(r: Reader) -> DataFrame:
    ranked = rel.rank_share(r.feed_articles.select("id", "source_id", "pub_date"), ["source_id"], [F.desc("pub_date"), F.desc("id")], "pct")
    return ranked.select("id", "source_id", r6(F.col("pct"), "pct"))


@query("W03 P08", """
SELECT id FROM (SELECT id, is_saved, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS n FROM feed_articles WHERE is_saved = 0) WHERE n > 20""")
def prunable_articles(r: Reader) -> DataFrame:
    loose = r.feed_articles.where("is_saved = 0").select("id", "source_id", "created_at")
    return rel.numbered(loose, ["source_id"], [F.desc("created_at"), F.desc("id")], "n").where("n > 20").select("id")


@query("W04", """
SELECT source_id, min(x) AS threshold FROM (SELECT source_id, length(content) AS x, row_number() OVER (PARTITION BY source_id ORDER BY length(content) DESC, id) AS n, count(*) OVER (PARTITION BY source_id) AS c FROM feed_articles)
WHERE n <= ceil(0.1 * c) GROUP BY 1""")
def top_share_threshold(r: Reader) -> DataFrame:
    scored = r.feed_articles.select("id", "source_id", F.length("content").cast("long").alias("x"))
    ranked = rel.numbered(scored, ["source_id"], [F.desc("x"), F.col("id")], "n", "c")
    return ranked.where("n <= ceil(0.1 * c)").groupBy("source_id").agg(F.min("x").alias("threshold"))


@query("W06 T15", """
WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS idx, l_quantity AS len FROM lineitem),
c AS (SELECT doc, idx, sum(len) OVER (PARTITION BY doc ORDER BY idx, len ROWS UNBOUNDED PRECEDING) AS run, sum(len) OVER (PARTITION BY doc) AS tot FROM b)
SELECT doc, min(idx) AS depth_block FROM c WHERE run >= 0.8 * tot GROUP BY 1""")
def read_depth_block(r: Reader) -> DataFrame:
    blocks = r.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("len"))
    by = Window.partitionBy("doc")
    run = F.sum("len").over(by.orderBy("idx", "len").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumns({"run": run, "tot": F.sum("len").over(by)}).where(F.col("run") >= F.lit(0.8).cast("double") * F.col("tot")).groupBy("doc").agg(F.min("idx").alias("depth_block"))


@query("W08", """
SELECT page_id, url, title FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
 row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY length(regexp_extract(html, '<title>([^<]*)</title>', 1)) DESC, page_id) AS n FROM pages) WHERE n = 1""")
def longest_title_per_url(r: Reader) -> DataFrame:
    rows = r.pages.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return rel.top_per_group(rows, ["url"], [F.desc(F.length("title")), F.col("page_id")])


@query("W12", "SELECT id, ceil((id % 137 + 1) / 20.0)::BIGINT * 20 AS shown FROM feed_articles")
def display_window(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", (F.ceil((F.col("id") % 137 + 1) / 20.0) * 20).alias("shown"))


@query("A20 T03", r"""
WITH t AS (SELECT *, trim(split_part(badge, '<', 1)) AS b, created_at + (id % 50) * INTERVAL 1 HOUR AS updated_at FROM feed_articles WHERE badge IS NOT NULL),
p AS (SELECT trim(split_part(substr(b, 15), ' (fell back from', 1)) AS provider, contains(b, ' (fell back from') AS fb, greatest(0, epoch(updated_at - created_at) / 60.0) AS w FROM t),
c AS (SELECT CASE provider WHEN 'qwen' THEN 'Qwen' WHEN 'deepseek' THEN 'DeepSeek' END AS provider, sum(cost_cny) AS cost FROM translation_usage WHERE provider IS NOT NULL GROUP BY 1)
SELECT p.provider, count(*) AS articles, count(*) FILTER (WHERE fb) AS fallbacks, round(avg(w), 1) AS avg_wait_min, round(max(w), 1) AS max_wait_min, round(coalesce(any_value(c.cost), 0), 4) AS cost_cny
FROM p LEFT JOIN c USING (provider) GROUP BY 1""")
def translation_status_providers(r: Reader) -> DataFrame:
    rows = translated(r)
    label = F.when(F.col("provider") == "qwen", "Qwen").when(F.col("provider") == "deepseek", "DeepSeek")
    costs = r.translation_usage.where("provider IS NOT NULL").groupBy(label.alias("provider")).agg(F.sum("cost_cny").alias("cost"))
    return status.providers(rows, costs)


def translated(r: Reader) -> DataFrame:
    """Translated articles with the time they were done and the badge without its leading words."""
    return r.feed_articles.where("badge IS NOT NULL").select(
        "id", "created_at", (F.col("created_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 50).cast("int"))).alias("updated_at"), F.substring("badge", 15, 200).alias("badge")
    )


@query("T03 F38", """
WITH b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-28 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 6 HOUR)) AS bucket),
a AS (SELECT time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM feed_articles GROUP BY 1)
SELECT b.bucket, coalesce(a.n, 0) AS arrived FROM b LEFT JOIN a USING (bucket)""")
def translation_status_series(r: Reader) -> DataFrame:
    return status.series(r.feed_articles, "created_at", hours=72, as_of="2024-01-31 00:00:00")


@query("A21", """
WITH o AS (SELECT CASE WHEN parse_status = 'failed' THEN 'failed' WHEN badge IS NOT NULL THEN 'ok' WHEN parse_status = 'pending' THEN 'queued' ELSE 'unbadged' END AS k FROM feed_articles)
SELECT count(*) AS needed, count(*) FILTER (WHERE k = 'ok') AS succeeded, count(*) FILTER (WHERE k = 'failed') AS failed, count(*) FILTER (WHERE k = 'queued') AS queued, count(*) FILTER (WHERE k = 'unbadged') AS unbadged,
 round(count(*) FILTER (WHERE k = 'ok') / nullif(count(*) FILTER (WHERE k <> 'queued'), 0), 4) AS success_rate FROM o""")
def translation_outcomes(r: Reader) -> DataFrame:
    return status.outcomes(r.feed_articles, F.col("parse_status") == "failed", F.col("badge").isNotNull(), F.col("parse_status") == "pending")


@query("A12", """
WITH l AS (SELECT DISTINCT id, primary_topic, unnest(CASE doc WHEN 0 THEN ['smartphone', 'tv series'] WHEN 1 THEN ['smartphone'] WHEN 2 THEN ['watch', 'watch'] ELSE []::VARCHAR[] END) AS label FROM (SELECT *, id % 5 AS doc FROM feed_articles))
SELECT label, primary_topic AS topic, count(*) AS n FROM l WHERE primary_topic IS NOT NULL AND primary_topic <> 'unknown' GROUP BY 1, 2""")
def secondary_cooccurrence(r: Reader) -> DataFrame:
    from feedlens.operators.weights import cooccurrence

    return cooccurrence(r.feed_articles)


@query("A13 J18", """
WITH l AS (SELECT unnest(CASE id % 5 WHEN 0 THEN ['Smartphones', 'TV Series'] WHEN 1 THEN ['Smartphone'] WHEN 2 THEN ['Watches', 'watch'] ELSE []::VARCHAR[] END) AS label FROM feed_articles),
k AS (SELECT label, count(*) AS n, CASE WHEN lower(label) LIKE 'smart%' THEN 'smartphone' WHEN lower(label) LIKE 'watch%' THEN 'watch' ELSE 'tv series' END AS canon FROM l GROUP BY 1)
SELECT canon, arg_max(label, (n, label)) AS display FROM k GROUP BY 1""")
def secondary_display(r: Reader) -> DataFrame:
    counts = r.feed_articles.select(F.explode(text.labels_of(F.col("secondary_topics"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.groupBy(text.canonical_label(F.col("label")).alias("canon")).agg(F.max_by("label", F.struct("n", "label")).alias("display"))


@query("A40", """
SELECT id, source_id FROM (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY md5('7-' || id), id) AS n FROM feed_articles) WHERE n <= 5""")
def stratified_sample(r: Reader) -> DataFrame:
    seeded = F.md5(F.concat(F.lit("7-"), F.col("id").cast("string")))
    return rel.top_per_group(r.feed_articles.select("id", "source_id"), ["source_id"], [seeded, F.col("id")], 5)


@query("F36 F37", """
SELECT id, retry_count, least(pow(2.0, retry_count - 1), 24.0) AS backoff_hours, least(900 * pow(2.0, retry_count - 1), 7200.0) AS cooldown_s FROM feed_articles WHERE retry_count > 0""")
def retry_backoff(r: Reader) -> DataFrame:
    n = F.col("retry_count")
    return r.feed_articles.where("retry_count > 0").select("id", n, numbers.retry_hours(n).alias("backoff_hours"), numbers.cooldown_seconds(n).alias("cooldown_s"))
