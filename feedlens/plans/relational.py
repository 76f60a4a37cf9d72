"""Filters, joins, orders and pages over the reader's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import urls
from feedlens.operators import relational as rel
from feedlens.plans.registry import query
from feedlens.sources.tables import Reader, timestamp


def effective():
    """The date an article is ordered by."""
    return F.coalesce(F.nullif("pub_date", F.lit("")), F.date_format("created_at", "yyyy-MM-dd"))


EFFECTIVE_SQL = "coalesce(nullif(pub_date, ''), strftime(created_at, '%Y-%m-%d'))"


@query("J03 J06 A11", """
SELECT c.id AS category_id, c.name, count(a.id) AS total, coalesce(sum(CASE WHEN a.is_read = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS unread, max(a.created_at) AS last_article_at
FROM categories c LEFT JOIN feed_sources s ON s.category_id = c.id LEFT JOIN feed_articles a ON a.source_id = s.id GROUP BY c.id, c.name""")
def reader_feeds_unread(r: Reader) -> DataFrame:
    per_source = r.feed_articles.groupBy("source_id").agg(
        F.count("*").alias("total"), F.sum(1 - F.col("is_read")).alias("unread"), F.max("created_at").alias("last")
    )
    sources = r.feed_sources.select(F.col("id").alias("source_id"), "category_id").join(per_source, "source_id", "left")
    per_category = sources.groupBy("category_id").agg(F.sum("total").alias("total"), F.sum("unread").alias("unread"), F.max("last").alias("last_article_at"))
    found = r.categories.withColumnRenamed("id", "category_id").join(per_category, "category_id", "left")
    return found.select("category_id", "name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("unread", F.lit(0)).alias("unread"), "last_article_at")


@query("J03", "SELECT c.id, c.name, count(f.id) AS n_feeds FROM categories c LEFT JOIN feed_sources f ON f.category_id = c.id GROUP BY c.id, c.name")
def category_source_counts(r: Reader) -> DataFrame:
    feeds = r.feed_sources.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    return r.categories.join(feeds, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_feeds"))


@query("J05 W02", """
SELECT s.id, s.name, l.title AS latest_title, l.pub_date AS latest_pub_date FROM feed_sources s LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pub_date DESC NULLS LAST, id DESC) AS n FROM feed_articles) l ON l.source_id = s.id AND l.n = 1""")
def latest_article_per_source(r: Reader) -> DataFrame:
    last = rel.last_write(r.feed_articles, ["source_id"], [F.col("pub_date"), F.col("id")], ["title", "pub_date"])
    return r.feed_sources.join(last.withColumnRenamed("source_id", "id"), "id", "left").select("id", "name", F.col("title").alias("latest_title"), F.col("pub_date").alias("latest_pub_date"))


@query("P01 P02 J01", """
SELECT a.id, a.title, a.url, s.name AS source_name FROM feed_articles a JOIN feed_sources s ON a.source_id = s.id WHERE a.parse_status = 'success'""")
def success_articles(r: Reader) -> DataFrame:
    sources = r.feed_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return r.feed_articles.where("parse_status = 'success'").join(sources, "source_id").select("id", "title", "url", "source_name")


@query("P03 P04 P06 O01", f"""
SELECT id, source_id, title, {EFFECTIVE_SQL} AS effective FROM feed_articles
WHERE parse_status = 'success' AND (is_read = 0 OR created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 3 DAY) ORDER BY effective DESC, id DESC LIMIT 50 OFFSET 20""")
def articles_page_latest(r: Reader) -> DataFrame:
    recent = (F.col("is_read") == 0) | (F.col("created_at") >= r.as_of - F.expr("INTERVAL 3 DAYS"))
    found = rel.where_all(r.feed_articles, F.col("parse_status") == "success", recent, None)
    return rel.page(found.select("id", "source_id", "title", effective().alias("effective")), [F.desc("effective"), F.desc("id")], 50, 20)


@query("P05", "SELECT a.id, a.source_id FROM feed_articles a JOIN feed_sources s ON s.id = a.source_id WHERE s.category_id IS NULL")
def uncategorized_articles(r: Reader) -> DataFrame:
    bare = r.feed_sources.where("category_id IS NULL").select(F.col("id").alias("source_id"))
    return r.feed_articles.join(bare, "source_id", "left_semi").select("id", "source_id")


@query("P07", "SELECT id, primary_topic FROM feed_articles WHERE id IN (SELECT article_id FROM article_votes WHERE vote = 'show_less')")
def articles_in_list(r: Reader) -> DataFrame:
    wanted = r.article_votes.where("vote = 'show_less'").select(F.col("article_id").alias("id"))
    return r.feed_articles.join(wanted, "id", "left_semi").select("id", "primary_topic")


@query("J04 P08", "SELECT a.id, a.source_id FROM feed_articles a LEFT JOIN feed_sources s ON s.id = a.source_id WHERE s.id IS NULL")
def orphan_articles(r: Reader) -> DataFrame:
    return rel.without(r.feed_articles, r.feed_sources.withColumnRenamed("id", "source_id"), ["source_id"]).select("id", "source_id")


@query("P09", "SELECT a.id FROM feed_articles a WHERE EXISTS (SELECT 1 FROM feed_sources s WHERE s.id = a.source_id AND s.enabled = 1)")
def guarded_insert_rows(r: Reader) -> DataFrame:
    live = r.feed_sources.where("enabled = 1").select(F.col("id").alias("source_id"))
    return r.feed_articles.join(live, "source_id", "left_semi").select("id")


@query("P10 P11", """
SELECT id, badge ILIKE '%deepl%' OR badge ILIKE '%google%' AS other_provider, badge NOT ILIKE '%translated by%' AS unbadged FROM feed_articles""")
def badge_patterns(r: Reader) -> DataFrame:
    badge = F.col("badge")
    return r.feed_articles.select("id", (badge.ilike("%deepl%") | badge.ilike("%google%")).alias("other_provider"), (~badge.ilike("%translated by%")).alias("unbadged"))


@query("P12", """
SELECT id, strpos(coalesce(content, ''), 'the') > 0 AS has_ref, strpos(substr(content, 1, 400), 'the') = 0 AND is_read = 0 AS needs FROM feed_articles""")
def content_references(r: Reader) -> DataFrame:
    content = F.col("content")
    return r.feed_articles.select(
        "id", (F.instr(F.coalesce(content, F.lit("")), "the") > 0).alias("has_ref"), ((F.instr(F.substring(content, 1, 400), "the") == 0) & (F.col("is_read") == 0)).alias("needs")
    )


@query("P28", """
WITH a AS (SELECT id, CASE WHEN id % 13 = 0 THEN '   ' ELSE coalesce(badge, '') || content END AS content, CASE WHEN id % 9 = 0 THEN '[queued] ' ELSE '' END || title AS title, id % 5 = 0 AS pending FROM feed_articles)
SELECT id, trim(content) <> '' AND NOT contains(substr(content, 1, 400), 'Translated by') AND (pending OR contains(title, '[queued]') OR contains(content, '[queued]')) AS needed FROM a""")
def needs_translation(r: Reader) -> DataFrame:
    """Articles for the translation queue: with a text that isn't translated yet, and pending or marked as queued."""
    key, content = F.col("id"), F.when(F.col("id") % 13 == 0, "   ").otherwise(F.concat(F.coalesce("badge", F.lit("")), "content"))
    rows = r.feed_articles.select("id", content.alias("content"), F.concat(F.when(key % 9 == 0, "[queued] ").otherwise(""), "title").alias("title"), (key % 5 == 0).alias("pending"))
    marked = F.col("pending") | F.contains("title", F.lit("[queued]")) | F.contains("content", F.lit("[queued]"))
    done = F.contains(F.substring("content", 1, 400), F.lit("Translated by"))
    return rows.select("id", ((F.trim("content") != "") & ~done & marked).alias("needed"))


@query("P13 P24", """
SELECT id, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 >= 10 THEN 'failed' ELSE 'pending' END AS next_status
FROM feed_articles WHERE parse_status = 'pending' AND retry_count > 0 AND retry_count < 11""")
def retry_transition(r: Reader) -> DataFrame:
    waiting = r.feed_articles.where("parse_status = 'pending' AND retry_count > 0 AND retry_count < 11")
    return waiting.select("id", (F.col("retry_count") + 1).alias("retry_count"), F.when(F.col("retry_count") + 1 >= 10, "failed").otherwise("pending").alias("next_status"))


@query("P14", "SELECT id FROM feed_articles WHERE NOT (contains(lower(title), 'idiot') OR contains(lower(title), 'the ') OR contains(lower(title), 'der '))")
def negative_keyword_filter(r: Reader) -> DataFrame:
    words = F.filter(F.transform(F.split(F.lit("idiot,the , der ,"), ","), lambda w: F.lower(w)), lambda w: F.trim(w) != "")
    words = F.transform(words, lambda w: F.ltrim(w))
    return r.feed_articles.where(~F.exists(words, lambda w: F.contains(F.lower(F.col("title")), w))).select("id")


PATTERNS = [("domain", "ththre.example.com"), ("path_prefix", "/fr/"), ("path_contains", "7")]


@query("P15", r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS pa FROM pages)
SELECT page_id, url FROM p WHERE NOT (h = 'ththre.example.com' OR starts_with(pa, '/fr/') OR contains(pa, '7'))""")
def url_exclusion(r: Reader) -> DataFrame:
    hit = F.lit(False)
    for kind, value in PATTERNS:
        hit |= urls.excluded_by(F.col("url"), F.lit(kind), F.lit(value))
    return r.pages.where(~hit).select("page_id", "url")


@query("P16 P22", r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS h, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS pa FROM pages)
SELECT page_id, h AS host, NOT (h IN ('facebook.com', 'twitter.com', 'instagram.com', 'linkedin.com', 'youtube.com', 'pinterest.com', 't.co') OR pa IN ('', '/')
 OR regexp_matches(pa, '^/(login|signup|register|about|contact|search|tag|category|author)')) AS is_article FROM p""")
def article_link_validity(r: Reader) -> DataFrame:
    return r.pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.is_article_link(F.col("url")).alias("is_article"))


@query("P17", """
SELECT page_id, (CASE WHEN contains(lower(html), 'track(') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'captcha') THEN 1 ELSE 0 END + CASE WHEN contains(lower(html), 'access denied') THEN 1 ELSE 0 END) AS markers,
 length(html) < 3000 AS thin FROM pages""")
def challenge_signals(r: Reader) -> DataFrame:
    low = F.lower("html")
    marks = sum((F.contains(low, F.lit(m)).cast("int") for m in ("track(", "captcha", "access denied")), F.lit(0))
    return r.pages.select("page_id", marks.alias("markers"), (F.length("html") < 3000).alias("thin"))


@query("P18 F25", """
SELECT page_id, (contains(lower(url), 'expires=') AND contains(lower(url), 'signature=')) OR contains(lower(url), 'x-amz-signature') OR contains(lower(url), 'token=') AS signed,
 starts_with(url, 'data:') OR ends_with(lower(url), '.svg') AS placeholder FROM pages""")
def signed_urls(r: Reader) -> DataFrame:
    url = F.col("url")
    return r.pages.select("page_id", urls.is_signed(url).alias("signed"), (url.startswith("data:") | F.lower(url).endswith(".svg")).alias("placeholder"))


@query("P21", "SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM feed_articles) WHERE n <= 5")
def newest_links_cap(r: Reader) -> DataFrame:
    return rel.top_per_group(r.feed_articles.select("id", "source_id"), ["source_id"], [F.col("id")], 5)


@query("P23 O02", """
SELECT id, status, next_check_at, row_number() OVER (ORDER BY CASE status WHEN 'red' THEN 0 WHEN 'yellow' THEN 1 ELSE 2 END, next_check_at NULLS FIRST, id) AS place
FROM feed_sources WHERE enabled = 1 AND (next_check_at IS NULL OR next_check_at <= TIMESTAMP '2024-01-31 00:00:00')""")
def sources_due(r: Reader) -> DataFrame:
    due = r.feed_sources.where((F.col("enabled") == 1) & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= r.as_of)))
    first = F.when(F.col("status") == "red", 0).when(F.col("status") == "yellow", 1).otherwise(2)
    order = Window.orderBy(first, F.col("next_check_at").asc_nulls_first(), "id")  # one row a source
    return due.select("id", "status", "next_check_at", F.row_number().over(order).alias("place"))


@query("P25 P30 T17", """
SELECT id FROM feed_articles WHERE (is_saved = 1 OR created_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY) AND content IS NOT NULL AND content <> ''""")
def retained_offline(r: Reader) -> DataFrame:
    kept = (F.col("is_saved") == 1) | (F.col("created_at") >= r.as_of - F.expr("INTERVAL 14 DAYS"))
    return r.feed_articles.where(kept & F.col("content").isNotNull() & (F.col("content") != "")).select("id")


@query("P26 J16", """
SELECT a.id, s.category_id, c.name AS category FROM feed_articles a JOIN feed_sources s ON s.id = a.source_id LEFT JOIN categories c ON c.id = s.category_id WHERE a.is_read = 0 AND s.category_id IN (1, 3)""")
def unread_of_categories(r: Reader) -> DataFrame:
    sources = r.feed_sources.where(F.col("category_id").isin(1, 3)).select(F.col("id").alias("source_id"), "category_id")
    names = r.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return r.feed_articles.where("is_read = 0").join(sources, "source_id").join(names, "category_id", "left").select("id", "category_id", "category")


@query("P27 A30", """
SELECT coalesce(c.name, 'Uncategorized') AS category, count(*) AS n_feeds, string_agg(s.name, ',' ORDER BY s.name) AS feeds
FROM feed_sources s LEFT JOIN categories c ON c.id = s.category_id WHERE contains(lower(s.name), 'src1') GROUP BY 1""")
def feed_name_search(r: Reader) -> DataFrame:
    names = r.categories.select(F.col("id").alias("category_id"), F.col("name").alias("cname"))
    found = r.feed_sources.where(F.contains(F.lower("name"), F.lit("src1"))).join(names, "category_id", "left")
    return found.groupBy(F.coalesce("cname", F.lit("Uncategorized")).alias("category")).agg(
        F.count("*").alias("n_feeds"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("feeds")
    )


@query("P31", """
WITH n AS (SELECT s.id, count(a.id) FILTER (WHERE a.created_at >= TIMESTAMP '2024-01-16 00:00:00') AS links, count(a.id) FILTER (WHERE a.created_at < TIMESTAMP '2024-01-16 00:00:00') AS before FROM feed_sources s LEFT JOIN feed_articles a ON a.source_id = s.id GROUP BY s.id),
t AS (SELECT source_id AS id, max(completion_tokens) / 139.0 AS seconds FROM translation_usage GROUP BY 1)
SELECT id, links, CASE WHEN links = 0 THEN 'red' WHEN coalesce(seconds, 0) > 5 OR (before > 0 AND links * 2 < before) THEN 'yellow' ELSE 'green' END AS health FROM n LEFT JOIN t USING (id)""")
def source_health(r: Reader) -> DataFrame:
    """A check of each source: its links of the month's second half against those of the first, and the time of its slowest request."""
    late = F.col("created_at") >= timestamp("2024-01-16 00:00:00")
    n = r.feed_articles.groupBy(F.col("source_id").alias("id")).agg(F.count_if(late).alias("links"), F.count_if(~late).alias("before"))
    took = r.translation_usage.groupBy(F.col("source_id").alias("id")).agg((F.max("completion_tokens") / 139.0).alias("seconds"))
    n = r.feed_sources.select("id").join(n, "id", "left").join(took, "id", "left").fillna(0)
    fewer = (F.col("before") > 0) & (F.col("links") * 2 < F.col("before"))
    return n.select("id", "links", F.when(F.col("links") == 0, "red").when((F.col("seconds") > 5) | fewer, "yellow").otherwise("green").alias("health"))


@query("J02", "SELECT a.id, v.vote, v.updated_at AS voted_at FROM feed_articles a LEFT JOIN article_votes v ON v.article_id = a.id")
def articles_with_votes(r: Reader) -> DataFrame:
    votes = r.article_votes.select(F.col("article_id").alias("id"), "vote", F.col("updated_at").alias("voted_at"))
    return r.feed_articles.select("id").join(votes, "id", "left")


@query("J07 T02", """
SELECT e.id, coalesce(CASE WHEN e.id % 2 = 0 THEN a.primary_topic END, a.primary_topic) AS primary_topic, a.region FROM user_article_events e LEFT JOIN feed_articles a ON a.id = e.article_id""")
def event_label_backfill(r: Reader) -> DataFrame:
    labels = r.feed_articles.select(F.col("id").alias("article_id"), F.col("primary_topic").alias("topic"), "region")
    events = r.user_article_events.select("id", "article_id").join(labels, "article_id", "left")
    known = F.when(F.col("id") % 2 == 0, F.col("topic"))  # what an event got when it came in
    return events.select("id", F.coalesce(known, "topic").alias("primary_topic"), "region")


@query("J08", """
SELECT e.id, e.article_id, coalesce(nullif(CASE WHEN e.id % 3 = 0 THEN '' END, ''), s.name) AS source_name, a.primary_topic FROM user_article_events e
LEFT JOIN feed_articles a ON a.id = e.article_id LEFT JOIN feed_sources s ON s.id = a.source_id""")
def event_denormalize(r: Reader) -> DataFrame:
    names = r.feed_sources.select(F.col("id").alias("source_id"), F.col("name").alias("sname"))
    articles = r.feed_articles.select(F.col("id").alias("article_id"), "source_id", "primary_topic").join(names, "source_id", "left")
    given = F.when(F.col("id") % 3 == 0, "")
    return r.user_article_events.select("id", "article_id").join(articles, "article_id", "left").select(
        "id", "article_id", F.coalesce(F.nullif(given, F.lit("")), "sname").alias("source_name"), "primary_topic"
    )


@query("J09 J10", """
WITH f AS (SELECT md5('k' || article_id) AS h, min(dwell_seconds) * 10 AS x FROM user_article_events WHERE event_type = 'hover' GROUP BY 1)
SELECT a.id, coalesce(f.x, 50)::BIGINT AS focal_x FROM feed_articles a LEFT JOIN f ON f.h = md5('k' || a.id)""")
def focal_lookup(r: Reader) -> DataFrame:
    key = lambda c: F.md5(F.concat(F.lit("k"), F.col(c).cast("string")).cast("binary"))
    focal = r.user_article_events.where("event_type = 'hover'").groupBy(key("article_id").alias("h")).agg((F.min("dwell_seconds") * 10).alias("x"))
    return r.feed_articles.select("id", key("id").alias("h")).join(focal, "h", "left").select("id", F.coalesce("x", F.lit(50)).alias("focal_x"))


@query("J14 A23 D16", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, page_id % 3 AS k FROM pages),
s AS (SELECT page_id, '/' || unnest(list_filter(string_split(path, '/'), lambda x: x <> '')) || '/' AS value FROM p WHERE k = 0),
f AS (SELECT page_id, '/' || regexp_extract(path, '^/+([^/]+)', 1) || '/' AS value FROM p WHERE k = 0 AND regexp_extract(path, '^/+([^/]+)', 1) <> ''),
pre AS (SELECT value, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE k = 1 AND starts_with(path, f.value)) GROUP BY 1),
rest AS (SELECT page_id FROM p WHERE k = 0 AND NOT EXISTS (SELECT 1 FROM pre WHERE starts_with(p.path, pre.value))),
seg AS (SELECT value, count(*) AS n FROM s JOIN rest USING (page_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE k = 1 AND contains(path, s.value)) GROUP BY 1)
SELECT 'path_prefix' AS kind, value, n FROM pre UNION ALL SELECT 'path_contains', value, n FROM seg""")
def derived_exclusions(r: Reader) -> DataFrame:
    """Patterns that excluded URLs (numbers 0 modulo 3) have and no included one (1 modulo 3): first segments, then inner ones.

    A path matches a pattern by the segments it ends with a slash, so both tests are joins on segments.
    """
    parts = F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != "")
    paths = r.pages.select("page_id", urls.path(F.col("url")).alias("path"), parts.alias("parts"))
    slashed = lambda c: F.concat(F.lit("/"), c, F.lit("/"))
    # what included paths begin with or hold: a segment with a slash on both sides
    closed = F.filter("parts", lambda x: F.contains(F.col("path"), slashed(x)))
    held = paths.where("page_id % 3 = 1").select(F.explode(closed).alias("x")).select(slashed(F.col("x")).alias("value")).distinct()
    led = paths.where("page_id % 3 = 1 and size(parts) > 0").select(slashed(F.col("parts")[0]).alias("value"), "path").where("startswith(path, value)").select("value").distinct()
    out = paths.where("page_id % 3 = 0")
    first = out.where("size(parts) > 0").select("page_id", "path", slashed(F.col("parts")[0]).alias("value"))
    prefixes = rel.without(first, led, ["value"])
    done = prefixes.where("startswith(path, value)").select("page_id")
    inner = rel.without(out, done, ["page_id"]).select("page_id", F.explode("parts").alias("x")).select("page_id", slashed(F.col("x")).alias("value"))
    counted = lambda rows, kind: rows.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return counted(prefixes, "path_prefix").unionByName(counted(rel.without(inner, held, ["value"]), "path_contains"))


@query("J15", r"""
WITH c AS (SELECT page_id, md5(url) AS h FROM pages), u AS (SELECT DISTINCT md5(url) AS h FROM pages WHERE page_id % 2 = 0)
SELECT page_id, h FROM c WHERE h NOT IN (SELECT h FROM u)""")
def unreferenced_images(r: Reader) -> DataFrame:
    used = r.pages.where("page_id % 2 = 0").select(urls.image_key(F.col("url")).alias("h"))
    return rel.without(r.pages.select("page_id", urls.image_key(F.col("url")).alias("h")), used, ["h"]).select("page_id", "h")


@query("J17 A28", """
WITH u AS (SELECT source_id, count(*) AS n FROM feed_articles WHERE is_read = 0 GROUP BY 1), d AS (SELECT source_id, count(*) AS d FROM feed_articles WHERE is_read = 0 AND id % 4 = 0 GROUP BY 1)
SELECT source_id, greatest(0, n - coalesce(d, 0)) AS unread FROM u LEFT JOIN d USING (source_id)""")
def unread_with_overrides(r: Reader) -> DataFrame:
    unread = r.feed_articles.where("is_read = 0").groupBy("source_id").agg(F.count("*").alias("n"))
    read_here = r.feed_articles.where("is_read = 0 AND id % 4 = 0").groupBy("source_id").agg(F.count("*").alias("d"))
    return unread.join(read_here, "source_id", "left").select("source_id", F.greatest(F.lit(0), F.col("n") - F.coalesce("d", F.lit(0))).alias("unread"))


@query("J19 A34 A35", """
WITH o AS (SELECT id, primary_topic AS t, region FROM feed_articles), n AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Travel' ELSE primary_topic END AS t, region, CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS conf FROM feed_articles)
SELECT count(*) AS n, round(count(*) FILTER (WHERE o.t = n.t) * 100.0 / count(*), 6) AS same, round(count(*) FILTER (WHERE o.t = n.t OR (o.t = 'Gaming' AND n.t = 'Travel')) * 100.0 / count(*), 6) AS related,
 round(count(*) FILTER (WHERE conf IN ('low', 'medium')) * 100.0 / count(*), 6) AS ambiguous FROM o JOIN n USING (id)""")
def tag_agreement(r: Reader) -> DataFrame:
    old = r.feed_articles.select("id", F.col("primary_topic").alias("t0"))
    new = r.feed_articles.select(
        "id", F.when(F.col("id") % 5 == 0, "Travel").otherwise(F.col("primary_topic")).alias("t1"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("id") % 3 + 1).cast("int")).alias("conf")
    )
    share = lambda c, n: F.round(F.count_if(c) * 100.0 / F.count("*"), 6).alias(n)
    same = F.col("t0") == F.col("t1")
    child = (F.col("t0") == "Gaming") & (F.col("t1") == "Travel")
    return old.join(new, "id").agg(F.count("*").alias("n"), share(same, "same"), share(same | child, "related"), share(F.col("conf").isin("low", "medium"), "ambiguous"))


@query("J20", """
SELECT id, source_id, lag(id, 1) OVER w AS before1, lag(id, 2) OVER w AS before2, lag(id, 3) OVER w AS before3, lead(id, 1) OVER w AS after1, lead(id, 2) OVER w AS after2, lead(id, 3) OVER w AS after3
FROM feed_articles WINDOW w AS (PARTITION BY source_id ORDER BY created_at DESC, id DESC)""")
def adjacent_rows(r: Reader) -> DataFrame:
    return rel.neighbours(r.feed_articles.select("id", "source_id", "created_at"), ["source_id"], [F.desc("created_at"), F.desc("id")], "id", 3)


@query("J21", """
WITH a AS (SELECT id, 'old' AS src FROM feed_articles WHERE id % 3 < 2), b AS (SELECT id, 'new' AS src FROM feed_articles WHERE id % 3 > 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)""")
def append_page(r: Reader) -> DataFrame:
    ids = r.feed_articles.select("id")
    shown = ids.where("id % 3 < 2").withColumn("src", F.lit("old"))
    return shown.unionByName(rel.without(ids.where("id % 3 > 0"), shown, ["id"]).withColumn("src", F.lit("new")))


@query("O03 S12", "SELECT id, title FROM feed_articles WHERE id > 100 ORDER BY id LIMIT 50")
def fever_items_since(r: Reader) -> DataFrame:
    return r.feed_articles.where("id > 100").select("id", "title").orderBy("id").limit(50)


@query("O03", "SELECT id, title FROM feed_articles WHERE id < 500 ORDER BY id DESC LIMIT 50")
def fever_items_max(r: Reader) -> DataFrame:
    return r.feed_articles.where("id < 500").select("id", "title").orderBy(F.desc("id")).limit(50)


@query("A39 S12", """
SELECT coalesce(category_id, 0) AS group_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS feed_ids FROM feed_sources GROUP BY 1""")
def fever_feeds_groups(r: Reader) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    return r.feed_sources.groupBy(F.coalesce("category_id", F.lit(0)).alias("group_id")).agg(ids.alias("feed_ids"))


@query("O04", "SELECT id, saved_at, created_at FROM (SELECT *, CASE WHEN id % 2 = 0 THEN created_at END AS saved_at FROM feed_articles WHERE is_saved = 1) ORDER BY saved_at DESC NULLS LAST, created_at DESC, id DESC LIMIT 50")
def saved_articles_order(r: Reader) -> DataFrame:
    saved = r.feed_articles.where("is_saved = 1").withColumn("saved_at", F.when(F.col("id") % 2 == 0, F.col("created_at")))
    return rel.page(saved.select("id", "saved_at", "created_at"), [F.col("saved_at").desc_nulls_last(), F.desc("created_at"), F.desc("id")], 50)


@query("O07 F39", "SELECT id, epoch(created_at)::BIGINT AS unix_ts FROM feed_articles ORDER BY unix_ts DESC, id DESC LIMIT 100")
def newest_by_clock(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("unix_ts")).orderBy(F.desc("unix_ts"), F.desc("id")).limit(100)


@query("O08", """
SELECT id, name, row_number() OVER (ORDER BY coalesce(nullif(coalesce(list_position(['ASIA', 'EUROPE'], name), 0), 0), 1000000), id) AS place FROM categories""")
def custom_category_order(r: Reader) -> DataFrame:
    wanted = F.array(F.lit("ASIA"), F.lit("EUROPE"))
    place = F.coalesce(F.nullif(F.array_position(wanted, F.col("name")), F.lit(0)), F.lit(1_000_000))
    return r.categories.select("id", "name", F.row_number().over(Window.orderBy(place, "id")).alias("place"))


@query("O09 T20", """
SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_id ORDER BY is_saved, is_read DESC, created_at, id) AS n, count(*) OVER (PARTITION BY source_id) AS c FROM feed_articles) WHERE n <= c - 20""")
def eviction_order(r: Reader) -> DataFrame:
    rows = r.feed_articles.select("id", "source_id", "is_saved", "is_read", "created_at")
    order = [F.col("is_saved"), F.desc("is_read"), F.col("created_at"), F.col("id")]
    return rel.numbered(rows, ["source_id"], order, "n", "c").where("n <= c - 20").select("id")


@query("P29", r"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') AS h FROM pages)
SELECT page_id, h = (SELECT h FROM p WHERE page_id = 0) AS same_site FROM p""")
def same_site_links(r: Reader) -> DataFrame:
    rows = r.pages.select("page_id", urls.host(F.col("url")).alias("h"))
    home = rows.where("page_id = 0").agg(F.max("h")).first()[0]
    return rows.select("page_id", (F.col("h") == F.lit(home)).alias("same_site"))


@query("O11", """
SELECT 'provider' AS kind, translator AS name, count(*) AS n, min(created_at) AS oldest FROM feed_articles a JOIN feed_sources s ON s.id = a.source_id GROUP BY 2
UNION ALL SELECT 'queue', 'all', count(*), min(created_at) FROM feed_articles WHERE parse_status = 'pending'""")
def provider_order(r: Reader) -> DataFrame:
    sources = r.feed_sources.select(F.col("id").alias("source_id"), F.col("translator").alias("name"))
    told = [F.count("*").alias("n"), F.min("created_at").alias("oldest")]
    providers = r.feed_articles.join(sources, "source_id").groupBy("name").agg(*told).select(F.lit("provider").alias("kind"), "name", "n", "oldest")
    queue = r.feed_articles.where("parse_status = 'pending'").agg(*told).select(F.lit("queue").alias("kind"), F.lit("all").alias("name"), "n", "oldest")
    return providers.unionByName(queue).orderBy("kind", F.desc("n"), "name")


@query("F08", "SELECT id, TIMESTAMP '2024-01-31 00:00:00' AS now, (epoch(TIMESTAMP '2024-01-31 00:00:00' - created_at) / 3600)::BIGINT AS hours FROM feed_articles")
def clock(r: Reader) -> DataFrame:
    hours = (F.unix_seconds(r.as_of.cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 3600
    return r.feed_articles.select("id", r.as_of.alias("now"), hours.cast("long").alias("hours"))
