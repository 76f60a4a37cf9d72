"""Scalar functions over text, URLs, markup, costs and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import images, markup, numbers, text, urls
from feedlens.plans.registry import query
from feedlens.sources.tables import Reader


@query("F09", r"""
WITH t AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' Series' WHEN 1 THEN ' Boxes' WHEN 2 THEN ' & Watches' WHEN 3 THEN ' Stories' ELSE ' Business' END), '[^a-z0-9]+', ' ', 'g')) AS s FROM part)
SELECT id, array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN length(w) <= 3 OR regexp_matches(w, '(series|species|rabies|clothes)$') THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:length(w)-3] || 'y'
 WHEN regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN w[:length(w)-2] WHEN regexp_matches(w, '(ss|us|is|as|os)$') THEN w WHEN w LIKE '%s' THEN w[:length(w)-1] ELSE w END), ' ') AS label FROM t""")
def canonical_labels(r: Reader) -> DataFrame:
    tails = F.array(*map(F.lit, (" Series", " Boxes", " & Watches", " Stories", " Business")))
    name = F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % 5 + 1).cast("int")))
    return r.part.select(F.col("p_partkey").alias("id"), text.canonical_label(name).alias("label"))


@query("F11 F61", r"""
SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '(?i)🌐\s*Translated by[^\n]*$', '', 'g'), '\s+', ' ', 'g')), 1, 600) AS body FROM pages""")
def clean_body(r: Reader) -> DataFrame:
    return r.pages.select("page_id", text.clean_body(F.col("html")).alias("body"))


@query("F12", r"""
WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN c_name || ' - ' || c_mktsegment WHEN 1 THEN c_mktsegment || ' | ' || c_name ELSE c_name END AS name FROM customer)
SELECT id, CASE id % 3 WHEN 0 THEN trim(split_part(name, ' - ', 1)) WHEN 1 THEN CASE WHEN length(split_part(name, ' | ', 1)) >= length(split_part(name, ' | ', 2)) THEN split_part(name, ' | ', 1) ELSE split_part(name, ' | ', 2) END ELSE trim(name) END AS publication FROM n""")
def publication_names(r: Reader) -> DataFrame:
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat_ws(" - ", "c_name", "c_mktsegment")).when(key % 3 == 1, F.concat_ws(" | ", "c_mktsegment", "c_name")).otherwise(F.col("c_name"))
    return r.customer.select(key.alias("id"), text.publication_name(name).alias("publication"))


@query("F13 F14 F55", """
WITH b AS (SELECT id, substr('<p>' || badge || content, strpos(substr('<p>' || badge || content, 1, 600), 'Translated by ') + 14, 120) AS frag FROM feed_articles WHERE badge IS NOT NULL)
SELECT id, trim(split_part(trim(split_part(frag, '<', 1)), ' (fell back from', 1)) AS provider, contains(split_part(frag, '<', 1), ' (fell back from') AS fallback, nullif(regexp_extract(frag, 'fell back from (.+?)\\)', 1), '') AS deferred FROM b""".replace("\\\\", "\\"))
def badge_parse(r: Reader) -> DataFrame:
    rows = r.feed_articles.where("badge IS NOT NULL").select("id", text.badge_text(F.concat(F.lit("<p>"), "badge", "content")).alias("frag"))
    frag = F.col("frag")
    return rows.select("id", text.badge_provider(frag).alias("provider"), text.badge_is_fallback(frag).alias("fallback"), text.deferred_from(frag).alias("deferred"))


@query("F15", """
SELECT id, CASE WHEN id % 2 = 0 AND split_part(lower(trim(detected_language || '-X')), '-', 1) <> 'zh' THEN split_part(lower(trim(detected_language || '-X')), '-', 1) END AS from_language FROM feed_articles""")
def translated_from(r: Reader) -> DataFrame:
    original = F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), "title")).otherwise(F.col("title"))
    return r.feed_articles.select("id", text.translated_from(original, F.col("title"), F.concat("detected_language", F.lit("-X"))).alias("from_language"))


@query("F16 F17", r"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN lower(coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+http-equiv=["'']content-language["''][^>]+content=["'']([^"'']+)', 1), ''), nullif(regexp_extract(html, '(?i)<html[^>]*\slang=["'']([^"'']+)', 1), ''), 'en'))
 WHEN 1 THEN 'ja' WHEN 2 THEN 'zh-tw' WHEN 3 THEN 'fr-ca' ELSE 'en' END AS lang FROM pages""")
def page_language(r: Reader) -> DataFrame:
    """Of pages, and of the same as feeds or with other ways to say it."""
    bare = F.regexp_replace("html", r"(?i)<html[^>]*>", "")
    with_ = lambda before: F.concat(F.lit(before), bare)
    n = F.col("page_id") % 5
    html = F.when(n == 0, F.col("html")).when(n == 1, with_("<rss><channel><Language> JA\n</Language>")).when(n == 2, with_("<feed xml:lang='zh-TW'>")).when(n == 3, with_("<html class=x lang=fr-CA>")).otherwise(bare)
    return r.pages.select("page_id", markup.language(html).alias("lang"))


DATES = """WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00Z') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
 WHEN 3 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 4 THEN strftime(o_orderdate, '%B %d, %Y') ELSE 'no date' END AS s, CAST(o_orderdate AS DATE) AS d FROM orders)"""


@query("F18 F20", DATES + " SELECT id, CASE WHEN id % 6 < 5 THEN d END AS published FROM d")
def parsed_dates(r: Reader) -> DataFrame:
    at, key = "o_orderdate", F.col("o_orderkey")
    raw = F.date_format(at, "yyyy-MM-dd'T'10:00:00'Z'")
    for k, form in ((1, "yyyy/MM/dd"), (2, "MM/dd/yyyy"), (3, "yyyy.MM.dd"), (4, "MMMM dd, yyyy")):
        raw = F.when(key % 6 == k, F.date_format(at, form)).otherwise(raw)
    raw = F.when(key % 6 == 5, "no date").otherwise(raw)
    return r.orders.select(key.alias("id"), markup.parse_date(raw).alias("published"))


@query("F18 F21", r"""
WITH h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<meta property="article:published_time" content="' WHEN 1 THEN '<script type="application/ld+json">{"datePublished":"' ELSE '<meta name="publish_date" content="' END ||
 strftime(DATE '2024-01-31' - CAST(page_id % 120 AS INTEGER), '%Y-%m-%d') || CASE page_id % 3 WHEN 1 THEN '"}</script>' ELSE '">' END AS head, DATE '2024-01-31' - CAST(page_id % 120 AS INTEGER) AS d FROM pages)
SELECT page_id, CASE WHEN page_id % 120 <= 90 THEN d END AS published FROM h""")
def page_publish_date(r: Reader) -> DataFrame:
    day = F.date_format(F.date_sub(F.to_date(F.lit("2024-01-31")), (F.col("page_id") % 120).cast("int")), "yyyy-MM-dd")
    kinds = [('<meta property="article:published_time" content="', '">'), ('<script type="application/ld+json">{"datePublished":"', '"}</script>'), ('<meta name="publish_date" content="', '">')]
    head = F.lit("")
    for k, (a, b) in enumerate(kinds):
        head = F.when(F.col("page_id") % 3 == k, F.concat(F.lit(a), day, F.lit(b))).otherwise(head)
    found = markup.publish_date(F.concat(head, "html"))
    return r.pages.select("page_id", markup.fresh_date(found, F.to_date(F.lit("2024-01-31"))).alias("published"))


@query("F32", r"""
WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) || ' - Site' AS t FROM pages)
SELECT page_id, CASE WHEN contains(t, ' | ') THEN CASE WHEN length(trim(list_last(string_split(t, ' | ')))) < length(trim(string_split(t, ' | ')[1])) THEN trim(list_last(string_split(t, ' | '))) ELSE trim(string_split(t, ' | ')[1]) END ELSE CASE WHEN length(trim(list_last(string_split(t, ' - ')))) < length(trim(string_split(t, ' - ')[1])) THEN trim(list_last(string_split(t, ' - '))) ELSE trim(string_split(t, ' - ')[1]) END END AS site FROM t""")
def page_site_name(r: Reader) -> DataFrame:
    title = F.concat(F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)), F.lit(" - Site"))
    return r.pages.select("page_id", markup.site_name(title).alias("site"))


@query("F23 F24", """
WITH s AS (SELECT page_id, page_id % 5 + 1 AS n FROM pages)
SELECT page_id, 'https://i.example/' || (n * 400) || '.jpg' AS best, 'https://i.example/' || least(n, 4) * 400 || '.jpg' AS bounded FROM s""")
def srcset_choice(r: Reader) -> DataFrame:
    one = lambda k: F.concat(F.lit("https://i.example/"), (k * 400).cast("string"), F.lit(".jpg "), (k * 400).cast("string"), F.lit("w"))
    srcset = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("page_id") % 5 + 1).cast("int")), one), ", ")
    return r.pages.select("page_id", markup.best_srcset(srcset).alias("best"), markup.bounded_srcset(srcset, 1600).alias("bounded"))


@query("F28 F29 F30 F31 J12", r"""
SELECT page_id, 'https://' || CASE WHEN len(string_split(h, '.')) >= 3 THEN regexp_replace(h, '^(feeds|feed|rss|feedproxy)[.]', '') ELSE h END AS site, md5(url) AS key, md5(url || '_800') AS key800, regexp_extract(url, '/([^/]+?)([.][^./]*)?$', 1) AS stem,
 CASE WHEN w <= 240 THEN 160 WHEN w <= 400 THEN 320 WHEN w <= 640 THEN 480 WHEN w <= 1000 THEN 800 ELSE 1200 END AS width FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, page_id * 37 % 1500 AS w FROM pages)""")
def url_keys(r: Reader) -> DataFrame:
    url = F.col("url")
    return r.pages.select(
        "page_id", urls.site_url(url).alias("site"), urls.image_key(url).alias("key"), urls.image_key(url, F.lit(800)).alias("key800"), urls.file_stem(url).alias("stem"),
        urls.nearest_width((F.col("page_id") * 37 % 1500).cast("int")).alias("width"),
    )


@query("F34 F35 F62", """
SELECT id, round((cache_miss_tokens * 2.0 + completion_tokens * 8.0 + 100 * 0.5) / 1000000, 9) AS deepseek, round((cache_miss_tokens * 0.16 + completion_tokens * 0.49) / 1000000 * 7.1, 9) AS qwen FROM translation_usage""")
def token_costs(r: Reader) -> DataFrame:
    miss, done = F.col("cache_miss_tokens"), F.col("completion_tokens")
    return r.translation_usage.select("id", F.round(numbers.deepseek_cost(F.lit(100), miss, done), 9).alias("deepseek"), F.round(numbers.qwen_cost(miss, done), 9).alias("qwen"))


@query("F41 F42 F60", r"""
SELECT id, substr(trim(regexp_replace(regexp_replace('<b>' || title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 48) AS label, regexp_replace(title, '\s+$', '') AS clean, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet FROM feed_articles""")
def title_labels(r: Reader) -> DataFrame:
    title = F.col("title")
    return r.feed_articles.select(
        "id", text.fallback_label(F.concat(F.lit("<b>"), title)).alias("label"), text.clean_title(F.concat(title, F.lit(" (Translation Error)"))).alias("clean"), text.snippet(F.col("content"), 200).alias("snippet")
    )


@query("F45 F46", """
WITH w AS (SELECT id, len(regexp_extract_all(content, '[A-Za-z0-9]+')) AS n FROM feed_articles)
SELECT id, greatest(1, floor(n / 230.0 + 0.5))::INTEGER AS minutes, round(greatest(15.0, least(90.0, n / 230.0 * 60 / 2)), 6) AS required FROM w""")
def reading_minutes(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", text.reading_minutes(F.col("content")).alias("minutes"), F.round(text.required_seconds(F.col("content")), 6).alias("required"))


@query("F47", """
WITH a AS (SELECT id, floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - created_at) / 60)::BIGINT AS m FROM feed_articles)
SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' WHEN m < 10080 THEN (m // 1440) || 'd' ELSE (m // 10080) || 'w' END AS age FROM a""")
def relative_dates(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", numbers.relative_age(F.col("created_at"), r.as_of).alias("age"))


@query("F48", r"""
WITH s AS (SELECT id, nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '') AS p FROM feed_articles)
SELECT id, concat_ws('-', CAST(id AS VARCHAR), p) AS slug, id AS parsed FROM s""")
def article_slugs(r: Reader) -> DataFrame:
    made = r.feed_articles.select("id", text.slug(F.col("title"), F.col("id")).alias("slug"))
    return made.withColumn("parsed", text.slug_id(F.col("slug")))


@query("F51 F53 S14", """
SELECT id, CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n, CASE id % 5 WHEN 0 THEN '["Smartphones","TV Series"]' WHEN 1 THEN '["Smartphone"]' WHEN 2 THEN '["Watches","watch"]' ELSE '[]' END AS encoded FROM feed_articles""")
def secondary_json(r: Reader) -> DataFrame:
    labels = text.labels_of(F.col("secondary_topics"))
    return r.feed_articles.select("id", F.size(labels).alias("n"), F.to_json(labels).alias("encoded"))


@query("F52 S18", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 0.3 ELSE p_size / 10.0 END AS value FROM part""")
def settings_coercion(r: Reader) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 3 == 0, "n/a").otherwise((F.col("p_size") / 10.0).cast("string"))
    return r.part.select(F.col("p_partkey").alias("id"), F.coalesce(raw.try_cast("double"), F.lit(0.3)).alias("value"))


@query("F06 F39", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE)::TIMESTAMP END AS ts, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE epoch(CAST(o_orderdate AS DATE)::TIMESTAMP)::BIGINT END AS unix FROM orders""")
def parsed_times(r: Reader) -> DataFrame:
    key, at = F.col("o_orderkey"), F.date_trunc("day", "o_orderdate")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")
    raw = F.lit("soon")
    for k, form in enumerate(forms):
        raw = F.when(key % 5 == k, F.date_format(at, form)).otherwise(raw)
    ts = numbers.parse_time(raw)
    return r.orders.select(key.alias("id"), ts.alias("ts"), F.coalesce(F.unix_seconds(ts.cast("timestamp")), F.lit(0)).alias("unix"))


@query("F40 S09", "SELECT id, strftime(created_at, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS pub FROM feed_articles")
def rfc_dates(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", F.concat(F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("pub"))


@query("F50 F56 X09", """
SELECT id, CASE detected_language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' WHEN 'de' THEN 'Deutsch' ELSE detected_language END AS native, CAST(greatest(0, least(100, round_even(id % 2500 / 20.0, 0))) AS BIGINT) AS focal,
 coalesce(CASE WHEN id % 4 = 0 THEN 'provider' END, CASE WHEN id % 4 = 1 THEN 'local' END, 'source') AS came_from FROM feed_articles""")
def display_choices(r: Reader) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in (("en", "English"), ("fr", "Français"), ("de", "Deutsch")) for x in kv])
    focal = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("id") % 2500 / 20.0, 0).cast("long")))
    source = F.coalesce(F.when(F.col("id") % 4 == 0, "provider"), F.when(F.col("id") % 4 == 1, "local"), F.lit("source"))
    native = F.coalesce(F.try_element_at(names, F.col("detected_language")), F.col("detected_language"))
    return r.feed_articles.select("id", native.alias("native"), focal.alias("focal"), source.alias("came_from"))


#: (source, srcset, width, height, alt, is no content, is furniture, is an icon, address where the source has none of its own) of images as pages have them.
IMAGES = (
    ("https://cdn.example/photo.jpg", "", "640", "480", "A view", False, False, False, None),
    ("https://b.scorecardresearch.com/p?c=2", "", "", "", "", True, False, False, None),
    ("https://notdoubleclick.net/a.jpg", "", "800px", "", "Sponsored", False, True, False, None),
    ("https://cdn.example/x.SVG?v=1", "", "200", "200", "", True, False, True, None),
    ("https://cdn.example/a.jpg?icon=b.svg", "", "200", "200", "A long text about an author who is so well known that it is no label", False, False, True, None),
    ("https://site.example/G/Collect?id=1", "", "", "", "", True, False, False, None),
    ("/img/view.png", "", "150", "150", "", False, False, False, "/img/view.png"),
    ("https://cdn.example/photo-2.jpg", "", "1px", "400", "", True, True, False, None),
    ("https://images.example.imgix.net/logo.png", "", "20", "20", "", False, False, True, None),
    ("https://cdn.example/resize/100x/photo.jpg", "", "", "", "", False, True, False, None),
    ("true", "/s-400.jpg 400w, /s-800.jpg 800w", "400", "400", "", False, False, False, "/s-800.jpg"),
    ("https://cdn.example/wide.jpg", "", "3000", "180", "", False, True, False, None),
    ("/cached/7.jpg", "/s.jpg 400w", "300", "", "share this", False, True, False, None),
    ("//cdn.example/a b*.jpg", "", "300", "200", "adroit", False, False, False, None),
    ("javascript:void(0)", "", "300", "200", "", False, False, False, None),
    ("", "", "300", "200", "", False, True, False, None),
    ("https://cdn.example/Emoji.png", "", "300", "200", "", False, False, True, None),
)
_VALUES = ", ".join("({}, {})".format(n, ", ".join("NULL" if v is None else str(v) if isinstance(v, bool) else f"'{v}'" for v in row)) for n, row in enumerate(IMAGES))
IMAGES_SQL = f"i(n, src, srcset, w, h, alt, gone, furniture, icon, own) AS (VALUES {_VALUES})"
IMAGE_COLUMNS = "n long, src string, srcset string, w string, h string, alt string, gone boolean, furniture boolean, icon boolean, own string"


def page_images(r: Reader, many: int) -> DataFrame:
    """(page_id, url, at, and an image's columns): `many` images of each page, in turn."""
    sample = r.spark.createDataFrame([(n, *row) for n, row in enumerate(IMAGES)], IMAGE_COLUMNS)
    asked = r.pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("at")).withColumn("n", (F.col("page_id") * 3 + F.col("at")) % len(IMAGES))
    return asked.join(F.broadcast(sample), "n")


@query("D11 P19", f"WITH {IMAGES_SQL} SELECT page_id, src, gone AS no_content, furniture AS boilerplate FROM pages JOIN i ON n = page_id * 3 % {len(IMAGES)}")
def boilerplate_images(r: Reader) -> DataFrame:
    """An image of each page, by the two rules."""
    rows = page_images(r, 1)
    c = {x: F.col(x) for x in ("src", "alt", "w", "h")}
    return rows.select("page_id", "src", images.is_no_content(c["src"], c["w"], c["h"]).alias("no_content"), images.is_boilerplate(c["src"], c["alt"], F.lit(None), c["w"], c["h"]).alias("boilerplate"))


@query("P32", f"""
WITH {IMAGES_SQL}, s AS (SELECT page_id, k, src, icon FROM pages, (VALUES (0), (1), (2), (3), (4), (5)) AS z(k) JOIN i ON n = (page_id * 3 + k) % {len(IMAGES)}),
m AS (SELECT page_id, src AS main, icon AS main_icon FROM s WHERE k = 4), f AS (SELECT page_id, src, min(CASE WHEN src = main THEN -1 ELSE k END) AS k FROM s JOIN m USING (page_id) WHERE NOT icon AND src <> '' GROUP BY ALL)
SELECT page_id, coalesce(string_agg(src, ' ' ORDER BY f.k), '') AS slides FROM m LEFT JOIN f USING (page_id) GROUP BY page_id""")
def page_slides(r: Reader) -> DataFrame:
    """The slides of each page: its main image, the fifth, and all of them."""
    rows = page_images(r, 6).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "src"))).alias("x"))
    srcs = F.transform("x", lambda x: x["src"])
    return rows.select("page_id", F.array_join(images.slides(F.get(srcs, 4), F.concat(srcs, srcs)), " ").alias("slides"))


@query("D17 F26", f"""
WITH {IMAGES_SQL}, p AS (SELECT page_id, k, i.*, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^([a-z]+:)', 1) AS scheme FROM pages, (VALUES (0), (1), (2)) AS z(k) JOIN i ON n = (page_id * 3 + k) % {len(IMAGES)}),
a AS (SELECT *, CASE WHEN src = '' OR src LIKE 'javascript:%' THEN NULL WHEN own IS NOT NULL THEN root || own WHEN src LIKE '//%' THEN scheme || src ELSE src END AS address FROM p),
t AS (SELECT page_id, k, CASE WHEN gone THEN '' WHEN src LIKE '/cached/%' THEN '<img alt="' || alt || '" src="' || src || '" width="' || w || '" height="' || h || '">'
 WHEN address IS NULL THEN '<img alt="' || alt || '" src="' || src || '" srcset="' || srcset || '" width="' || w || '" height="' || h || '">'
 ELSE '<img src="/image-proxy?url=' || replace(url_encode(address), '%2F', '/') || '&amp;w=800" alt="' || alt || '" width="' || w || '" height="' || h || '">' END AS tag FROM a)
SELECT page_id, string_agg('<p>' || k || '</p>' || tag, '' ORDER BY k) AS html FROM t GROUP BY page_id""")
def rewritten_sources(r: Reader) -> DataFrame:
    """Bodies with three images each, taken from the proxy."""
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), F.col(c), F.lit('"'))
    tag = F.concat(F.lit("<p>"), F.col("at").cast("string"), F.lit("</p><img"), attribute("alt", "alt"), attribute("src", "src"), attribute("srcset", "srcset"), attribute("width", "w"), attribute("height", "h"), F.lit(">"))
    bodies = page_images(r, 3).groupBy("page_id", "url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", tag.alias("x")))), lambda x: x["x"]), "").alias("html"))
    return bodies.select("page_id", images.proxied(F.col("html"), F.col("url"), "/image-proxy", "/cached/").alias("html"))


@query("D13 D14", """
WITH b AS (SELECT id, title, substr(content, 1, CAST(id % 400 AS BIGINT)) AS content, CASE WHEN id % 5 < 2 THEN '' ELSE 'payload ' || id END AS s_title, CASE id % 4 WHEN 0 THEN substr(content, 1, 300) WHEN 1 THEN NULL ELSE '' END AS s_content,
 substr(content, 1, CAST(id % 350 AS BIGINT)) AS rendered, id % 6 = 0 AS blocked, id % 7 = 0 AS r_blocked FROM feed_articles),
m AS (SELECT id, CASE WHEN coalesce(s_content, '') <> '' THEN coalesce(nullif(s_title, ''), title) ELSE title END AS title, CASE WHEN coalesce(s_content, '') <> '' THEN s_content ELSE content END AS content, rendered, blocked, r_blocked FROM b),
r AS (SELECT *, length(content) < 200 AND (length(rendered) > length(content) OR (blocked AND NOT r_blocked)) AS again FROM m)
SELECT id, title, CASE WHEN again THEN rendered ELSE content END AS content, again AS rendered FROM r WHERE NOT CASE WHEN again THEN r_blocked ELSE blocked END""")
def override_and_retry(r: Reader) -> DataFrame:
    """What a page's own payload says goes before what was extracted, field by field, if it has content; thin articles take the
    rendered page where that has more, or isn't blocked as theirs is; what is blocked in the end is left out."""
    key, part = F.col("id"), lambda n: F.substring(F.col("content"), F.lit(1), (F.col("id") % n).cast("int"))
    s_title = F.when(key % 5 < 2, "").otherwise(F.concat(F.lit("payload "), key.cast("string")))
    s_content = F.when(key % 4 == 0, F.substring("content", 1, 300)).when(key % 4 == 1, None).otherwise("")
    rows = r.feed_articles.select(
        "id", "title", part(400).alias("content"), s_title.alias("s_title"), s_content.alias("s_content"), part(350).alias("rendered_content"), (key % 6 == 0).alias("blocked"), (key % 7 == 0).alias("r_blocked"),
    )
    said = F.coalesce("s_content", F.lit("")) != ""
    over = lambda own, base: F.when(said, F.coalesce(F.nullif(own, F.lit("")), base)).otherwise(F.col(base))
    rows = rows.withColumns({"title": over("s_title", "title"), "content": over("s_content", "content")})
    longer = F.length("rendered_content") > F.length("content")
    rows = rows.withColumn("rendered", (F.length("content") < 200) & (longer | (F.col("blocked") & ~F.col("r_blocked"))))
    kept = rows.where(~F.when(F.col("rendered"), F.col("r_blocked")).otherwise(F.col("blocked")))
    return kept.select("id", "title", F.when(F.col("rendered"), F.col("rendered_content")).otherwise(F.col("content")).alias("content"), "rendered")
