"""Pages and feeds, read and written. Rows that SQL can't check are held against literals by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from feedlens.functions import markup, text, urls
from feedlens.operators import html, localize, nodes
from feedlens.operators import relational as rel
from feedlens.plans.registry import query
from feedlens.sources import sinks
from feedlens.sources.shared import settled
from feedlens.sources.tables import Reader


ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"


#: Pages leave their bold paragraphs open, which close at the end of the article.
ARTICLES = fr"""a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inner_, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1 FROM pages),
t AS (SELECT *, trim(regexp_replace({ENTITIES.format("regexp_replace(inner_, '<[^>]*>', ' ', 'g')")}, '[[:space:]]+', ' ', 'g')) AS t FROM a)"""

BODY = """trim(regexp_replace('<article>' || replace(replace(inner_, '&quot;', '"'), '&#39;', chr(39)) || repeat('</b></p>', len(regexp_extract_all(inner_, '<p><b>'))) || '</article>', '[[:space:]]+', ' ', 'g'))"""


@query("D01 D02 D05 D06 D07 D08 D09 D12 D20 D22 F22 F27", fr"""
WITH {ARTICLES}
SELECT page_id, trim({ENTITIES.format("h1")}) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(NULL AS VARCHAR) AS main_image, {BODY} AS body,
 t AS text, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 200) || '...' END AS snippet, CASE WHEN length(t) <= 1200 THEN t ELSE substr(t, 1, 1200) || '...' END AS featured,
 CAST(len(regexp_extract_all(string_split(inner_, '<p><b>')[1], '</p>|</h1>')) + CASE WHEN contains(inner_, '<p><b>') THEN 1 ELSE 0 END AS INTEGER) AS n_blocks, '[]' AS images FROM t""")
def extract_articles(r: Reader) -> DataFrame:
    return nodes.articles(r.pages).withColumn("images", F.to_json("images"))


@query("F10", f"WITH {ARTICLES} SELECT page_id, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 200) || '...' END AS snippet, CASE WHEN length(t) <= 1200 THEN t ELSE substr(t, 1, 1200) || '...' END AS featured FROM t")
def snippets(r: Reader) -> DataFrame:
    return nodes.articles(r.pages).select("page_id", "snippet", "featured")


@query("D15 A19 F33", fr"""
WITH n AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages WHERE page_id % 2 = 0),
l AS (SELECT page_id, root, unnest(regexp_extract_all(nav, '<a href="([^"]+)">', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]+">([^<]*)</a>', 1)) AS title, generate_subscripts(regexp_extract_all(nav, '<a href="([^"]+)">', 1), 1) AS n FROM n),
u AS (SELECT page_id, string_split(CASE WHEN starts_with(href, '/') THEN root || href ELSE href END, '#')[1] AS link, trim({ENTITIES.format('title')}) AS title, n FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY length(title) DESC, n) AS first, lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM u)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS place, link, title, 'ul>li' AS pattern FROM k
WHERE first = 1 AND path NOT IN ('', '/') AND NOT list_bool_or(list_transform([{", ".join(f"'{x}'" for x in urls.OTHER_PATHS)}], lambda p: starts_with(path, p)))""")
def link_discovery(r: Reader) -> DataFrame:
    """The links of pages, of the group above all others: by number, length of titles and headings. Every second page has its menu as a list."""
    list_ = F.replace(F.replace("html", F.lit("<nav>"), F.lit('<div class="list">')), F.lit("</nav>"), F.lit("</div>"))
    pages = r.pages.select("page_id", "url", F.when(F.col("page_id") % 2 == 0, list_).otherwise(F.col("html")).alias("html"))
    found = nodes.links(pages).where(urls.is_article_link(F.col("link")))
    found = rel.top_per_group(found, ["page_id", "link"], [F.desc(F.length("title")), F.col("place")])
    groups = found.groupBy("page_id", "pattern").agg(F.count("*").alias("n"), F.avg(F.length("title")).alias("mean_title"), F.max(F.col("headed").cast("int")).alias("headed"), F.min("place").alias("first"))
    score = F.least("n", F.lit(30)) * 1.0 + F.least("mean_title", F.lit(80.0)) / 4 + 10 * F.col("headed")
    best = groups.groupBy("page_id").agg(F.max_by("pattern", F.struct(score, -F.col("first"))).alias("pattern"))
    chosen = found.join(best, ["page_id", "pattern"])
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("place")) - 1  # a page is bounded
    return chosen.select("page_id", number.cast("long").alias("place"), "link", "title", "pattern")


@query("D03 D04 X02", fr"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS p, html LIKE '%<div class="ad">%' AS has_p, html LIKE '%<h1%' AS has_h, regexp_extract(html, '(?s)<nav><ul>(.*?)</ul>', 1) AS m, html LIKE '%<nav><ul>%' AS has_m FROM pages)
SELECT page_id, {", ".join(f"CASE WHEN has_{c} THEN trim(regexp_replace({ENTITIES.format(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')")}, '[[:space:]]+', ' ', 'g')) END AS {n}" for c, n in (("h", "heading"), ("p", "notice"), ("m", "menu")))} FROM t""")
def selector_fields(r: Reader) -> DataFrame:
    return nodes.selected(r.pages, {"heading": "article h1, h1", "notice": "body div.ad, aside.ad", "menu": "nav ul"})


@query("D18", fr"""
WITH {ARTICLES}, p AS (SELECT page_id, string_split(inner_, '<p><b>')[1] AS closed, CASE WHEN contains(inner_, '<p><b>') THEN [substr(inner_, strpos(inner_, '<p><b>'))] ELSE [] END AS rest FROM t),
b AS (SELECT page_id, regexp_extract_all(closed, '(?s)<(h1|p)>.*?</(?:h1|p)>', 1) || list_transform(rest, lambda x: 'p') AS tags, regexp_extract_all(closed, '(?s)<(?:h1|p)>(.*?)</(?:h1|p)>', 1) || rest AS texts FROM p),
l AS (SELECT page_id, unnest(tags) AS tag, unnest(texts) AS x, generate_subscripts(tags, 1) AS n FROM b),
c AS (SELECT page_id, tag, n, trim(regexp_replace({ENTITIES.format("regexp_replace(x, '<[^>]*>', ' ', 'g')")}, '[[:space:]]+', ' ', 'g')) AS text FROM l)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS idx, tag, text FROM c WHERE text <> ''""")
def text_blocks(r: Reader) -> DataFrame:
    found = nodes.blocks(nodes.cleaned(nodes.flat_nodes(r.pages)))
    number = F.row_number().over(Window.partitionBy("page").orderBy("place")) - 1  # a page is bounded
    return found.select(F.col("page").alias("page_id"), number.alias("idx"), "tag", "text")


@query("D19", """
WITH b AS (SELECT id, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS o FROM feed_articles)
SELECT id, CAST(len(o) AS INTEGER) AS n, array_to_string(list_transform(o, lambda x: x || chr(10) || translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')), chr(10)) AS both FROM b""")
def bilingual_blocks(r: Reader) -> DataFrame:
    blocks = r.feed_articles.select("id", F.filter(F.split("content", "\n"), lambda x: F.trim(x) != "").alias("orig"))
    both = F.zip_with("orig", F.transform("orig", lambda x: F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), lambda a, b: F.concat(a, F.lit("\n"), b))
    return blocks.select("id", F.size("orig").alias("n"), F.array_join(both, "\n").alias("both"))


@query("F43 X04", """
SELECT id, array_to_string(list_transform(regexp_extract_all('<the>' || content, '<[^>]*>|[^<]+|<'), lambda x: CASE WHEN x LIKE '<%>' THEN x
 ELSE replace(replace(replace(replace(replace(replace(x, 'there', chr(1)), 'the', chr(2)), 'of', chr(3)), chr(1), 'là'), chr(2), 'le'), chr(3), 'de') END), '') AS content FROM feed_articles""")
def glossary_localize(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", localize.localize(F.concat(F.lit("<the>"), "content"), {"the": "le", "there": "là", "of": "de"}).alias("content"))


@query("J13")
def fuzzy_url_match(r: Reader) -> DataFrame:
    """Of the links of each page every second one comes back damaged, without its ninth character from the end, and is looked for among all of the page."""
    links = r.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"']+)"""), F.lit(1))).alias("at", "href"))
    whole = links.select("page_id", "at", urls.absolute(F.col("url"), F.col("href")).alias("url"))
    n = F.length("url")
    damaged = whole.where((F.col("at") % 2 == 0) & (n > 9)).select("page_id", F.concat(F.left("url", n - 9), F.right("url", F.lit(8))).alias("url"))
    return localize.fuzzy_urls(damaged, whole.select("page_id", "url"), "page_id")


HOSTS = ("127.0.0.1", "10.1.2.3", "8.8.8.8", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.1.1", "100.64.0.1", "1.1.1.1:8080", "[::1]", "[2606:4700::1111]", "[fe80::1]", "[fd00::1]", "localhost", "printer.local", "0.0.0.0", "224.0.0.1", "300.1.1.1", "198.51.100.7", "203.0.114.1")
PUBLIC_HOSTS = (2, 4, 8, 10, 17, 19)


@query("P20", f"SELECT page_id, page_id % 25 >= {len(HOSTS)} OR list_contains([{', '.join(map(str, PUBLIC_HOSTS))}], page_id % 25) AS public FROM pages")
def public_hosts(r: Reader) -> DataFrame:
    """Which pages may be fetched: literal addresses of private and reserved networks may not. Most pages have their host replaced by such an address."""
    literal = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % 25).cast("int"))
    url = F.coalesce(F.concat(F.lit("http://user@"), literal, F.lit("/x?y")), F.col("url"))
    return r.pages.select("page_id", urls.is_public(url).alias("public"))


@query("S05", """
SELECT id AS source_id, CASE id % 4 WHEN 0 THEN 'https://site' || id || '.example/' WHEN 1 THEN 'https://' || name || '.example/home' WHEN 2 THEN 'https://atom' || id || '.example' END AS site_url FROM feed_sources""")
def channel_links(r: Reader) -> DataFrame:
    """The site that a feed belongs to: the channel's own link, not the one to itself, made absolute."""
    key, n = F.col("id").cast("string"), F.col("id") % 4
    own = F.concat(F.lit('<atom:link rel="self" href="'), "url", F.lit('"/>'))
    rss = lambda link: F.concat(F.lit("<rss><channel>"), own, F.lit("<title>t</title>"), link, F.lit("<item><link>https://else.example/1</link></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><link rel="self" href="'), "url", F.lit('"/><link rel="alternate" href="https://atom'), key, F.lit('.example"/><entry><link href="https://else.example/1"/></entry></feed>'))
    text = F.when(n == 0, rss(F.concat(F.lit("<link>https://site"), key, F.lit(".example/</link>")))).when(n == 1, rss(F.lit("<link> /home </link>"))).when(n == 2, atom).otherwise(rss(F.lit("")))
    feeds = r.feed_sources.select(F.col("id").alias("source_id"), F.col("url").alias("base"), text.alias("text"))
    return feeds.select("source_id", markup.channel_link(F.col("text"), F.col("base")).alias("site_url"))


XML_SQL = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("S09", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created_at DESC, id DESC) AS n FROM feed_articles),
i AS (SELECT source_id, n, '<item><title>' || {XML_SQL.format("coalesce(nullif(title, ''), 'Untitled')")} || '</title><link>' || {XML_SQL.format('url')} || '</link><guid>' || {XML_SQL.format('url')} || '</guid><pubDate>'
 || strftime(created_at, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate><content:encoded>' || {XML_SQL.format('content')} || '</content:encoded>'
 || CASE id % 3 WHEN 0 THEN '<enclosure url="' || url || '/a.png?x=1&amp;y=&quot;2&quot;" type="image/png" length="0"/>' WHEN 1 THEN '<enclosure url="' || url || '/b" type="image/jpeg" length="0"/>' ELSE '' END || '</item>' AS x FROM t WHERE n <= 50)
SELECT s.id AS source_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" version="2.0"><channel><title>' || {XML_SQL.format('s.name')} || '</title><link>' || {XML_SQL.format('s.url')}
 || '</link><description>RSS feed for ' || {XML_SQL.format('s.name')} || '</description>' || coalesce(string_agg(x, '' ORDER BY n), '') || '</channel></rss>' AS xml
FROM feed_sources s LEFT JOIN i ON i.source_id = s.id GROUP BY s.id, s.name, s.url""")
def rss_sink(r: Reader) -> DataFrame:
    """An RSS document for each source, of its newest 50 articles; sinks.write_documents puts such rows into files."""
    image = F.when(F.col("id") % 3 == 0, F.concat("url", F.lit('/a.png?x=1&y="2"'))).when(F.col("id") % 3 == 1, F.concat("url", F.lit("/b")))
    return sinks.rss_documents(r.feed_sources, r.feed_articles.withColumn("main_image", image), 50)


@query("S10", f"""
WITH f AS (SELECT coalesce(c.name, 'Uncategorized') AS category, s.* FROM feed_sources s LEFT JOIN categories c ON c.id = s.category_id WHERE enabled = 1)
SELECT '' AS category, 0 AS part, 0 AS source_id, '<?xml version="1.0" encoding="utf-8"?><opml version="2.0"><head><title>Feeds</title></head><body>' AS line
UNION ALL SELECT DISTINCT category, 1, 0, '<outline text="' || {XML_SQL.format('category')} || '" title="' || {XML_SQL.format('category')} || '">' FROM f
UNION ALL SELECT category, 2, id, '<outline type="rss" text="' || {XML_SQL.format('name')} || '" title="' || {XML_SQL.format('name')} || '" xmlUrl="https://reader.example/feed/' || id || '/rss" htmlUrl="' || {XML_SQL.format('url')} || '"/>' FROM f
UNION ALL SELECT DISTINCT category, 3, 0, '</outline>' FROM f UNION ALL SELECT '', 4, 0, '</body></opml>'""")
def opml_sink(r: Reader) -> DataFrame:
    """The lines of the outline document, in the order of sinks.OPML_ORDER, which sinks.write_lines keeps."""
    return sinks.opml_lines(r.feed_sources, r.categories, "https://reader.example")


@query("J11", r"""
SELECT id, coalesce(CASE WHEN id % 3 > 0 THEN 'kept ' || id END, trim(substr(regexp_replace(content, '\s+', ' ', 'g'), 1, 160))) AS snippet, id % 3 = 0 AS filled FROM feed_articles""".replace("\\\\", "\\"))
def snippet_fallback(r: Reader) -> DataFrame:
    """Snippets as stored; contents are read for those rows alone that have none yet."""
    stored = r.feed_articles.select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("kept "), F.col("id").cast("string"))).alias("snippet"))
    missing = stored.where("snippet is null").select("id")
    made = r.feed_articles.select("id", "content").join(missing, "id", "left_semi")
    made = made.select("id", F.trim(F.substring(F.regexp_replace("content", r"\s+", " "), 1, 160)).alias("made"))
    return stored.join(made, "id", "left").select("id", F.coalesce("snippet", "made").alias("snippet"), F.col("made").isNotNull().alias("filled"))


@query("J12", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT path, arg_min(url || '?token=new' || page_id, page_id) AS fresh FROM p WHERE page_id % 3 < 2 AND path <> '' GROUP BY 1)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN coalesce(fresh, url || '?token=old') ELSE url END AS src, page_id % 2 = 0 AND fresh IS NOT NULL AS swapped FROM p LEFT JOIN f USING (path)""")
def fresh_signed_images(r: Reader) -> DataFrame:
    """Stored images whose URL is signed take the fresh URL with the same path, the first that has it; others stay."""
    rows = r.pages.select("page_id", "url", urls.path(F.col("url")).alias("path"))
    fresh = rows.where("page_id % 3 < 2 and path <> ''").groupBy("path").agg(F.min_by(F.concat("url", F.lit("?token=new"), F.col("page_id").cast("string")), "page_id").alias("fresh"))
    stored = rows.select("page_id", "path", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("?token=old"))).otherwise(F.col("url")).alias("src"))
    swap = urls.is_signed(F.col("src")) & F.col("fresh").isNotNull()
    return stored.join(fresh, "path", "left").select("page_id", F.when(swap, F.col("fresh")).otherwise(F.col("src")).alias("src"), swap.alias("swapped"))


@query("X08", "SELECT l_orderkey, l_orderkey % 5 <> 0 OR NOT list_contains(list(l_linenumber), 1) AS accepted FROM lineitem GROUP BY 1")
def marker_reassembly(r: Reader) -> DataFrame:
    """Batches come back with markers; one whose markers aren't exactly those sent is refused."""
    sent = r.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("sent"))
    back = sent.withColumn("text", F.array_join(F.transform(F.filter("sent", lambda k: (F.col("l_orderkey") % 5 != 0) | (k != 1)), lambda k: F.concat(F.lit("[["), k.cast("string"), F.lit("]] x"))), " "))
    ids = F.array_sort(F.transform(F.regexp_extract_all("text", F.lit(r"\[\[(\d+)\]\]"), F.lit(1)), lambda x: x.cast("int")))
    return back.select("l_orderkey", (ids == F.col("sent")).alias("accepted"))


@query("F19", "SELECT page_id, CAST(DATE '2024-01-31' - CAST(page_id % 60 AS INTEGER) AS DATE) AS published FROM pages")
def content_dates(r: Reader) -> DataFrame:
    @pandas_udf("string")
    def of(batch):
        return batch.map(html.date_text)

    said = F.concat(F.lit("Posted on "), F.date_format(F.date_sub(F.to_date(F.lit("2024-01-31")), (F.col("page_id") % 60).cast("int")), "MMMM d, yyyy"), F.lit(" "), F.regexp_replace("html", "<[^>]+>", " "))
    return r.pages.select("page_id", markup.parse_date(of(said)).alias("published"))


@query("D10", fr"""
WITH {ARTICLES}, b AS (SELECT page_id, replace(url, '&', '&amp;') AS u, {BODY} AS body, t, trim({ENTITIES.format("h1")}) AS h, inner_ FROM t JOIN pages USING (page_id)),
k AS (SELECT *, trim(right(left(t, 60), 20)) AS tail, trim(substr(t, length(h) + 1)) AS p FROM b),
i AS (SELECT *, '<img src="' || u || '" alt="">' AS img FROM k)
SELECT page_id, CASE WHEN tail <> '' AND contains(h, tail) THEN replace(body, '</h1>', img || '</h1>') WHEN tail <> '' AND contains(p, tail) THEN regexp_replace(body, '</p></article>$', img || '</p></article>') ELSE body || img END AS body FROM i""")
def merged_images(r: Reader) -> DataFrame:
    """Bodies with an image, the page's address standing for it, behind the block that holds the end of the body's first 60 characters."""
    found = settled(nodes.articles(r.pages).select(F.col("page_id").alias("page"), "body", "text"), "bodies")
    shots = found.join(r.pages.select(F.col("page_id").alias("page"), "url"), "page").select("page", F.lit(0).alias("n"), F.col("url").alias("src"), F.lit("").alias("alt"), F.left("text", F.lit(60)).alias("anchor"))
    return nodes.with_images(found.select("page", F.col("body").alias("html")), shots).select(F.col("page").alias("page_id"), F.col("html").alias("body"))


@query("F54", r"""
WITH s AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inner_, html FROM pages),
o AS (SELECT page_id, inner_, regexp_replace(regexp_replace(regexp_replace(html, '<!DOCTYPE html>', ''), '<!--.*?-->', '', 'g'), '</body></html>$', '') AS x FROM s),
c AS (SELECT page_id, replace(replace(replace(replace(replace(x, '</article>', repeat('</b></p>', len(regexp_extract_all(inner_, '<p><b>'))) || '</article>'), '="</p>"', '="&lt;/p&gt;"'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS x FROM o)
SELECT page_id, replace(x, '&#39;', chr(39)) || '</body></html>' AS html FROM c""")
def restored_attributes(r: Reader) -> DataFrame:
    pages = r.pages.select(F.col("page_id").alias("page"), "html")
    bare = pages.select("page", F.regexp_replace("html", r"<(\w+)[^>]*>", "<$1>").alias("html"))
    return nodes.with_attributes(bare, pages).select(F.col("page").alias("page_id"), "html")


@query("F49", r"""
WITH t AS (SELECT id, ltrim(title, ':—–- ' || chr(9) || chr(10) || chr(13)) AS bare, title, 'TOP > News > ' || title AS b FROM feed_articles), p AS (SELECT *, string_split_regex(b, '[>＞›»]') AS parts FROM t),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, len(parts)), lambda i: NOT (length(trim(parts[i])) BETWEEN 1 AND 24 AND NOT regexp_matches(parts[i], '[。.!?！？\n]')))), len(parts)) - 1 AS steps FROM p)
SELECT id, trim(CASE id % 5 WHEN 0 THEN bare WHEN 1 THEN 'A novel translated by Jane Doe wins: ' || title WHEN 2 THEN 'Also ' || bare WHEN 3 THEN bare ELSE 'Not translated by hand, but ' || title END) AS title,
 CASE WHEN steps < 2 THEN b ELSE ltrim(substr(b, CAST(list_sum(list_transform(parts[1:steps], lambda x: length(x) + 1)) AS BIGINT) + 1)) END AS plain,
 CASE id % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'Japan' WHEN 2 THEN 'Plain 📰' ELSE '🔥' END AS category FROM k""")
def display_texts(r: Reader) -> DataFrame:
    """Titles without the translator's tag, which stands in front, or behind a globe, or is no tag but text; without trails; and categories without pictographs."""
    title, n = F.col("title"), F.col("id") % 5
    told = lambda words: F.concat(F.lit(words), title)
    tagged = F.when(n == 0, told("Translated by Qwen: ")).when(n == 1, told("A novel translated by Jane Doe wins: ")).when(n == 2, told("Also 🌐 translated by Qwen 2.5 (max) — ")).when(n == 3, told(" 🌐 TRANSLATED BY lmt: ")).otherwise(told("Not translated by hand, but "))
    names = F.array(F.lit("🗞️ News"), F.lit("🇯🇵 Japan"), F.lit("Plain 📰"), F.lit("🔥"))
    return r.feed_articles.select("id", text.clean_translation_tag(tagged).alias("title"), text.strip_breadcrumb(told("TOP > News > ")).alias("plain"), text.category_label(F.get(names, (F.col("id") % 4).cast("int"))).alias("category"))
