"""What sites send: feed documents, payloads in pages, links under a source's own selectors; and bodies and reviews that go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import markup
from feedlens.operators import bilingual, payloads, selectors
from feedlens.plans.registry import query
from feedlens.sources import feeds, review
from feedlens.sources.shared import scratch
from feedlens.sources.tables import Reader

lit, concat, when = F.lit, F.concat, F.when


def feed_documents(r: Reader) -> DataFrame:
    """(feed, base, text): every article as an item of a feed document, up to 50 in one. RSS, Atom, RDF and RSS with CDATA take turns
    by the document's number; images come as media elements, enclosures or image elements, links in several spellings; each
    thirteenth item has no link of its own (an entry then takes any link), and every ninth document is broken."""
    a = r.feed_articles.select("id", "url", markup.escaped(F.col("title")).alias("title"), F.col("title").alias("raw"), F.regexp_extract("url", "^https://([^/]*)", 1).alias("host"), F.expr("id div 50").alias("g"))
    k, style = F.col("id") % 5, F.col("g") % 4
    key = F.col("id").cast("string")
    address = when(F.col("id") % 3 == 0, F.col("url")).when(F.col("id") % 3 == 1, concat(lit("/a/"), key)).otherwise(concat(lit("../x/./../a/"), key))
    image = concat("url", lit("/i.png"))
    attribute = lambda before, after: concat(lit(before), image, lit(after))
    media = when(k == 0, attribute('<media:content url="', '"/><media:thumbnail url="/t.png"/>')).when(k == 1, attribute('<media:thumbnail url="', '"/>'))
    shown = media.when(k == 2, attribute('<enclosure type="audio/mpeg" url="/x.mp3"/><enclosure type="image/png" url="', '"/>')).when(k == 3, attribute("<image><url> ", " </url></image>")).otherwise(lit(""))
    entry_shown = media.when(k == 2, attribute('<link rel="enclosure" type="image/png" href="', '"/>')).when(k == 3, lit('<link rel="preview" type="text/html" href="/p"/>')).otherwise(attribute('<media:content medium="x"/><link rel="image" type="image/webp" href="', '"/>'))
    title = when(style == 3, concat(lit("<title><![CDATA["), "raw", lit("]]></title>"))).otherwise(concat(lit("<title>"), "title", lit("</title>")))
    linked = F.col("id") % 13 != 12
    item = concat(lit("<item>"), title, when(linked, concat(lit("<link> "), address, lit(" </link>"))).otherwise(lit("")), lit("<atom:link href='/no'/>"), shown, lit("</item>"))
    entry = concat(lit("<entry>"), title, when(linked, concat(lit('<link rel="self" href="/self"/><link rel="alternate" href="'), address, lit('"/>'))).otherwise(lit("")), entry_shown, lit("</entry>"))
    rows = a.select("host", "g", F.struct("id", when(style == 1, entry).otherwise(item).alias("x")).alias("i"))
    docs = rows.groupBy("host", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "\n").alias("items"))
    name = when(F.col("g") % 2 == 0, concat(lit("<title>Feed of "), "host", lit("</title>"))).otherwise(lit(""))
    own = concat(lit("<link>/home</link>"), name)
    rss = concat(lit('<rss version="2.0"><channel><atom:link rel="self" href="/feed"/>'), own, "items", lit("</channel></rss>"))
    atom = concat(lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><link rel="self" href="/feed"/><link rel="alternate" href="/home"/>'), name, "items", lit("</feed>"))
    rdf = concat(lit("\n <rdf:RDF><channel>"), own, lit("</channel>"), "items", lit("</rdf:RDF>"))
    style = F.col("g") % 4
    text = when(style == 1, atom).when(style == 2, rdf).otherwise(rss)
    text = when(F.col("g") % 9 == 8, F.replace(text, lit("</title>"), lit(""))).otherwise(text)
    return docs.select(concat("host", lit("/"), F.col("g").cast("string")).alias("feed"), concat(lit("https://"), "host", lit("/feed")).alias("base"), text.alias("text"))


@query("S03 S04", r"""
WITH a AS (SELECT id, title, url, regexp_extract(url, '^https://([^/]*)', 1) AS host, id // 50 AS g FROM feed_articles),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY host, g ORDER BY id) - 1 AS INTEGER) AS place FROM a)
SELECT host || '/' || g AS feed, place, CASE WHEN id % 13 <> 12 THEN url WHEN id % 5 = 3 THEN 'https://' || host || '/p' ELSE url || '/i.png' END AS url, trim(title, ' ' || chr(9) || chr(10) || chr(13)) AS title, CASE WHEN (g % 4 = 1 AND id % 5 <> 3) OR (g % 4 <> 1 AND id % 5 <> 4) THEN url || '/i.png' END AS image,
 CASE WHEN g % 2 = 0 THEN 'Feed of ' || host ELSE host END AS site_name, 'https://' || host || '/home' AS site_url
FROM p WHERE (id % 13 <> 12 OR (g % 4 = 1 AND id % 5 > 1)) AND g % 9 <> 8""")
def feed_scan(r: Reader) -> DataFrame:
    return feeds.scan_feeds(feed_documents(r), "feed", "text", "base")


PAYLOAD_RULES = [
    ("one.example", "__NEXT_DATA__", "$.props.initialProps.pageProps.article.blocks", "$.blockType", "$.htmlTokens", "$.image.cdnUrl", "$.image.caption", "$.summary",
     "$.props.initialProps.pageProps.article.teaser", "$.props.initialProps.pageProps.article.description", "$.props.initialProps.pageProps.article.mainImage.cdnUrl"),
    ("two.example", "story-data", "$.story.parts", "$.type", "$.tokens", "$.src", "$.caption", "$.text", "$.story.intro", "$.story.subtitle", "$.story.hero"),
]


def payload_pages(r: Reader) -> DataFrame:
    """(page_id, url, html): the pages as two sites would send them whose text is in a script: a block for each paragraph, as prose, image or
    summary in turn, and blocks of other kinds. Every third page is of a site without rule, every seventh payload is cut off."""
    text = lambda pattern: F.regexp_extract("html", pattern, 1)
    p = r.pages.select("page_id", F.col("url").alias("base"), F.regexp_extract_all("html", lit("<p>([^<]+)</p>"), lit(1)).alias("ps"), text("<title>([^<]*)").alias("title"))
    kind = F.col("page_id") % 3
    token = lambda k, c: F.struct(k.alias("type"), c.alias("content"))

    def tokens(t: Column, i: Column) -> Column:
        return F.array(F.array(token(when(i == 0, lit("H2")).otherwise(lit("text")), F.substring(t, 1, 5)), token(lit("b"), F.substr(t, lit(6)))), F.array().cast("array<struct<type:string,content:string>>"))

    def block(kind_name: str, tokens_name: str, summary_name: str, image: str):
        def of(t: Column, i: Column) -> Column:
            src, said = concat("base", lit("/"), i.cast("string")), when(i % 2 == 0, t).otherwise(lit(" "))
            shot = F.struct(src.alias("cdnUrl"), said.alias("caption")) if image == "nested" else None
            columns = [when(i % 3 == 0, lit("Text")).when(i % 3 == 1, lit("image")).otherwise(lit("summary")).alias(kind_name), tokens(t, i).alias(tokens_name), F.array(t, lit(" ")).alias(summary_name)]
            return F.struct(*columns, *([shot.alias("image")] if shot is not None else [src.alias("src"), said.alias("caption")]))
        return of

    other = ',7,{"kind":"ad","image":{"cdnUrl":"no"}}]'
    blocks = lambda *names: F.regexp_replace(F.to_json(F.transform("ps", block(*names))), r"\]$", when(F.size("ps") > 0, lit(other)).otherwise(lit("]")))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    one = concat(lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"initialProps":{"pageProps":{"article":{"teaser":['), quoted(F.col("title")), lit(',""],"mainImage":{"cdnUrl":"/m'), F.col("page_id").cast("string"), lit('"},"blocks":'), blocks("blockType", "htmlTokens", "summary", "nested"), lit("}}}}}</script>"))
    two = concat(lit("<SCRIPT type='application/json' id='story-data'>{\"story\":{\"subtitle\":"), quoted(F.col("title")), lit(',"parts":'), blocks("type", "tokens", "text", "flat"), lit("}}</SCRIPT>"))
    made = concat(lit("<html><body>"), when(kind == 0, one).otherwise(two), lit("</body></html>"))
    made = when(F.col("page_id") % 7 == 6, F.replace(F.replace(made, lit("}</script>"), lit("</script>")), lit("}</SCRIPT>"), lit("</SCRIPT>"))).otherwise(made)
    where = when(kind == 0, lit("https://www.one.example/x")).when(kind == 1, lit("https://two.example/x")).otherwise(lit("https://three.example/x"))
    return p.select("page_id", where.alias("url"), made.alias("html"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query("S07 X03", rf"""
WITH p AS (SELECT page_id, url, regexp_extract_all(html, '<p>([^<]+)</p>', 1) AS ps, trim(regexp_extract(html, '<title>([^<]*)', 1)) AS title FROM pages WHERE page_id % 3 < 2 AND page_id % 7 <> 6),
b AS (SELECT *, array_to_string(list_transform(ps, lambda t, i: CASE (i - 1) % 3 WHEN 0 THEN CASE WHEN i = 1 THEN '<h2>' || {_ESC.format('t')} || '</h2>' ELSE '<p>' || {_ESC.format('t')} || '</p>' END
 WHEN 1 THEN '<figure><img src="' || {_ESC.format("url || '/' || (i - 1)")} || '" alt="' || CASE WHEN (i - 1) % 2 = 0 THEN {_ESC.format('trim(t)')} ELSE '' END || '"/>' || CASE WHEN (i - 1) % 2 = 0 AND trim(t) <> '' THEN '<figcaption>' || {_ESC.format('trim(t)')} || '</figcaption>' ELSE '' END || '</figure>'
 ELSE CASE WHEN trim(t) <> '' THEN '<p>' || {_ESC.format('trim(t)')} || '</p>' ELSE '' END END), '') AS body FROM p)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'one.example' ELSE 'two.example' END AS host, '<div>' || CASE WHEN title <> '' AND NOT contains(body, title) THEN '<p>' || {_ESC.format('title')} || '</p>' ELSE '' END || body || '</div>' AS content,
 CASE WHEN page_id % 3 = 0 THEN '/m' || page_id ELSE '' END AS main_image FROM b WHERE body <> ''""")
def embedded_json(r: Reader) -> DataFrame:
    return payloads.embedded_articles(payload_pages(r), r.spark.createDataFrame(PAYLOAD_RULES, payloads.RULES))


@query("S06", r"""
WITH n AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages WHERE page_id % 4 <> 3),
l AS (SELECT page_id, root, unnest(regexp_extract_all(nav, '<a href="([^"]+)">', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]+">([^<]*)</a>', 1)) AS title, generate_subscripts(regexp_extract_all(nav, '<a href="([^"]+)">', 1), 1) AS n FROM n),
u AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN root || href ELSE href END AS url, arg_min(title, n) AS title, min(n) AS n FROM l GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS place, url, title FROM u""")
def selector_links(r: Reader) -> DataFrame:
    """Each page's menu, by four ways to say it that sources may have; the last excludes it."""
    rules = [(0, "nav li", "a", None), (1, "nav, footer", "ul > li a[href]", ".ad, article"), (2, "html nav", None, "footer"), (3, "nav ul", "a", "nav")]
    sources = r.spark.createDataFrame(rules, "rule long, item_selector string, link_selector string, exclude_selector string")
    return selectors.links_by_selectors(r.pages.withColumn("rule", F.col("page_id") % 4), sources, "rule")


@query("D19", r"""
WITH b AS (SELECT id, detected_language AS lang, list_transform(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''), lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS o FROM feed_articles),
e AS (SELECT id, lang, list_transform(o, lambda x, i: {'t': ['p', 'h2', 'li'][(i - 1) % 3 + 1], 'o': x, 'b': CASE WHEN i % 4 <> 0 THEN translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END, 'n': (i - 1) - (i - 1) // 4}) AS x FROM b),
f AS (SELECT id, lang, x, CAST(len(list_filter(x, lambda y: y.b IS NOT NULL)) AS INTEGER) AS n_pairs, CASE WHEN id % 2 = 0 THEN '<p>Translated by Qwen</p>' ELSE '' END AS badge FROM e)
SELECT id, n_pairs, CASE WHEN n_pairs = 0 THEN badge ELSE '' END || array_to_string(list_transform(x, lambda y: CASE WHEN y.b IS NULL THEN '<' || y.t || '>' || y.o || '</' || y.t || '>' ELSE '<' || y.t || ' data-pair="' || y.n || '" lang="' || lang || '">' || y.o || '</' || y.t || '>' END), '') AS original,
 CASE WHEN n_pairs = 0 THEN badge ELSE '' END || array_to_string(list_transform(x, lambda y: CASE WHEN y.b IS NULL THEN '<' || y.t || '>' || y.o || '</' || y.t || '>' ELSE '<blockquote data-pair="' || y.n || '" lang="' || lang || '"><' || y.t || '>' || y.o || '</' || y.t || '></blockquote><' || y.t || '>' || y.b || '</' || y.t || '>' END), '') AS both,
 CASE WHEN n_pairs = 0 THEN badge ELSE '' END || array_to_string(list_transform(x, lambda y: CASE WHEN y.b IS NULL THEN '<' || y.t || '>' || y.o || '</' || y.t || '>' ELSE '<' || y.t || ' data-pair="' || y.n || '">' || y.b || '</' || y.t || '>' END), '') AS translation FROM f""")
def translation_views(r: Reader) -> DataFrame:
    """The three views of bodies in which all blocks but each fourth are folded with a translation."""
    a = r.feed_articles.select("id", "detected_language", F.transform(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), lambda x: markup.escaped(x)).alias("o"))
    tags = F.array(lit("p"), lit("h2"), lit("li"))
    upper = lambda x: F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    blocks = F.transform("o", lambda x, i: F.struct(F.element_at(tags, i % 3 + 1).alias("tag"), x.alias("original"), when(i % 4 != 3, upper(x)).alias("translation")))
    body = concat(when(F.col("id") % 2 == 0, lit("<p>Translated by Qwen</p>")).otherwise(lit("")), bilingual.interleaved(blocks))
    found = a.select("id", "detected_language", body.alias("body")).withColumn("pairs", bilingual.pairs(F.col("body")))
    return found.select("id", F.size("pairs").alias("n_pairs"), *[bilingual.view(F.col("body"), F.col("pairs"), v, F.col("detected_language")).alias(v) for v in bilingual.VIEWS])


REVIEW_AXES = {"Topic": "primary_topic", "Region": "region", "Type": "article_type"}


@query("S20", r"""
WITH l AS (SELECT 'Topic' AS axis, primary_topic AS name, id, title FROM feed_articles UNION ALL SELECT 'Region', region, id, title FROM feed_articles UNION ALL SELECT 'Type', article_type, id, title FROM feed_articles),
c AS (SELECT axis, name, count(*) AS n FROM l WHERE name IS NOT NULL GROUP BY ALL), s AS (SELECT axis, sum(n) AS total FROM c GROUP BY axis),
x AS (SELECT axis, name, string_agg(title, ' | ' ORDER BY id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY axis, name ORDER BY id) AS k FROM l WHERE name IS NOT NULL AND title IS NOT NULL) WHERE k <= 5 GROUP BY ALL)
SELECT axis AS "Axis", name AS "Name", n AS "Sample_Count", round(n / 30.0, 1) AS "Est_Daily_Flow_Articles", printf('%.1f%%', n * 100.0 / total) AS "Est_Share_Pct", t AS "Example_Headlines", NULL AS "Evaluation (more/less/depends)", NULL AS "User_Comments"
FROM c JOIN s USING (axis) LEFT JOIN x USING (axis, name)""")
def review_export(r: Reader) -> DataFrame:
    """The review sheets, written as files and read again."""
    folder = scratch(r.spark, "review")
    review.write_review(review.review_rows(r.feed_articles, REVIEW_AXES, days=30), folder)
    return review.read_review(r.spark, folder)
