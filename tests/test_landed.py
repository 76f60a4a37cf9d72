"""Feeds, payloads, selectors, paired bodies and review files against literals."""

import json
import random

from pyspark.sql import functions as F

from feedlens.functions import urls
from feedlens.operators import bilingual, html, payloads, selectors
from feedlens.sources import feeds, review


def scanned(spark, *texts):
    rows = spark.createDataFrame([(n, t, "https://h.example/dir/feed?x=1") for n, t in enumerate(texts)], "id int, text string, base string")
    return [tuple(r)[:5] for r in feeds.scan_feeds(rows, "id", "text", "base").orderBy("id", "place").collect()]


def test_rss_items_links_and_images(spark):
    rss = """  <?xml version="1.0"?><rss xmlns:media="m"><channel><title>Site</title><link>https://s</link>
      <item><title> A &amp; B </title><link>one</link><media:thumbnail url="/t.jpg"/><media:content url="//cdn.example/c.jpg"/><enclosure type="image/png" url="e.png"/></item>
      <item><title>No link</title></item>
      <item><link><![CDATA[/two?a=1&b=2]]></link><enclosure type="audio/mp3" url="e.mp3"/><enclosure type="image/png" url="../e.png"/></item>
      <item><link>?q</link><title>first</title><title>second</title><image><url>i.gif</url></image></item>
      <item><link>#f</link><image>plain.gif</image></item><item><link>mailto:x@y</link></item></channel></rss>"""
    assert scanned(spark, rss) == [
        (0, 0, "https://h.example/dir/one", "A & B", "https://cdn.example/c.jpg"), (0, 2, "https://h.example/two?a=1&b=2", "", "https://h.example/e.png"),
        (0, 3, "https://h.example/dir/feed?q", "first", "https://h.example/dir/i.gif"), (0, 4, "https://h.example/dir/feed?x=1#f", "", "https://h.example/dir/plain.gif"), (0, 5, "mailto:x@y", "", None),
    ]


def test_atom_entries_and_texts_that_are_no_feeds(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">T</title><link rel="self" href="s"/>
      <entry><title>E</title><link rel="enclosure" type="image/x" href="q"/><link href="z"/><link rel="alternate" href="y"/></entry>
      <entry><link rel="related" href="r"/><content type="html">&lt;b&gt;</content></entry><entry><title>none</title></entry></feed>"""
    assert scanned(spark, atom, "<rss><channel><item><link>x</link></item>", None, "", "<html><item><link>x</link></item></html>", "<rss><channel/></rss>") == [
        (0, 0, "https://h.example/dir/y", "E", "https://h.example/dir/q"), (0, 1, "https://h.example/dir/r", "", None),
    ]


def test_absolute_urls(spark):
    from urllib.parse import urljoin

    bases = ("https://h.example", "https://h.example/", "https://h.example/a/b/c?d#e", "http://h.example/x")
    links = ("g", "./g", "g/", "/g", "//o.example/p", "?y", "g?y/./x", "g#s", "#s", ".", "./", "..", "../", "../g", "../../g", "../../../g", "/./g", "/../g", "g/./h", "g/../h", "g/..", "https://x/y/../z", "mailto:a")
    rows = spark.createDataFrame([(b, k) for b in bases for k in links], "b string, k string")
    for r in rows.withColumn("u", urls.absolute(F.col("b"), F.col("k"))).collect():
        want = r["k"] if r["k"].startswith("https:") else urljoin(r["b"], r["k"])
        assert r["u"] == want, (r["b"], r["k"])


def found(text, selector):
    return [n.text() for n in selectors.matches(html.tree(text), selector)]


def test_selectors_find_all_in_the_order_of_the_page():
    page = '<div id="m" class="x y"><p>a</p><span class="z">b<i>c</i></span></div><ul class="x"><li>d</li><li data-k="v w">e<ul><li>f</li></ul></li></ul>'
    assert found(page, "li") == ["d", "e f", "f"] and found(page, "ul > li") == ["d", "e f", "f"] and found(page, "li li, p") == ["a", "f"]
    assert found(page, ".x.y > span i") == ["c"] and found(page, "#m i") == ["c"] and found(page, "#m > i") == [] and found(page, "[data-k]") == ["e f"] and found(page, "li[data-k='v']") == []
    assert found(page, "div *") == ["a", "b c", "c"] and found(page, "") == [] and found(page, "table") == []


def test_links_by_selectors(spark):
    page = """<div class="custom-card"><a href="/1">One</a><a href="/1">Again</a><a>none</a></div><div class="ad custom-card"><a href="/3">Ad</a></div>
      <div class="custom-card"><div class="ad"><a href="/4">Ad</a></div><h2><a href="2">T <b>wo</b></a></h2><a href="http://[bad">x</a></div><a href="/5">Outside</a>"""
    pages = spark.createDataFrame([(1, "s", "https://e.example/d/", page), (2, "t", "https://e.example/", page), (3, "u", "https://e.example/", page), (4, "s", "https://e.example/", None), (5, None, "x", page)], "page_id int, site string, url string, html string")
    sources = spark.createDataFrame([("s", ".custom-card", None, ".ad"), ("t", ".custom-card", "h2 a", None), ("u", None, "a", None)], "site string, item_selector string, link_selector string, exclude_selector string")
    got = selectors.links_by_selectors(pages, sources, "site").orderBy("page_id", "place").collect()
    assert list(map(tuple, got)) == [(1, 0, "https://e.example/1", "One"), (1, 1, "https://e.example/d/2", "T wo"), (2, 0, "https://e.example/2", "T wo")]


def test_payloads_of_two_hosts(spark):
    rules = spark.createDataFrame([
        ("a.example", "__NEXT_DATA__", "$.p.blocks", "$.blockType", "$.htmlTokens", "$.image.cdnUrl", "$.image.caption", "$.summary", "$.p.teaser", "$.p.description", "$.p.main.cdnUrl"),
        ("b.example", "d", "$.x[0].y", "$.k", "$.t", "$.i", "$.c", "$.s", "$.none", "$.intro", "$.hero"),
    ], payloads.RULES)
    one = {"p": {"teaser": ["Lede & more", " ", "In body"], "description": "no", "main": {"cdnUrl": "/m"}, "blocks": [
        {"blockType": "Summary", "summary": "In body <x>"}, {"blockType": "image", "image": {"cdnUrl": '/i"', "caption": " C "}}, {"blockType": "image", "image": {"caption": "no src"}}, {"blockType": "widget", "image": {"cdnUrl": "/no"}}, 5, None, "s",
        {"blockType": "text", "htmlTokens": [[{"type": "H3", "content": "He"}, {"content": "ad"}], [], "x", [{"type": "link", "content": ""}, {"type": "b", "content": "'q'"}]]}, {"blockType": "text"}, {"blockType": "summary", "summary": {"a": 1}},
    ]}}
    two = {"x": [{"y": [{"k": "text", "t": [[{"type": "p", "content": "Hi"}]]}]}], "intro": "Intro", "hero": "/h"}
    wrap = lambda name, data: f"<html><script id='{name}' type='x'>{data}</script></html>"
    pages = [(1, "https://www.A.example/1", wrap("__NEXT_DATA__", json.dumps(one))), (2, "https://b.example/", wrap("d", json.dumps(two))), (3, "https://b.example/", wrap("d", "{")), (4, "https://b.example/", wrap("e", json.dumps(two))),
             (5, "https://c.example/", wrap("d", json.dumps(two))), (6, None, None), (7, "https://b.example/", wrap("d", '{"x": [{"y": []}]}')), (8, "https://b.example/", wrap("d", '{"x": 3}'))]
    got = {r[0]: tuple(r)[1:] for r in payloads.embedded_articles(spark.createDataFrame(pages, "page_id int, url string, html string"), rules).collect()}
    assert got == {
        1: ("a.example", '<div><p>Lede &amp; more</p><p>In body &lt;x&gt;</p><figure><img src="/i&quot;" alt="C"/><figcaption>C</figcaption></figure><h3>Head</h3><p>&#x27;q&#x27;</p></div>', "/m"),
        2: ("b.example", "<div><p>Intro</p><p>Hi</p></div>", "/h"),
    }


def test_paired_bodies_there_and_back(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(("a", " ", "<b>x</b>", "&amp;", "$1", "\\", "\n")) for _ in range(rng.randint(0, 8)))
    rows = [(n, [(rng.choice(("p", "h2", "li", "h6")), text(), text() if rng.random() < 0.7 else None) for _ in range(rng.randint(0, 7))]) for n in range(80)]
    df = spark.createDataFrame(rows, "id int, b array<struct<tag: string, original: string, translation: string>>").withColumn("body", bilingual.interleaved(F.col("b"))).withColumn("pairs", bilingual.pairs(F.col("body")))
    for r in df.select("*", *[bilingual.view(F.col("body"), F.col("pairs"), v, F.lit("fr")).alias(v) for v in bilingual.VIEWS]).collect():
        paired = [x for x in r["b"] if x["translation"] is not None]
        assert [(p["tag"], p["original"], p["translation"]) for p in r["pairs"]] == [tuple(x) for x in paired]
        plain = lambda x: f"<{x['tag']}>{x['original']}</{x['tag']}>"
        number = {id(x): k for k, x in enumerate(paired)}
        want = {
            "original": lambda x, k: f'<{x["tag"]} data-pair="{k}" lang="fr">{x["original"]}</{x["tag"]}>', "translation": lambda x, k: f'<{x["tag"]} data-pair="{k}">{x["translation"]}</{x["tag"]}>',
            "both": lambda x, k: f'<blockquote data-pair="{k}" lang="fr">{plain(x)}</blockquote><{x["tag"]}>{x["translation"]}</{x["tag"]}>',
        }
        for v in bilingual.VIEWS:
            assert r[v] == "".join(want[v](x, number[id(x)]) if id(x) in number else plain(x) for x in r["b"])


def test_views_of_other_bodies(spark):
    bodies = [
        '<p class="b">Translated by Qwen</p>\n<blockquote><p id="o">x</p></blockquote>\n<p id="t">y</p>', "<p>Translated by Qwen</p><p>x</p>", "<blockquote><p>two</p><p>inside</p></blockquote><p>y</p>",
        "<blockquote><p>x</p></blockquote><h2>other kind</h2>", None, "",
    ]
    df = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "id int, body string").withColumn("pairs", bilingual.pairs(F.col("body")))
    got = {r["id"]: (r["o"], r["t"]) for r in df.select("id", bilingual.view(F.col("body"), F.col("pairs"), "original").alias("o"), bilingual.view(F.col("body"), F.col("pairs"), "translation").alias("t")).collect()}
    assert got[0] == ('\n<p id="o" data-pair="0">x</p>', '\n<p id="t" data-pair="0">y</p>')
    assert all(got[n] == (bodies[n], bodies[n]) for n in range(1, 6))


def test_review_files(spark, tmp_path):
    rows = [(1, ' a "q", x ', "T", None), (2, "line\nbreak", "T", "R"), (3, None, "T", None), (4, "d", "S", None), (5, "e", None, None), (6, "f", "U, V", None), (7, "g", "T", None), (8, "h", "T", None), (9, "i", "T", None)]
    articles = spark.createDataFrame(rows, "id long, title string, topic string, region string")
    table = review.review_rows(articles, {"Topic": "topic", "Region": "region"}, days=10)
    review.write_review(table, str(tmp_path / "out"))
    got = sorted(tuple(r)[:6] for r in review.read_review(spark, str(tmp_path / "out")).collect())
    assert got == [("Region", "R", 1, 0.1, "100.0%", "line\nbreak"), ("Topic", "S", 1, 0.1, "12.5%", "d"), ("Topic", "T", 6, 0.6, "75.0%", ' a "q", x  | line\nbreak | g | h | i'), ("Topic", "U, V", 1, 0.1, "12.5%", "f")]
    first = next((tmp_path / "out" / "Axis=Topic").glob("*.csv")).read_text().splitlines()
    assert first[0].startswith("Name,Sample_Count,") and first[1].startswith("T,6,")


def test_proxied_images(spark):
    from feedlens.functions import images

    pages = [
        ("<p>a</p><img src='x/y.jpg' width=9><IMG alt=q SRCSET='/a.jpg 1x, /b.jpg 2x' src=\"data:image/gif;base64,x\">", "<p>a</p><img src=\"/p?url=https%3A//h.example/d/x/y.jpg&amp;w=800\" width=9><img src=\"/p?url=https%3A//h.example/b.jpg&amp;w=800\" alt=q>"),
        ("<img src='/c/1.jpg' data-srcset='/z 1x'><img src='https://a.media.net/1.gif'><img src='true'>b<img height='1px' src='/q.jpg'>", "<img src='/c/1.jpg'><img src='true'>b"), ("no images", "no images"), ("", ""), (None, None),
    ]
    rows = spark.createDataFrame(pages, "html string, want string").withColumn("got", images.proxied(F.col("html"), F.lit("https://h.example/d/e?f"), "/p", "/c/"))
    assert [r["got"] for r in rows.collect()] == [w for _, w in pages]
    assert spark.range(1).select(images.slides(F.lit("m.jpg"), F.array(F.lit("a.jpg"), F.lit("m.jpg"), F.lit(None), F.lit("x.svg?1"), F.lit(""), F.lit("a.jpg"), F.lit("my-LOGO.png"))).alias("x")).first()[0] == ["m.jpg", "a.jpg"]
    assert spark.range(1).select(images.slides(F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("x")).first()[0] == []


def test_views_of_long_bodies_take_time_by_their_length(spark):
    import time

    from feedlens.functions import images, text

    def took(column, n):
        began = time.perf_counter()
        rows = spark.range(1).select(F.repeat(F.lit("<blockquote><p>x &lt; y</p></blockquote><p>X</p>"), F.lit(n)).alias("b"), F.repeat(F.lit("<img src='/a.jpg'>b"), F.lit(n)).alias("i"), F.repeat(F.lit("a 🌐 Translated by X: b"), F.lit(n)).alias("t"))
        rows = rows.repartition(1).withColumn("pairs", bilingual.pairs(F.col("b")))
        assert rows.select(F.length(column).alias("n")).first()["n"] > n
        return time.perf_counter() - began

    for column in (bilingual.view(F.col("b"), F.col("pairs"), "both"), images.proxied(F.col("i"), F.lit("https://h.example/"), "/p", "/c/")):
        took(column, 10)
        assert took(column, 3000) < 20
    took(text.clean_translation_tag(F.col("t")), 10)
    assert took(text.clean_translation_tag(F.col("t")), 2000) < 20
