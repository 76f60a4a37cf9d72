"""Literals and invariants of the operators outside SQL's reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.functions import markup, numbers, text, urls
from feedlens.operators import localize, nodes, rerank
from feedlens.operators import relational as rel
from feedlens.operators import status, weights


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("label, key", [("Smartphones", "smartphone"), ("TV Series", "tv series"), ("Business", "business"), ("Model Kits", "model kit"), ("Fashion & Accessories", "fashion accessory"), (None, ""), ("  ", ""), ("Boxes", "box"), ("Analysis", "analysis")])
def test_canonical_label(spark, label, key):
    assert one(spark, text.canonical_label(F.col("l")), l=label) == key


@pytest.mark.parametrize("votes, value", [(1, 0.24), (3, 0.70), (5, 1.14), (10, 2.11), (20, 3.31)])
def test_saturate(spark, votes, value):
    assert round(one(spark, numbers.saturate(F.col("v"), 4, 17), v=votes), 2) == value


def test_decay(spark):
    assert one(spark, numbers.decay(F.col("a")), a=90.0) == 0.5 and one(spark, numbers.decay(F.col("a")), a=-3.0) == 1.0


@pytest.mark.parametrize("raw, day", [("2026-03-17T14:30:00Z", "2026-03-17"), ("2026/03/17", "2026-03-17"), ("03/17/2026", "2026-03-17"), ("2026.03.17", "2026-03-17"), ("March 5, 2026 at noon", "2026-03-05"), ("5 March 2026", "2026-03-05"), ("2026年3月7日", "2026-03-07"), ("2026-13-45", "None"), ("soon", "None"), (None, "None")])
def test_parse_date(spark, raw, day):
    assert str(one(spark, markup.parse_date(F.col("d")), d=raw)) == day


def test_publication_and_site_names(spark):
    p = lambda s: one(spark, text.publication_name(F.col("s")), s=s)
    assert [p(s) for s in ("Hype - Travel", "Football | The Guardian", "ROOMIE | 旅行", "Plain", None)] == ["Hype", "The Guardian", "ROOMIE", "Plain", ""]
    assert one(spark, markup.site_name(F.col("t")), t="A long headline - Site") == "Site"


def test_srcset(spark):
    s = "a.jpg 400w, b.jpg 1600w, c.jpg 2400w"
    assert one(spark, markup.best_srcset(F.col("s")), s=s) == "c.jpg" and one(spark, markup.bounded_srcset(F.col("s"), 1600), s=s) == "b.jpg"
    assert one(spark, markup.best_srcset(F.col("s")), s="a.jpg 1x, b.jpg 2x") == "b.jpg"


def test_urls(spark):
    assert one(spark, urls.host(F.col("u")), u="https://WWW.Example.com/a?b") == "example.com"
    assert one(spark, urls.site_url(F.col("u")), u="https://feeds.example.com/x") == "https://example.com"
    assert [one(spark, urls.is_article_link(F.col("u")), u=u) for u in ("https://a.b/c", "https://a.b/", "https://t.co/x", "mailto:x", "https://a.b/login?x")] == [True, False, False, False, False]


def test_badges(spark):
    assert one(spark, text.badge_provider(F.col("b")), b="Qwen (fell back from Google)</p>") == "Qwen"
    assert one(spark, text.badge_is_fallback(F.col("b")), b="Qwen (fell back from Google)</p>") is True
    assert one(spark, text.badge_provider(F.col("b")), b="<p>") is None


def candidates(n=60):
    rng = np.random.default_rng(0)
    return [(1, i, int(rng.integers(5)), f"t{rng.integers(4)}", f"r{rng.integers(3)}", "News", None, 0, int(rng.integers(9)), float(rng.normal()), 0.0, 0.0, 0.0) for i in range(n)]


COLUMNS = "page long, id long, source_id long, primary_topic string, region string, article_type string, vote string, times long, topic_votes long, score double, t_topic double, t_region double, t_type double"


def test_rerank_is_a_permutation_and_spreads_feeds(spark):
    rows = candidates()
    for every in (0, 10):
        got = rerank.rerank_pages(spark.createDataFrame(rows, COLUMNS).withColumn("t_topic", (F.col("primary_topic") == "t0").cast("double")), every=every).collect()
        assert sorted(r["id"] for r in got) == list(range(60)) and sorted(r["place"] for r in got) == list(range(1, 61))
    order = rerank.calibrated(np.array([3.0, 2.99, 2.98, 2.97, 1.0]), [(np.array([0, 0, 0, 1, 0]), np.array([0.5, 0.5]))])
    assert order[0] == 0 and order[1] == 3  # the other feed comes second though others score more
    assert rerank.calibrated(np.ones(3), [(np.zeros(3, int), np.ones(1))]) == [0, 1, 2]


def brute_rerank(score, dims, strength=0.3, eps=0.01):
    """Candidate by candidate, the whole divergence computed anew."""
    lo, hi = min(score), max(score)
    norm = [(s - lo) / (hi - lo) if hi - lo > 1e-9 else 1.0 for s in score]
    out, left = [], list(range(len(score)))
    while left:
        def value(i):
            kl = 0.0
            for codes, q in dims:
                k = len(out) + 1
                for c, share in enumerate(q):
                    have = sum(codes[j] == c for j in [*out, i])
                    kl += share * math.log(share / ((have + eps) / (k + eps * max(1, len(q)))))
            return (1 - strength) * norm[i] - strength * kl
        best = max(left, key=lambda i: (round(value(i), 9), -i))
        out.append(best)
        left.remove(best)
    return out


def test_rerank_matches_brute_force():
    rng = np.random.default_rng(4)
    score = rng.normal(size=14)
    dims = [(rng.integers(0, 3, 14), np.array([0.5, 0.3, 0.2])), (rng.integers(0, 2, 14), np.array([0.5, 0.5]))]
    assert rerank.calibrated(score, dims) == brute_rerank(score, dims)


def test_exploration_moves_unseen_up():
    n = 30
    order = rerank.explore(list(range(n)), np.arange(n, 0, -1.0), np.ones(n, bool), np.arange(n) % 3, np.zeros(n))
    assert sorted(order) == list(range(n)) and order[9] == 15 and order[19] == 19  # 16, of another feed, stands above the slot already


def test_exploration_matches_slot_by_slot():
    """Each slot in turn looks through the pool: by score, then fewest topic votes, a feed without a slot first."""
    rng = np.random.default_rng(5)
    for n in (10, 11, 40, 100):
        score, votes, feed, ok = rng.integers(0, 4, n).astype(float), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.random(n) < 0.8
        order = rng.permutation(n).tolist()
        want, used = list(order), set()
        pool = sorted((i for i in order[n // 2 :] if ok[i]), key=lambda i: (-score[i], votes[i])) if n > 10 else []
        for slot in range(9, n, 10):
            if pool:
                chosen = next((i for i in pool if feed[i] not in used), pool[0])
                pool.remove(chosen)
                used.add(feed[chosen])
                if want.index(chosen) > slot:
                    want.remove(chosen)
                    want.insert(slot, chosen)
        assert rerank.explore(list(order), score, ok, feed, votes) == want


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_numbers_and_neighbours_of_a_large_group(spark, monkeypatch, one_task):
    monkeypatch.setattr(rel, "ONE_TASK", one_task)
    rows = [(None if n % 50 == 0 else n % 50 % 2, n, (n * 37) % 101) for n in range(400)]
    df = spark.createDataFrame(rows, "g long, id long, v long")
    groups = {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((-v, i, v))
    want, near = {}, {}
    for g, members in groups.items():
        members.sort()
        for k, (_, i, _) in enumerate(members):
            want[i] = (k + 1, len(members), sum(m[2] for m in members[:k]), sum(m[2] for m in members))
            near[i] = tuple(members[k + d][1] if 0 <= k + d < len(members) else None for d in (-1, -2, 1, 2))
    got = rel.numbered(df, ["g"], [F.desc("v"), F.col("id")], "n", "c", {"run": "v"}).collect()
    assert {r["id"]: (r["n"], r["c"], r["run"], r["run_all"]) for r in got} == want
    got = rel.neighbours(df.select("g", "id", "v"), ["g"], [F.desc("v"), F.col("id")], "id", 2).collect()
    assert {r["id"]: (r["before1"], r["before2"], r["after1"], r["after2"]) for r in got} == near
    assert not rel.numbered(df.where("id < 0"), ["g"], [F.col("id")], "n").collect()


def test_documents_as_files(spark, tmp_path):
    from xml.etree import ElementTree

    from feedlens.sources import sinks

    sources = spark.createDataFrame([(1, 'A & "B"', "https://a.example", 1, 1), (2, "C", "https://c.example", None, 1), (3, "off", "https://o.example", 1, 0)], "id long, name string, url string, category_id long, enabled int")
    categories = spark.createDataFrame([(1, "News <1>")], "id long, name string")
    articles = spark.sql("SELECT 7L AS id, 1L AS source_id, '' AS title, 'https://a.example/7?x=1&y=2' AS url, '<p>x</p>' AS content, TIMESTAMP_NTZ '2024-01-05 06:07:08' AS created_at, 'https://a.example/i.webp' AS main_image")
    sinks.write_lines(sinks.opml_lines(sources, categories, "https://r.example"), str(tmp_path / "opml"))
    (path,) = (tmp_path / "opml").glob("part-*")
    root = ElementTree.fromstring(path.read_bytes())
    assert [(c.get("text"), [s.get("title") for s in c]) for c in root.find("body")] == [("News <1>", ['A & "B"']), ("Uncategorized", ["C"])]
    sinks.write_documents(sinks.rss_documents(sources, articles, 5), "source_id", "xml", str(tmp_path / "rss"))
    (path,) = (tmp_path / "rss" / "source_id=1").glob("part-*")
    item = ElementTree.fromstring(path.read_bytes()).find("channel/item")
    assert (item.findtext("title"), item.findtext("link"), item.findtext("pubDate")) == ("Untitled", "https://a.example/7?x=1&y=2", "Fri, 05 Jan 2024 06:07:08 +0000")
    assert item.findtext("{http://purl.org/rss/1.0/modules/content/}encoded") == "<p>x</p>" and item.find("enclosure").get("type") == "image/webp"


def test_trails_and_tags(spark):
    strip = lambda s: one(spark, text.strip_breadcrumb(F.col("s")), s=s)
    assert [strip(s) for s in ("TOP > News > The title", "TOP » A › B ＞ x > 1", "Only > one", "A sentence. Yes > b > c", "a > " + "b" * 25 + " > c", None)] == ["The title", "1", "Only > one", "A sentence. Yes > b > c", "a > " + "b" * 25 + " > c", ""]
    clean = lambda s: one(spark, text.clean_translation_tag(F.col("s")), s=s)
    assert [clean(s) for s in ("🌐 Translated by Qwen-MT (v2): The title", "translated BY DeepL — x", "plain", "a 🌐 Translated by B: c", None)] == ["The title", "x", "plain", "a c", ""]


def test_packing_and_spacing(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([1000, 1000, 1000, 3000, 10])], "doc long, idx long, size long")
    got = rerank.packed(rows, "doc", "idx", "size", 2400).orderBy("idx").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 2, 3]
    rows = spark.createDataFrame([(1, i, True) for i in range(12)], "page long, place long, wanted boolean")
    got = rerank.spaced(rows, "page", "place", "wanted", 4).orderBy("place").collect()
    assert [r["place"] for r in got if r["picked"]] == [0, 5, 10]


PAGE = """<html lang="fr"><head><title>Head - Site</title><meta property="og:image" content="/i.jpg"></head><body><nav><a href="/n">nav</a></nav>
<article><h1>Title</h1><p>One <b>two<p>Three<script>x()</script><img data-src="/l.png" alt="a"><iframe src="https://ads.example/x"></iframe><iframe src="https://youtube.com/v"></iframe></article></body></html>"""


def pages(spark, *rows):
    return spark.createDataFrame([(n, u, h) for n, (u, h) in enumerate(rows)], "page_id int, url string, html string")


def test_articles(spark):
    more = '<div><p> </p><div class="share-box"><p>gone</p></div><table><tr><td></td></tr></table><p>a &lt; b "c"<br>e</p><img src="data:xx" data-original="/q.png" title="it\'s"><img src="/q.png"><ul><li>x<li>y</ul><b><i> </i></b></div>'
    long = "<div>" + "".join(f"<p>{'word ' * 60}{n}</p>" for n in range(5)) + '</div><div><p><a href="/x">' + "link " * 400 + "</a></p></div>"
    got = [r.asDict(True) for r in nodes.articles(pages(spark, ("https://h.example/p", PAGE), (None, None), ("", ""), ("https://h.example/d/", more), ("x", long))).orderBy("page_id").collect()]
    assert (got[0]["title"], got[0]["lang"], got[0]["main_image"]) == ("Title", "fr", "https://h.example/i.jpg")
    assert got[0]["text"] == "Title One two Three" and "script" not in got[0]["body"] and "ads.example" not in got[0]["body"] and "youtube" in got[0]["body"]
    assert got[0]["images"] == [{"src": "https://h.example/l.png", "alt": "a", "anchor": "Title One two Three"}]
    for empty in got[1:3]:
        assert (empty["title"], empty["text"], empty["body"], empty["images"], empty["n_blocks"], empty["main_image"], empty["lang"]) == ("Untitled", "", "", [], 0, None, "en")
    assert got[3]["body"] == '<div><table><tr><td></td></tr></table><p>a &lt; b "c"<br>e</p><img title="it&#x27;s" src="/q.png"><img src="/q.png"><ul><li>x</li><li>y</li></ul></div>'
    assert [i["src"] for i in got[3]["images"]] == ["https://h.example/q.png"] and got[3]["n_blocks"] == 3
    assert "link" not in got[4]["text"] and got[4]["snippet"] == got[4]["text"][:200] + "..." and got[4]["featured"] == got[4]["text"][:1200] + "..."


def test_very_deep_and_very_long_pages(spark):
    deep, long = "<div>" * 3000 + "<p>core</p>" + "</div>" * 3000, "<article>" + "<p>some words</p>" * 5000 + "</article>"
    got = [r for r in nodes.articles(pages(spark, ("", deep), ("", long))).orderBy("page_id").collect()]
    assert got[0]["text"] == "core" and got[1]["n_blocks"] == 5000 and got[1]["text"].count("words") == 5000


def test_links_and_selectors(spark):
    page = '<nav><a href="/x">no</a></nav><div class="list b a"><h2><a href="/a#t">First</a></h2><a href="b">Second <h3>x</h3></a></div><a href="">none</a><a href="c"></a>'
    got = nodes.links(pages(spark, ("https://h.e/", page))).orderBy("place").collect()
    assert [tuple(r)[2:] for r in got] == [("https://h.e/a", "First", "div.a.b>h2", True), ("https://h.e/b", "Second x", "div.a.b", True), ("https://h.e/c", "", "", False)]
    page = '<div id="m" class="x y"><p>a</p><span class="z">b</span></div>'
    got = nodes.selected(pages(spark, ("", page), ("", None)), {"one": "div.x .z", "two": "#m p", "three": "ul, span", "four": "ul", "five": "div div p"}).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(0, "b", "a", "b", None, None), (1, None, None, None, None, None)]


def test_images_and_attributes_put_back(spark):
    html = spark.createDataFrame([(1, "<div><p>One two three four five six</p><p>Seven</p></div>"), (2, ""), (3, '<p>x</p><img src="a">')], "page int, html string")
    shots = [(1, 0, "a", None, "text before: three four five six"), (1, 1, "b", "q", "nowhere to be found"), (1, 2, "a", None, "Seven"), (1, 3, "c", "", "Seven"), (2, 0, "a", "", ""), (3, 0, "a", "", "x"), (3, 1, "b", "", "x"), (3, 2, "d", "", "x")]
    got = {r["page"]: r["html"] for r in nodes.with_images(html, spark.createDataFrame(shots, "page int, n int, src string, alt string, anchor string")).collect()}
    assert got == {1: '<div><p>One two three four five six<img src="a" alt=""></p><p>Seven<img src="c" alt=""></p></div><img src="b" alt="q">', 2: '<img src="a" alt="">', 3: '<p>x<img src="b" alt=""><img src="d" alt=""></p><img src="a">'}
    one = spark.createDataFrame([(1, '<p lang="fr">Un <a>b</a><p><a href="own" rel="r">c</a><i>d</i>'), (2, None)], "page int, html string")
    two = spark.createDataFrame([(1, '<p class="x">One <a href="1">b</a></p><p><a href="2" title="t">c</a></p><a href="3">e</a>'), (2, "<p>")], "page int, html string")
    got = {r["page"]: r["html"] for r in nodes.with_attributes(one, two).collect()}
    assert got == {1: '<p lang="fr" class="x">Un <a href="1">b</a></p><p><a rel="r" href="2" title="t">c</a><i>d</i></p>', 2: ""}


def test_fuzzy_urls_and_public_addresses(spark):
    base = "https://cdn.example/folder/of/images/"
    right = [(1, base + "sunset-over-the-bay-4711.jpg"), (1, base + "sunset-over-the-bay-4711.jpg"), (1, base + "portrait-of-a-lady-0815.jpg"), (2, base + "a1.jpg"), (2, base + "a2.jpg"), (2, None)]
    left = [(1, base + "sunset-over-the-bay-471.jpg"), (1, "https://short"), (2, base + "a3.jpg"), (3, base + "sunset-over-the-bay-4711.jpg"), (1, None)]
    got = localize.fuzzy_urls(spark.createDataFrame(left, "page int, url string"), spark.createDataFrame(right, "page int, url string"), "page").collect()
    assert [(r["page"], r["url"], r["match"]) for r in got] == [(1, left[0][1], right[0][1])] and 0.98 < got[0]["ratio"] < 1
    import ipaddress

    literals = ["0.1.2.3", "9.255.255.255", "10.0.0.1", "100.63.255.255", "100.64.0.0", "126.1.1.1", "127.8.8.8", "169.253.1.1", "169.254.0.9", "172.15.0.1", "172.31.255.255", "192.0.2.5", "198.18.0.1", "198.20.0.1", "203.0.113.9", "223.255.255.255", "224.0.0.1", "255.255.255.255", "8.8.4.4"]
    rows = [(f"https://{x}:80/a", ipaddress.ip_address(x).is_global and not ipaddress.ip_address(x).is_multicast) for x in literals] + [("http://[::1]/", False), ("http://[2606:4700::1]:8/", True), ("HTTPS://Example.COM", True), ("ftp://example.com", False), ("http://", False), (None, False), ("http://LOCALHOST:3", False)]
    assert [r["u"] for r in spark.createDataFrame(rows, "u string, w boolean").where(urls.is_public(F.col("u")) != F.col("w")).collect()] == []


def test_localize_longest_first_outside_tags(spark):
    frame = spark.createDataFrame([("<the>there the",), (None,)], "t string")
    assert [r["x"] for r in frame.select(localize.localize(F.col("t"), {"the": "le", "there": "là"}).alias("x")).collect()] == ["<the>là le", None]


def test_status_series_fills_gaps(spark):
    rows = spark.createDataFrame([("2024-01-30 01:00:00",), ("2024-01-30 01:30:00",)], "s string").select(F.to_timestamp_ntz("s").alias("at"))
    got = status.series(rows, "at", 72, "2024-01-31 00:00:00").collect()
    assert len(got) == 13 and sum(r["arrived"] for r in got) == 2


def test_upsert_and_insert_ignore(spark):
    old, new = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long"), spark.createDataFrame([(2, 9), (3, 1), (3, 0)], "k long, v long")
    assert sorted(map(tuple, rel.insert_ignore(old, new, ["k"], [F.col("v")]).collect())) == [(1, 5), (2, 6), (3, 0)]
    merged = rel.upsert(old, new.where("v > 0"), ["k"], {"v": F.coalesce(F.col("new.v"), F.col("old.v"))})
    assert sorted(map(tuple, merged.collect())) == [(1, 5), (2, 9), (3, 1)]


def test_votes_cancel_out(spark):
    votes = spark.createDataFrame([(1, "show_more"), (2, "show_less")], "article_id long, vote string").withColumn("updated_at", F.to_timestamp_ntz(F.lit("2024-01-31")))
    articles = spark.createDataFrame([(i, "T", '["A"]', "unknown", "News") for i in (1, 2)], "id long, primary_topic string, secondary_topics string, region string, article_type string")
    got = {(r["axis"], r["label"]): r for r in weights.vote_tally(votes, articles, F.to_timestamp_ntz(F.lit("2024-01-31"))).collect()}
    assert set(got) == {("topic", "T"), ("secondary", "a"), ("type", "News")} and all(r["tally"] == 0 and r["votes"] == 2 for r in got.values())


def test_translation_tags_and_category_names(spark):
    from feedlens.functions import text

    tags = {
        "A novel translated by Jane Doe wins": "A novel translated by Jane Doe wins", "🌐🌐 Translated by X-1 (v2): t": "t", " a 🌐  Translated by X — b": "a b", "Translated by A: Translated by B: c": "Translated by B: c",
        "": "", "x 🌐Translated byZ": "x 🌐Translated byZ", "TRANSLATED BY q": "", "a 🌐 translated by X: b 🌐 translated by Y: c": "a b c",
    }
    names = {"🗞️ News": "News", "🇯🇵日本": "日本", "🔥": "🔥", "© 2024": "2024", "Plain 📰": "Plain 📰", "": ""}
    for clean, want in ((text.clean_translation_tag, tags), (text.category_label, names)):
        rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", clean(F.col("s")).alias("c"))
        assert {r["s"]: r["c"] for r in rows.collect()} == want


def test_references_without_semicolon_are_text(spark):
    from feedlens.operators import html

    assert [(str(t), t.markup) for t in html.tree("a&amp;b &amp &am &copy; &foo; &#65; &#39 &").children] == [("a&b &amp &am © &foo; A &#39 &", "a&amp;b &amp &am © &foo; A &#39 &")]
    assert html.tree("<a href='/x?a=1&copy=2&amp;b'>\U000f0000&</a>").children[0] == html.Node("a", {"href": "/x?a=1&copy=2&b"}, ["\U000f0000&"])
    page = "<html><body><article><h1>A &amp;&amp; b&amp</h1><p>c&am</p><p>&amp;amp &lt;i&gt;</p></article></body></html>"
    pages = spark.createDataFrame([(1, "https://e.example/", page)], "page_id int, url string, html string")
    got = nodes.articles(pages).first()
    assert (got["title"], got["text"]) == ("A && b&amp", "A && b&amp c&am &amp <i>")
    assert got["body"] == "<article><h1>A &amp;&amp; b&amp</h1><p>c&am</p><p>&amp;amp &lt;i&gt;</p></article>"
    assert nodes.selected(pages, {"heading": "h1"}).first()["heading"] == "A && b&amp"
    assert [r["text"] for r in nodes.blocks(nodes.cleaned(nodes.flat_nodes(pages))).orderBy("place").collect()] == ["A && b&amp", "c&am", "&amp <i>"]
    with_page = pages.withColumnRenamed("page_id", "page")
    assert nodes.with_attributes(with_page, with_page).first()["html"] == page
    shots = spark.createDataFrame([(1, 0, "/i", "", "c&am")], "page int, n int, src string, alt string, anchor string")
    assert nodes.with_images(with_page.select("page", "html"), shots).first()["html"] == page.replace("c&am", 'c&am<img src="/i" alt="">')


def test_elements_that_are_never_closed_end_with_what_is_around_them(spark):
    deep = "<article>" + "<p><b>x" * 120 + "</article></i><footer>y</footer>"
    page = spark.createDataFrame([(1, deep)], "page int, html string")
    assert nodes.with_attributes(page, page).first()["html"] == "<article>" + "<p><b>x" * 120 + "</b></p>" * 120 + "</article><footer>y</footer>"
    assert nodes.articles(page.selectExpr("1 AS page_id", "'' AS url", "html")).first()["body"] == "<article>" + "<p><b>x" * 120 + "</b></p>" * 120 + "</article>"


def test_links_keep_no_other_texts(spark, monkeypatch):
    kept, settled = [], nodes.settled
    monkeypatch.setattr(nodes, "settled", lambda df, name: kept.append(settled(df, name)) or kept[-1])
    page = "<body><div class='b a'><p>long text</p><h2><a href='/x#y'>X <b>Y</b></a></h2></div><a href='z'><h3>Z</h3></a>text<a>none</a></body>"
    pages = spark.createDataFrame([(1, "https://e.example/d/", page)], "page_id int, url string, html string")
    got = sorted(tuple(r)[2:] for r in nodes.links(pages).collect())
    assert got == [("https://e.example/d/z", "Z", "body", True), ("https://e.example/x", "X Y", "div.a.b>h2", True)]
    assert sorted(r["text"] for r in kept[0].where("tag = '#text'").collect()) == ["X ", "Y", "Z", "none"]
