"""Pages as rows: one for each element and piece of text, with the elements above it. What pages say is joins and aggregates of these.

A parser in Arrow batches gives the rows and nothing else. Every aggregate is by page, so its groups are bounded by a page.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions import markup, urls
from feedlens.operators.html import BLOCKS, CHROME, DROPPED, LAZY, VIDEO_HOSTS, VOID, tree
from feedlens.sources.shared import settled

#: place counts elements and texts in the order of the page, from 0 for the page itself; last is the last place inside. mark: class and id, of an iframe
#: its address. path: what lies above, from the page down. Texts have the tag #text; markup: as html.Text has it.
NODE = "place int, last int, tag string, attrs map<string, string>, text string, markup string, mark string, path array<struct<place: int, tag: string, mark: string>>"
CONTAINERS = ("article", "main", "div", "section", "body", "td")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Attributes that a cleaned body keeps, elements that it keeps when they are empty, and words in class or id that mark page furniture.
KEPT_ATTRIBUTES = ("href", "src", "srcset", "alt", "width", "height", "title")
KEPT_EMPTY = ("td", "th", "iframe", "video")
BOILERPLATE = r"(?i)(^|[\s_-])(ad|ads|advert|share|social|related|newsletter|comments?|sidebar|promo)([\s_-]|$)"
PAGE = ["page"]
#: Elements that a path may hold. What lies deeper counts as lying in the last of them, so that a row's size is bounded.
DEEPEST = 200


def _rows(html: str | None) -> Iterator[tuple]:
    rows, above, todo = [], [], [(tree(html), (), 0)]
    while todo:
        node, path, parent = todo.pop()
        above.append(parent)
        if isinstance(node, str):
            rows.append([len(rows), len(rows), "#text", {}, str(node), node.markup, "", path])
            continue
        mark = node.attrs.get("src", "") if node.tag == "iframe" else f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".strip()
        place = len(rows)
        rows.append([place, place, node.tag, node.attrs, None, None, mark, path])
        below = path if len(path) >= DEEPEST else (*path, {"place": place, "tag": node.tag, "mark": mark})
        todo += [(c, below, place) for c in reversed(node.children)]
    for row, parent in zip(reversed(rows), reversed(above)):
        rows[parent][1] = max(rows[parent][1], row[1])
    yield from rows


def flat_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", asked: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(page, NODE): the rows of every page; a null or empty one has its #root alone. Settled, as what reads them reads them often; asked leaves
    out what none of them reads."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page", *(c.split(":")[0].split()[0] for c in ("place", "last", "tag", "attrs", "text", "markup", "mark", "path"))]
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                yield pd.DataFrame([(i, *row) for i, html in zip(part["page"], part["html"]) for row in _rows(html)], columns=names)

    kind = pages.schema[id_col].dataType.simpleString()
    return settled(asked(pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html")).mapInPandas(parse, f"page {kind}, {NODE}")), "nodes")


def _in(path: Column, test) -> Column:
    return F.exists(path, test)


def plain(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _joined(rows: DataFrame, group: list[str], order: Column, text: Column, name: str, between: str = " ") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("s"))))
    return rows.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["s"]), between).alias(name))


def said(nodes: DataFrame) -> DataFrame:
    """The rows of text that readers see."""
    return nodes.where((F.col("tag") == "#text") & ~_in(F.col("path"), lambda p: p["tag"].isin("script", "style")))


def texts_of(nodes: DataFrame, wanted: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """(page, place, said): the text inside each wanted element (page, place); an empty one where there is none. tags: those that wanted elements
    have, where they are known, so that texts go to no other elements above them."""
    above = F.filter("path", lambda p: p["tag"].isin(*tags)) if tags else F.col("path")
    inside = said(nodes).select("page", F.col("place").alias("at"), "text", F.explode(F.transform(above, lambda p: p["place"])).alias("place"))
    wanted = wanted.select("page", "place").distinct()
    found = _joined(inside.join(wanted, ["page", "place"], "left_semi"), ["page", "place"], F.col("at"), F.col("text"), "said")
    return wanted.join(found, ["page", "place"], "left").select("page", "place", plain(F.coalesce("said", F.lit(""))).alias("said"))


def _dropped(tag: Column, mark: Column) -> Column:
    furniture = tag.isin("div", "section", "ul") & mark.rlike(BOILERPLATE)
    video = F.lit(False)
    for host in VIDEO_HOSTS:
        video = video | F.contains(F.lower(mark), F.lit(host))
    return tag.isin(*DROPPED, *CHROME) | furniture | ((tag == "iframe") & ~video)


def bodies(nodes: DataFrame) -> DataFrame:
    """(page, body): the place of the element with the most text in blocks of its own, less twice its links' texts.

    Articles and main parts have 25 characters in hand; the page's first article stands in if the element found has not half of its text. Of equal
    scores the first element is taken, and the page itself where none has a score above -1.
    """
    holders = nodes.where(F.col("tag").isin(*CONTAINERS)).select("page", "place", "tag")
    blocks = nodes.where(F.col("tag").isin(*BLOCKS) & F.element_at("path", -1)["tag"].isin(*CONTAINERS)).select("page", "place", F.element_at("path", -1)["place"].alias("holder"))
    own = texts_of(nodes, blocks, BLOCKS).join(blocks, ["page", "place"]).groupBy("page", F.col("holder").alias("place")).agg(F.sum(F.length("said")).alias("own"))
    anchors = nodes.where("tag = 'a'").select("page", "place", F.explode("path.place").alias("holder"))
    links = texts_of(nodes, anchors, ("a",)).join(anchors, ["page", "place"]).groupBy("page", F.col("holder").alias("place")).agg(F.sum(F.length("said")).alias("links"))
    scored = holders.join(own, ["page", "place"], "left").join(links, ["page", "place"], "left").fillna(0, ["own", "links"])
    score = F.col("own") - 2 * F.col("links") + F.when(F.col("tag").isin("article", "main"), 25).otherwise(0)
    best = scored.withColumn("score", score).where("score > -1").groupBy("page").agg(F.max_by("place", F.struct("score", -F.col("place"))).alias("best"))
    first = nodes.where("tag = 'article'").groupBy("page").agg(F.min("place").alias("article"))
    chosen = nodes.where("place = 0").select("page").join(best, "page", "left").join(first, "page", "left").withColumn("best", F.coalesce("best", F.lit(0)))
    asked = chosen.select("page", F.explode(F.array(F.lit(0), F.col("best"), F.coalesce("article", F.lit(0)))).alias("place"))
    sizes = texts_of(nodes, asked).select("page", "place", F.length("said").alias("n"))
    of = lambda c: sizes.select("page", F.col("place").alias(c), F.col("n").alias(f"n_{c}"))
    whole = chosen.join(of("best"), ["page", "best"]).join(of("article"), ["page", "article"], "left").join(of("root").where("root = 0").drop("root"), "page")
    instead = F.col("article").isNotNull() & (F.col("n_best") < 0.5 * F.least("n_root", "n_article"))
    return whole.select("page", F.when(instead, F.col("article")).otherwise(F.col("best")).alias("body"))


def cleaned(nodes: DataFrame) -> DataFrame:
    """The rows of each page's body, `body` its place: without scripts, forms, page furniture and frames other than video; lazy images have their sources."""
    inside = nodes.join(bodies(nodes), "page").where((F.col("place") == F.col("body")) | _in(F.col("path"), lambda p: p["place"] == F.col("body")))
    above = F.filter("path", lambda p: p["place"] > F.col("body"))
    rows = inside.where(~_in(above, lambda p: _dropped(p["tag"], p["mark"])) & ((F.col("place") == F.col("body")) | ~_dropped(F.col("tag"), F.col("mark"))))
    src = F.col("attrs")["src"]
    lazy = F.coalesce(*[F.nullif(F.col("attrs")[n], F.lit("")) for n in reversed(LAZY)])
    waits = (F.col("tag") == "img") & lazy.isNotNull() & (F.coalesce(src, F.lit("")).isin("") | F.coalesce(src.startswith("data:"), F.lit(False)))
    shown = F.when(waits, F.map_concat(F.map_filter("attrs", lambda k, v: k != "src"), F.create_map(F.lit("src"), lazy))).otherwise(F.col("attrs"))
    return rows.withColumn("attrs", F.map_filter(shown, lambda k, v: k.isin(*KEPT_ATTRIBUTES))).withColumn("path", F.filter("path", lambda p: p["place"] >= F.col("body")))


def _tag_text(tag: Column, attrs: Column) -> Column:
    entries = F.transform(F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(markup.escaped(e["value"], quotes=True), F.lit("'"), F.lit("&#x27;")), F.lit('"')))
    return F.concat(F.lit("<"), tag, F.array_join(entries, ""), F.lit(">"))


def serialized(rows: DataFrame, name: str, more: DataFrame | None = None) -> DataFrame:
    """(page, name): the rows as HTML again, elements around what is inside them. more: (page, pos, kind, depth, s) of text to put in:
    kind 0 opens at a place, 1 closes behind one, the deeper first, which is the one that opened later: an element has -2 times its place."""
    opened = F.when(F.col("tag") == "#text", F.coalesce("markup", markup.escaped(F.col("text")))).otherwise(_tag_text(F.col("tag"), F.col("attrs")))
    depth = -2 * F.col("place")
    begins = rows.where("tag <> '#root'").select("page", F.col("place").alias("pos"), F.lit(0).alias("kind"), depth.alias("depth"), opened.alias("s"))
    closing = rows.where(~F.col("tag").isin("#text", "#root", *VOID))
    ends = closing.select("page", F.col("last").alias("pos"), F.lit(1).alias("kind"), depth.alias("depth"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("s"))
    events = begins.union(ends) if more is None else begins.union(ends).union(more)
    return _joined(events, PAGE, F.struct("pos", "kind", "depth"), F.col("s"), name, "")


def without_empty(rows: DataFrame) -> DataFrame:
    """rows without elements in which there is nothing: no text but white space, no void element, no cell or frame."""
    full = rows.where(((F.col("tag") == "#text") & (plain(F.col("text")) != "")) | F.col("tag").isin(*VOID, *KEPT_EMPTY))
    own = full.where("tag <> '#text'").select("page", "place")
    kept = full.select("page", F.explode("path.place").alias("place")).union(own).distinct()
    # no path names elements below DEEPEST; few others come here
    rest = rows.where("tag <> '#text' and last > place").select("page", "place", "last").join(kept, ["page", "place"], "left_anti").alias("e")
    within = (F.col("e.page") == F.col("f.page")) & (F.col("f.place") > F.col("e.place")) & (F.col("f.place") <= F.col("e.last"))
    kept = kept.union(rest.join(full.select("page", "place").alias("f"), within, "left_semi").select("page", "place"))
    holder = F.when(F.col("tag") == "#text", F.coalesce(F.element_at("path", -1)["place"], F.col("place"))).otherwise(F.col("place"))
    return rows.withColumn("holder", holder).join(kept.withColumnRenamed("place", "holder"), ["page", "holder"]).select(*rows.columns)


def images(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """(page, place, src, alt, anchor): the images of cleaned rows, each address once, with up to 100 characters of the text before them; bases: (page, url)."""
    found = rows.where("tag = 'img' and attrs['src'] <> ''").join(bases, "page").select("page", "place", urls.absolute(F.col("url"), F.trim(F.col("attrs")["src"])).alias("src"), F.coalesce(F.col("attrs")["alt"], F.lit("")).alias("alt"))
    first = found.where("not startswith(src, 'data:')").groupBy("page", "src").agg(F.min(F.struct("place", "alt")).alias("x")).select("page", "x.place", "src", "x.alt")
    before = said(rows).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    joined = first.join(before, "page", "left")
    text = F.array_join(F.transform(F.filter("t", lambda x: x["place"] < F.col("place")), lambda x: x["text"]), " ")
    return joined.select("page", "place", "src", "alt", F.right(plain(F.coalesce(text, F.lit(""))), F.lit(100)).alias("anchor"))


def blocks(rows: DataFrame) -> DataFrame:
    """(page, place, tag, text): the topmost blocks of cleaned rows that have text."""
    top = rows.where(F.col("tag").isin(*BLOCKS) & ~_in(F.col("path"), lambda p: p["tag"].isin(*BLOCKS))).select("page", "place", "tag")
    return top.join(texts_of(rows, top, BLOCKS), ["page", "place"]).where("said <> ''").select("page", "place", "tag", F.col("said").alias("text"))


def articles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, title, lang, main_image, body, text, snippet, featured, n_blocks, images): what each page's article is.

    The title is that of the metadata, else the first h1, else the title element, else Untitled; the main image that of the metadata, else the
    body's first. snippet and featured are the text's first 200 and 1200 characters. Null and empty pages have empty texts.
    """
    nodes, bases = flat_nodes(pages, id_col, html_col), pages.select(F.col(id_col).alias("page"), F.coalesce(url_col, F.lit("")).alias("url"))
    rows = settled(cleaned(nodes), "cleaned")
    name = F.lower(F.coalesce(F.nullif(F.col("attrs")["property"], F.lit("")), F.col("attrs")["name"]))
    told = lambda k: F.min_by(F.when(name == k, F.coalesce(F.col("attrs")["content"], F.lit(""))), F.when(name == k, F.col("place")))
    meta = nodes.where("tag = 'meta'").groupBy("page").agg(told("og:title").alias("og_title"), told("og:image").alias("og_image"), told("twitter:image").alias("twitter_image"))
    firsts = nodes.where("tag in ('h1', 'title')").groupBy("page", "tag").agg(F.min("place").alias("place"))
    heads = firsts.join(texts_of(nodes, firsts, ("h1", "title")), ["page", "place"]).groupBy("page").agg(F.max(F.when(F.col("tag") == "h1", F.col("said"))).alias("h1"), F.max(F.when(F.col("tag") == "title", F.col("said"))).alias("head"))
    langs = nodes.where("tag = 'html'").groupBy("page").agg(F.min_by(F.col("attrs")["lang"], "place").alias("lang"))
    text = _joined(said(rows), PAGE, F.col("place"), F.col("text"), "raw").select("page", plain(F.col("raw")).alias("text"))
    body = serialized(without_empty(rows), "body")
    shots = images(rows, bases).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "src", "alt", "anchor"))).alias("shots"))
    counts = blocks(rows).groupBy("page").agg(F.count("*").cast("int").alias("n_blocks"))
    found = bases
    for part in (meta, heads, langs, text, body, shots, counts):
        found = found.join(part, "page", "left")
    told_ = lambda *columns: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])
    text = F.coalesce("text", F.lit(""))
    cut = lambda n: F.when(F.length(text) <= n, text).otherwise(F.concat(F.left(text, F.lit(n)), F.lit("...")))
    main = F.coalesce(told_("og_image", "twitter_image"), F.get("shots", 0)["src"])
    shots = F.transform(F.coalesce("shots", F.array().cast("array<struct<place:int,src:string,alt:string,anchor:string>>")), lambda s: F.struct(s["src"].alias("src"), s["alt"].alias("alt"), s["anchor"].alias("anchor")))
    return found.select(
        F.col("page").alias(id_col), F.trim(F.coalesce(told_("og_title", "h1", "head"), F.lit("Untitled"))).alias("title"), F.coalesce(told_("lang"), F.lit("en")).alias("lang"), urls.absolute(F.col("url"), main).alias("main_image"),
        plain(F.coalesce("body", F.lit(""))).alias("body"), text.alias("text"), cut(200).alias("snippet"), cut(1200).alias("featured"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), shots.alias("images"),
    )


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, place, link, title, pattern, headed): the links outside page furniture, absolute, without fragments.

    pattern: the two elements above, each as tag.class.class of its first two classes by name; headed: under or around a heading.
    """
    def asked(rows: DataFrame) -> DataFrame:
        """Elements, and the texts of links; what lies above is read of links, their texts and headings."""
        told = F.when(F.col("tag").isin("#text", "a", *HEADINGS[:4]), F.col("path")).otherwise(F.array().cast(rows.schema["path"].dataType))
        rows = rows.where((F.col("tag") != "#text") | _in(F.col("path"), lambda p: p["tag"] == "a"))
        return rows.select("page", "place", "tag", F.map_filter("attrs", lambda k, v: k.isin("href", "class")).alias("attrs"), "text", told.alias("path"))

    nodes = flat_nodes(pages, id_col, html_col, asked)
    anchors = nodes.where((F.col("tag") == "a") & (F.col("attrs")["href"] != "") & ~_in(F.col("path"), lambda p: p["tag"].isin(*CHROME)))
    above = F.filter("path", lambda p: p["tag"] != "#root")
    classes = nodes.where("place > 0 and tag <> '#text'").select("page", "place", F.array_sort(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")).alias("classes"))
    steps = anchors.select("page", F.col("place").alias("a"), F.posexplode(F.slice(above, F.greatest(F.size(above) - 1, F.lit(1)), F.lit(2))).alias("at", "p")).select("page", "a", "at", F.col("p.place").alias("place"), F.col("p.tag").alias("tag"))
    named = steps.join(classes, ["page", "place"]).withColumn("step", F.concat_ws(".", F.array_insert(F.slice("classes", 1, 2), 1, F.col("tag"))))
    patterns = _joined(named, ["page", "a"], F.col("at"), F.col("step"), "pattern", ">").withColumnRenamed("a", "place")
    around = nodes.where(F.col("tag").isin(*HEADINGS[:4])).select("page", F.explode("path.place").alias("place")).distinct().withColumn("around", F.lit(True))
    under = _in(F.col("path"), lambda p: p["tag"].isin(*HEADINGS[:4]))
    rows = anchors.select("page", "place", F.col("attrs")["href"].alias("href"), under.alias("under")).join(texts_of(nodes, anchors, ("a",)), ["page", "place"])
    rows = rows.join(patterns, ["page", "place"], "left").join(around, ["page", "place"], "left").join(pages.select(F.col(id_col).alias("page"), F.coalesce(url_col, F.lit("")).alias("url")), "page")
    link = F.substring_index(urls.absolute(F.col("url"), F.trim("href")), "#", 1)
    return rows.select(F.col("page").alias(id_col), "place", link.alias("link"), F.col("said").alias("title"), F.coalesce("pattern", F.lit("")).alias("pattern"), (F.col("under") | F.coalesce("around", F.lit(False))).alias("headed"))


def fits(selector: str) -> Column:
    """Whether a row is an element that a selector of tags, .classes, #ids and descendants matches; commas part alternatives."""
    def one(step: str, tag: Column, mark: Column) -> Column:
        name = re.match(r"[A-Za-z0-9]*", step)[0].lower()
        out = (tag == name) if name else (tag != "#text")
        for _, value in re.findall(r"([.#])([\w-]+)", step):
            out = out & F.array_contains(F.split(mark, r"\s+"), value)
        return out

    def inside(path: Column, steps: list[str]) -> Column:
        """How many of the steps lie above, one below the other; the first that fits is as good as any."""

        def after(n: Column, p: Column) -> Column:
            out = n
            for k, step in enumerate(steps):
                out = F.when((n == k) & one(step, p["tag"], p["mark"]), F.lit(k + 1)).otherwise(out)
            return out

        return F.aggregate(path, F.lit(0), after)

    options = F.lit(False)
    for option in selector.split(","):
        *above, last = option.split()
        options = options | (one(last, F.col("tag"), F.col("mark")) & (inside(F.col("path"), above) == len(above)))
    return options & (F.col("place") > 0)


def selected(pages: DataFrame, selectors: dict[str, str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, one text column for each selector): the first element of each page that a site's own selectors match; null where none does."""
    nodes = flat_nodes(pages, id_col, html_col)
    firsts = nodes.groupBy("page").agg(*[F.min(F.when(fits(s), F.col("place"))).alias(n) for n, s in selectors.items()])
    long = firsts.unpivot(["page"], list(selectors), "name", "place").where("place IS NOT NULL")
    text = long.join(texts_of(nodes, long), ["page", "place"]).groupBy("page").pivot("name", list(selectors)).agg(F.first("said"))
    return firsts.select("page").join(text, "page", "left").withColumnRenamed("page", id_col)


def _of_all(pages: DataFrame, found: DataFrame) -> DataFrame:
    """found (page, html) for every page, empty where a page has nothing."""
    return pages.select("page").join(found, "page", "left").select("page", F.coalesce("html", F.lit("")).alias("html"))


def with_images(html: DataFrame, shots: DataFrame, key: int = 20) -> DataFrame:
    """(page, html): bodies (page, html) with images (page, n, src, alt, anchor) behind the first block that holds the end of their anchor text.

    Others come at the end, in the order of n. Images that a body has already, and repeated ones, are left out.
    """
    nodes = flat_nodes(html, "page", "html")
    have = nodes.where("tag = 'img'").select("page", F.col("attrs")["src"].alias("src"))
    new = shots.groupBy("page", "src").agg(F.min(F.struct("n", "alt", "anchor")).alias("x")).select("page", "src", "x.*").join(have, ["page", "src"], "left_anti")
    paragraphs = nodes.where(F.col("tag").isin(*BLOCKS)).select("page", "place", "last")
    texts = paragraphs.join(texts_of(nodes, paragraphs, BLOCKS), ["page", "place"])
    tail = new.withColumn("tail", F.trim(F.right(F.coalesce("anchor", F.lit("")), F.lit(key))))
    at = tail.join(texts, "page").where("tail <> '' and contains(said, tail)").groupBy("page", "src").agg(F.min_by(F.struct("last", "place"), "place").alias("p"))
    ends = nodes.where("place = 0").select("page", F.col("last").alias("end"))
    put = tail.join(at, ["page", "src"], "left").join(ends, "page")
    image = _tag_text(F.lit("img"), F.create_map(F.lit("src"), F.col("src"), F.lit("alt"), F.coalesce("alt", F.lit(""))))
    # behind the block's content: before its closing tag, which has its own depth; several in the order of n
    several = put.select("page", F.coalesce("p.last", "end").alias("pos"), F.coalesce(-2 * F.col("p.place") - 1, F.lit(1)).alias("depth"), F.struct("n", image.alias("s")).alias("x"))
    more = several.groupBy("page", "pos", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("s"))
    return _of_all(html, serialized(nodes, "html", more.select("page", "pos", F.lit(1).alias("kind"), "depth", "s")))


def with_attributes(translated: DataFrame, originals: DataFrame) -> DataFrame:
    """(page, html): translated markup with the attributes of the original: its n-th element of a tag gets those of the n-th there, over its own."""
    nth = F.row_number().over(Window.partitionBy("page", "tag").orderBy("place"))
    elements = lambda n: n.where("tag not in ('#text', '#root')").select("page", "tag", "place", "attrs", nth.alias("n"))
    nodes = flat_nodes(translated, "page", "html")
    given = elements(flat_nodes(originals, "page", "html")).select("page", "tag", "n", F.col("attrs").alias("given"))
    merged = elements(nodes).join(given, ["page", "tag", "n"]).select("page", "place", F.map_concat(F.map_filter("attrs", lambda k, v: ~F.map_contains_key(F.col("given"), k)), F.col("given")).alias("merged"))
    rows = nodes.join(merged, ["page", "place"], "left").withColumn("attrs", F.coalesce("merged", "attrs")).drop("merged")
    return _of_all(translated, serialized(rows, "html"))
