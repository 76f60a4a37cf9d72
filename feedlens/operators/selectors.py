"""Links of pages by selectors that each source keeps: a table function, joined laterally to rows that carry page and selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.operators.html import Node, tree

_PART = re.compile(r"([.#]?)([\w-]+|\*)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")


def _fits(node: Node, step: str) -> bool:
    for kind, name, attribute, value in _PART.findall(step):
        if attribute:
            if attribute not in node.attrs or value and node.attrs[attribute] != value:
                return False
        elif kind == ".":
            if name not in node.attrs.get("class", "").split():
                return False
        elif kind == "#":
            if node.attrs.get("id") != name:
                return False
        elif name != "*" and node.tag != name.lower():
            return False
    return True


def matches(root: Node, selector: str) -> Iterator[Node]:
    """All nodes below root that fit, in the order of the page. Steps: tag, .class, #id, [attribute], [attribute=value], below or
    directly below (>) the step before; commas part alternatives. root itself is no step."""
    options = [re.sub(r"\s*>\s*", " > ", o).split() for o in selector.split(",") if o.strip()]

    def held(above: list[Node], steps: list[str]) -> bool:
        if not steps:
            return True
        if steps[-1] == ">":
            return bool(above) and _fits(above[-1], steps[-2]) and held(above[:-1], steps[:-2])
        return any(_fits(above[n], steps[-1]) and held(above[:n], steps[:-1]) for n in range(len(above) - 1, -1, -1))

    todo: list[tuple[Node, list[Node]]] = [(c, []) for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        node, above = todo.pop()
        if any(_fits(node, steps[-1]) and held(above, steps[:-1]) for steps in options):
            yield node
        inside = [*above, node]
        todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]


@F.udtf(returnType="place int, url string, title string", useArrow=True)
class selected_links:
    """Rows (place, url, title) of one page's links: those that the link selector finds in what the item selector finds."""

    def eval(self, html: str, base: str, item: str, link: str, exclude: str):
        root = tree(html)
        gone = {id(below) for node in matches(root, exclude or "") for below in node.walk()}
        seen: set[str] = set()
        for container in matches(root, item or ""):
            for a in matches(container, link or "a") if id(container) not in gone else ():
                if id(a) in gone or not a.attrs.get("href"):
                    continue
                try:
                    url = urljoin(base or "", a.attrs["href"])
                except ValueError:  # a host that is none
                    continue
                if url not in seen:
                    seen.add(url)
                    yield len(seen) - 1, url, a.text()


def links_by_selectors(pages: DataFrame, sources: DataFrame, key: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, place, url, title): each page's links under its source's own selectors, the first of those with the same absolute URL.

    sources: key, item_selector, link_selector (null: a), exclude_selector (null: none), one row a source; pages carry the key. What the
    excluded parts hold is left out. Pages without a source, without item selector or html, and links without address give nothing.
    """
    asked = pages.select(id_col, key, F.col(url_col).alias("base"), F.col(html_col).alias("html")).join(sources.select(key, "item_selector", "link_selector", "exclude_selector"), key)
    outer = lambda c: F.col(c).outer()
    rows = selected_links(outer("html"), outer("base"), outer("item_selector"), outer("link_selector"), outer("exclude_selector"))
    return asked.where("html IS NOT NULL AND item_selector IS NOT NULL").lateralJoin(rows).select(id_col, "place", "url", "title")
