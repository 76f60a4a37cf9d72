"""RSS, RDF and Atom documents as rows, parsed by schema: one nested struct a document, exploded by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import urls

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string, _type: string>>"
_MEDIA = "array<struct<_url: string>>"
_ITEM = (
    f"struct<title: array<string>, link: {_LINK}, `media:content`: {_MEDIA}, content: {_MEDIA}, `media:thumbnail`: {_MEDIA}, "
    "enclosure: array<struct<_url: string, _type: string>>, image: array<struct<_VALUE: string, url: string>>>"
)
#: What is read of a feed. RSS has its items in the channel, RDF beside it, Atom has entries; prefixes are part of the names.
FEED = f"channel struct<title: array<string>, link: {_LINK}, item: array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>, title array<string>, link {_LINK}"


def _told(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _first(items: Column, name: str) -> Column:
    return F.try_element_at(items, F.lit(1))[name]


def _media(item: Column) -> Column:
    """The URL of the first media element: content, then thumbnail."""
    return F.coalesce(_first(item["media:content"], "_url"), _first(item["content"], "_url"), _first(item["media:thumbnail"], "_url"))


def _of_item(item: Column) -> Column:
    enclosed = _first(F.filter(item["enclosure"], lambda e: F.startswith(e["_type"], F.lit("image/"))), "_url")
    shown = F.coalesce(_told(_first(item["image"], "url")), _told(_first(item["image"], "_VALUE")))
    return F.struct(_told(_first(item["link"], "_VALUE")).alias("link"), F.trim(F.try_element_at(item["title"], F.lit(1))).alias("title"), F.coalesce(_media(item), enclosed, shown).alias("image"))


def _of_entry(entry: Column) -> Column:
    links = entry["link"]
    own = F.coalesce(_first(F.filter(links, lambda k: k["_rel"] == "alternate"), "_href"), _first(F.filter(links, lambda k: k["_rel"].isNull()), "_href"), _first(links, "_href"))
    shown = _first(F.filter(links, lambda k: k["_rel"].isin("enclosure", "image", "preview") & F.startswith(k["_type"], F.lit("image/"))), "_href")
    return F.struct(_told(own).alias("link"), F.trim(F.try_element_at(entry["title"], F.lit(1))).alias("title"), F.coalesce(_media(entry), shown).alias("image"))


def scan_feeds(feeds: DataFrame, id_col: str, text_col: str, base_col: str) -> DataFrame:
    """(id, place, url, title, image, site_name, site_url): a row for each item of each feed that has a link.

    The title is the first one given, or empty. The image is that of a media element, else of the first enclosure of an image type,
    else the item's image element; entries have links of such types instead. An entry's link is the alternate one, else one without
    relation, else the first. Addresses are made absolute by the feed's own. place counts all items from 0. site_name is
    the channel's title or the feed's host, site_url its first link that isn't to itself. Texts that aren't XML, are broken or are null
    give no rows; so do feeds without items.
    """
    text = F.ltrim(F.col(text_col), F.lit(" \t\r\n\ufeff"))
    known = text.startswith("<?xml") | text.startswith("<rss") | text.startswith("<feed") | text.startswith("<rdf:RDF")
    read = feeds.where(known).select(F.col(id_col), F.col(base_col).alias("base"), F.from_xml(text, FEED).alias("f"))
    items = F.concat(F.coalesce("f.channel.item", F.array()), F.coalesce("f.item", F.array()))
    rows = F.when(F.size(items) > 0, F.transform(items, _of_item)).otherwise(F.transform("f.entry", _of_entry))
    links = F.filter(F.coalesce("f.channel.link", "f.link"), lambda k: k["_rel"].isNull() | (k["_rel"] != "self"))
    site = F.coalesce(_told(_first(links, "_href")), _told(_first(links, "_VALUE")))
    name = F.coalesce(_told(F.try_element_at(F.coalesce("f.channel.title", "f.title"), F.lit(1))), F.regexp_extract("base", r"^[^:]+://([^/?#]*)", 1))
    found = read.select(id_col, "base", name.alias("site_name"), urls.absolute(F.col("base"), site).alias("site_url"), F.posexplode(rows).alias("place", "item")).where("item.link IS NOT NULL")
    return found.select(
        id_col, "place", urls.absolute(F.col("base"), F.col("item.link")).alias("url"), F.coalesce("item.title", F.lit("")).alias("title"), urls.absolute(F.col("base"), F.col("item.image")).alias("image"), "site_name", "site_url",
    )
