"""Fields of HTML by pattern, Column to Column; what needs a tree is in operators.html."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the title rule, in the order in which they are tried.
SEPARATORS = (" | ", " - ", " – ", " — ", " :: ", " » ", " ｜ ", "｜")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def _first(html: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def language(html: Column) -> Column:
    """The language that a page or feed states, in lower case: in its content-language, its html element, its language element, or anywhere by xml:lang; else en."""
    stated = _first(html, r"""(?i)<meta[^>]+http-equiv=["']content-language["'][^>]+content=["']([^"']+)""")
    of_page, of_feed, of_xml = _first(html, r"""(?i)<html[^>]*\slang=["']?([^\s"'>]+)"""), _first(html, r"(?i)<language>\s*([^<]*?)\s*</language>"), _first(html, r"""(?i)xml:lang=["']([^"']+)""")
    return F.lower(F.trim(F.coalesce(stated, of_page, of_feed, of_xml, F.lit("en"))))


def _date(text: Column, pattern: str, form: str) -> Column:
    return F.to_date(F.try_to_timestamp(_first(text, pattern), F.lit(form)))


def parse_date(text: Column) -> Column:
    """A date that a text begins with, in the common spellings; null if there is none."""
    text = F.trim(text)
    return F.coalesce(
        _date(text, r"^(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"), _date(text, r"^(\d{4}/\d{2}/\d{2})", "yyyy/MM/dd"), _date(text, r"^(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"),
        _date(text, r"^(\d{4}\.\d{2}\.\d{2})", "yyyy.MM.dd"), _date(text, rf"^((?:{MONTHS}) \d{{1,2}}, \d{{4}})", "MMMM d, yyyy"),
        _date(text, rf"^(\d{{1,2}} (?:{MONTHS}) \d{{4}})", "d MMMM yyyy"), _date(F.regexp_replace(text, r"^(\d{4})年(\d{1,2})月(\d{1,2})日.*", "$1-$2-$3"), r"^(\d{4}-\d{1,2}-\d{1,2})$", "yyyy-M-d"),
    )


def publish_date(html: Column) -> Column:
    """From metadata: published_time of articles or Open Graph, datePublished of linked data, publish_date."""
    meta = lambda kind, name: _first(html, rf"""(?i)<meta\s+{kind}=["']{name}["']\s+content=["']([^"']+)["']""")
    linked = _first(html, r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>[^<]*?"datePublished"\s*:\s*"([^"]+)"')
    found = (meta("property", "article:published_time"), meta("property", "og:published_time"), linked, meta("name", "publish_date"), meta("name", "date"))
    return F.coalesce(*map(parse_date, found))


def fresh_date(day: Column, today: Column) -> Column:
    """The date unless it is more than 7 days ahead or more than 90 days ago."""
    age = F.datediff(today, day)
    return F.when((age >= -7) & (age <= 90), day)


def site_name(title: Column) -> Column:
    """The shorter end of a title at its first separator in rank, the first one if they are equal."""
    out = title
    for sep in reversed(SEPARATORS):
        parts = F.split(title, "\\Q" + sep + "\\E")
        first, last = F.trim(F.element_at(parts, 1)), F.trim(F.element_at(parts, -1))
        out = F.when(F.contains(title, F.lit(sep)), F.when(F.length(last) < F.length(first), last).otherwise(first)).otherwise(out)
    return F.trim(out)


def _candidates(srcset: Column) -> Column:
    """(width, -place, url) of each entry; x descriptors count a thousand, none counts zero."""
    parts = F.split(F.trim(srcset), r",\s+")
    def one(part: Column, place: Column) -> Column:
        word = F.split(F.trim(part), r"\s+")
        size = F.try_element_at(word, F.lit(2))
        wide = F.coalesce(F.regexp_extract(size, r"^([0-9.]+)w$", 1).try_cast("double"), F.regexp_extract(size, r"^([0-9.]+)x$", 1).try_cast("double") * 1000, F.lit(0.0))
        return F.struct(wide.alias("w"), (-place).alias("p"), F.element_at(word, 1).alias("u"))
    return F.transform(parts, one)


def best_srcset(srcset: Column) -> Column:
    return F.array_max(_candidates(srcset))["u"]


def bounded_srcset(srcset: Column, most: int) -> Column:
    """The widest entry up to a width, else the widest of all."""
    found = _candidates(srcset)
    return F.coalesce(F.array_max(F.filter(found, lambda c: c["w"] <= most))["u"], F.array_max(found)["u"])


def escaped(text: Column, quotes: bool = False) -> Column:
    """text as XML character data, or as an attribute's value."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def channel_link(feed: Column, base: Column) -> Column:
    """The site that an RSS or Atom document names as its own, absolute; null if it names none but itself."""
    rss = F.xpath_string(feed, F.lit("/rss/channel/link[not(@rel='self')]"))
    atom = F.xpath_string(feed, F.lit("/feed/link[not(@rel='self')]/@href"))
    link = F.coalesce(F.nullif(F.trim(rss), F.lit("")), F.nullif(F.trim(atom), F.lit("")))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(link.startswith("/"), F.concat(root, link)).otherwise(link)
