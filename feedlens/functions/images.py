"""Which images belong to an article, and where readers get them from. Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.functions import markup, urls

#: Fixed values of the image rules: hosts and paths of beacons; hosts that are trusted; parts of the addresses and words in the texts of page furniture.
BEACON_HOSTS = (
    "scorecardresearch.com", "google-analytics.com", "googletagmanager.com", "doubleclick.net", "adnxs.com", "media.net", "valuecommerce.com", "adsrvr.org",
    "rubiconproject.com", "casalemedia.com", "pubmatic.com", "openx.net", "criteo.com", "quantserve.com", "atdmt.com",
)
BEACON_PATHS = ("/atrk.gif", "/cksync", "/getuid", "/g/collect", "/pixel", "/beacon")
TRUSTED_HOSTS = ("cloudfront.net", "akamaihd.net", "fastly.net", "cloudinary.com", "imgix.net", "wp.com", "googleusercontent.com", "amazonaws.com")
FURNITURE = (
    "pixel", "tracker", "beacon", "spacer", "tracking", "1x1", "clear", "blank", "invisible", "transparent", "dot", "shim", "cleardot", "trans", "telemetry", "avatar", "logo", "badge",
    "author", "profile", "writer", "related", "recommend", "social", "share", "resize/100x", "placeholder", "bg-", "background", "button", "matcha-news", "chiachia", "jia",
)
FURNITURE_WORDS = ("ad", "advertisement", "promo", "sponsored", "icon", "avatar", "profile", "writer", "author", "share", "social", "related", "recommended")
ICONS = ("favicon", "avatar", "badge", "pixel", "icon", "logo", "1x1", "spacer", "emoji", "tracking")
LEAST_SIZE, WIDEST_RATIO, SHORT_TEXT = 150, 15, 50


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def _size(text: Column) -> Column:
    """A width or height as a number; what isn't digits, with or without px, is none."""
    return F.regexp_extract(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"^(\d{1,9})(px)*$", 1).try_cast("int")


def is_beacon(url: Column) -> Column:
    """A web address of a measuring host, or with a path that only beacons have."""
    host = F.regexp_extract(F.lower(url), r"^https?://([^/?#]*)", 1)
    known = F.lit(False)
    for name in BEACON_HOSTS:
        known = known | (host == name) | F.endswith(host, F.lit("." + name))
    return F.coalesce(url.rlike("^https?://") & (known | _any(F.lower(urls.path(url)), BEACON_PATHS)), F.lit(False))


def is_svg(url: Column) -> Column:
    """By its path alone."""
    path = F.when(url.contains("://"), urls.path(url)).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    return F.coalesce(url.startswith("data:image/svg") | F.lower(path).rlike(r"\.svgz?$"), F.lit(False))


def is_no_content(url: Column, width: Column, height: Column) -> Column:
    """Beacons, images of a pixel and SVG drawings."""
    return is_beacon(url) | is_svg(url) | F.coalesce(_size(width) <= 1, F.lit(False)) | F.coalesce(_size(height) <= 1, F.lit(False))


def is_boilerplate(url: Column, alt: Column, title: Column, width: Column, height: Column) -> Column:
    """Page furniture by address, by a short text with one of its words, by size or shape. Trusted hosts' images never are, missing addresses always."""
    low = F.lower(F.coalesce(url, F.lit("")))
    said = F.concat(F.lower(F.coalesce(alt, F.lit(""))), F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    worded = said.rlike(rf"\b({'|'.join(FURNITURE_WORDS)})\b") & (F.length(said) < SHORT_TEXT)
    w, h = F.coalesce(_size(width), F.lit(0)), F.coalesce(_size(height), F.lit(0))
    small = ((w > 0) & (w < LEAST_SIZE)) | ((h > 0) & (h < LEAST_SIZE))
    long = (w > 0) & (h > 0) & (F.greatest(w, h) > F.least(w, h) * WIDEST_RATIO)
    return F.when(low == "", True).when(_any(low, TRUSTED_HOSTS), False).otherwise(_any(low, FURNITURE) | worded | small | long)


def slides(main: Column, others: Column) -> Column:
    """The main image and the others, each once, without icons and missing ones."""
    icon = lambda u: F.endswith(F.lower(u), F.lit(".svg")) | _any(F.lower(u), (".svg?", *ICONS))
    return F.array_distinct(F.filter(F.concat(F.array(main), F.coalesce(others, F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != "") & ~icon(u)))


def resolved(src: Column, base: Column) -> Column:
    """The web address of an image's source on the page at base; null for what is no image: scripts, anchors, bare words."""
    src = F.trim(src)
    word = ~src.contains("/") & ~src.contains(".")
    full = F.when(src.rlike("^https?://"), src).when(src.rlike("^(javascript:|about:|#|data:)") | (src == "") | (word & ~src.startswith("//")), None).otherwise(urls.absolute(base, src))
    return F.when(full.rlike("^https?://"), full)


def quoted(text: Column) -> Column:
    """Percent-encoded for a query, slashes kept."""
    out = F.url_encode(text)
    for was, now in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


_IMAGE = r"(?is)<img\b[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def proxied(html: Column, base: Column, proxy: str, cached: str, width: int = 800) -> Column:
    """html with its images taken from a proxy: no_content images go, cached ones stay, the others' sources become proxy?url=...&w=....

    The source is the src, else the best entry of a srcset, whichever is an address first. Sets of sources go, as browsers would prefer them. An image
    without an address stays as it is. Null stays null.
    """
    def shown(tag: Column) -> Column:
        src = F.coalesce(_attribute(tag, "src"), F.lit(""))
        sets = [_attribute(tag, n) for n in ("srcset", "data-srcset", "data-lazy-srcset")]
        address = F.coalesce(resolved(src, base), *[resolved(markup.best_srcset(s), base) for s in sets])
        bare = F.regexp_replace(tag, r"""(?is)\s(data-(lazy-)?)?srcset\s*=\s*["'][^"']*["']""", "")
        without = F.regexp_replace(bare, r"""(?is)\ssrc\s*=\s*["'][^"']*["']""", "")
        own = F.concat(F.lit('<img src="'), F.lit(f"{proxy}?url="), quoted(address), F.lit(f'&amp;w={width}"'), F.substr(without, F.lit(5)))
        gone = is_no_content(src, _attribute(tag, "width"), _attribute(tag, "height"))
        return F.when(gone, "").when(src.startswith(cached), bare).when(address.isNull(), tag).otherwise(own)

    between, tags = F.split(html, _IMAGE, -1), F.regexp_extract_all(html, F.lit(_IMAGE), F.lit(0))
    return F.array_join(F.zip_with(between, F.transform(tags, shown), lambda t, made: F.concat(t, F.coalesce(made, F.lit("")))), "")
