"""URL functions, Column to Column. parse_url fails on broken URLs in ANSI mode, so hosts and paths come by pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the link rules.
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "pinterest.com", "t.co")
OTHER_PATHS = ("/login", "/signup", "/register", "/about", "/contact", "/search", "/tag", "/category", "/author")
OTHER_SCHEMES = ("javascript:", "mailto:", "tel:")
IMAGE_WIDTHS = (160, 320, 480, 800, 1200)

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower case, without www. in front."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www[.]", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def first_segment(url: Column) -> Column:
    return F.regexp_extract(path(url), r"^/([^/]*)", 1)


def is_article_link(url: Column) -> Column:
    p = F.lower(path(url))
    bad = url.isNull() | (url == "") | url.startswith("#") | host(url).isin(*SOCIAL_HOSTS) | p.isin("", "/")
    for scheme in OTHER_SCHEMES:
        bad |= F.lower(url).startswith(scheme)
    for prefix in OTHER_PATHS:
        bad |= p.startswith(prefix)
    return ~bad


def excluded_by(url: Column, kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "domain", host(url) == value)
        .when(kind == "path_prefix", F.startswith(path(url), value))
        .when(kind == "path_contains", F.contains(path(url), value))
        .otherwise(False)
    )


def is_signed(url: Column) -> Column:
    low = F.lower(url)
    return (low.contains("expires=") & low.contains("signature=")) | low.contains("x-amz-signature") | low.contains("token=")


def site_url(url: Column) -> Column:
    """The site of a feed host: its feeds., feed., rss. or feedproxy. label goes where three labels or more stand."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    bare = F.when(F.size(F.split(h, "[.]")) >= 3, F.regexp_replace(h, r"^(feeds|feed|rss|feedproxy)[.]", "")).otherwise(h)
    return F.concat(F.lit("https://"), bare)


def image_key(url: Column, width: Column | None = None) -> Column:
    return F.md5((F.concat_ws("_", url, width.cast("string")) if width is not None else url).cast("binary"))


def file_stem(url: Column) -> Column:
    return F.regexp_extract(url, r"/([^/]+?)([.][^./]*)?$", 1)


def nearest_width(wanted: Column) -> Column:
    """The nearest width offered, the smaller one of two."""
    return F.array_min(F.array(*[F.struct(F.abs(wanted - w).alias("d"), F.lit(w).alias("w")) for w in IMAGE_WIDTHS]))["w"]


def _without_dots(p: Column) -> Column:
    """A path whose . and .. steps are taken."""
    steps = F.split(p, "/")
    last = F.element_at(steps, -1)
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(step == ".", done).otherwise(F.array_append(done, step)),
    )
    return F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def absolute(base: Column, url: Column) -> Column:
    """url as it is meant on a page at base: absolute, from the host, from the root, or from the page's folder; null stays null."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(path(base) == "", F.lit("/")).otherwise(F.regexp_extract(path(base), r"^(.*/)", 1))
    own, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    full = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    full = F.when(full.rlike(r"/[.]{1,2}(/|$)"), _without_dots(full)).otherwise(full)
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]+:)", 1), url)).when(url == "", base)
        .when(url.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), url)).when(url.startswith("?"), F.concat(page, url)).otherwise(F.concat(root, full, rest))
    )


#: Networks whose addresses aren't public, as first address and length of the prefix.
PRIVATE_NETWORKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
PRIVATE_PREFIXES6 = r"^(::1?$|::ffff:|f[cd]|fe[89ab]|ff|2001:db8|100::|64:ff9b:1:)"


def is_public(url: Column) -> Column:
    """Whether a web address has a host that isn't a literal address of a private, local or reserved network, localhost or a .local name. Names aren't resolved."""
    authority = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#]*)", 1))
    six = F.nullif(F.regexp_extract(authority, r"^\[([^\]]*)\]", 1), F.lit(""))
    name = F.regexp_replace(authority, r":\d*$", "")
    parts = F.transform(F.split(name, r"\."), lambda x: x.try_cast("long"))
    four = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(parts, lambda x: x > 255)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    private = F.lit(False)
    for first, bits in PRIVATE_NETWORKS:
        low = sum(int(x) << 8 * (3 - k) for k, x in enumerate(first.split(".")))
        private = private | number.between(low, low + (1 << 32 - bits) - 1)
    local = name.isin("", "localhost") | name.endswith(".local")
    return F.coalesce(F.when(six.isNotNull(), ~six.rlike(PRIVATE_PREFIXES6)).when(four, ~private).otherwise(~local), F.lit(False))
