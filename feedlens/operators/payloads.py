"""Article bodies out of the JSON that a page carries for its own scripts. Where a site keeps what is data: a row of paths for each host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import urls
from feedlens.operators.relational import small

#: One row a host: the script's id, and JSON paths: of the list of blocks; of a block's kind, paragraphs of tokens, image, caption and summary,
#: from the block; of the lede, what stands in for it, and the main image, from the payload.
RULES = "host string, script string, blocks string, kind string, tokens string, image string, caption string, summary string, lede string, spare string, main string"


def _escaped(text: str) -> str:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\\'", "&#x27;")):
        text = f"replace({text}, '{mark}', '{name}')"
    return text


def _texts(value: str, path: str) -> str:
    """The non-empty texts of a text or a list of texts, trimmed; none of anything else."""
    found = f"coalesce(try_variant_get({value}, {path}, 'array<string>'), CASE WHEN schema_of_variant(try_variant_get({value}, {path}, 'variant')) = 'STRING' THEN array(try_variant_get({value}, {path}, 'string')) END, array())"
    return f"filter(transform({found}, t -> trim(t)), t -> t <> '')"


_TOKENS = (
    "transform(try_variant_get(b, tokens, 'array<variant>'), q -> filter(transform(try_variant_get(q, '$', 'array<variant>'), t -> struct("
    "lower(try_variant_get(t, '$.type', 'string')) AS kind, try_variant_get(t, '$.content', 'string') AS content)), t -> t.content <> ''))"
)
_TAG = "CASE WHEN q[0].kind IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN q[0].kind ELSE 'p' END"
_PROSE = f"array_join(transform(filter(coalesce({_TOKENS}, array()), q -> size(q) > 0), q -> concat('<', {_TAG}, '>', {_escaped("array_join(transform(q, t -> t.content), '')")}, '</', {_TAG}, '>')), '')"
_CAPTION = "trim(coalesce(try_variant_get(b, caption, 'string'), ''))"
_FIGURE = (
    f"concat('<figure><img src=\"', {_escaped("try_variant_get(b, image, 'string')")}, '\" alt=\"', {_escaped(_CAPTION)}, '\"/>', "
    f"CASE WHEN {_CAPTION} <> '' THEN concat('<figcaption>', {_escaped(_CAPTION)}, '</figcaption>') ELSE '' END, '</figure>')"
)
_SUMMARY = f"array_join(transform({_texts('b', 'summary')}, t -> concat('<p>', {_escaped('t')}, '</p>')), '')"
_BLOCK = (
    f"CASE lower(try_variant_get(b, kind, 'string')) WHEN 'image' THEN CASE WHEN try_variant_get(b, image, 'string') <> '' THEN {_FIGURE} ELSE '' END WHEN 'text' THEN {_PROSE} WHEN 'summary' THEN {_SUMMARY} ELSE '' END"
)


def embedded_articles(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, content, main_image): the bodies of pages whose host has a rule and whose script has a payload with blocks.

    Blocks of the kinds image, text and summary become figures and paragraphs, in order; others are left out. A paragraph's first token
    says whether it is a heading. The lede goes in front where the body doesn't hold it already. Pages without a rule, without
    the script, with broken JSON or with nothing in their blocks give no row; so do nulls. Rules are RULES rows, one a host.
    """
    host = urls.host(F.col(url_col))
    asked = pages.select(id_col, host.alias("host"), F.col(html_col).alias("html")).join(small(rules), "host")
    raw = F.expr(r"""regexp_extract(html, concat('(?is)<script[^>]*\\bid=["\']\\Q', script, '\\E["\'][^>]*>(.*?)</script>'), 1)""")
    read = asked.withColumn("v", F.try_parse_json(raw)).where("v IS NOT NULL")
    body = read.withColumn("body", F.expr(f"array_join(transform(try_variant_get(v, blocks, 'array<variant>'), b -> coalesce({_BLOCK}, '')), '')")).where("body <> ''")
    ledes = body.withColumn("lede", F.expr(f"CASE WHEN size({_texts('v', 'lede')}) > 0 THEN {_texts('v', 'lede')} ELSE {_texts('v', 'spare')} END"))
    front = f"array_join(transform(filter(lede, t -> NOT contains(body, t)), t -> concat('<p>', {_escaped('t')}, '</p>')), '')"
    return ledes.select(id_col, "host", F.expr(f"concat('<div>', {front}, body, '</div>')").alias("content"), F.expr("coalesce(try_variant_get(v, main, 'string'), '')").alias("main_image"))
