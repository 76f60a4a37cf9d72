"""Bodies that hold each block twice, original and translation: how they are folded, unfolded, and shown in three views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIEWS = ("original", "both", "translation")
#: An original in a quotation of its own and the element of the same kind behind it: tag, attributes, original, attributes, translation.
#: Neither text holds another element of its kind. What stands before a text's first tag is taken at once, the rest character by character.
_INSIDE = r"([^<]*+(?:(?!<\1[\s>])[\s\S])*?)"
PAIR = rf"(?i)<blockquote>\s*<(p|h[1-6]|li)((?:\s[^>]*)?)>{_INSIDE}</\1>\s*</blockquote>\s*<\1((?:\s[^>]*)?)>{_INSIDE}</\1>"
BADGE = r"(?is)^\s*<p(?:\s[^>]*)?>(?:(?!</p>).)*?Translated by(?:(?!</p>).)*</p>"


def interleaved(blocks: Column) -> Column:
    """The body of an array of (tag, original, translation), HTML each; blocks without translation stand alone."""

    def one(b: Column) -> Column:
        element = lambda text: F.concat(F.lit("<"), b["tag"], F.lit(">"), text, F.lit("</"), b["tag"], F.lit(">"))
        paired = F.concat(F.lit("<blockquote>"), element(b["original"]), F.lit("</blockquote>"), element(b["translation"]))
        return F.when(b["translation"].isNull(), element(b["original"])).otherwise(paired)

    return F.array_join(F.transform(blocks, one), "")


def pairs(body: Column) -> Column:
    """The inverse: an array of (tag, attrs, original, translated_attrs, translation) of the pairs that a body holds, in order."""
    groups = [F.regexp_extract_all(body, F.lit(PAIR), F.lit(k)) for k in range(1, 6)]
    names = ("tag", "attrs", "original", "translated_attrs", "translation")
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)]), lambda p: F.struct(*[p[n].alias(n) for n in names]))


def view(body: Column, found: Column, kind: str, lang: Column | None = None) -> Column:
    """The body in one of VIEWS; found: pairs(body). What is shown of pair i has data-pair i, originals their language. Without pairs it stays as it is.

    The line that names the translator, at the top, goes as soon as there are pairs. A null body stays null.
    """
    language = F.coalesce(F.concat(F.lit(' lang="'), lang, F.lit('"')), F.lit("")) if lang is not None else F.lit("")
    between = F.split(body, PAIR, -1)

    def shown(p: Column, i: Column) -> Column:
        number = F.concat(F.lit(' data-pair="'), i.cast("string"), F.lit('"'))
        element = lambda attrs, text: F.concat(F.lit("<"), p["tag"], attrs, F.lit(">"), text, F.lit("</"), p["tag"], F.lit(">"))
        if kind == "translation":
            return element(F.concat(p["translated_attrs"], number), p["translation"])
        if kind == "original":
            return element(F.concat(p["attrs"], number, language), p["original"])
        return F.concat(F.lit("<blockquote"), number, language, F.lit(">"), element(p["attrs"], p["original"]), F.lit("</blockquote>"), element(p["translated_attrs"], p["translation"]))

    # side by side: an array that is indexed inside a lambda is made again for each element
    whole = F.array_join(F.zip_with(between, F.transform(found, shown), lambda text, part: F.concat(text, F.coalesce(part, F.lit("")))), "")
    return F.when(F.size(found) > 0, F.regexp_replace(whole, BADGE, "")).otherwise(body)
