"""Chat formatting by quotation linking.

Quoted lines are parsed with their levels, normalised and hashed as passages: a quoted block, its paragraphs and its
lines. What messages say themselves is hashed alike. A message replies to the earlier message of its conversation
of which it quotes most words, a quoted word counting once, with the largest passage around it that was said; replies make
threads, and a conversation is its threads in order, without the quotes.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from feedlens.llm.common import lookup, stored

MARK = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
ATTRIBUTION = re.compile(r"(wrote|writes|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
BLOCK, PARAGRAPH, LINE = 0, 1, 2
QUOTED = ("level", "block", "paragraph", "unit", "h", "words")
PARSED = "own string, depth int, said array<long>, quoted array<struct<level:int,block:long,paragraph:long,unit:int,h:long,words:int>>"
LAST = (1 << 62) - 1


def quote_level(line: str) -> tuple[int, str]:
    """How many quote marks a line begins with, and the rest of it."""
    mark = MARK.match(line)
    return (mark[1].count(">"), line[mark.end() :]) if mark else (0, line)


def passage(lines: list[str]) -> tuple[int, int] | None:
    """(hash, words) of lines in lower case with single blanks; None if there is no word."""
    words = " ".join(lines).lower().split()
    return (xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), 11) - (1 << 63), len(words)) if words else None


def passages(lines: list[str]) -> set[tuple[int, int, int, int, int]]:
    """(block, paragraph, unit, hash, words) of a block, its paragraphs and its lines; block and paragraph are the hashes around."""
    paragraphs: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    whole = passage(lines)
    if not whole:
        return set()
    found = {(whole[0], 0, BLOCK, *whole)}
    for part in filter(None, map(passage, paragraphs)):
        found.add((whole[0], part[0], PARAGRAPH, *part))
    for part in paragraphs:
        around = passage(part)
        for line in filter(None, (passage([x]) for x in part)):
            found.add((whole[0], around[0], LINE, *line))
    return found


def parse(text: str | None) -> tuple[str, int, set[int], set[tuple[int, int, int, int, int, int]]]:
    """(own text, deepest level, hashes of own passages, quoted passages as QUOTED) of a message.

    An attribution line right before a quote goes with it. Null and empty texts have no words of their own.
    """
    blocks: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        level, rest = quote_level(line)
        if not blocks or blocks[-1][0] != level:
            blocks.append((level, []))
        blocks[-1][1].append(rest)
    own, said, quoted = [], set(), set()
    for n, (level, lines) in enumerate(blocks):
        if level:
            quoted |= {(level, *x) for x in passages(lines)}
            continue
        if n + 1 < len(blocks):
            while lines and not lines[-1].strip():
                lines = lines[:-1]
            if lines and ATTRIBUTION.search(lines[-1]):
                lines = lines[:-1]
        own += lines
        said |= {x[3] for x in passages(lines)}
    whole = passage(own)
    return "\n".join(own).strip("\n"), max((b[0] for b in blocks), default=0), said | ({whole[0]} if whole else set()), quoted


def numbered(rows: DataFrame, group: list[str], steps: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: 0, 1, ... in each group by steps, then order, without ordering a whole group in one task.

    Groups are counted by growing prefixes of steps; each window spans the values of one step only.
    """
    counts = rows.groupBy(*group, *steps).agg(F.count("*").alias("__n"))
    starts = None
    for k in range(1, len(steps) + 1):
        here = counts.groupBy(*group, *steps[:k]).agg(F.sum("__n").alias("__m"))
        before = Window.partitionBy(*group, *steps[: k - 1]).orderBy(steps[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        here = here.select(*group, *steps[:k], F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__o"))
        if starts is None:
            starts = here.withColumnRenamed("__o", "__s")
        else:
            starts = here.join(starts, [*group, *steps[: k - 1]]).select(*group, *steps[:k], (F.col("__o") + F.col("__s")).alias("__s"))
    keys = [*group, *steps]
    rows = rows.repartition(*[F.col(c) for c in keys])
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).join(starts, keys)
    return rows.withColumn(name, F.col("__s") + F.col("__r")).drop("__r", "__s")


def roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, root) for (conv, turn, parent), a parent being earlier than its child, by doubling the steps."""
    at = stored(parents.select("conv", "turn", F.col("parent").alias("root")))
    while True:
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"))
        further = at.join(up, ["conv", "root"], "left")
        further = stored(further.select("conv", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if not further.where("moved").limit(1).count():
            return further.drop("moved")
        at = further.drop("moved")


def link_quotations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv, turn, role, text without quotes, quote_depth, reply_to, thread, position) for each row of messages.

    reply_to is the turn of the earlier message in the conversation that a message quotes most words of. A quoted block
    counts whole if an earlier message says it, else those of its paragraphs that one says, else their lines; a passage counts
    for the first message that says it, once for each quote level, and levels are added up. Ties go to the message quoted at the
    outermost level, then to the earlier turn. Null where nothing quoted is found. thread is the turn that its chain of replies
    begins with. position numbers a conversation's rows from 0 by thread, turn, role and text, so a reply follows what it
    answers. A null conversation is one of its own; rows without a turn come last and take no part in linking. Rows that share a turn are
    one message to the others, with the passages of all, and are kept next to each other. Null texts become empty. Texts of any length
    are parsed whole; an empty table gives no rows; other columns aren't read.
    """

    @pandas_udf(PARSED)
    def parsed(texts: pd.Series) -> pd.DataFrame:
        rows = [parse(t) for t in texts]
        return pd.DataFrame(
            {
                "own": [r[0] for r in rows], "depth": [r[1] for r in rows], "said": [sorted(r[2]) for r in rows],
                "quoted": [[dict(zip(QUOTED, x)) for x in sorted(r[3])] for r in rows],
            }
        )

    rows = stored(
        messages.select(
            F.col(conv_col).alias("id"), F.coalesce(F.col(conv_col).cast("string"), F.lit("\x00")).alias("conv"),
            F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), parsed(F.col(text_col)).alias("p"),
        ).select("id", "conv", "turn", "role", "p.*")
    )
    quoting = stored(
        rows.where(F.col("turn").isNotNull() & (F.size("quoted") > 0)).select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*").distinct()
        .withColumn("key", F.xxhash64("conv", "h"))
    )
    # Only what someone quotes is looked for.
    asked = quoting.select("key").distinct()
    said = rows.where("turn is not null").select("conv", "turn", F.explode("said").alias("h")).withColumn("key", F.xxhash64("conv", "h"))
    first = stored(said.join(asked, "key", "left_semi").groupBy("key", "conv", "h").agg(F.min("turn").alias("original")))
    found = lookup(quoting, first.select("key", "original"), "key").where(F.col("original") < F.col("turn"))
    # of one message's quotes, what lies in a larger passage that was found doesn't count again
    in_block, in_paragraph = Window.partitionBy("conv", "turn", "level", "block"), Window.partitionBy("conv", "turn", "level", "block", "paragraph")
    found = found.withColumns({"__b": F.min("unit").over(in_block) == BLOCK, "__p": F.min("unit").over(in_paragraph) == PARAGRAPH})
    found = found.where((F.col("unit") == BLOCK) | ~F.col("__b") & ((F.col("unit") == PARAGRAPH) | ~F.col("__p")))
    counted = found.select("conv", "turn", "level", "h", "words", "original").distinct()
    weight = counted.groupBy("conv", "turn", "original").agg(F.sum("words").alias("words"), F.min("level").alias("level"))
    parents = stored(
        weight.groupBy("conv", "turn").agg(F.max_by("original", F.struct(F.col("words"), -F.col("level"), -F.col("original"))).alias("parent"))
    )
    chain = roots(parents).join(parents, ["conv", "turn"])
    linked = rows.select("id", "conv", "turn", "role", "own", "depth").join(chain, ["conv", "turn"], "left")
    linked = linked.withColumns({"thread": F.coalesce("root", "turn"), "__t": F.coalesce("root", "turn", F.lit(LAST)), "__u": F.coalesce("turn", F.lit(LAST))})
    steps = {"__a": F.expr("__t div 1048576"), "__b": F.expr("__t div 1024"), "__c": F.col("__t"), "__d": F.expr("__u div 1024")}
    placed = numbered(linked.withColumns(steps), ["conv"], list(steps), ["__u", "role", "own", "depth"], "position")
    return placed.select(
        F.col("id").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias(text_col),
        F.col("depth").alias("quote_depth"), F.col("parent").alias("reply_to"), "thread", "position",
    )
