"""The dealt queries opN_<name>: thin callers of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm.common import WORD, bucket_of, table
from feedlens.llm import chat, collocations, decontaminate, knn, langid, lm, mixing, runs, substrings, warc
from feedlens.llm.minhash import minhash_components
from feedlens.llm.simhash import simhash_components
from feedlens.llm.toxicity import score_toxicity, train, training_rows

Query = Callable[[SparkSession, str], DataFrame]


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(knn.usable(F.col("embedding"))).select("vec_id", knn.scaled(F.col("embedding")).alias("vector"))
    found = knn.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, id_col="vec_id", vector_col="vector")
    return found.withColumnRenamed("id", "vec_id")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = bucket_of(F.col("doc_id"), 5) == 1
    return lm.score_texts(docs, docs.where(~held)).withColumn("held_out", held)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(table(spark, sf_dir, "conversations"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.near_passages(table(spark, sf_dir, "documents"), least_words=50, similarity=0.8)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.write_bundles(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return warc.read_bundles(index, folder).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "intact"
    )


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = bucket_of(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


#: Domains of the mixing query: sources are dealt to them by number.
DOMAINS = ("web", "news", "books", "forum")
MIX_WEIGHTS = {"domain": {"web": 4, "news": 3, "books": 2, "forum": 1}, "lang": {"en": 5, "fr": 2, "de": 2, "es": 2}}


def domain_of(source):
    """web, news, books or forum by the source's number modulo four; other names are web, null stays null."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return F.when(source.isNotNull(), F.element_at(F.array(*map(F.lit, DOMAINS)), (number % 4 + 1).cast("int")))


def mixed(docs: DataFrame) -> DataFrame:
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, MIX_WEIGHTS, share=0.6, max_epochs=3)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_rows(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (bucket_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, radius=3)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"), "doc_id", "text", words=5, percent=85)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, contained=80, top=2000)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
    # Every tenth document is made periodic from one of its words on: the words up to there, then the next few over and over.
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(h div 10 % n as int)")))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + h div 10 % 8) as int)"))
    turns = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    looped = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), F.col("n") - F.col("a")))
    found = runs.find_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(looped, " ")).otherwise(F.col("text")).alias("text")), least=12)
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as minus, r.start as start, r.period as period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.minus")).alias("length"), "best.period",
        F.expr("-1000 * best.minus div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    return {"op1_knn": op1_knn, "op2_lm": op2_lm, "op3_decontaminate": op3_decontaminate, "op4_chat": op4_chat, "op5_substrings": op5_substrings, "op6_warc": op6_warc, "op7_langid": op7_langid, "op8_mix": op8_mix, "op9_toxicity": op9_toxicity, "op10_simhash": op10_simhash, "op11_minhash": op11_minhash, "op12_collocations": op12_collocations, "op13_runs": op13_runs}


def oracle_sql() -> dict[str, str]:
    return {"op1_knn": KNN_SQL, "op6_warc": WARC_SQL, "op8_mix": MIX_SQL, "op11_minhash": MINHASH_SQL, "op12_collocations": COLLOCATIONS_SQL}


KNN_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT vec_id, max(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM w q JOIN v c ON c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

#: Base32 of a hexadecimal digest: five digits are twenty bits, four letters.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
FROM p JOIN m USING (h)
"""

MIX_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NOT NULL THEN ['web', 'news', 'books', 'forum'][CAST(coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT), 0) % 4 + 1 AS BIGINT)] END AS domain,
    lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents
), leaf AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * 3 AS cap FROM d GROUP BY ALL),
root AS (SELECT least(CAST(floor(sum(tokens) * 0.6) AS BIGINT), sum(cap)) AS budget FROM leaf),
n1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'web' THEN 4 WHEN 'news' THEN 3 WHEN 'books' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
a1 AS (SELECT *, (SELECT budget FROM root) - coalesce(sum(cap) OVER o, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rst
  FROM n1 WINDOW o AS (ORDER BY cap / w, cap, domain NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b1 AS (SELECT *, max(CASE WHEN NOT cap * rst <= lft * w THEN {'rst': rst, 'lft': lft} END) OVER () AS lv FROM a1),
g1 AS (SELECT domain, CASE WHEN cap * rst <= lft * w OR lv IS NULL THEN cap ELSE greatest(0, least(cap, lv.lft * w // lv.rst)) END AS budget FROM b1),
n2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain, lang),
a2 AS (SELECT n2.*, g1.budget - coalesce(sum(cap) OVER o, 0) AS lft, sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER o, 0) AS rst
  FROM n2 JOIN g1 USING (domain) WINDOW o AS (PARTITION BY domain ORDER BY cap / w, cap, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b2 AS (SELECT *, max(CASE WHEN NOT cap * rst <= lft * w THEN {'rst': rst, 'lft': lft} END) OVER (PARTITION BY domain) AS lv FROM a2),
g2 AS (SELECT domain, lang, CASE WHEN cap * rst <= lft * w OR lv IS NULL THEN cap ELSE greatest(0, least(cap, lv.lft * w // lv.rst)) END AS budget FROM b2),
a3 AS (SELECT domain, lang, source, tokens, cap, 1 AS w, g2.budget - coalesce(sum(cap) OVER o, 0) AS lft, count(*) OVER (PARTITION BY domain, lang) - coalesce(count(*) OVER o, 0) AS rst
  FROM leaf JOIN g2 USING (domain, lang) WINDOW o AS (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b3 AS (SELECT *, max(CASE WHEN NOT cap * rst <= lft THEN {'rst': rst, 'lft': lft} END) OVER (PARTITION BY domain, lang) AS lv FROM a3),
g3 AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN cap * rst <= lft OR lv IS NULL THEN cap ELSE greatest(0, least(cap, lv.lft // lv.rst)) END AS BIGINT) AS given FROM b3),
x AS (SELECT d.*, CASE WHEN tokens > 0 THEN CAST(given // tokens AS BIGINT) ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM d JOIN g3 USING (domain, lang, source)),
y AS (SELECT *, md5('mix-1-' || epochs || '-' || doc_id) AS ord FROM x),
z AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY ord, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM y)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(CASE WHEN n > 0 THEN epochs ELSE 0 END AS BIGINT) AS epochs, CAST(greatest(0, least(n, rest - bef)) AS BIGINT) AS part_tokens,
  CAST(epochs * n + greatest(0, least(n, rest - bef)) AS BIGINT) AS taken_tokens FROM z
"""

COLLOCATIONS_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score FROM cuts
  JOIN f AS l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f AS r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')
), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT DISTINCT lang, phrase FROM (
    SELECT c.lang, array_to_string(c.ws[i:i + size - 1], ' ') AS phrase, c.a AS longer FROM c, (VALUES (2), (3)) AS z(size), (VALUES (1), (2), (3)) AS y(i) WHERE size < c.k AND i + size - 1 <= c.k
  ) JOIN c AS own USING (lang, phrase) WHERE 100 * longer >= 80 * own.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM one ANTI JOIN held USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""

#: Two sets can only be linked if their sizes allow it and they share a shingle; every such pair is counted in full.
MINHASH_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS own FROM d
), e AS MATERIALIZED (SELECT doc_id, len(own) AS n, md5_number(unnest(own)) AS x FROM s),
pairs AS MATERIALIZED (
  SELECT p.doc_id AS a, q.doc_id AS b FROM e AS p JOIN e AS q ON p.x = q.x AND p.doc_id < q.doc_id AND 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.b)
SELECT s.doc_id, CAST(len(own) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""
