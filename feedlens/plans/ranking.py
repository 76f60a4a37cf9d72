"""Preference learning and ranking over the reader's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.functions import numbers, text
from feedlens.operators import relational as rel
from feedlens.operators import rerank, scoring, status, weights
from feedlens.plans.registry import query
from feedlens.sources.shared import settled
from feedlens.sources.tables import Reader

CANON = "CASE doc WHEN 0 THEN ['smartphone', 'tv series'] WHEN 1 THEN ['smartphone'] WHEN 2 THEN ['watch'] ELSE []::VARCHAR[] END"
AGE = "greatest(0.0, epoch(TIMESTAMP '2024-01-31 00:00:00' - {0}) / 86400.0)"
AXES = f"""ax AS (SELECT id AS article_id, 'topic' AS axis, primary_topic AS label FROM feed_articles UNION ALL SELECT id, 'region', region FROM feed_articles UNION ALL SELECT id, 'type', article_type FROM feed_articles
 UNION ALL SELECT id, 'secondary', unnest({CANON}) FROM (SELECT *, id % 5 AS doc FROM feed_articles)), lab AS (SELECT * FROM ax WHERE label IS NOT NULL AND label NOT IN ('', 'unknown')),
vt AS (SELECT axis, label, sum(CASE WHEN vote = 'show_more' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * pow(0.5::DOUBLE, {AGE.format('v.updated_at')} / 90.0)) AS tally, count(*) AS votes FROM article_votes v JOIN lab USING (article_id) GROUP BY 1, 2)"""
READ = f"""rc AS (SELECT axis, label, sum(0.5::DOUBLE * pow(0.5::DOUBLE, {AGE.format('f.at')} / 90.0)) AS read FROM (SELECT article_id, min(created_at) AS at FROM user_article_events WHERE event_type = 'read_complete'
 AND article_id NOT IN (SELECT article_id FROM article_votes) GROUP BY 1) f JOIN lab USING (article_id) GROUP BY 1, 2)"""
BEHAVED = f"""bt AS (SELECT axis, label, sum(val * pow(0.5::DOUBLE, {AGE.format('e.created_at')} / 90.0)) AS behaviour FROM (SELECT *, CASE WHEN event_type = 'open' THEN 1.0::DOUBLE WHEN event_type = 'hover' THEN 0.6::DOUBLE
 WHEN event_type = 'skip' AND dwell_seconds >= 1 THEN -0.4::DOUBLE ELSE 0::DOUBLE END AS val FROM user_article_events) e JOIN lab USING (article_id) WHERE val <> 0 GROUP BY 1, 2)"""
COOC = f"""co AS (SELECT label, topic, count(*) AS n FROM (SELECT primary_topic AS topic, unnest({CANON}) AS label FROM (SELECT *, id % 5 AS doc FROM feed_articles) WHERE primary_topic IS NOT NULL AND primary_topic <> 'unknown') GROUP BY 1, 2)"""
WEIGHTS = f"""{AXES}, {READ}, {BEHAVED}, {COOC},
j AS (SELECT axis, label, coalesce(votes, 0) AS votes, coalesce(tally, 0) AS tally, CASE axis WHEN 'secondary' THEN 1.2 * tanh((coalesce(tally, 0) + coalesce(read, 0)) / 6.0) ELSE 4.0 * tanh((coalesce(tally, 0) + coalesce(read, 0)) / 17.0) END AS explicit,
 CASE axis WHEN 'secondary' THEN 0.3 * tanh(coalesce(behaviour, 0) / 6.0) ELSE tanh(coalesce(behaviour, 0) / 17.0) END AS behavioural FROM vt FULL JOIN rc USING (axis, label) FULL JOIN bt USING (axis, label)),
te AS (SELECT label AS topic, greatest(-5.5, least(5.5, explicit + behavioural)) AS te FROM j WHERE axis = 'topic'),
pr AS (SELECT 'secondary' AS axis, label, 0.35 * sum(n * coalesce(te, 0)) / sum(n) AS raw FROM co LEFT JOIN te USING (topic) GROUP BY 2),
w AS (SELECT axis, label, coalesce(votes, 0) AS votes, coalesce(explicit, 0) AS explicit, coalesce(behavioural, 0) AS behavioural, coalesce(raw, 0) * 3.0 / (coalesce(votes, 0) + 3.0) AS prior,
 greatest(-5.5, least(5.5, coalesce(explicit, 0) + coalesce(behavioural, 0) + coalesce(raw, 0) * 3.0 / (coalesce(votes, 0) + 3.0))) AS effective, coalesce(votes, 0) >= 8 AND abs(coalesce(tally, 0)) / greatest(1, coalesce(votes, 0)) < 0.25 AS contested
 FROM j FULL JOIN pr USING (axis, label))"""
SCORES = f"""{WEIGHTS}, ps AS (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY pub_date DESC, id DESC) - 1) / greatest(1, count(*) OVER (PARTITION BY source_id) - 1) AS pct, id % 5 AS doc FROM feed_articles),
im AS (SELECT article_id, count(*) AS n, max(created_at) AS last_seen_at FROM user_article_events WHERE event_type = 'impression' GROUP BY 1),
sc AS (SELECT id, sum(effective) AS raw FROM (SELECT id, unnest(CASE doc WHEN 0 THEN ['smartphone', 'tv series'] WHEN 1 THEN ['smartphone'] WHEN 2 THEN ['watch', 'watch'] ELSE []::VARCHAR[] END) AS label FROM ps) JOIN w ON w.axis = 'secondary' AND w.label = label_ GROUP BY 1),
t AS (SELECT ps.id, ps.source_id, coalesce(wt.effective, 0) AS topic, coalesce(wy.effective, 0) AS type, 0.3 * coalesce(wr.effective, 0) AS region,
 greatest(-greatest(1.0, abs(coalesce(wt.effective, 0))), least(greatest(1.0, abs(coalesce(wt.effective, 0))), 0.3 * coalesce(sc.raw, 0))) AS secondary, exp(-3.0 * pct) AS fresh,
 CASE WHEN v.vote = 'show_less' THEN -4.0 ELSE 0.0 END AS vote, CASE WHEN is_saved = 1 OR im.n IS NULL THEN 0.0 ELSE -(1 - exp(-im.n / 2.0)) * exp(-greatest(0.0, epoch(TIMESTAMP '2024-01-31 00:00:00' - im.last_seen_at) / 3600.0) / 48.0) END AS exposure
 FROM ps LEFT JOIN w wt ON wt.axis = 'topic' AND wt.label = ps.primary_topic LEFT JOIN w wy ON wy.axis = 'type' AND wy.label = ps.article_type LEFT JOIN w wr ON wr.axis = 'region' AND wr.label = ps.region
 LEFT JOIN sc ON sc.id = ps.id LEFT JOIN article_votes v ON v.article_id = ps.id LEFT JOIN im ON im.article_id = ps.id)""".replace("AS label FROM ps)", "AS label_ FROM ps)")


def the_weights(r: Reader) -> DataFrame:
    return weights.label_weights(r.article_votes, r.user_article_events, r.feed_articles, r.as_of)


def the_scores(r: Reader, known: DataFrame | None = None) -> DataFrame:
    """Scores of all articles. The weights, a row a label, are written once: four joins read them."""
    known = settled(the_weights(r), "weights") if known is None else known
    return scoring.scores(r.feed_articles, known, r.article_votes, status.impressions(r.user_article_events), r.as_of)


@query("A14 F01 F07", f"WITH {AXES} SELECT axis, label, votes, round(tally, 6) AS tally FROM vt")
def explicit_tally(r: Reader) -> DataFrame:
    return weights.vote_tally(r.article_votes, r.feed_articles, r.as_of).select("axis", "label", "votes", F.round("tally", 6).alias("tally"))


@query("A15", f"WITH {AXES}, {READ} SELECT axis, label, round(read, 6) AS tally FROM rc")
def completion_tally(r: Reader) -> DataFrame:
    return weights.completion_tally(r.user_article_events, r.article_votes, r.feed_articles, r.as_of).withColumn("tally", F.round("tally", 6))


@query("A16 T14", f"WITH {AXES}, {BEHAVED} SELECT axis, label, round(behaviour, 6) AS behaviour FROM bt")
def behavioural_tally(r: Reader) -> DataFrame:
    return weights.behavioural_tally(r.user_article_events, r.feed_articles, r.as_of).withColumn("behaviour", F.round("behaviour", 6))


@query("K01 A17 A18 F02 F05", f"WITH {WEIGHTS} SELECT axis, label, votes, round(explicit, 6) AS explicit, round(behavioural, 6) AS behavioural, round(prior, 6) AS prior, round(effective, 6) AS effective, contested FROM w")
def label_weights(r: Reader) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("explicit", "behavioural", "prior", "effective")}
    return the_weights(r).withColumns(rounded)


@query("O06", f"WITH {WEIGHTS} SELECT label, row_number() OVER (ORDER BY -round(abs(explicit + behavioural), 6), label) AS place FROM w WHERE axis = 'topic'")
def label_table_order(r: Reader) -> DataFrame:
    from pyspark.sql import Window

    size = -F.round(F.abs(F.col("explicit") + F.col("behavioural")), 6)
    return the_weights(r).where("axis = 'topic'").select("label", F.row_number().over(Window.orderBy(size, "label")).alias("place"))


@query("K02 K03 F03 F04", f"WITH {SCORES} SELECT id, round(topic + type + region + secondary + fresh + vote + exposure, 6) AS score FROM t")
def article_scores(r: Reader) -> DataFrame:
    return the_scores(r).select("id", F.round("score", 6).alias("score"))


@query("K09", f"""WITH {SCORES} SELECT id, term, round(contribution, 6) + 0.0 AS contribution FROM (UNPIVOT (SELECT id, topic::DOUBLE AS topic, type::DOUBLE AS type, region::DOUBLE AS region, secondary::DOUBLE AS secondary, fresh::DOUBLE AS fresh, vote::DOUBLE AS vote, exposure::DOUBLE AS exposure FROM t)
 ON topic, type, region, secondary, fresh, vote, exposure INTO NAME term VALUE contribution)""")
def score_terms(r: Reader) -> DataFrame:
    return scoring.terms(the_scores(r)).withColumn("contribution", F.round("contribution", 6) + 0.0)  # no negative zero


@query("K04", f"""WITH {WEIGHTS}, p AS (SELECT axis, label, greatest(0.02, exp(effective) / sum(exp(effective)) OVER (PARTITION BY axis)) AS p FROM w)
SELECT axis, label, round(p / sum(p) OVER (PARTITION BY axis), 6) AS share FROM p""")
def target_distribution(r: Reader) -> DataFrame:
    return scoring.target_distribution(the_weights(r)).withColumn("share", F.round("share", 6))


@query("K08", f"""WITH {WEIGHTS}, s AS (SELECT a.primary_topic AS label, count(*) AS shown FROM user_article_events e JOIN feed_articles a ON a.id = e.article_id WHERE event_type = 'impression' AND e.created_at >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1)
SELECT w.label, round(effective, 6) AS effective, coalesce(shown, 0) AS shown, coalesce(shown, 0) = 0 AS unseen FROM w LEFT JOIN s USING (label) WHERE axis = 'topic'""")
def label_weights_unseen(r: Reader) -> DataFrame:
    since = F.col("created_at") >= F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))
    per_article = r.user_article_events.where(since & (F.col("event_type") == "impression")).groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("k"))
    seen = per_article.join(r.feed_articles.select("id", F.col("primary_topic").alias("label")), "id").groupBy("label").agg(F.sum("k").alias("shown"))
    found = the_weights(r).where("axis = 'topic'").join(seen, "label", "left")
    return found.select("label", F.round("effective", 6).alias("effective"), F.coalesce("shown", F.lit(0)).alias("shown"), F.col("shown").isNull().alias("unseen"))


@query("K10 T04", f"""WITH {SCORES} SELECT t.id, round(t.topic + t.type + t.region + t.secondary + t.fresh + t.vote + t.exposure, 6) AS score, a.detected_language, greatest(a.created_at, v.updated_at) AS changed FROM t JOIN feed_articles a USING (id) LEFT JOIN article_votes v ON v.article_id = t.id
 WHERE greatest(a.created_at, v.updated_at) >= TIMESTAMP '2024-01-20 00:00:00'""")
def ranking_scores(r: Reader) -> DataFrame:
    votes = r.article_votes.select(F.col("article_id").alias("id"), F.col("updated_at").alias("voted_at"))
    rows = r.feed_articles.select("id", "detected_language", "created_at").join(votes, "id", "left")
    rows = rows.select("id", "detected_language", F.greatest("created_at", "voted_at").alias("changed")).where(F.col("changed") >= F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))
    return the_scores(r).select("id", F.round("score", 6).alias("score")).join(rows, "id")


@query("K13", """
SELECT id, CASE WHEN primary_topic IN ('Travel', 'Gaming', 'Science', 'Politics') THEN primary_topic ELSE 'unknown' END AS topic, CASE WHEN article_type IN ('News', 'Review') THEN article_type ELSE 'unknown' END AS kind FROM feed_articles""")
def closed_vocabulary(r: Reader) -> DataFrame:
    keep = lambda c, names: F.when(F.col(c).isin(*names), F.col(c)).otherwise("unknown")
    return r.feed_articles.select("id", keep("primary_topic", ("Travel", "Gaming", "Science", "Politics")).alias("topic"), keep("article_type", ("News", "Review")).alias("kind"))


@query("K14", """
WITH b AS (SELECT id, source_id, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) // 8 AS batch, (row_number() OVER (PARTITION BY source_id ORDER BY id) - 1) % 8 AS place FROM feed_articles),
a AS (SELECT *, count(*) OVER (PARTITION BY source_id, batch) AS n FROM b), x AS (SELECT *, CASE WHEN n <= 5 THEN 0 WHEN place < greatest(1, n // 2) THEN 1 WHEN place - greatest(1, n // 2) < greatest(1, (n - greatest(1, n // 2)) // 4) THEN 2 END AS attempt FROM a)
SELECT id, source_id, CAST(batch AS BIGINT) AS batch, CAST(attempt AS BIGINT) AS attempt FROM x""")
def tagging_batches(r: Reader) -> DataFrame:
    """Batches of eight, and the attempt that tags each article where a request of more than five comes back empty: the whole batch
    first, then half of what is left, then a quarter of the rest; null where none of the three does."""
    rows = rel.numbered(r.feed_articles.select("id", "source_id"), ["source_id"], [F.col("id")], "i")
    rows = rows.select("id", "source_id", F.floor((F.col("i") - 1) / 8).alias("batch"), ((F.col("i") - 1) % 8).alias("place"))
    sizes = rows.groupBy("source_id", "batch").agg(F.count("*").alias("n"))
    second = F.greatest(F.lit(1), F.expr("n div 2"))
    third = F.greatest(F.lit(1), F.floor((F.col("n") - second) / 4))
    attempt = F.when(F.col("n") <= 5, 0).when(F.col("place") < second, 1).when(F.col("place") - second < third, 2).cast("long")
    return rows.join(sizes, ["source_id", "batch"]).select("id", "source_id", "batch", attempt.alias("attempt"))


@query("F59", """
SELECT id, coalesce(nullif(concat_ws(', ', nullif(primary_topic, 'unknown'), nullif(region, 'unknown'), article_type), ''), 'General article') AS reason FROM feed_articles""")
def score_reason(r: Reader) -> DataFrame:
    return r.feed_articles.select("id", text.reason(F.col("primary_topic"), F.col("region"), F.col("article_type")).alias("reason"))


@query("F02", """
SELECT o_orderkey AS id, round(4.0 * tanh((o_orderkey % 40 - 20) / 17.0), 6) AS explicit, round(pow(0.5::DOUBLE, greatest(0, o_orderkey % 400) / 90.0), 6) AS decay FROM orders""")
def saturation_curve(r: Reader) -> DataFrame:
    key = F.col("o_orderkey")
    return r.orders.select(key.alias("id"), F.round(numbers.saturate(key % 40 - 20, 4.0, 17.0), 6).alias("explicit"), F.round(numbers.decay((key % 400).cast("double")), 6).alias("decay"))


def page_of(r: Reader, most: int = 200) -> DataFrame:
    """Candidates by category (uncategorised: 0): the best rows of each, with the votes that their topics have."""
    sources = r.feed_sources.select(F.col("id").alias("source_id"), F.coalesce("category_id", F.lit(0)).alias("page"))
    known = settled(the_weights(r), "weights")
    rows = rel.top_per_group(the_scores(r, known).join(sources, "source_id"), ["page"], [F.desc("score"), F.col("id")], most)
    votes = rel.small(known.where("axis = 'topic'").select(F.col("label").alias("primary_topic"), F.col("votes").alias("topic_votes")))
    return rows.join(votes, "primary_topic", "left")


def _wanted(k: int) -> str:
    """Wanted shares of the labels in column l{k}: softmax of their weights w{k} in the page, none below 0.02."""
    return f"""e{k} AS (SELECT page, l, exp(w - max(w) OVER (PARTITION BY page)) AS e FROM (SELECT page, l{k} AS l, arg_min(w{k}, i) AS w FROM p GROUP BY 1, 2)),
g{k} AS (SELECT page, l, greatest(e / sum(e) OVER (PARTITION BY page), 0.02) AS g FROM e{k}), z{k} AS (SELECT page, l, g / sum(g) OVER (PARTITION BY page) AS q FROM g{k})"""


#: A page's candidates are taken one by one: the best of score and of what its labels bring the page nearer to the wanted shares. What is the same for all candidates is left out.
ORDERED = f"""{SCORES}, c AS (SELECT t.id, t.source_id AS l0, coalesce(s.category_id, 0) AS page, t.topic + t.type + t.region + t.secondary + t.fresh + t.vote + t.exposure AS score, coalesce(a.primary_topic, 'unknown') AS l1, coalesce(a.region, 'unknown') AS l2, coalesce(a.article_type, 'unknown') AS l3,
 t.topic AS w1, t.region AS w2, t.type AS w3 FROM t JOIN feed_sources s ON s.id = t.source_id JOIN feed_articles a ON a.id = t.id),
p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS i FROM c QUALIFY i <= 200), m AS (SELECT page, min(score) AS lo, max(score) AS hi, count(DISTINCT l0) AS feeds FROM p GROUP BY page),
{", ".join(map(_wanted, (1, 2, 3)))},
v AS MATERIALIZED (SELECT p.page, p.id, i, score, l0, l1, l2, l3, CASE WHEN hi - lo > 1e-9 THEN (score - lo) / (hi - lo) ELSE 1.0 END AS norm, 1.0::DOUBLE / feeds AS q0, z1.q AS q1, z2.q AS q2, z3.q AS q3
 FROM p JOIN m USING (page) JOIN z1 ON z1.page = p.page AND z1.l = l1 JOIN z2 ON z2.page = p.page AND z2.l = l2 JOIN z3 ON z3.page = p.page AND z3.l = l3),
r AS (SELECT DISTINCT page, 0 AS k, []::BIGINT[] AS ids, []::BIGINT[] AS s0, []::VARCHAR[] AS s1, []::VARCHAR[] AS s2, []::VARCHAR[] AS s3 FROM v
 UNION ALL SELECT page, k + 1, list_append(ids, b.id), list_append(s0, b.l0), list_append(s1, b.l1), list_append(s2, b.l2), list_append(s3, b.l3) FROM (
  SELECT r.page, r.k, any_value(ids) AS ids, {", ".join(f"any_value(s{k}) AS s{k}" for k in range(4))}, arg_max({{'id': r.id, 'l0': l0, 'l1': l1, 'l2': l2, 'l3': l3}}, {{'x': 0.7 * norm - 0.3 * ({" + ".join(f"q{k} * ln((n{k} + 0.01) / (n{k} + 1.01))" for k in range(4))}), 'i': -r.i}}) AS b
  FROM (SELECT r.page, r.k, r.ids, s0, s1, s2, s3, v.id, v.i, l0, l1, l2, l3, norm, q0, q1, q2, q3, {", ".join(f"len(list_filter(s{k}, lambda x: x = l{k}))::DOUBLE AS n{k}" for k in range(4))} FROM r JOIN v ON v.page = r.page WHERE NOT list_contains(r.ids, v.id)) AS r GROUP BY r.page, r.k)),
o AS (SELECT page, arg_max(ids, k) AS ids FROM r GROUP BY page)"""


@query("K05 K06", f"WITH RECURSIVE {ORDERED} SELECT page, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) AS INTEGER) AS place FROM o")
def calibrated_rerank(r: Reader) -> DataFrame:
    return rerank.rerank_pages(page_of(r))


@query("K07", f"""
WITH RECURSIVE {ORDERED}, y AS (SELECT page, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos, len(ids) AS n FROM o),
el AS (SELECT y.page, y.id, y.pos, v.score, v.l0, coalesce(w.votes, 0) AS votes FROM y JOIN v ON v.page = y.page AND v.id = y.id JOIN feed_articles a ON a.id = y.id LEFT JOIN w ON w.axis = 'topic' AND w.label = a.primary_topic
 LEFT JOIN article_votes x ON x.article_id = y.id LEFT JOIN im ON im.article_id = y.id WHERE pos > y.n // 2 AND y.n > 10 AND coalesce(x.vote, '') <> 'show_less' AND coalesce(im.n, 0) = 0),
kk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, votes, pos) AS turn FROM el), ll AS (SELECT *, row_number() OVER (PARTITION BY page, l0 ORDER BY turn) > 1 AS again FROM kk),
u AS (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY again, turn) AS nth FROM ll),
xx AS (SELECT page, ids AS placed, 0::BIGINT AS nth FROM o UNION ALL
 SELECT xx.page, CASE WHEN list_position(placed, u.id) > u.nth * 10 THEN list_filter(placed, lambda z: z <> u.id)[1:u.nth * 10 - 1] || [u.id] || list_filter(placed, lambda z: z <> u.id)[u.nth * 10:] ELSE placed END, u.nth
 FROM xx JOIN u ON u.page = xx.page AND u.nth = xx.nth + 1 WHERE u.nth * 10 <= len(placed)),
oo AS (SELECT page, arg_max(placed, nth) AS ids FROM xx GROUP BY page)
SELECT page, unnest(ids) AS id, CAST(generate_subscripts(ids, 1) AS INTEGER) AS place FROM oo""")
def exploration_slots(r: Reader) -> DataFrame:
    return rerank.rerank_pages(page_of(r), every=10)


@query("W05", f"""
WITH RECURSIVE {SCORES}, c AS (SELECT t.id, coalesce(s.category_id, 0) AS page, round(topic + type + region + secondary + fresh + vote + exposure, 6) AS score FROM t JOIN feed_sources s ON s.id = t.source_id),
p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY page) AS n FROM c),
h AS (SELECT page, min(score) AS threshold FROM p WHERE place <= greatest(1, ceil(n * 0.1)) GROUP BY page),
q AS MATERIALIZED (SELECT page, id, place, score >= threshold AND id % 3 <> 0 AS wanted FROM p JOIN h USING (page) WHERE place <= 200),
f AS (SELECT page, id, place, wanted, wanted AS picked, CASE WHEN wanted THEN 0 ELSE 5 END AS since FROM q WHERE place = 1
 UNION ALL SELECT q.page, q.id, q.place, q.wanted, q.wanted AND f.since >= 4, CASE WHEN q.wanted AND f.since >= 4 THEN 0 ELSE f.since + 1 END FROM f JOIN q ON q.page = f.page AND q.place = f.place + 1)
SELECT page, id, place, wanted, picked FROM f""")
def feature_cards(r: Reader) -> DataFrame:
    """Large cards of a page of 200 in the order of its scores: articles with an image among the best tenth of all in the category, four others between two."""
    sources = r.feed_sources.select(F.col("id").alias("source_id"), F.coalesce("category_id", F.lit(0)).cast("long").alias("page"))
    scored = the_scores(r).select("id", "source_id", F.round("score", 6).alias("score")).join(sources, "source_id").select("page", "id", "score")
    placed = settled(rel.numbered(scored, ["page"], [F.desc("score"), F.col("id")], "place", "n"), "placed")
    best = placed.where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))).groupBy("page").agg(F.min("score").alias("threshold"))  # a row a category
    shown = placed.where("place <= 200").join(F.broadcast(best), "page")
    wanted = shown.select("page", "id", "place", ((F.col("score") >= F.col("threshold")) & (F.col("id") % 3 != 0)).alias("wanted"))
    return rerank.spaced(wanted, "page", "place", "wanted", 4)


@query("W07", """
WITH RECURSIVE b AS (SELECT l_orderkey AS doc, l_linenumber AS idx, CAST(sum(l_quantity) * 40 AS BIGINT) AS size FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY idx, size) AS n FROM b),
p AS (SELECT doc, idx, n, 0 AS batch, size AS used FROM o WHERE n = 1 UNION ALL
 SELECT o.doc, o.idx, o.n, CASE WHEN p.used > 0 AND p.used + o.size > 2400 THEN p.batch + 1 ELSE p.batch END, CASE WHEN p.used > 0 AND p.used + o.size > 2400 THEN o.size ELSE p.used + o.size END FROM p JOIN o ON o.doc = p.doc AND o.n = p.n + 1)
SELECT doc, CAST(idx AS BIGINT) AS idx, batch FROM p""")
def char_budget_batches(r: Reader) -> DataFrame:
    blocks = r.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx")).agg((F.sum("l_quantity") * 40).alias("size"))
    return rerank.packed(blocks, "doc", "idx", "size", 2400)


@query("O05", "SELECT id, md5('seed-1-' || id) AS key FROM feed_articles ORDER BY key, id LIMIT 100")
def seeded_random_page(r: Reader) -> DataFrame:
    key = F.md5(F.concat(F.lit("seed-1-"), F.col("id").cast("string")))
    return r.feed_articles.select("id", key.alias("key")).orderBy("key", "id").limit(100)


@query("O05", """
SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY md5('visit-1-' || id), id) AS place FROM feed_articles WHERE is_read = 0""")
def seeded_shuffle(r: Reader) -> DataFrame:
    """Unread articles of each source in an order that a visit's seed fixes, so that pages of it fit together."""
    unread = r.feed_articles.where("is_read = 0").select("id", "source_id", F.md5(F.concat(F.lit("visit-1-"), F.col("id").cast("string"))).alias("key"))
    return rel.numbered(unread, ["source_id"], [F.col("key"), F.col("id")], "place").drop("key")


@query("O10", """
SELECT id, source_id FROM (SELECT id, source_id, coalesce(sum(length(content)) OVER (PARTITION BY source_id ORDER BY is_saved, is_read DESC, created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
 sum(length(content)) OVER (PARTITION BY source_id) AS total FROM feed_articles) WHERE total - run > 100000""")
def budget_eviction(r: Reader) -> DataFrame:
    rows = r.feed_articles.select("id", "source_id", "is_saved", "is_read", "created_at", F.length("content").cast("long").alias("size"))
    order = [F.col("is_saved"), F.desc("is_read"), F.col("created_at"), F.col("id")]
    return rel.numbered(rows, ["source_id"], order, "n", sums={"run": "size"}).where("run_all - run > 100000").select("id", "source_id")
