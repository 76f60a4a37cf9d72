"""Tables and the domain views over them.

A view is one SQL text that Spark and the oracle share; only the name of the timestamp type differs. All times are naive
UTC, and `as_of` stands for the present in every query.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
TABLES = tuple("region nation customer supplier part orders lineitem events documents pages labels".split())

VIEWS = {
    "categories": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name FROM {region}",
    "feed_sources": """
        SELECT id, source AS name, 'https://' || source || '.example/feed' AS url,
          CASE WHEN id % 6 = 5 THEN NULL ELSE id % 5 + 1 END AS category_id,
          CASE WHEN id % 10 = 9 THEN 0 ELSE 1 END AS enabled,
          CASE WHEN id % 4 = 0 THEN '1' ELSE NULL END AS translate_to,
          CASE id % 3 WHEN 0 THEN 'qwen' WHEN 1 THEN 'google' ELSE 'lmt' END AS translator,
          CASE id % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' ELSE 'grey' END AS status,
          CASE WHEN id % 5 = 0 THEN NULL ELSE TS '2024-01-30 00:00:00' + (id % 72) * INTERVAL '1' HOUR END AS next_check_at
        FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source FROM {documents}) s""",
    "feed_articles": """
        SELECT doc_id AS id,
          CASE WHEN doc_id % 97 = 96 THEN 999 ELSE CAST(substr(source, 4) AS BIGINT) END AS source_id,
          'https://' || source || '.example/a/' || CAST(doc_id AS VARCHAR(20)) AS url,
          substr(text, 1, 60) AS title, text AS content, lang AS detected_language,
          CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(CAST(TS '2024-01-01 00:00:00' + ((doc_id * 7) % 720) * INTERVAL '1' HOUR AS DATE) AS VARCHAR(10)) END AS pub_date,
          TS '2024-01-01 00:00:00' + ((doc_id * 13) % 720) * INTERVAL '1' HOUR AS created_at,
          CASE doc_id % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'success' END AS parse_status,
          CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS is_read, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS is_saved,
          CASE doc_id % 7 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Gaming' WHEN 2 THEN 'Science' WHEN 3 THEN 'Politics' WHEN 4 THEN 'Sports' WHEN 5 THEN 'unknown' ELSE NULL END AS primary_topic,
          CASE doc_id % 5 WHEN 0 THEN '["Smartphones","TV Series"]' WHEN 1 THEN '["Smartphone"]' WHEN 2 THEN '["Watches","watch"]' WHEN 3 THEN NULL ELSE '[]' END AS secondary_topics,
          CASE lang WHEN 'en' THEN 'United Kingdom' WHEN 'de' THEN 'Germany' WHEN 'fr' THEN 'Global' ELSE 'unknown' END AS region,
          CASE doc_id % 4 WHEN 0 THEN 'News' WHEN 1 THEN 'Review' WHEN 2 THEN 'Deal' ELSE 'Feature' END AS article_type,
          CAST(doc_id % 12 AS INTEGER) AS retry_count,
          CASE WHEN doc_id % 3 = 1 THEN 'Translated by Qwen' || CASE WHEN doc_id % 2 = 0 THEN ' (fell back from Google)' ELSE '' END || '</p>' WHEN doc_id % 3 = 2 THEN 'Translated by DeepL<br>' END AS badge
        FROM {documents}""",
    "user_article_events": """
        SELECT event_id AS id, event_id % (SELECT count(*) FROM {documents}) AS article_id, user_id,
          CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'read_complete' WHEN 'error' THEN 'skip' ELSE 'hover' END AS event_type,
          CAST(floor(value) AS BIGINT) % 10 AS dwell_seconds, ts AS created_at FROM {events}""",
    "article_votes": """
        SELECT doc_id AS article_id, CASE WHEN toxic = 1 OR quality = 0 THEN 'show_less' ELSE 'show_more' END AS vote,
          TS '2024-01-01 00:00:00' + ((doc_id * 5) % 720) * INTERVAL '1' HOUR AS updated_at FROM {labels}""",
    "translation_usage": """
        SELECT o_orderkey AS id, o_custkey % 20 AS source_id,
          CASE o_orderstatus WHEN 'F' THEN 'qwen' WHEN 'O' THEN NULL ELSE 'deepseek' END AS provider,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'tagging' WHEN '2' THEN 'ondemand' ELSE 'translation' END AS kind,
          o_orderkey % 5000 AS cache_miss_tokens, o_orderkey % 700 AS completion_tokens, o_totalprice / 1000000 AS cost_cny, o_orderdate AS created_at
        FROM {orders}""",
}


def timestamp(text: str = AS_OF):
    return F.to_timestamp_ntz(F.lit(text))


class Reader:
    """The tables and views of one directory, as attributes: Reader(spark, dir).feed_articles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            used = {t: getattr(self, t) for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
            return self.spark.sql(VIEWS[name].replace("TS '", "TIMESTAMP_NTZ '"), **used)
        raise AttributeError(name)

    @cached_property
    def as_of(self):
        return timestamp()


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})".replace("TS '", "TIMESTAMP '") for n in used]
    body = sql.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if parts and body.upper().startswith(opening):
            return f"{opening}{', '.join(parts)}, {body[len(opening):]}"
    return f"WITH {', '.join(parts)} {body}" if parts else body
