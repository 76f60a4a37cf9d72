"""Feeds and outlines as documents, and documents as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.functions.markup import escaped

OPML_ORDER = ("category_last", "category", "part", "source_id")


def tag(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escaped(text), F.lit(f"</{name}>"))


def rss_documents(sources: DataFrame, articles: DataFrame, most: int) -> DataFrame:
    """(source_id, xml): an RSS 2.0 document of each source's newest `most` articles; sources without articles have empty channels.

    articles: id, source_id, title, url, content, created_at (UTC), main_image. An image's type follows from its ending, jpeg if unknown.
    """
    newest = Window.partitionBy("source_id").orderBy(F.desc("created_at"), F.desc("id"))
    top = articles.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    ending = F.lower(F.regexp_extract("main_image", r"\.([A-Za-z]+)(?:[?#].*)?$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in (("png", "image/png"), ("gif", "image/gif"), ("webp", "image/webp"), ("svg", "image/svg+xml")) for x in kv])
    kind = F.coalesce(F.try_element_at(kinds, ending), F.lit("image/jpeg"))
    enclosure = F.concat(F.lit('<enclosure url="'), escaped(F.col("main_image"), quotes=True), F.lit('" type="'), kind, F.lit('" length="0"/>'))
    date = F.concat(F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(
        F.lit("<item>"), tag("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))), tag("link", F.col("url")), tag("guid", F.col("url")), tag("pubDate", date),
        tag("content:encoded", F.coalesce("content", F.lit(""))), F.coalesce(enclosure, F.lit("")), F.lit("</item>"),
    )
    items = top.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))).alias("items"))
    body = F.coalesce(F.array_join(F.transform("items", lambda s: s["x"]), ""), F.lit(""))
    head = F.concat(tag("title", F.col("name")), tag("link", F.col("url")), tag("description", F.concat(F.lit("RSS feed for "), "name")))
    opening = '<?xml version="1.0" encoding="utf-8"?>\n<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" version="2.0"><channel>'
    found = sources.select(F.col("id").alias("source_id"), "name", "url").join(items, "source_id", "left")
    return found.select("source_id", F.concat(F.lit(opening), head, body, F.lit("</channel></rss>")).alias("xml"))


def opml_lines(sources: DataFrame, categories: DataFrame, base: str) -> DataFrame:
    """(category, part, source_id, line) of the enabled sources' outline: part 0 opens the document, 1 a category, 2 is a source,
    3 closes the category, 4 the document. Sources without category are Uncategorized."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    mine = sources.where("enabled = 1").join(names, "category_id", "left").withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), escaped(c, quotes=True), F.lit('"'))
    line = F.concat(
        F.lit('<outline type="rss"'), attribute("text", F.col("name")), attribute("title", F.col("name")),
        attribute("xmlUrl", F.concat(F.lit(f"{base}/feed/"), F.col("id").cast("string"), F.lit("/rss"))), attribute("htmlUrl", F.col("url")), F.lit("/>"),
    )
    row = lambda df, category, part, key, text: df.select(category.alias("category"), F.lit(part).alias("part"), key.alias("source_id"), text.alias("line"))
    each, none, zero = mine.select("category").distinct(), F.lit(""), F.lit(0).cast("long")
    opened = F.concat(F.lit("<outline"), attribute("text", F.col("category")), attribute("title", F.col("category")), F.lit(">"))
    once = sources.sparkSession.range(1)
    out = row(once, none, 0, zero, F.lit('<?xml version="1.0" encoding="utf-8"?><opml version="2.0"><head><title>Feeds</title></head><body>'))
    out = out.unionByName(row(each, F.col("category"), 1, zero, opened)).unionByName(row(mine, F.col("category"), 2, F.col("id").cast("long"), line))
    return out.unionByName(row(each, F.col("category"), 3, zero, F.lit("</outline>"))).unionByName(row(once, none, 4, zero, F.lit("</body></opml>")))


def write_lines(lines: DataFrame, folder: str) -> None:
    """The document of opml_lines as one text file below folder."""
    ordered = lines.withColumn("category_last", (F.col("part") == 4).cast("int"))
    ordered.coalesce(1).sortWithinPartitions(*OPML_ORDER).select("line").write.text(folder)


def write_documents(documents: DataFrame, key: str, text: str, folder: str) -> None:
    """Each document as a text file below folder/<key>=<value>."""
    documents.select(F.col(key), F.col(text)).write.partitionBy(key).text(folder)
