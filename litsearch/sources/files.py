"""Full-text JSON files, feeds, articles and bulk-index lines."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FULLTEXT_SCHEMA = "body_text array<struct<text: string, section: string>>"
FEED_SCHEMA = "title string, link string, item array<struct<title: string, link: string, description: string, pubDate: string>>"

ATOM_SCHEMA = ("title string, entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, "
               "summary: string, content: string, published: string, updated: string>>")


def _file_path() -> Column:
    # paths come back with special characters written as %XX; a plus sign stands for itself
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _relative_path(root: str) -> Column:
    bare = re.sub(r"^[a-z0-9+.-]+:/*", "/", root)
    bare = (bare if "://" in root else os.path.abspath(bare)).rstrip("/") + "/"
    path = _file_path()
    return F.substring(path, F.instr(path, bare) + len(bare), F.length(path))


def read_fulltext_json(spark: SparkSession, root: str) -> DataFrame:
    """(path, body_text) of every JSON file below ``root``; ``path`` is relative to it."""
    return (
        spark.read.schema(FULLTEXT_SCHEMA).option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
        .select(_relative_path(root).alias("path"), "body_text")
    )


def _feed_name() -> Column:
    return F.regexp_extract(_file_path(), r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("feed")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(feed, title, entries) of landed RSS and Atom files; ``feed`` is the file name without ending.

    An Atom entry's link is its alternate one, its description the summary or else the content, and its
    date that of publication or else of the last change.
    """
    channels = spark.read.format("xml").option("rowTag", "channel").schema(FEED_SCHEMA).load(path)
    kind = channels.schema["item"].dataType
    atoms = spark.read.format("xml").option("rowTag", "feed").schema(ATOM_SCHEMA).load(path)
    alternate = F.expr("""transform(entry, e -> named_struct('title', e.title,
        'link', coalesce(filter(e.link, l -> l._rel IS NULL OR l._rel = 'alternate')[0]._href, e.link[0]._href),
        'description', coalesce(e.summary, e.content), 'pubDate', coalesce(e.published, e.updated)))""")
    both = channels.select(_feed_name(), "title", "item").unionAll(atoms.select(_feed_name(), "title", alternate.cast(kind).alias("item")))
    return both.select("feed", "title", F.coalesce("item", F.array().cast(kind)).alias("entries"))


def read_feed_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(feed, parsed) of landed RSS and Atom files: everything that the file says, as one VARIANT, whatever its fields."""
    def whole(tag: str) -> DataFrame:
        parsed = spark.read.format("xml").option("rowTag", tag).option("singleVariantColumn", "parsed").load(path)
        return parsed.select(_feed_name(), "parsed")

    return whole("channel").unionAll(whole("feed"))


def write_feed_metadata(feeds: DataFrame, path: str) -> None:
    """One JSON row per feed."""
    feeds.write.mode("overwrite").json(path)


def write_articles(articles: DataFrame, path: str, folder: str = "feed_date", feed: str = "feed_title") -> None:
    """Articles in folders by date and feed, added to those that are there already."""
    parts = int(articles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        articles.withColumn("written_at", F.current_timestamp())
        .repartition(folder, feed, F.pmod(F.xxhash64("filename"), F.lit(parts)))
        .write.mode("append").partitionBy(folder, feed).parquet(path)
    )


def load_articles(spark: SparkSession, path: str, folder: str = "feed_date", feed: str = "feed_title") -> DataFrame:
    """Written articles; of a file written more than once, the latest."""
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c not in (folder, feed, "filename", "written_at")]
    latest = F.max_by(F.struct(*rest), F.struct("written_at", *rest)).alias("_row")
    return stored.groupBy(folder, feed, "filename").agg(latest).select(folder, feed, "filename", "_row.*")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of plain text files, one row per file however often it is listed."""
    return (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select(_file_path().alias("path"), F.col("value").alias("body"))
        .dropDuplicates(["path"])
    )


def to_bulk_actions(
    df: DataFrame, index: str, id_col: str | None = None, doc_type: str | None = None
) -> DataFrame:
    """One ``value`` per row: the index action and the JSON of the row, a line each."""
    target = [F.lit(index).alias("_index")]
    if doc_type is not None:
        target.append(F.lit(doc_type).alias("_type"))
    if id_col is not None:
        target.append(F.col(id_col).cast("string").alias("_id"))
    action = F.to_json(F.struct(F.struct(*target).alias("index")))
    source = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.concat_ws("\n", action, source).alias("value"))


def to_bulk_deletes(ids: DataFrame, index: str, id_col: str) -> DataFrame:
    """One ``value`` per row: the delete action of an id."""
    target = F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id"))
    return ids.select(F.to_json(F.struct(target.alias("delete"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
