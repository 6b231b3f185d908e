"""Whole jobs: what a user runs end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from litsearch.operators.body import assemble_body
from litsearch.operators.clean import clean_papers
from litsearch.operators.dedup import dedup_report, drop_duplicates
from litsearch.operators.layout import rebalance
from litsearch.operators.news import (
    FEED_CONTAINERS, article_filename, extract_nested_article_text, feed_entries, feed_folder,
    with_scrape_rule,
)
from litsearch.operators.search import DEFAULT_BOOSTS, SearchIndex, write_index
from litsearch.operators.store import upsert
from litsearch.sources.files import load_articles, read_feed_metadata, read_feeds, read_fulltext_json, write_articles, write_feed_metadata
from litsearch.sources.tables import read_metadata_csv, write_papers


def ingest_papers(spark: SparkSession, metadata_csv: str, fulltext_root: str, out: str) -> DataFrame:
    """Metadata CSV and full-text JSON files to a Parquet table of complete papers."""
    papers = clean_papers(read_metadata_csv(spark, metadata_csv))
    write_papers(rebalance(assemble_body(papers, read_fulltext_json(spark, fulltext_root))), out)
    return spark.read.parquet(out)


def build_search_index(
    papers: DataFrame, path: str, key: str = "cord_uid", fields: Sequence[str] = tuple(DEFAULT_BOOSTS)
) -> SearchIndex:
    return write_index(papers, key, fields, path)


def update_papers(
    spark: SparkSession, current: str, updates: DataFrame, target: str, key: str, order_by: Sequence[str]
) -> DataFrame:
    """Upsert into a new snapshot folder; the one being read is never overwritten."""
    write_papers(upsert(spark.read.parquet(current), updates, [key], order_by), target)
    return spark.read.parquet(target)


def deduplicate_papers(
    spark: SparkSession, path: str, target: str, keys: Sequence[str], id_col: str, keep: str = "first"
) -> DataFrame:
    """Write the table without duplicates to ``target``; returns the counts before and after."""
    papers = spark.read.parquet(path)
    write_papers(drop_duplicates(papers, keys, id_col, keep), target)
    return dedup_report(papers, keys, keep)


def ingest_news(
    spark: SparkSession, feeds_path: str, pages: DataFrame, day: Column, out: str,
    rules: Mapping[str, str] = FEED_CONTAINERS,
) -> DataFrame:
    """Landed feed files and article pages (url, html) to article texts by date and feed.

    Entries whose page shows no article text are left out; those whose page has not landed are listed
    in the folder ``missing``.
    """
    feeds = read_feeds(spark, feeds_path)
    write_feed_metadata(feeds, f"{out}/feeds")
    write_feed_metadata(read_feed_metadata(spark, feeds_path), f"{out}/feeds_parsed")
    entries = with_scrape_rule(feed_entries(feeds), rules)
    landed = pages.select(F.col("url").alias("link"), "html")
    entries.join(landed, "link", "left_anti").write.mode("overwrite").parquet(f"{out}/missing")
    found = entries.join(landed, "link")
    articles = (
        extract_nested_article_text(found).filter("body <> ''")
        .select(
            feed_folder(day).alias("feed_date"), "feed_title", "title",
            article_filename(F.col("title")).alias("filename"), F.col("link").alias("url"), "body",
        )
    )
    write_articles(articles, f"{out}/articles")
    return load_articles(spark, f"{out}/articles")
