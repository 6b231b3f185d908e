"""Paper-shaped views of the shared test tables, as SQL text both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litsearch.session import spread

# title and abstract are the first two lines, the body is the whole text; some cells are missing
PAPERS_SQL = """
SELECT doc_id, cast(doc_id AS varchar(20)) AS cord_uid,
  CASE WHEN source = 'src3' THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN source = 'src11' THEN NULL ELSE source END AS authors,
  nullif(split_part(text, chr(10), 2), '') AS abstract,
  CASE WHEN source = 'src5' THEN NULL ELSE concat('2020-', lpad(cast(1 + n_chars % 12 AS varchar(2)), 2, '0'),
    '-', lpad(cast(1 + n_chars % 28 AS varchar(2)), 2, '0')) END AS publish_time,
  CASE WHEN lang = 'es' THEN NULL
    ELSE concat('http://papers.example.com/', cast(doc_id AS varchar(20))) END AS url,
  lang AS journal, text AS body
FROM {documents}
"""

# how many turns a conversation has decides whether it lists no file, one file, or two of which
# the first is missing or another conversation's
PAPER_FILES_SQL = """
SELECT conv_id, CASE WHEN n < 4 THEN NULL
  WHEN n = 4 THEN concat('p/', cast(conv_id AS varchar(20)), '.json')
  WHEN n = 5 THEN concat('p/missing_', cast(conv_id AS varchar(20)), '.json; p/', cast(conv_id AS varchar(20)), '.json')
  ELSE concat('p/', cast(conv_id + 1 AS varchar(20)), '.json; p/', cast(conv_id AS varchar(20)), '.json')
  END AS pdf_json_files
FROM (SELECT conv_id, count(*) AS n FROM {conversations} GROUP BY conv_id) c
"""

# a page as a feed: the language part of its address names it, its navigation links are entries
FEEDS_SQL = """
SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?]*)', 1) AS feed,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS titles,
  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS links
FROM {pages}
"""

TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAPERS_SQL, documents=table(spark, sf_dir, "documents"))


def paper_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAPER_FILES_SQL, conversations=table(spark, sf_dir, "conversations"))
