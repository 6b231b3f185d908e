"""Document bodies from paragraphs and full-text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def sections_to_text(
    df: DataFrame, key: str, pos: str, section: str, text: str,
    exclude: Sequence[str] = ("abstract",), out: str = "body",
) -> DataFrame:
    """Paragraph rows rolled up to one text per key, in order, without the excluded sections.

    The result holds a document in one cell, so a document's paragraphs do meet in one task.
    A key left without paragraphs gets ''.
    """
    kept = ~F.lower(F.coalesce(F.col(section), F.lit(""))).isin(list(exclude))
    paragraph = F.when(kept, F.struct(pos, F.coalesce(F.col(text), F.lit("")).alias("text")))
    ordered = F.array_sort(F.collect_list(paragraph))  # collect_list skips nulls
    return df.groupBy(key).agg(ordered.alias("_p")).select(key, F.array_join(F.col("_p.text"), "\n").alias(out))


def assemble_body(
    papers: DataFrame, fulltext: DataFrame, key: str = "cord_uid",
    files: str = "pdf_json_files", exclude: str = "abstract", out: str = "body",
) -> DataFrame:
    """Add the body of each paper: the paragraphs of its first file that has any.

    ``fulltext`` has (path, body_text array<struct<text, section>>), as the full-text source
    reads it. Paths that are not there are skipped; a paper without a usable file gets ''.

    Which file wins depends only on the section names, so the winner is found on (key, path)
    pairs and a scan of that nested column, and the text is shuffled once.
    """
    sections = F.coalesce(F.col("body_text.section"), F.array().cast("array<string>"))
    has_paragraphs = F.exists(
        sections, lambda s: F.lower(F.coalesce(s, F.lit(""))) != exclude
    )
    usable = fulltext.filter(has_paragraphs).select("path")
    wanted = (
        papers.filter(F.col(files).isNotNull() & (F.col(files) != ""))
        .select(key, F.posexplode(F.split(files, "; ")).alias("_pos", "path"))
    )
    winner = (
        wanted.join(usable, "path", "left_semi")
        .groupBy(key).agg(F.min_by("path", "_pos").alias("path"))
    )
    kept = F.filter("body_text", lambda p: F.lower(F.coalesce(p["section"], F.lit(""))) != exclude)
    texts = F.transform(kept, lambda p: F.coalesce(p["text"], F.lit("")))
    bodies = fulltext.select("path", F.array_join(texts, "\n").alias("_body"))
    # papers without a file get a path of their own that meets nothing: left null, they would all
    # go to one task
    nowhere = F.concat(F.lit("\0"), F.col(key).cast("string"))
    located = papers.drop(out).join(winner, key, "left").withColumn("path", F.coalesce("path", nowhere))
    return (
        located.join(bodies, "path", "left")
        .withColumn(out, F.coalesce("_body", F.lit(""))).drop("path", "_body")
    )
