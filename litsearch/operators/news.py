"""Feed entries and article text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from litsearch.functions.text import decode_entities
from litsearch.operators.clean import keyword_filter

# The feeds followed, their addresses and the class of their article containers.
FEEDS = {
    "nyt_health": "https://rss.nytimes.com/services/xml/rss/nyt/Health.xml",
    "nyt_science": "https://rss.nytimes.com/services/xml/rss/nyt/Science.xml",
    "nyt_travel": "https://rss.nytimes.com/services/xml/rss/nyt/Travel.xml",
    "wired_rss": "https://www.wired.com/feed/rss",
    "mit_technology_review_rss": "https://cdn.technologyreview.com/stories.rss",
}
FEED_CONTAINERS = {
    "nyt_health": "StoryBodyCompanionColumn",
    "nyt_science": "StoryBodyCompanionColumn",
    "nyt_travel": "StoryBodyCompanionColumn",
    "wired_rss": "article__chunks",
    "mit_technology_review_rss": "storyContent",
}

# HTML elements whose start ends an open paragraph.
BLOCK_TAGS = (
    "address article aside blockquote center details dir div dl dd dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul"
).split()


def feed_entries(feeds: DataFrame) -> DataFrame:
    """One row per entry of each feed; feeds without entries give none."""
    return (
        feeds.filter(F.size("entries") > 0)
        .select("feed", F.col("title").alias("feed_title"), F.explode("entries").alias("e"))
        .select("feed", "feed_title", F.col("e.title").alias("title"), F.col("e.link").alias("link"))
    )


def with_scrape_rule(
    entries: DataFrame, rules: Mapping[str, str] = FEED_CONTAINERS, feed: str = "feed"
) -> DataFrame:
    """Add the container pattern of the entry's feed; null where there is no rule."""
    pairs = [F.lit(x) for pair in rules.items() for x in pair]
    rule = F.create_map(*pairs)[F.col(feed)] if pairs else F.lit(None).cast("string")
    return entries.withColumn("class_pattern", rule)


def without_scrape_rule(entries: DataFrame, feed: str = "feed") -> DataFrame:
    """(feed, n) of the entries for which no rule is known."""
    return entries.filter("class_pattern IS NULL").groupBy(feed).agg(F.count("*").alias("n"))


def topic_filter(entries: DataFrame, keywords: Sequence[str], col: str = "title") -> DataFrame:
    return keyword_filter(entries, col, keywords)


def article_filename(title: Column) -> Column:
    return F.concat(F.replace(F.replace(title, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")), F.lit(".txt"))


def feed_folder(day: Column) -> Column:
    return F.concat(F.lit("rss_feeds_"), F.date_format(day, "MM-dd-yyyy"))


def article_paragraphs(html: Column, container: str = "article") -> Column:
    """Array of the paragraph texts in all ``container`` elements, in order.

    For pages whose containers do not nest. Comments, scripts and styles are removed first; a
    paragraph runs to its end tag, the next block element or the end of the container.
    """
    c = re.escape(container)
    page = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    page = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    inner = F.regexp_extract_all(page, F.lit(rf"(?is)<{c}\b[^>]*>(.*?)(</{c}\s*>|$)"), 1)
    ends = rf"(?is)(</p\s*>|<({'|'.join(BLOCK_TAGS)})\b).*$"
    def paragraphs(text: Column) -> Column:
        pieces = F.split(text, r"(?i)<p(\s[^>]*)?>")
        return F.slice(pieces, 2, F.size(pieces))  # what precedes the first paragraph is not one

    return F.transform(
        F.flatten(F.transform(inner, paragraphs)),
        lambda p: decode_entities(F.regexp_replace(F.regexp_replace(p, ends, ""), r"(?s)<[^>]*>", "")),
    )


def extract_article_text(
    pages: DataFrame, html: str = "html", container: str = "article", out: str = "body"
) -> DataFrame:
    """Article text with a line break after each paragraph; '' where nothing is found."""
    lines = F.transform(article_paragraphs(F.col(html), container), lambda p: F.concat(p, F.lit("\n")))
    return pages.withColumn(out, F.coalesce(F.array_join(lines, ""), F.lit("")))


class _ArticleParser(HTMLParser):
    """Paragraph texts inside elements whose class matches a pattern; containers may nest."""

    def __init__(self, tag: str, pattern: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.pattern = tag, re.compile(pattern)
        self.open_tags: list[bool] = []  # for each open container tag: does its class match
        self.paragraph: list[str] | None = None
        self.skipped = 0
        self.lines: list[str] = []

    def _end_paragraph(self) -> None:
        if self.paragraph is not None:
            self.lines.append("".join(self.paragraph) + "\n")
            self.paragraph = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skipped += 1
        if tag in BLOCK_TAGS:
            self._end_paragraph()
        if tag == self.tag:
            classes = (dict(attrs).get("class") or "").split()
            # a pattern may match one class name or the attribute as a whole; without a class
            # only the empty pattern, which takes any container, matches
            names = [*classes, " ".join(classes)] if classes else []
            self.open_tags.append(not self.pattern.pattern or any(map(self.pattern.search, names)))
        if tag == "p" and any(self.open_tags):
            self.paragraph = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skipped = max(0, self.skipped - 1)
        if tag == "p" or tag in BLOCK_TAGS:
            self._end_paragraph()
        if tag == self.tag and self.open_tags:
            self.open_tags.pop()

    def handle_data(self, data):
        if self.paragraph is not None and not self.skipped:
            self.paragraph.append(data)

    def text(self, html: str) -> str:
        self.feed(html)
        self.close()
        self._end_paragraph()
        return "".join(self.lines)


def extract_nested_article_text(
    pages: DataFrame, html: str = "html", pattern: str = "class_pattern",
    container: str = "div", out: str = "body",
) -> DataFrame:
    """As :func:`extract_article_text`, for containers picked by class that may nest.

    Balanced tags are beyond regular expressions, so this is an Arrow-batched Python function.
    ``pattern`` names the column with the class pattern, see :func:`with_scrape_rule`; an empty
    pattern takes every container, a missing one none.
    A paragraph inside nested matching containers is taken once.
    """

    @F.pandas_udf("string")
    def extract(pages_: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series([
            _ArticleParser(container, p).text(h) if h and p is not None else ""
            for h, p in zip(pages_, patterns)
        ], dtype=object)

    return pages.withColumn(out, extract(F.col(html), F.col(pattern)))
