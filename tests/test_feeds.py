"""RSS and Atom files, and the whole of what they say."""

import json

from conftest import rows

from litsearch.sources import files

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>News</title><ttl>60</ttl>
<image><url>i.png</url></image>
<item><title>One</title><link>http://a/1</link><description>First</description><guid isPermaLink="false">g1</guid></item>
<item><title>Two</title><link>http://a/2</link><category>x</category><category>y</category></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Journal</title><id>urn:1</id>
<entry><title>Three</title><link rel="self" href="http://b/s"/><link rel="alternate" href="http://b/3"/>
<summary>Short</summary><updated>2020-01-02</updated></entry>
<entry><title>Four</title><link href="http://b/4"/><content type="html">Whole</content><published>2020-01-01</published><updated>2020-01-03</updated></entry></feed>"""
EMPTY = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Nothing</title></feed>"""


def test_rss_and_atom(spark, tmp_path):
    for name, text in (("news.xml", RSS), ("journal.atom", ATOM), ("nothing.xml", EMPTY)):
        (tmp_path / name).write_text(text)
    feeds = files.read_feeds(spark, str(tmp_path))
    assert rows(feeds.selectExpr("feed", "title", "size(entries)")) == [("journal", "Journal", 2), ("news", "News", 2), ("nothing", "Nothing", 0)]
    assert rows(feeds.selectExpr("inline(entries)")) == sorted([
        ("One", "http://a/1", "First", None), ("Two", "http://a/2", None, None),
        ("Three", "http://b/3", "Short", "2020-01-02"), ("Four", "http://b/4", "Whole", "2020-01-01")], key=repr)
    files.write_feed_metadata(files.read_feed_metadata(spark, str(tmp_path)), str(tmp_path / "out"))
    said = {r.feed: json.loads(r.p) for r in spark.read.schema("feed string, parsed variant").json(str(tmp_path / "out")).selectExpr(
        "feed", "to_json(parsed) AS p").collect()}
    assert said.keys() == {"news", "journal", "nothing"}
    news = said["news"]
    assert news["ttl"] == 60 and news["image"]["url"] == "i.png" and news["item"][0]["guid"]["_VALUE"] == "g1" and news["item"][1]["category"] == ["x", "y"]
    assert said["journal"]["id"] == "urn:1" and said["journal"]["entry"][0]["link"][1]["_href"] == "http://b/3"


def test_news_job_lists_entries_without_a_page(spark, tmp_path):
    from pyspark.sql import functions as F

    from litsearch.plans.ingest import ingest_news

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "news.xml").write_text(RSS)
    pages = spark.createDataFrame([("http://a/1", '<div class="c"><p>Text of one</p></div>')], "url string, html string")
    out = str(tmp_path / "out")
    articles = ingest_news(spark, str(tmp_path / "in"), pages, F.lit("2020-05-01").cast("date"), out, {"news": "c"})
    assert rows(articles, "title", "url", "body") == [("One", "http://a/1", "Text of one\n")]
    assert rows(spark.read.parquet(f"{out}/missing"), "link") == [("http://a/2",)]
