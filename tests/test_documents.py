"""Bodies, articles, summaries and model scoring."""

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from litsearch.operators import body, news, summarize

PAPERS = [
    (1, None), (2, ""), (3, "missing.json"), (4, "empty.json; good.json"), (5, "abstract.json; good.json"),
    (6, "blank.json; good.json"), (7, "missing.json; good.json; other.json"), (8, "other.json; good.json"),
    (9, "nosection.json"), (10, "nobody.json"),
]
FILES = [
    ("empty.json", []),
    ("abstract.json", [("only this", "Abstract")]),
    ("blank.json", [("", "Intro")]),
    ("good.json", [("skip", "ABSTRACT"), ("one", "Intro"), ("two", "")]),
    ("other.json", [("other", "Intro")]),
    ("nosection.json", [("kept", None)]),
    ("nobody.json", None),
]
BODIES = {1: "", 2: "", 3: "", 4: "one\ntwo", 5: "one\ntwo", 6: "", 7: "one\ntwo", 8: "other", 9: "kept", 10: ""}


def test_assemble_body(spark):
    papers = spark.createDataFrame([(i, p, "t") for i, p in PAPERS], "id int, pdf_json_files string, title string")
    fulltext = spark.createDataFrame(FILES, "path string, body_text array<struct<text: string, section: string>>")
    out = body.assemble_body(papers, fulltext, "id")
    assert out.columns == ["id", "pdf_json_files", "title", "body"]
    assert dict(rows(out, "id", "body")) == BODIES


def test_only_section_names_are_read_to_pick_a_file(spark, tmp_path):
    spark.createDataFrame(FILES, "path string, body_text array<struct<text: string, section: string>>").write.parquet(str(tmp_path / "f"))
    papers = spark.createDataFrame([(i, p) for i, p in PAPERS], "id int, pdf_json_files string")
    out = body.assemble_body(papers, spark.read.parquet(str(tmp_path / "f")), "id")
    plan = out._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    schemas = [line.split("ReadSchema: ")[1].strip() for line in plan.splitlines() if "ReadSchema: " in line]
    assert sorted(schemas) == [
        "struct<path:string,body_text:array<struct<section:string>>>",
        "struct<path:string,body_text:array<struct<text:string,section:string>>>",
    ]


def test_sections_to_text(spark):
    df = spark.createDataFrame(
        [(1, 2, "Results", "c"), (1, 0, "Abstract", "a"), (1, 1, None, "b"), (2, 0, "abstract", "x"), (3, 0, "r", None)],
        "k int, pos int, section string, text string",
    )
    assert rows(body.sections_to_text(df, "k", "pos", "section", "text"), "k", "body") == [(1, "b\nc"), (2, ""), (3, "")]


FLAT = [
    (1, "<article><p>one</p><p class='x'>t<b>w</b>o</p></article><p>after</p>", "one\ntwo\n"),
    (2, "<div><p>no container</p></div>", ""),
    (3, "<article>lead<p>one<p>two<ul><li>item</li></ul>tail</article>", "one\ntwo\n"),
    (4, "<article><script>var t='</p><p>';</script><p>a<!-- <p>hidden</p> -->b</p></article>", "ab\n"),
    (5, "<article><p>a &amp; b &lt;c&gt;</p>", "a & b <c>\n"),
    (6, "<article></article>", ""),
    (7, None, ""),
    (8, "<article><pre>x</pre><param name='p'><p></p></article>", "\n"),
]


def test_flat_articles(spark):
    pages = spark.createDataFrame([(i, h) for i, h, _ in FLAT], "id int, html string")
    expected = [(i, t) for i, _, t in FLAT]
    assert rows(news.extract_article_text(pages), "id", "body") == expected
    anywhere = pages.withColumn("class_pattern", F.lit(""))
    nested = news.extract_nested_article_text(anywhere, container="article")
    assert rows(nested, "id", "body") == expected


def test_all_containers_of_a_page_count(spark):
    page = spark.createDataFrame([("<article><p>a</p></article><p>x</p><article class='k'>t<p>b<p>c</article>",)], "html string")
    assert news.extract_article_text(page).first().body == "a\nb\nc\n"


def test_fuzziness_has_a_limit():
    from litsearch.functions.fuzzy import allowed_edits, allowed_edits_col

    for edits in (allowed_edits, allowed_edits_col):
        with pytest.raises(ValueError):
            edits("word" if edits is allowed_edits else F.lit("word"), 3)


def test_nested_articles(spark):
    html = (
        "<div class='story-body main'><p>one</p><div class='ad'><p>two</p></div>"
        "<div class='story-inner'><p>three</p></div></div><p>out</p><div><p>none</p></div>"
    )
    pages = spark.createDataFrame([(1, html, "story"), (2, html, "ad$"), (3, html, "zzz"), (4, html, None)],
                                  "id int, html string, class_pattern string")
    assert rows(news.extract_nested_article_text(pages), "id", "body") == [
        (1, "one\ntwo\nthree\n"), (2, "two\n"), (3, ""), (4, ""),
    ]


def test_feed_entries(spark):
    feeds = spark.createDataFrame(
        [("wired_rss", "Wired", [("a", "u1"), ("b", "u2")]), ("nyt_health", "Health", []), ("new", "New", [("c", "u3")])],
        "feed string, title string, entries array<struct<title: string, link: string>>",
    )
    entries = news.with_scrape_rule(news.feed_entries(feeds))
    assert rows(entries, "feed", "feed_title", "title", "link", "class_pattern") == [
        ("new", "New", "c", "u3", None),
        ("wired_rss", "Wired", "a", "u1", "article__chunks"),
        ("wired_rss", "Wired", "b", "u2", "article__chunks"),
    ]
    assert rows(news.without_scrape_rule(entries), "feed", "n") == [("new", 1)]
    assert rows(news.topic_filter(entries, ["b"]), "link") == [("u2",)]
    assert set(news.FEEDS) == set(news.FEED_CONTAINERS)


def test_names(spark):
    row = spark.range(1).select(
        news.article_filename(F.lit("A/B test now")).alias("f"),
        news.feed_folder(F.to_date(F.lit("2020-11-24"))).alias("d"),
    ).first()
    assert (row.f, row.d) == ("A_B_test_now.txt", "rss_feeds_11-24-2020")


def test_sentences(spark):
    df = spark.createDataFrame([(2, "No. A drug here. drug"), (1, "Other. One drug."), (3, "none")], "id int, t string")
    assert rows(summarize.sentences_matching(df, "id", "t", "drug"), "id", "sentence_no", "sentence") == [
        (1, 1, " One drug"), (2, 1, " A drug here"), (2, 2, " drug"),
    ]
    assert rows(summarize.sentences_matching(df, "id", "t", "drug", limit_docs=1), "id") == [(1,)]


def test_summary(spark):
    df = spark.createDataFrame(
        [(1, "common word. rare zebra quagga. unusual okapi tapir"), (2, "common word"), (3, "")],
        "id int, t string",
    )
    got = dict(rows(summarize.summarize_extractive(df, "id", "t", 2), "id", "summary"))
    assert got == {1: "rare zebra quagga. unusual okapi tapir.", 2: "common word.", 3: ""}
    assert summarize.truncate_tokens(df, "t", 3).filter("id = 1").first().tokens == ["common", "word", "rare"]


def test_infer_batches_makes_one_model_per_task(spark):
    def init():
        return {"calls": 0}

    def predict(model, batch: pd.DataFrame) -> pd.Series:
        model["calls"] += 1
        return batch["id"] * 10 + model["calls"] * 0

    df = spark.range(100).repartition(3)
    out = summarize.infer_batches(df, ["id"], init, predict, "p", "bigint")
    assert rows(out, "id", "p") == sorted([(i, i * 10) for i in range(100)], key=repr)


@pytest.mark.parametrize("k", [1, 2])
def test_summary_is_at_most_k_sentences(spark, k):
    df = spark.createDataFrame([(1, "aa bb. cc dd. ee ff")], "id int, t string")
    assert summarize.summarize_extractive(df, "id", "t", k).first().summary.count(".") == k
