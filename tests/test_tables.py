"""Deduplication, keyed writes, layout, vectors, TF-IDF, sources and streaming."""

import json
import math
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from litsearch.operators import dedup, layout, store, tfidf, vector
from litsearch.plans import ingest
from litsearch.sources import files, tables
from litsearch.streaming import ingest as stream

# ---- duplicates


@pytest.fixture(scope="module")
def copies(spark):
    data = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x"), (5, None, "x"), (6, None, "x"), (7, "1", "23"), (8, "12", "3")]
    return spark.createDataFrame(data, "id int, k string, j string")


def test_groups_and_members(copies):
    groups = dedup.duplicate_groups(copies, ["k"], "id")
    assert rows(groups, "n_docs", "first_id") == [(2, 5), (3, 1)]
    assert rows(dedup.duplicate_members(copies, ["k"], "id"), "id") == [(1,), (2,), (3,), (5,), (6,)]


def test_drop_duplicates(copies):
    first = dedup.drop_duplicates(copies, ["k"], "id")
    none = dedup.drop_duplicates(copies, ["k"], "id", "none")
    assert rows(first, "id") == [(1,), (4,), (5,), (7,), (8,)]
    assert rows(none, "id") == [(4,), (7,), (8,)]
    assert rows(dedup.drop_duplicates(copies, ["k", "j"], "id"), "id") == [(1,), (3,), (4,), (5,), (7,), (8,)]
    assert rows(dedup.dedup_report(copies, ["k"]), "n_before", "n_after") == [(8, 5)]
    assert rows(dedup.dedup_report(copies, ["k"], "none"), "n_before", "n_after") == [(8, 3)]
    for f in (lambda: dedup.drop_duplicates(copies, ["k"], "id", "last"), lambda: dedup.dedup_report(copies, ["k"], "last")):
        with pytest.raises(ValueError):
            f()


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "id int, at int, v string")
    assert rows(dedup.drop_repeated_ids(df, "id", "at"), "id", "v") == [(1, "a"), (2, "c")]


# ---- keyed writes


def test_upsert(spark):
    base = spark.createDataFrame([(1, 1, "old"), (2, 1, "old")], "id int, at int, v string")
    updates = spark.createDataFrame([("new", 2, 2), ("newest", 2, 3), ("added", 3, 1)], "v string, id int, at int")
    once = store.upsert(base, updates, ["id"], ["at"])
    assert rows(once, "id", "v") == [(1, "old"), (2, "newest"), (3, "added")]
    assert rows(store.upsert(once, updates, ["id"], ["at"])) == rows(once)
    assert store.append(base, updates).count() == 5


def test_by_id(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    ids = spark.createDataFrame([(1,), (1,)], "id int")
    for given in (ids, [1]):
        assert rows(store.get_by_ids(df, given, "id"), "v") == [("a",)]
        assert rows(store.delete_by_id(df, given, "id"), "v") == [("b",), ("c",)]
    assert rows(store.match_all(df.filter("id > 0"), "id", 1, 1), "id") == [(2,)]


def test_bulk_lines(spark):
    df = spark.createDataFrame([("x\"1", None)], "cord_uid string, title string")
    action, source = files.to_bulk_actions(df, "papers", "cord_uid").first().value.split("\n")
    assert json.loads(action) == {"index": {"_index": "papers", "_id": "x\"1"}}
    assert json.loads(source) == {"cord_uid": "x\"1", "title": None}
    typed = files.to_bulk_actions(df, "papers", doc_type="record").first().value
    assert json.loads(typed.split("\n")[0]) == {"index": {"_index": "papers", "_type": "record"}}
    deleted = files.to_bulk_deletes(df, "papers", "cord_uid").first().value
    assert json.loads(deleted) == {"delete": {"_index": "papers", "_id": "x\"1"}}


# ---- layout


@pytest.mark.parametrize("n, rows_per_chunk, sizes", [(10, 5, [5, 5]), (11, 5, [1, 5, 5]), (3, 5, [3])])
def test_chunks(spark, n, rows_per_chunk, sizes):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("key"))
    chunks = layout.with_chunk_id(df, ["key"], rows_per_chunk)
    assert sorted(r["count"] for r in chunks.groupBy("chunk_id").count().collect()) == sizes


def test_row_numbers_follow_the_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"), F.lit("abc").alias("t")).repartition(7)
    numbered = layout.with_row_number(df, ["k"], "n", F.length("t"), "total").collect()
    keys = sorted(r.k for r in numbered)
    assert {r.k: (r.n, r.total) for r in numbered} == {k: (i, 3 * i + 3) for i, k in enumerate(keys)}
    assert [r.k for r in layout.row_slice(df, ["k"], 3, 5).orderBy("k").collect()] == keys[3:6]


def test_byte_batches(spark):
    sizes = [10, 40, 50, 51, 30, 100, 250, 1, 49, 50, 50, 2]
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "id int, t string")
    batches = {}
    for r in layout.with_byte_batches(df, ["id"], 100).collect():
        batches.setdefault(r.batch_id, []).append(len(r.t))
    assert sorted(sum(batches.values(), [])) == sorted(sizes)
    assert all(sum(b) <= 100 or b == [250] for b in batches.values())
    # each batch takes all that fit
    assert [batches[k] for k in sorted(batches)] == [[10, 40, 50], [51, 30], [100], [250], [1, 49, 50], [50, 2]]


def test_byte_batches_are_runs_within_the_limit(spark):
    sizes = [(i * 7919) % 130 for i in range(400)] + [0] * 300 + [100, None, 101, 0]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id int, n int").repartition(5)
    got = layout.with_byte_batches(df, ["id"], 100, F.col("n")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(sizes)))
    assert [r.batch_id for r in got] == sorted(r.batch_id for r in got)
    assert all(r.oversize == ((r.n or 0) > 100) for r in got)
    batches = {}
    for r in got:
        batches.setdefault(r.batch_id, []).append(r.n or 0)
        assert r.batch_id <= r.id
    assert all(sum(b) <= 100 or len(b) == 1 for b in batches.values())
    empty = layout.with_byte_batches(df.limit(0), ["id"], 100, F.col("n"))
    assert empty.count() == 0 and empty.columns == ["id", "n", "batch_id", "oversize"]


def test_batches_go_on_from_one_arrow_batch_to_the_next(spark):
    """Many empty rows are one block: a task streams them and carries the unfinished batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        sizes = [(i * 31) % 7 for i in range(3000)] + [0] * 5000 + [99, 2, 98, 2, 1]
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id int, n int").repartition(3)
        got = [r.batch_id for r in layout.with_byte_batches(df, ["id"], 1000, F.col("n")).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected, ends, block, filled = [], 0, None, 0
    for i, n in enumerate(sizes):
        if ends // 16000 != block or filled + n > 1000:
            block, start, filled = ends // 16000, i, 0
        filled, ends = filled + n, ends + n + 1
        expected.append(start)
    assert got == expected


def test_only_keys_and_sizes_are_written(spark, monkeypatch):
    written = []
    kept = layout.materialize
    monkeypatch.setattr(layout, "materialize", lambda df, path=None: written.append(df.columns) or kept(df, path))
    df = spark.createDataFrame([(i, None if i == 0 else i * 2, "text") for i in range(50)], "id int, k int, t string")
    layout.with_chunk_id(df, ["k"], 5).count(), layout.with_byte_batches(df, ["k"], 20).count()
    assert written == [["k", "_size", "_weight", "_id"]] * 2
    assert sorted(r.id for r in layout.row_slice(df, ["k"], 0, 3).collect()) == [0, 1, 2, 3]
    assert sorted(r.id for r in layout.row_slice(df, ["k"], 48, 90).collect()) == [48, 49]
    assert layout.row_slice(df, ["k"], 50, 60).count() == 0
    two = df.withColumn("a", F.col("id") % 3)
    ordered = sorted(range(50), key=lambda i: (i % 3, i))
    assert sorted(r.id for r in layout.row_slice(two, ["a", "k"], 10, 20).collect()) == sorted(ordered[10:21])
    assert layout.with_chunk_id(df, ["k"], 5).filter("k is null").first().chunk_id == 0
    with pytest.raises(Exception, match="must be unique"):
        layout.with_chunk_id(df.withColumn("k", F.lit(1)), ["k"], 5).count()


def test_partition_sizes(spark):
    df = spark.range(100).select(F.lit("x" * 1024).alias("t")).repartition(1)
    assert layout.repartition_by_size(df, 1).rdd.getNumPartitions() == 1
    assert layout.repartition_by_size(df, 1, total_bytes=5 * 1024 * 1024).rdd.getNumPartitions() == 5
    assert layout.repartition_fixed(df).rdd.getNumPartitions() == 30
    assert layout.rebalance(df).count() == 100


def test_samples(spark):
    df = spark.range(20000)
    some = layout.sample_rows(df, "id", 0.1, 3)
    assert 1700 < some.count() < 2300
    assert rows(some) == rows(layout.sample_rows(df.repartition(5), "id", 0.1, 3))
    assert layout.sample_rows(df, "id", 0).count() == 0 and layout.sample_rows(df, "id", 1).count() == 20000
    parts = df.repartition(4)
    assert sum(layout.sample_partition(parts, i).count() for i in range(4)) == 20000


# ---- vectors and TF-IDF


def test_vector_search(spark):
    emb = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])], "id int, embedding array<float>")
    hits = vector.vector_search(emb, [5.0, 0.0], "id", k=10).collect()
    assert [(r.id, r.score) for r in hits] == [(1, 2.0), (3, 2.0), (2, 1.0), (4, 0.0)]
    page = spark.createDataFrame([(4, 9.0), (3, 8.0), (99, 7.0)], "id int, score double")
    ranked = [r.id for r in vector.rerank(page, emb, [1.0, 0.0], "id").collect()]
    assert ranked[:2] == [3, 4] and sorted(ranked) == sorted(r.id for r in page.collect())
    with pytest.raises(Exception, match="expected vectors of length 3"):
        vector.vector_search(emb, [1.0, 0.0, 0.0], "id").collect()
    assert rows(vector.dimension_report(emb), "dim", "n") == [(2, 4)]


def test_tfidf(spark, tmp_path):
    docs = spark.createDataFrame([(1, "both Alpha alpha"), (2, "both beta x"), (3, ""), (4, None)], "id int, t string")
    model = tfidf.fit_tfidf(docs, "t")
    idf = {r.term: r.idf for r in model.collect()}
    assert idf == {
        "both": pytest.approx(math.log(5 / 3) + 1), "alpha": pytest.approx(math.log(5 / 2) + 1),
        "beta": pytest.approx(math.log(5 / 2) + 1),
    }
    weights = tfidf.transform_tfidf(docs, "id", "t", model)
    lengths = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("l")).collect()
    assert {r.id: pytest.approx(r.l) for r in lengths} == {1: 1.0, 2: 1.0}
    assert rows(tfidf.tfidf_stats(weights, "id")) == [(3, 4, 32)]
    tfidf.save_tfidf(model, str(tmp_path / "model"))
    loaded = tfidf.load_tfidf(spark, str(tmp_path / "model"))
    vec = tfidf.tfidf_query_vector(loaded, "Alpha unknown alpha beta")
    got = {r.term: r.weight for r in vec.collect()}
    assert got == {"alpha": pytest.approx(2 / math.sqrt(5)), "beta": pytest.approx(1 / math.sqrt(5))}
    assert tfidf.tfidf_query_vector(model, "unknown").count() == 0
    assert tfidf.tfidf_query_vector(model, "").count() == 0
    assert [r.id for r in tfidf.tfidf_search(weights, vec, "id").collect()] == [1, 2]
    none = tfidf.tfidf_search(weights, tfidf.tfidf_query_vector(model, "unknown"), "id", 1).collect()
    assert [(r.id, r.score) for r in none] == [(1, 0.0)]


# ---- sources and jobs

CSV = '''cord_uid,title,authors,abstract,publish_time,url,journal,pdf_json_files,who_covidence_id
a1,"A ""quoted"", title","X; Y","line one
line two",2020-01-01,http://a,J,pdf_json/a b.json; pdf_json/b.json,1.5
a2,NA,X,abs,2020,http://b,J,,
a3,Plain,Z,null,2020-02,http://c,NaN,pdf_json/gone.json; pdf_json/b.json,
'''


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    (root / "metadata.csv").write_text(CSV)
    (root / "pdf_json").mkdir()
    (root / "pdf_json" / "a b.json").write_text(json.dumps(
        {"paper_id": "a", "body_text": [{"text": "skip", "section": "Abstract"}, {"text": "of a", "section": "Intro", "cite_spans": []}]}, indent=2))
    (root / "pdf_json" / "b.json").write_text(json.dumps({"body_text": [{"text": "of b", "section": ""}, {"text": "more", "section": "x"}]}))
    (root / "feeds").mkdir()
    (root / "feeds" / "wired_rss.xml").write_text(
        "<?xml version='1.0'?><rss version='2.0'><channel><title>Wired</title><link>http://w</link>"
        "<item><title>First / story</title><link>http://w/1</link></item><item><title>Second</title><link>http://w/2</link></item>"
        "</channel></rss>")
    (root / "feeds" / "nyt_health.xml").write_text("<rss><channel><title>Health</title></channel></rss>")
    return root


def test_csv(spark, landed, tmp_path):
    path = str(landed / "metadata.csv")
    papers = tables.read_metadata_csv(spark, path)
    assert papers.columns == tables.METADATA_COLUMNS and {t for _, t in papers.dtypes} == {"string"}
    got = {r.cord_uid: r for r in papers.collect()}
    assert got["a1"].title == 'A "quoted", title' and got["a1"].abstract == "line one\nline two"
    assert got["a2"].title is None and got["a3"].abstract is None and got["a3"].journal is None
    assert {t for _, t in tables.read_csv_as_strings(spark, path).dtypes} == {"string"}
    assert dict(tables.read_csv_inferred(spark, path).dtypes)["who_covidence_id"] == "double"
    tables.write_csv(papers, str(tmp_path / "csv"))
    assert rows(tables.read_csv_as_strings(spark, str(tmp_path / "csv"))) == rows(papers)


def test_fulltext_paths(spark, landed):
    texts = files.read_fulltext_json(spark, str(landed))
    assert rows(texts, "path") == [("pdf_json/a b.json",), ("pdf_json/b.json",)]


def test_ingest_papers(spark, landed, tmp_path):
    papers = ingest.ingest_papers(spark, str(landed / "metadata.csv"), str(landed), str(tmp_path / "papers"))
    assert rows(papers, "cord_uid", "abstract", "body") == [
        ("a1", "line one\nline two", "of a"), ("a3", "", "of b\nmore"),
    ]
    assert rows(tables.read_papers(spark, str(tmp_path / "papers" / "*.parquet")), "cord_uid") == [("a1",), ("a3",)]
    index = ingest.build_search_index(papers, str(tmp_path / "index"))
    from litsearch.operators.search import search

    assert [r.cord_uid for r in search(index, "plian").collect()] == ["a3"]
    updates = papers.filter("cord_uid = 'a3'").withColumn("title", F.lit("Changed"))
    merged = ingest.update_papers(spark, str(tmp_path / "papers"), updates, str(tmp_path / "papers2"), "cord_uid", ["publish_time"])
    assert rows(merged, "cord_uid", "title") == [("a1", 'A "quoted", title'), ("a3", "Changed")]
    report = ingest.deduplicate_papers(spark, str(tmp_path / "papers2"), str(tmp_path / "papers3"), ["journal"], "cord_uid")
    assert rows(report) == [(2, 2)]
    assert spark.read.parquet(str(tmp_path / "papers3")).count() == 2


def test_news(spark, landed, tmp_path):
    pages = spark.createDataFrame([
        ("http://w/1", "<div class='article__chunks x'><p>one</p><p>two</p></div>"), ("http://w/2", "<p>no container</p>"),
    ], "url string, html string")
    out = ingest.ingest_news(spark, str(landed / "feeds"), pages, F.to_date(F.lit("2020-11-24")), str(tmp_path / "news"))
    assert rows(out, "feed_date", "feed_title", "title", "filename", "url", "body") == [
        ("rss_feeds_11-24-2020", "Wired", "First / story", "First___story.txt", "http://w/1", "one\ntwo\n"),
    ]
    feeds = spark.read.json(str(tmp_path / "news" / "feeds"))
    assert rows(feeds.select("feed", F.size("entries").alias("n"))) == [("nyt_health", 0), ("wired_rss", 2)]


def test_articles(spark, tmp_path):
    for name in ("a b.txt", "c+d.txt"):
        os.makedirs(tmp_path / "in" / "Wired", exist_ok=True)
        (tmp_path / "in" / "Wired" / name).write_text("line\nline of " + name)
    got = files.read_articles(spark, str(tmp_path / "in")).collect()
    assert sorted((os.path.basename(r.path), r.body) for r in got) == [
        ("a b.txt", "line\nline of a b.txt"), ("c+d.txt", "line\nline of c+d.txt"),
    ]


def test_articles_of_one_day_are_all_kept(spark, tmp_path):
    path = str(tmp_path / "articles")
    schema = "feed_date string, feed_title string, filename string, body string"
    for batch in ([("d", "f", "a.txt", "1"), ("d", "f", "b.txt", "2")], [("d", "f", "b.txt", "3"), ("d", "f", "c.txt", "4")]):
        files.write_articles(spark.createDataFrame(batch, schema), path)
    assert rows(files.load_articles(spark, path), "filename", "body") == [("a.txt", "1"), ("b.txt", "3"), ("c.txt", "4")]


def test_datasets(spark, tmp_path):
    for _ in range(2):
        tables.create_dataset(spark, "litsearch_test", "id int, v string", str(tmp_path / "t"))
    spark.createDataFrame([(1, "a")], "id int, v string").write.insertInto("litsearch_test")
    tables.create_dataset(spark, "litsearch_test", "id int, v string", str(tmp_path / "t"))
    assert rows(tables.scan_all(spark, "litsearch_test")) == [(1, "a")]
    for _ in range(2):
        tables.drop_dataset(spark, "litsearch_test")
    assert not spark.catalog.tableExists("litsearch_test")


def test_embeddings(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,0.5,1\nb,2,3\n")
    emb = tables.read_embeddings(spark, "bert", str(tmp_path / "e.csv"), dim=2)
    assert rows(emb) == [("a", [0.5, 1.0]), ("b", [2.0, 3.0])]
    with pytest.raises(ValueError):
        tables.read_embeddings(spark, "word2vec", "x")
    with pytest.raises(Exception, match="expected 768 dimensions, found 2"):
        tables.read_embeddings(spark, "cord19", str(tmp_path / "e.csv")).collect()
    emb.write.parquet(str(tmp_path / "p"))
    assert tables.read_embeddings(spark, "bert", str(tmp_path / "p"), fmt="parquet", dim=2).count() == 2


def test_stream(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "sink", "checkpoint"))
    schema = "id int, at int, v string"

    def land(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        new = spark.readStream.schema(schema).parquet(source)
        stream.ingest_stream(new, sink, checkpoint, ["id"], ["at"]).awaitTermination()

    land([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    run()
    assert rows(stream.read_current(spark, sink, ["id"], ["at"]), "id", "v") == [(1, "b"), (2, "c")]
    land([(2, 0, "later batch"), (3, 1, "d")])
    run()
    run()  # nothing new
    current = [(1, "b"), (2, "later batch"), (3, "d")]
    assert rows(stream.read_current(spark, sink, ["id"], ["at"]), "id", "v") == current
    stream.compact(spark, sink, str(tmp_path / "compact"), ["id"], ["at"])
    assert rows(stream.read_current(spark, str(tmp_path / "compact"), ["id"], ["at"]), "id", "v") == current


def test_frequent_terms_are_broadcast_and_the_weights_stay(spark):
    docs = spark.createDataFrame([(1, "red stone red"), (2, "red river"), (3, "stone red of"), (4, None)], "id int, t string")
    model = layout.materialize(tfidf.fit_tfidf(docs, "t"))
    plain = {(r.id, r.term): pytest.approx(r.weight) for r in tfidf.transform_tfidf(docs, "id", "t", model).collect()}
    for most, kept in ((0, set()), (2, {"red", "stone"}), (3, {"red", "stone"}), (9, {"red", "stone", "river", "of"})):
        frequent = tfidf.frequent_terms(model, most)
        assert {r.term for r in model.filter(frequent).collect()} == kept
        got = tfidf.transform_tfidf(docs, "id", "t", model, frequent=frequent)
        assert {(r.id, r.term): r.weight for r in got.collect()} == plain
