import math
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from litsearch.operators import joins, search
from litsearch.operators.layout import materialize
from litsearch.plans.views import papers

SCHEMA = "doc_id bigint, title string, abstract string, body string, authors string, url string, publish_time string"
DOCS = [
    (1, "drug trial", "a study of nothing", "words", "x", "u", "2020"),
    (2, "something else", "drug trial", "more words", "x", None, "2020"),
    (3, "drug", "trial", "neither word together", "x", "u", "2020"),
    (4, None, None, "the drug and the trial the drug", "x", "u", "2020"),
    (5, "", "", "", "x", "u", "2020"),
    (6, "durg trail", "x", "y", "x", "u", "2020"),
    (7, "größe über", "x", "y", "x", "u", "2020"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def ids(hits):
    return [r.doc_id for r in hits.collect()]


def test_all_words_in_one_field(docs):
    # 3 has the words in different fields
    assert set(ids(search.search(docs, "drug trial", "doc_id", fuzziness=0))) == {1, 2, 4}


def test_title_counts_double(docs):
    assert ids(search.search(docs, "drug trial", "doc_id", fuzziness=0))[0] == 1


def test_swapped_letters(docs):
    assert 6 in ids(search.search(docs, "drug trial", "doc_id"))
    assert 1 in ids(search.search(docs, "durg trila", "doc_id"))


def test_no_hits_and_empty_query(docs):
    assert ids(search.search(docs, "unheardof", "doc_id")) == []
    empty = search.search(docs, " ,", "doc_id")
    assert empty.columns == ["doc_id", "score"] and ids(empty) == []


def test_other_letters(docs):
    assert ids(search.search(docs, "grösse", "doc_id")) == [7]  # two edits


def test_or_finds_what_and_finds(docs):
    both = set(ids(search.search(docs, "drug trial", "doc_id", operator="AND")))
    either = set(ids(search.search(docs, "drug trial", "doc_id", operator="OR")))
    assert both < either
    with pytest.raises(ValueError):
        search.search(docs, "drug", "doc_id", operator="XOR")


def test_score_by_hand(docs):
    hit = search.search(docs, "words", "doc_id", {"body": 1}, 0).collect()
    lengths = {1: 1, 2: 2, 3: 3, 4: 7, 6: 1, 7: 1}
    average = sum(lengths.values()) / len(lengths)
    idf = math.log(1 + (6 - 2 + 0.5) / (2 + 0.5))
    expected = {d: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[d] / average)) for d in (1, 2)}
    assert {r.doc_id: pytest.approx(r.score) for r in hit} == expected


def test_pages_follow_each_other(docs):
    whole = ids(search.search(docs, "drug trial", "doc_id", operator="OR", size=10))
    parts = [ids(search.search(docs, "drug trial", "doc_id", operator="OR", size=2, offset=o)) for o in (0, 2, 4)]
    assert sum(parts, []) == whole[:6]


def test_index_gives_the_same_hits(spark, docs, tmp_path):
    index = search.write_index(docs, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / "index"))
    again = search.load_index(spark, str(tmp_path / "index"), "doc_id", list(search.DEFAULT_BOOSTS))
    for query in ("drug trial", "durg", "grösse"):
        direct = rows(search.search(docs, query, "doc_id"), "doc_id", "score")
        assert rows(search.search(index, query), "doc_id", "score") == direct
        assert rows(search.search(again, query), "doc_id", "score") == direct


def test_index_carries_document_boosts(spark, docs, tmp_path):
    index = search.write_index(
        docs, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / "index"), {"complete": search.prefer_complete(0.5)})
    for query in ("drug trial", "durg", "drug unheardof"):
        direct = search.search(docs, query, "doc_id", doc_boost=search.prefer_complete(0.5))
        stored = search.search(index, query, doc_boost=F.col("complete"))
        assert rows(stored, "doc_id", "score") == rows(direct, "doc_id", "score")


def test_index_scan_opens_matching_buckets_only(spark, docs, tmp_path):
    index = search.write_index(docs, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / "index"))
    hit = index.terms.filter("field = 'title' and term = 'drug'").first()
    plan = search.index_scores(index, "durg", {"title": 1})._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    scans = [line for line in plan.splitlines() if "FileScan" in line and "weight" in line]
    assert scans
    for scan in scans:
        filters = scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
        assert "field" in filters and re.search(rf"\(bucket#\d+ = {hit.bucket}\)|bucket#\d+ IN", filters)


def test_no_posting_is_joined_to_candidates_before_the_term_filter(spark, docs, tmp_path):
    index = search.write_index(docs, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "drug trial")], "q int, text string")
    plan = search.search_batch(index, queries, "q", "text")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = [i for i, line in enumerate(lines) if "Relation" in line and "weight" in line]
    assert scans
    for i in scans:  # the nearest inner join above a postings scan is by term
        above, level = [], depth[i]
        for j in range(i, -1, -1):
            if depth[j] < level:
                level = depth[j]
                above.append(lines[j])
        nearest = next(line for line in above if "Join Inner" in line)
        assert "term" in nearest


@pytest.mark.parametrize("operator", ["AND", "OR"])
def test_batch_equals_single_searches(spark, docs, tmp_path, operator):
    index = search.write_index(docs, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / "index"))
    texts = {1: "drug trial", 2: "durg", 3: "unheardof drug", 4: "the drug the", 5: ""}
    queries = spark.createDataFrame(list(texts.items()), "q int, text string")
    batch = search.search_batch(index, queries, "q", "text", operator=operator)
    expected = [
        (q, r.doc_id, r.score, i + 1)
        for q, text in texts.items() for i, r in enumerate(search.search(index, text, operator=operator).collect())
    ]
    assert rows(batch, "q", "doc_id", "score", "rank") == sorted(expected, key=repr)


@pytest.mark.parametrize("operator", ["AND", "OR"])
def test_batch_in_shares_equals_the_batch_in_one(spark, docs, tmp_path, monkeypatch, operator):
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 200))
    texts = {1: "drug trial", 2: "durg", 3: "unheardof drug", 4: "the drug the", 5: "", 6: "drug"}
    queries = spark.createDataFrame(list(texts.items()), "q int, text string")
    found = []
    for n, share_rows in enumerate((10**9, 1)):
        monkeypatch.setattr(search, "SHARE_ROWS", share_rows)
        index = search.write_index(more, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / f"index{n}"))
        assert search._shares(index.postings) == (search.MOST_SHARES if n else 1)
        found.append(rows(search.search_batch(index, queries, "q", "text", operator=operator, size=4), "q", "doc_id", "score", "rank"))
        assert rows(index.postings, "doc_id", "field", "term") == rows(
            search.build_postings(more, "doc_id", list(search.DEFAULT_BOOSTS)), "doc_id", "field", "term")
    assert found[0] == found[1] and found[0]


def test_candidates_have_several_of_the_rarest_words(spark, tmp_path):
    texts = ["alpha", "alpha gamma", "alpha gamma omega common", "omega common", "common", "common gamma"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, body string")
    index = search.write_index(docs, "doc_id", ["body"], str(tmp_path / "index"))
    reach = index.terms.select(F.lit(1).alias("q"), F.lit(4).alias("needed"), F.col("term").alias("word"), F.lit(1).alias("times"), "field", "term", "df")
    assert rows(search._candidates(index.postings, reach, "doc_id", "q"), "doc_id") == [(2,)]
    queries = spark.createDataFrame([(1, "gamma alpha"), (2, "omega common nowhere")], "q int, text string")
    assert rows(search.search_batch(index, queries, "q", "text", fuzziness=0), "q", "doc_id") == [(1, 1), (1, 2)]


def test_sift_keeps_every_wanted_row(spark):
    facts = spark.range(1000).select("id", (F.col("id") % 100).cast("string").alias("k"), F.lit("f").alias("field"))
    wanted = spark.createDataFrame([("f", "3"), ("f", "99"), ("f", "3"), ("f", "unknown")], "field string, k string")
    exact = rows(facts.join(wanted, ["k", "field"], "left_semi"), "id")
    assert rows(joins.sift(facts, wanted, ["k", "field"]), "id") == exact
    assert set(exact) <= set(rows(joins.sift(facts, wanted, ["k", "field"], places=4), "id"))


def test_shuffles_of_a_written_table_are_removed(spark, tmp_path):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
        return {f for f in files.split("|") if "shuffle_" in f}

    before, setting = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    kept = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), str(tmp_path / "t"))
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before and kept.count() == 10 and spark.conf.get(setting) == was


def test_prefer_complete_and_response(docs):
    plain = search.search(docs, "drug trial", "doc_id", {"abstract": 1}, 0)
    boosted = search.search(docs, "drug trial", "doc_id", {"abstract": 1}, 0, doc_boost=search.prefer_complete(0.5))
    a, b = plain.collect(), boosted.collect()
    assert [r.doc_id for r in a] == [2] and b[0].score == pytest.approx(1.5 * a[0].score)  # no url
    whole = search.with_columns(search.search(docs, "drug trial", "doc_id", fuzziness=0), docs, "doc_id")
    text = search.to_response(whole, "doc_id").first().response
    assert text.startswith('{"status":200,"papers":[{"title":"drug trial","authors":"x"')
    assert '"title":null' in text and text.index("drug trial") < text.index('"title":null')
    empty = search.with_columns(search.search(docs, "unheardof", "doc_id"), docs, "doc_id")
    assert search.to_response(empty, "doc_id").first().response == '{"status":200,"papers":[]}'


def test_one_scan_of_the_texts(spark):
    found = papers(spark, "/root/testdata/sf0.001")
    plan = search.matching_scores(found, "doc_id", "thing")._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan  # the ranking reads the written rows only
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pages_are_broadcast(spark, docs):
    hits = search.search(docs.repartition(3), "drug", "doc_id")
    plan = search.with_columns(hits, papers(spark, "/root/testdata/sf0.1"), "doc_id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan[plan.index("== Physical Plan =="):]


def test_batch_limits_each_query_before_the_shuffle(spark, docs, tmp_path):
    index = search.write_index(docs, "doc_id", list(search.DEFAULT_BOOSTS), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "drug")], "q int, text string")
    plan = search.search_batch(index, queries, "q", "text")._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, how):
    facts = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, "warm")
                                     .when(F.col("id") < 990, "none").alias("k"))
    lookup = spark.createDataFrame([("hot", 700, 1), ("warm", 200, 2), ("unused", 1, 3)], "k string, n int, v int")
    plain = rows(facts.join(lookup, "k", how), "id", "k", "v")
    for slice_rows, hot_keys in ((10, 10), (10, 1), (1000, 10)):
        spread = joins.spread_join(facts, lookup, ["k"], "n", "id", how, slice_rows, hot_keys)
        assert rows(spread, "id", "k", "v") == plain


def test_spread_join_splits_the_hot_key(spark):
    facts = spark.range(1000).select("id", F.lit("hot").alias("k"))
    lookup = spark.createDataFrame([("hot", 1000, 1)], "k string, n int, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = joins.spread_join(facts, lookup, ["k"], "n", "id", slice_rows=50)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1


def test_stored_postings_are_not_joined_to_the_vocabulary(spark, docs, tmp_path, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("postings were joined")

    with monkeypatch.context() as m:
        m.setattr(search, "spread_join", never)
        index = search.write_index(docs, "doc_id", ["title", "body"], str(tmp_path / "index"))
    stats = {r.field: r for r in search.field_stats(search.build_postings(docs, "doc_id", ["title", "body"]), "doc_id").collect()}
    for r in index.terms.collect():
        n = stats[r.field].n_docs
        assert r.idf == pytest.approx(math.log(1 + (n - r.df + 0.5) / (r.df + 0.5)))
    assert "idf" not in index.postings.columns


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_is_a_join(spark, how):
    facts = spark.range(100).select("id", F.when(F.col("id") < 70, "hot").when(F.col("id") < 90, "rare")
                                    .when(F.col("id") < 95, "none").alias("k"))
    lookup = spark.createDataFrame([("hot", 70, 1), ("rare", 20, 2), ("unused", 1, 3)], "k string, n int, v int")
    plain = rows(facts.join(lookup, "k", how), "id", "k", "n", "v")
    for least in (1, 50, 100):
        assert rows(joins.split_join(facts, lookup, ["k"], F.col("n") >= least, how), "id", "k", "n", "v") == plain
