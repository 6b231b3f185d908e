"""The forward index: its rows, and that reading them moves neither texts nor documents."""

import pytest
from conftest import rows

from litsearch.operators import forward, tfidf


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "red stone red river", "a title"), (2, None, "title of two"), (3, "", None), (4, "river of it, the river", "x"),
             (5, "red stone red river", "other title")]
    return spark.createDataFrame(texts, "id long, body string, title string").repartition(3)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return forward.write_forward(docs, "id", ["body", "title"], str(tmp_path_factory.mktemp("forward") / "index"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_document_has_a_row_per_field(index):
    assert rows(index.documents, "id", "field") == sorted(((i, f) for i in range(1, 6) for f in ("body", "title")), key=repr)
    assert rows(index.counts) == [("body", 5), ("title", 5)]
    frequency = [(r.field, r.df) for r in index.dictionary.orderBy("term_id").collect()]
    assert frequency == sorted(frequency, key=lambda x: (x[0], -x[1]))  # frequent terms have small numbers
    by_key = {(r.id, r.field): len(r.terms) for r in index.documents.collect()}
    assert by_key[2, "body"] == by_key[3, "body"] == by_key[3, "title"] == by_key[4, "title"] == 0


def test_weights_equal_those_fitted_from_the_texts(docs, index):
    for col in ("body", "title"):
        model = tfidf.fit_tfidf(docs, col)
        expected = {(r.id, r.term): r.weight for r in tfidf.transform_tfidf(docs, "id", col, model).collect()}
        got = {(r.id, r.term): r.weight for r in forward.forward_weights(index).filter(f"field = '{col}'").collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
        assert rows(forward.forward_model(index).filter(f"field = '{col}'"), "term", "df", "n_docs") == rows(model, "term", "df", "n_docs")


def test_search_scores_each_row_by_itself(index):
    best = forward.forward_search(index, "red stone unheardof", "body", 2)
    assert [r.id for r in best.collect()] == [1, 5]
    assert "Exchange hashpartitioning" not in plan(best) and "Exchange hashpartitioning" not in plan(forward.forward_vectors(index))
    nothing = forward.forward_search(index, "unheardof", "body", 5).collect()
    assert [(r.id, r.score) for r in nothing] == [(1, 0.0), (4, 0.0), (5, 0.0)]


def test_texts_are_not_shuffled(docs, spark, tmp_path, monkeypatch):
    plans, kept = [], forward.materialize
    monkeypatch.setattr(forward, "materialize", lambda df: plans.append(plan(df)) or kept(df))
    forward.write_forward(docs, "id", ["body"], str(tmp_path / "i"))
    above, split = plans[0].split("Generate", 1)
    assert "Exchange hashpartitioning" in above and "body" not in above  # words are shuffled, above the splitting
    assert "Exchange hashpartitioning" not in split


def test_an_empty_table(docs, tmp_path):
    empty = forward.write_forward(docs.limit(0), "id", ["body"], str(tmp_path / "i"))
    assert empty.documents.count() == forward.forward_weights(empty).count() == forward.forward_stats(empty).count() == 0
    assert forward.forward_search(empty, "red", "body").count() == 0


def test_weights_and_counts_need_no_lookup(index):
    for df in (forward.forward_weights(index), forward.forward_term_counts(index)):
        assert "Join" not in plan(df).replace("BroadcastHashJoin [field", "") and "Exchange hashpartitioning" not in plan(df)


@pytest.mark.parametrize("most", [0, 2, 6])
def test_rare_terms_get_their_numbers_by_a_join(docs, tmp_path, monkeypatch, most):
    whole = forward.write_forward(docs, "id", ["body", "title"], str(tmp_path / "whole"))
    monkeypatch.setattr(forward, "FREQUENT_TERMS", most)
    index = forward.write_forward(docs, "id", ["body", "title"], str(tmp_path / "i"))
    assert rows(index.documents) == rows(whole.documents)
