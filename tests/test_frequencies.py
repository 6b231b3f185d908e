"""Document frequencies kept up to date batch by batch, against a fit over the current documents."""

import pytest
from conftest import rows

from litsearch.operators.tfidf import fit_tfidf
from litsearch.streaming import frequencies as f

SCHEMA = "id long, at int, text string"


def docs(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def fitted(spark, texts):
    return rows(fit_tfidf(spark.createDataFrame([(t,) for t in texts], "text string"), "text"), "term", "df", "n_docs")


@pytest.fixture
def batches(spark):
    return [
        docs(spark, (1, 1, "red blue"), (2, 1, "red red green"), (3, 1, None), (None, 1, "never")),
        # a repeated key, a changed document, a document that loses all its words
        docs(spark, (2, 1, "old words"), (2, 2, "blue"), (3, 2, "red"), (1, 2, "")),
        docs(spark, (4, 3, "green green"), (2, 3, "blue sky"), (2, 3, "blue sky")),
    ]


CURRENT = [["red blue", "red red green", ""], ["", "blue", "red"], ["", "blue sky", "red", "green green"]]


def test_model_equals_a_fit_after_every_batch_and_a_replay(spark, batches, tmp_path):
    path = str(tmp_path / "model")
    for number, (batch, texts) in enumerate(zip(batches, CURRENT)):
        f.update_frequencies(batch, number, path, "id", "text", ["at"])
        got = rows(f.read_model(spark, path), "term", "df", "n_docs")
        assert got == fitted(spark, texts)
    f.update_frequencies(batches[2], 2, path, "id", "text", ["at"])  # the last batch again
    assert rows(f.read_model(spark, path), "term", "df", "n_docs") == got
    f.compact_frequencies(spark, path, str(tmp_path / "compact"), "id")
    assert rows(f.read_model(spark, str(tmp_path / "compact")), "term", "df", "n_docs") == got
    f.update_frequencies(docs(spark, (4, 4, "sky")), 0, str(tmp_path / "compact"), "id", "text", ["at"])
    assert rows(f.read_model(spark, str(tmp_path / "compact")), "term", "df", "n_docs") == fitted(spark, ["", "blue sky", "red", "sky"])


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "model")
    f.update_frequencies(docs(spark), 0, path, "id", "text", ["at"])
    assert rows(f.read_model(spark, path)) == []
    f.update_frequencies(docs(spark, (1, 1, "red")), 1, path, "id", "text", ["at"])
    f.update_frequencies(docs(spark), 2, path, "id", "text", ["at"])
    assert rows(f.read_model(spark, path), "term", "df", "n_docs") == [("red", 1, 1)]


def test_stream_of_several_files(spark, batches, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "model", "checkpoint"))
    for batch, texts in zip(batches, CURRENT):
        batch.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        f.frequency_stream(stream, path, checkpoint, "id", "text", ["at"]).awaitTermination()
        assert rows(f.read_model(spark, path), "term", "df", "n_docs") == fitted(spark, texts)
