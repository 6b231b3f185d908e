"""Vector folders: the same hits as a scan, from fewer folders."""

import random
import re

import numpy as np
import pytest

from litsearch.operators.vector import vector_search
from litsearch.operators.vector_index import NO_DIRECTION, NOT_FINITE, folder_bounds, search_vectors, write_vectors

EMB = "id long, embedding array<float>, folder string"


def clustered(n, dim=8, groups=6):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(groups, dim)) * 4
    return [(i, [float(np.float32(c)) for c in middle[i % groups] + 0.3 * rng.normal(size=dim)], "x") for i in range(n)], middle


def hits(df):
    return [(r.id, None if r.score is None else round(r.score, 9)) for r in df.collect()]


def test_same_hits_as_a_scan_from_reachable_folders(spark, tmp_path):
    rows, middle = clustered(300)
    rows += [(900, None, "x"), (901, [0.0] * 8, "x"), (5, rows[5][1], "x")]
    opposite = [-c for c in np.mean(middle, axis=0)]
    emb = spark.createDataFrame(rows, EMB)
    index = write_vectors(emb, "id", str(tmp_path / "v"), folders=6)
    assert sum(index.n) == 301 and index.rows([NO_DIRECTION]).count() == 2 and index.rows().count() == 303
    rng = random.Random(2)
    for query in (middle[0].tolist(), opposite, [rng.gauss(0, 1) for _ in range(8)], [1.0] + [0.0] * 7):
        assert hits(search_vectors(index, query, 10)) == hits(vector_search(emb, query, "id", k=10))
        bounds = folder_bounds(index, query)
        for f in range(len(index.n)):
            best = vector_search(index.rows([f]), query, "id", k=1).first()
            assert best is None or best.score <= bounds[f] + 1e-9
    # the scan opens reachable folders only
    near = search_vectors(index, middle[0].tolist(), 10)
    plan = near._jdf.queryExecution().toString()
    opened = re.search(r"PartitionFilters: \[[^\]]*folder#\d+ IN \(([-\d,]+)\)", plan).group(1).split(",")
    assert len(set(opened) - {str(NOT_FINITE)}) < 6
    # more hits than vectors: those without a direction come too
    assert len(search_vectors(index, middle[0].tolist(), 400).collect()) == 303


def test_vectors_that_are_not_finite_rank_as_in_a_scan(spark, tmp_path):
    rows, middle = clustered(30)
    emb = spark.createDataFrame([*rows, (70, [float("nan")] * 8, "x"), (71, [float("inf")] * 8, "x"), (72, [None] * 8, "x")], EMB)
    index = write_vectors(emb, "id", str(tmp_path / "v"), folders=3)
    got = [r.id for r in search_vectors(index, middle[0].tolist(), 5).collect()]
    assert got == [r.id for r in vector_search(emb, middle[0].tolist(), "id", k=5).collect()] and 70 in got


def test_probes_reach_most_hits(spark, tmp_path):
    rows, _ = clustered(400, groups=8)
    emb = spark.createDataFrame(rows, EMB)
    index = write_vectors(emb, "id", str(tmp_path / "v"), folders=8)
    found = wanted = 0
    for i in range(0, 400, 100):
        exact = {k for k, _ in hits(vector_search(emb, rows[i][1], "id", k=10))}
        found += len(exact & {k for k, _ in hits(search_vectors(index, rows[i][1], 10, probes=2))})
        wanted += len(exact)
    assert found >= 0.9 * wanted


def test_empty_and_uneven_vectors(spark, tmp_path):
    empty = write_vectors(spark.createDataFrame([], EMB), "id", str(tmp_path / "e"))
    assert search_vectors(empty, [1.0, 2.0]).collect() == []
    uneven = spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [1.0], "x")], EMB)
    with pytest.raises(ValueError):
        write_vectors(uneven, "id", str(tmp_path / "u"))
