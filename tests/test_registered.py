"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries
from litsearch.plans.oracles import ORACLES
from litsearch.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_each_sql_has_its_query():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "corpus_pipeline", "litsearch.llm"])
def test_core_queries_stand_without_the_training_data_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(QUERIES)), str(len(ORACLES))]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert difference(queries()[name](spark, SF_DIR), con, oracle_sql()[name]) is None


def test_entry(spark):
    found = entry(spark)
    assert found.columns == [
        "doc_id", "title", "authors", "abstract", "body", "url", "publish_time", "score",
    ]
    assert found.count() == 20
