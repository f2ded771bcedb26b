"""The corpus pipeline's stages on the test table and on corner cases, and the query with an SQL equivalent."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
sys.path.insert(0, str(Path(__file__).parents[1]))

import corpus_pipeline  # noqa: E402
from oracle_check import compare, connect  # noqa: E402

from fleetscore.llm import oracles, queries  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        path = corpus_pipeline.settle(out, name)
        assert path.select("doc_id").distinct().count() == path.count()
        assert path.count() >= 0.8 * seen.count(), name
        seen = path
    final = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert {"doc_id", "position", "taken"} <= set(final.columns)
    assert final.count() > 0


def test_stages_take_odd_tables(spark):
    rows = [(1, "some words are here today", "en", "a", 1, "p"), (1, "some words are here today", "en", "a", 1, "p"),
            (None, None, None, None, None, None), (2, "", "en", None, 0, "p"), (3, "x " * 20_000, "en", "b", 3, None)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, position string"
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= 0, name


def test_one_row_of_each_group_stays(spark):
    """Ids that several texts share, groups without any id, near copies under one id."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: words(k) + " more"
    rows = [(5, words(1)), (5, words(2)), (9, near(1)), (3, words(2)), (None, words(3)), (None, near(3)), (7, words(4)), (7, near(4)),
            (None, words(5)), (8, near(5)), (4, ""), (6, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()]
    assert {(5, words(1)), (3, words(2)), (8, near(5)), (4, ""), (6, None)} <= set(got)
    assert len(got) == 7 and sum(i is None for i, _ in got) == 1 and sum(i == 7 for i, _ in got) == 1


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    difference, notes = compare(queries.queries()[name](spark, SF), connect(SF), oracles.oracle_sql()[name])
    assert difference is None and not notes, (difference, notes, duckdb.__version__)
