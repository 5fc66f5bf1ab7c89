"""The measures and lists of papers on literal rows: Spark's operators against DuckDB's SQL, and the registered queries over the given tables."""

import itertools

import duckdb
import pytest
from compare import rows
from paper_rows import ROWS, values

from vellum.operators import measures
from vellum.plans import catalog, paper_queries


@pytest.mark.parametrize("name", sorted(n for n, over in paper_queries.PAPERS.items() if set(over.inputs) <= ROWS.keys()))
def test_literal_rows(spark, name):
    over = paper_queries.PAPERS[name]
    got = over.build(*(spark.createDataFrame(ROWS[n][1], ROWS[n][0]) for n in over.inputs)).toPandas()
    expected = duckdb.sql("WITH " + ", ".join(values(n, ROWS[n]) for n in over.inputs) + over.sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
    assert len(got)


def test_no_query_reads_literal_rows():
    assert not [n for n in catalog.queries() if "fixture" in n]


def test_index_does_not_depend_on_the_order_of_rows(spark):
    said = [("cross_refs", "structure", 0.1), ("macro_redundancy", "structure", 0.2), ("x", "structure", 0.3), ("argument_graph", "argument", 0.7), ("figure_exposition", "artifacts", 0.1), ("y", "other", 0.45), ("z", "other", None)]
    add = lambda *x: sum(x[1:], x[0]) / len(x)
    exact = add(add(0.1, 0.2, 0.3), 0.7, 0.1, 0.45)
    for rows in itertools.islice(itertools.permutations(said), 0, 5040, 701):
        frame = spark.createDataFrame([(1, k, p, "done" if s else "error", s) for k, p, s in rows], "doc_id long, key string, plane string, status string, score double").coalesce(1)
        got = measures.aggregate(frame).first()
        assert (got["score"], got["index"], got["partial"]) == (exact, round(exact * 100), True)
