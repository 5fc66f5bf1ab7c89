"""Every query with SQL gives DuckDB's rows."""

import pytest
from compare import DATA, connection, rows

from vellum.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, expected = catalog.queries()[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rows_do_not_depend_on_partitions(spark):
    from vellum.operators import prose

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one = prose.macro_redundancy(docs, prose.judged_sentences(prose.sentences(prose.sections(docs))))
    shuffled = docs.repartition(7, "text")
    other = prose.macro_redundancy(shuffled, prose.judged_sentences(prose.sentences(prose.sections(shuffled))))
    assert rows(one.toPandas()) == rows(other.toPandas())
    assert one.filter("score < 0 or score > 1 or num > den").count() == 0
