"""Lines are moved to their paper once: what is made of them meets there."""

import re

import pytest
from compare import DATA, rows

from vellum.plans import catalog, paper_queries, paper_tables, reader_queries
from vellum.sources import latex


@pytest.fixture
def shuffled(spark):
    """Plans without broadcasts, as those of large tables are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda df: re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _inputs(spark, *names):
    return [paper_tables.derived(spark, DATA, n) for n in names]


@pytest.mark.parametrize("name", sorted(paper_tables.ONE_PASS))
def test_one_pass_gives_the_rows_of_the_union(spark, name):
    assert rows(paper_tables.derived(spark, DATA, name).toPandas()) == rows(paper_tables.select(spark, DATA, paper_tables.INPUTS[name]).toPandas())


def test_reports_shuffle_lines_only_once(spark, shuffled):
    """measures and findings were shuffled by report and measure, and again by report."""
    moved = shuffled(reader_queries._reports(*_inputs(spark, *reader_queries._READ)))
    assert {m.rsplit(",", 1)[0] for m in moved} <= {"l_orderkey", "doc_id"}
    assert len([m for m in moved if m.startswith("doc_id")]) == 1  # the heads, which come from orders


def test_reports_are_written_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reader_queries, "folder", lambda spark, name: str(tmp_path / name))
    assert reader_queries.WRITTEN["reports_read"].query(spark, DATA).count() > 0
    assert all(p.name.endswith(".gz") for p in (tmp_path / "jobs").glob("part-*"))


def test_large_tables_get_more_tasks(spark, monkeypatch):
    """the lines of a task grew with the table."""
    monkeypatch.setattr(paper_tables, "LINES_A_TASK", 500)
    assert paper_tables.derived(spark, DATA, "points").rdd.getNumPartitions() == 12


def test_object_references_shuffle_lines_only(spark, shuffled):
    """every join of pointers with objects, homes and the road shuffled both sides again."""
    moved = shuffled(paper_queries.PAPERS["object_references"].build(*_inputs(spark, "sections", "objects", "pointers")))
    assert {m.rsplit(",", 1)[0] for m in moved} == {"l_orderkey"}


def test_listed_targets_shuffle_lines_only(spark, shuffled):
    """texts and objects were shuffled by kind and number for each of two joins."""
    moved = shuffled(paper_queries.PAPERS["listed_targets"].build(*_inputs(spark, "texts", "numbered")))
    assert {m.rsplit(",", 1)[0] for m in moved} == {"l_orderkey"}


def test_listed_targets_of_repeated_numbers(spark):
    texts = spark.createDataFrame([(1, 1, "See Sections 2.1 and 9, Table 4, App. B and Algorithm 3.2."), (2, 1, "Appendix A.1, Fig. 1"), (3, 1, None)], "doc_id long, src int, raw string")
    kinds = spark.createDataFrame([(1, "section", "2", "s2"), (1, "table", "4", "t4"), (1, "table", "4", "t5"), (1, "algorithm", "3", "a3"), (1, None, "9", "x"), (3, "figure", "1", "f1")], "doc_id long, kind string, number string, id string")
    got = sorted((r.doc_id, r.kind, r.number, r.target) for r in latex.listed_targets(texts, kinds).collect())
    assert got == [(1, "algorithm", "3", "a3"), (1, "appendix", "B", "appendix:B"), (1, "section", "2.1", "s2"), (1, "table", "4", "t4"), (1, "table", "4", "t5"), (2, "appendix", "A.1", "appendix:A.1")]


def test_drawn_sentences_cut_texts_once(spark):
    """sentences were cut and tokenized again to count them by document."""
    plan = catalog.queries()["drawn_sentences"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "Join" not in plan


def test_document_terms_store_no_sentences(spark):
    """sentences were tokenized and written, of which only the texts were read, and once."""
    plan = catalog.queries()["document_terms"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "documents.parquet" in plan


@pytest.mark.parametrize(("name", "inputs"), [("citing_sentences", ("sents", "roles", "names")), ("citation_isolation", ("docs", "sents", "roles", "names"))])
def test_citing_sentences_shuffle_lines_only(spark, shuffled, name, inputs):
    """sentences were shuffled by section, by name's word and by place, and cut twice for the names."""
    moved = shuffled(paper_queries.PAPERS[name].build(*_inputs(spark, *inputs)))
    assert {m.rsplit(",", 1)[0] for m in moved} <= {"l_orderkey", "o_orderkey", "doc_id"}
    assert len([m for m in moved if not m.startswith("l_orderkey")]) == (name == "citation_isolation")  # docs, which come from orders
