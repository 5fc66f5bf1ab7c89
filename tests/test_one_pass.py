"""What is read of LaTeX papers in one pass, without storing their sections, and gaps that are sought before sentences are cut."""

import pytest
from pyspark.sql import functions as F

from vellum.plans import paper_queries
from vellum.sources import latex

DATA = "/root/testdata/sf0.001"
FOUND = "doc_id long, sec int, title string, starred boolean, kind string, raw string"


@pytest.mark.parametrize("name", ["latex_tables", "latex_objects"])
def test_sections_are_not_stored(spark, monkeypatch, name):
    monkeypatch.setattr(paper_queries, "kept", lambda *a: pytest.fail("stored"))
    df = paper_queries.QUERIES[name][0](spark, DATA)
    assert df.count() > 0


def test_objects_of_odd_sections(spark):
    raw = "\\label{s1} \\begin{figure}\\caption{A {b} c}\\label{f1}\\label{f2}\\end{figure} \\begin{table}no label\\end{table} \\begin{align*}x\\label{e}\\end{align*}"
    found = spark.createDataFrame([(1, 0, "Abstract", False, "abstract", "\\begin{figure}\\label{a}\\end{figure}"), (1, 1, "T", False, "body", raw), (1, 2, "U", False, "body", "")], FOUND)
    got = {tuple(r) for r in latex.placed_objects(found).collect()}
    at = lambda name: raw.index("\\label{" + name + "}") + 1
    heads = {(1, "sec:1", "section", 1, "s1", "T", None), (1, "sec:2", "section", 2, "", "U", None)}
    assert got == heads | {(1, "a", "figure", 0, "a", "", 15), (1, "f1", "figure", 1, "f1", "A {b} c", at("f1")), (1, "f2", "figure", 1, "f2", "A {b} c", at("f2")), (1, "e", "equation", 1, "e", "", at("e"))}


def test_numeric_cells(spark):
    cells = {"12": True, " 1,234.5 ": True, "12\\%": True, "\\textbf{3} \\pm 0.1": True, "$4$": True, "a 5": False, "": False, "n/a": False, "\t7\n*": True, "1 2": False, "x": False, "٣": False, "[math] 8": True, None: None}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", latex.numeric(F.col("c"))).collect()
    assert dict(map(tuple, got)) == cells


def test_gaps_are_those_of_sentences(spark):
    gap = "No \\emph{individual}\ncases were shown. Good."
    found = [(1, 1, gap), (2, 1, "We show no. Individual cases were shown."), (3, 1, ""), (4, 1, "All is well."), (4, 2, "It does not\n show any~concrete examples \\cite{a}."), (5, 1, "no individual\n\ncases were shown"), (6, 1, "Known \\cite{no individual cases were shown}.")]
    got = latex.acknowledged_in(spark.createDataFrame([(d, s, "T", False, "body", r) for d, s, r in found], FOUND)).collect()
    assert dict(map(tuple, got)) == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
