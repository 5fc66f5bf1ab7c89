"""Printed reference lists and captions on literal rows, against results worked out by hand."""

from pyspark.sql import functions as F

from vellum.sources import references

LINES = "doc_id int, line int, x0 double, text string"


def test_numbered_list(spark):
    lines = spark.createDataFrame(
        [(1, 3, 0.0, "in text [2] A. Roe. Plain: words. 2020."), (1, 1, 0.0, "References"), (1, 2, 0.0, "[01] J. Doe. GPTScore: evaluate"), (1, 4, 0.0, "[3] B. Poe? Two Word-Name"), (1, 5, 0.0, "here: on"), (1, 6, 0.0, None), (2, 1, 0.0, "nothing"), (3, 1, 0.0, "[7] ÉcoleNet: x"), (4, 1, 0.0, "[8] " + "x" * 260 + ". LateNet: y")],
        LINES,
    )
    keys = {(r.doc_id, r.cite_key) for r in references.numbered_entries(lines).collect()}
    assert keys == {(1, "ref1"), (1, "ref2"), (1, "ref3"), (3, "ref7"), (4, "ref8")}
    names = {(r.doc_id, r.cite_key, r.name) for r in references.short_names(references.numbered_entries(lines)).collect()}
    assert names == {(1, "ref1", "GPTScore"), (1, "ref3", "Two Word-Name\nhere")}


def test_hanging_list(spark):
    lines = spark.createDataFrame(
        [(1, 1, 72.0, "Jane Doe, R. Roe."), (1, 2, 84.0, "BERTx: a study, 2019a."), (1, 3, 74.9, "Poe, E. NoYear: none."), (1, 4, 75.0, "still the same"), (1, 5, 72.0, "Müller 2001 MixedCase: x"), (1, 6, 72.0, "2003, without an author: x"), (2, 1, 10.0, None), (3, 1, 5.0, ". 1999 Ax: y")],
        LINES,
    )
    got = {(r.doc_id, r.cite_key): r.entry for r in references.hanging_entries(lines).collect()}
    assert got == {(1, "doe2019a"): "Jane Doe, R. Roe. BERTx: a study, 2019a.", (1, "müller2001"): "Müller 2001 MixedCase: x", (1, "20032003"): "2003, without an author: x"}
    # At an entry's start up to three words count, whatever they are.
    assert {(r.cite_key, r.name) for r in references.short_names(references.hanging_entries(lines)).collect()} == {("doe2019a", "BERTx"), ("müller2001", "Müller 2001 MixedCase")}


def test_each_list_in_its_style(spark):
    lines = spark.createDataFrame([(d, 1, 1.0, "[1] Doe, 2001. MyNet: x") for d in (1, 2, 3)], LINES)
    styles = spark.createDataFrame([(1, "numeric"), (2, "author-year")], "doc_id int, style string")
    assert {(r.doc_id, r.cite_key) for r in references.printed_names(lines, styles).collect()} == {(1, "ref1"), (2, "doe2001"), (3, "doe2001")}
    assert references.printed_names(lines.limit(0), styles).count() == 0


def test_captions(spark):
    texts = ["Figure 3: x", "fig. A2. y", "TABLE 12 | z", "Tab. 4 : w", "Algorithm 1.", "Alg. 7: v", "Figure 3 shows", "In Table 3: no", "Table 1234: x", "Fig 3: x", "", None]
    got = [r.c and tuple(r.c) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(references.caption(F.col("t")).alias("c")).collect()]
    assert got == [("figure", "3"), ("figure", "A2"), ("table", "12"), ("table", "4"), ("algorithm", "1"), ("algorithm", "7")] + [None] * 6
