"""Places of matches against Python's, and the order of references in LaTeX."""

import re

from pyspark.sql import functions as F

from vellum.functions import matches
from vellum.operators import measures, terms
from vellum.sources import latex

TEXTS = ["", "no match", "a1b22c333", "1", "11", "é1ß22𝄞3", "1 1 1 1 1 " * 40, None, "x" * 5000 + "7", "7" + "x" * 5000, "".join(f"a{i}" for i in range(3000))]


def test_running_sums(spark):
    rows = [(i, list(range(-3, n - 3)) if n is not None else None) for i, n in enumerate([0, 1, 2, 3, 7, 8, 9, 1000, None])]
    got = spark.createDataFrame(rows, "i int, a array<int>").select("i", matches.running_sums(F.col("a")).alias("s")).collect()
    for r in got:
        a = dict(rows)[r.i]
        assert r.s == (None if a is None else [sum(a[: j + 1]) for j in range(len(a))])


def test_match_spans(spark):
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame(rows, "i int, t string")
    for pattern in (r"\d+", r"\d", r"(?<=b)\d+", r"[a-z]\d"):
        for r in frame.select("i", matches.match_spans(F.col("t"), pattern).alias("s")).collect():
            t = TEXTS[r.i]
            assert ([tuple(s) for s in r.s] if r.s is not None else None) == (None if t is None else [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)])


def test_token_spans(spark):
    text = "It's [cite] café state-of-the-art — 3.5"
    (got,) = spark.createDataFrame([(text,)], "t string").select(matches.token_spans(F.col("t"))).first()
    assert [(s.token, text[s.at : s.end].lower()) for s in got] == [(t, t) for t in ["it's", "[cite]", "caf", "state-of-the-art", "3", "5"]]


PAPER = r"""\begin{document}
\section{Opening}\label{sec:o}
First \ref{sec:m}, \ref{fig:a}, then \ref{sec:m} again and \ref{sec:r}. Figure 10 is not Figure 1; see \cref{sec:r,fig:a} and \hyperref[sec:m]{it}. \ref{sec:none}
\section{Middle part}\label{sec:m}
The opening section is not named here, but the Ending part section is; the ending part section comes twice. Section 1 and Section 10.
\section{Ending part}\label{sec:r}
\begin{figure}\caption{x}\label{fig:a}\end{figure}
\end{document}
"""


def test_pointers_in_true_order(spark):
    papers = spark.createDataFrame([(1, PAPER)], "doc_id long, tex string")
    found = latex.sections(papers).cache()
    things = latex.objects(found)
    points = latex.pointers(papers, found, things).cache()
    got = {s: [(r.target, r.via) for r in points.filter(F.col("src") == s).orderBy("pos").collect()] for s in (1, 2)}
    assert got[1] == [("sec:2", "ref"), ("fig:a", "ref"), ("sec:2", "ref"), ("sec:3", "ref"), ("fig:a", "number"), ("fig:a", "ref"), ("sec:3", "ref"), ("sec:2", "ref")]
    assert got[2] == [("sec:1", "name"), ("sec:3", "name"), ("sec:3", "name"), ("sec:1", "number")]
    raw = {r.sec: r.raw for r in found.collect()}
    for r in points.collect():
        assert raw[r.src][r["at"] :].startswith({"ref": "\\", "number": ("Section 1", "Figure 1"), "name": ("The ", "the ")}[r.via])
    # The roadmap is the longest run in this order: the second mention of the middle part, and the ending.
    road = measures.roadmap(found.filter("kind = 'body'"), things, points)
    assert sorted(r.pos for r in road.collect()) == [2, 3]


def test_spans_of_texts_with_marks(spark):
    """A text that holds the mark itself, one without matches and one with more than FEW of them."""
    rows = [(0, "a1\0b22"), (1, "none"), (2, None), (3, "x1 " * 40), (4, "")]
    got = spark.createDataFrame(rows, "id long, text string").select("id", matches.match_spans(F.col("text"), r"\d+").alias("s")).collect()
    for r in got:
        text = dict(rows)[r.id]
        assert (None if r.s is None else [(s.at, s.end, s.match) for s in r.s]) == (None if text is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", text)])


def test_references_are_sought_once(spark):
    texts = spark.createDataFrame([(1, 1, "XSection 1, Section 1.2 and Secs. ~3; §4, Figs. 2 BigFigure 2, Tables 1, Appendices B, Appendix AB.")], "doc_id long, src long, raw string")
    kinds = spark.createDataFrame([(1, k, str(n), f"{k}{n}") for k in ("section", "figure", "table") for n in range(1, 5)], "doc_id long, kind string, number string, id string")
    found = latex.printed_references(texts, kinds)
    assert [r.target for r in found.orderBy("at").collect()] == ["section1", "section3", "section4", "figure2", "table1", "appendix:B"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_object_numbers_read_sections_once_for_places(spark):
    found = spark.createDataFrame([(1, 1, "A", False, "body", r"\begin{figure}\label{f2}\end{figure} \begin{figure}\label{f1}\end{figure}")], "doc_id long, sec int, title string, starred boolean, kind string, raw string")
    numbered = latex.object_numbers(found, latex.placed_objects(found))
    assert {(r.kind, r.number, r.id) for r in numbered.collect()} == {("section", "1", "sec:1"), ("figure", "1", "f2"), ("figure", "2", "f1")}
    assert "Join" not in numbered._jdf.queryExecution().optimizedPlan().toString()


def test_titles_are_tested_where_they_stand(spark):
    texts = spark.createDataFrame([(1, 1, "See the METHÖD one Section and “Results x” section."), (1, 2, "The methöd one is none."), (1, 3, "In Results X Section 2.")], "doc_id long, src long, raw string")
    heads = spark.createDataFrame([(1, 3, "Results x"), (1, 4, "MethÖd one")], "doc_id long, sec int, title string")
    found = latex.title_mentions(texts, heads)
    assert {(r.src, r.target) for r in found.collect()} == {(1, "sec:3"), (1, "sec:4")}


def test_definitions_read_sentences_once(spark):
    sents = spark.createDataFrame([(1, 0, 0, "SRE is high."), (1, 0, 1, "The Self-Recall Error (SRE) denotes it."), (1, 1, 0, "A data-driven way."), (1, 2, 0, None)], "doc_id long, sec int, sent int, text string")
    found = terms.term_definitions(sents)
    assert {(r.term, r.n, r.def_sent, r.how, r.verdict) for r in found.collect()} == {("SRE", 2, 1, "expansion", "late")}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
