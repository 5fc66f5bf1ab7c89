"""Papers in LaTeX are read once: no step of the reader stands twice in a plan, and no text is stored or shuffled on the way."""

import re

import pytest
from compare import DATA
from pyspark.sql import functions as F

from vellum import storage
from vellum.functions import text
from vellum.operators import prose
from vellum.plans import catalog, paper_queries
from vellum.sources import inclusion, latex

FOUND = "doc_id long, sec int, title string, starred boolean, kind string, raw string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan):
    return {m.rsplit(",", 1)[0] for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan))}


@pytest.mark.parametrize("name", ["latex_sentences", "latex_pointers"])
def test_sections_are_read_once_and_not_stored(spark, monkeypatch, name):
    """sections were stored, and pointers shuffled by label, number and place."""
    monkeypatch.setattr(paper_queries, "kept", lambda *a: pytest.fail("stored"))
    plan = _plan(paper_queries.QUERIES[name][0](spark, DATA))
    assert plan.count("begin\\{abstract") <= 1
    assert _exchanges(plan) == {"l_orderkey"}


def test_cross_refs_store_no_texts(spark, monkeypatch):
    """papers, sections, objects and pointers were stored, each by itself."""
    stored = []
    monkeypatch.setattr(paper_queries, "kept", lambda df, name: stored.append(df.columns) or df)
    paper_queries.paper_cross_refs(spark, DATA)
    assert stored == [["doc_id", "sections", "objects", "pointers"]]


def test_pointers_of_labels_that_repeat(spark):
    tex = (
        "\\begin{document}\\section{First things}\\label{a}See \\ref{a, f,x} and Figure 2, Table 9 or \\hyperref[app]{it}.\n"
        "\\section*{Second things}\\label{a}\\begin{figure}\\label{f}\\end{figure}\\begin{figure}\\label{g}\\end{figure} The first things section, Section 1.\\appendix\\label{app}\\label{a}"
    )
    papers = spark.createDataFrame([(1, tex), (2, "\\section{Alone}Appendix B"), (3, None)], "doc_id long, tex string")
    expected = [(1, 1, ("sec:1", "sec:2", "f", "g", "appendix:app")), (1, 2, ("sec:1", "sec:1")), (2, 1, ("appendix:B",))]
    found = latex.sections(papers)
    for got in (latex.pointer_rows(latex.read_papers(papers)), latex.pointers(papers, found, latex.placed_objects(found))):
        by_place = {}
        for r in sorted(got.collect(), key=lambda r: (r.doc_id, r.src, r.pos)):
            by_place.setdefault((r.doc_id, r.src), []).append(r.target)
        assert [(d, s, tuple(sorted(t))) for (d, s), t in sorted(by_place.items())] == [(d, s, tuple(sorted(t))) for d, s, t in expected]


def test_prose_without_words_of_a_gap_is_not_read(spark):
    """all prose was made plain, to be searched for a gap."""
    rows = [(1, "No indi\\emph vidual cases were shown."), (2, "NO Concrete EXAMPLES are shown"), (3, "It rests on aggre\\relax\\relax gate."), (4, "no spe\\%cific cases were shown"), (5, None), (6, "Plain.")]
    found = spark.createDataFrame([(d, 1, "T", False, "body", r) for d, r in rows], FOUND)
    got = latex.acknowledged_in(found)
    assert dict(map(tuple, got.collect())) == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert "contains(lower(raw" in re.sub(r"#\d+", "", _plan(got)).lower()


def test_breaks_of_odd_texts(spark):
    cases = {"One.  Two\n three. \n\n Four e.g. this! \"Five?\" 6.5 is J. Doe\t. End": ["One.", "Two three.", "Four e.g. this!", '"Five?', "6.5 is J. Doe .", "End"], "A\0b. C": ["A\0b.", "C"], "x.) Y.": ["x.", "Y."], "U.S. Law. No. 4": ["U.S. Law.", "No. 4"]}
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.split_sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def test_sentences_of_stand_ins_only(spark):
    raw = "[ref] \\cite{a, b}. It \\cite{c}. \\ref{x} ok. \\ref{y} a. 12."
    found = spark.createDataFrame([(1, 1, "T", False, "body", raw)], FOUND)
    got = [(r.text, r.cites) for r in latex.sentences(found).orderBy("sent").collect()]
    assert got == [("It [cite].", [["c"]]), ("[ref] ok.", []), ("12.", [])]


def test_inclusion_is_followed_within_an_archive(spark, monkeypatch):
    """mentions were joined to files in up to 33 rounds, each stored and shuffled."""
    monkeypatch.setattr(inclusion, "kept", lambda *a: pytest.fail("stored"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = _exchanges(_plan(catalog.queries()["expanded_papers"](spark, DATA)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved <= {"l_orderkey", "archive"}


def test_inclusion_of_odd_names(spark):
    head = "\\documentclass{x}\\begin{document}"
    files = [("a", "p/main.tex", head + "1\\input{../../q}2\\input{}3\\input{sub/../c}4\\include{p/c}5"), ("a", "p/c.tex", "C\\input{main}D"), ("b", "other.tex", head + "x"), ("b", "main.tex", head + "y\\input other"), ("c", "no.tex", "z"), ("c", None, "w")]
    members = spark.createDataFrame([(a, p, bytearray(t.encode())) for a, p, t in files] + [("b", "empty", None)], "archive string, path string, content binary")
    got = {r.archive: (r.path, r.text, r.n_files) for r in inclusion.expanded_papers(members).collect()}
    assert got == {"a": ("p/main.tex", head + "123\nCD\n45", 2), "b": ("main.tex", head + "y\n" + head + "x\n", 2)}


def test_pairs_are_screened_where_they_are_made(spark, monkeypatch):
    """every pair that overlaps left the join of blocks, which were stored, and took its words through four joins."""
    stored = []
    monkeypatch.setattr(prose, "kept", lambda df, name: stored.append(name) or storage.kept(df, name))
    gram = "one two three four five six seven eight"
    said = ["red green blue", "red red red red black", gram, gram + " " + " ".join(f"w{i}" for i in range(60)), "green blue red", "red green", ""]
    sents = spark.createDataFrame([(1, sec, 0, text.split()) for sec, text in enumerate(said)] + [(None, 0, 0, ["red"]), (None, 1, 0, ["red"])], "doc_id long, sec int, sent int, words array<string>")
    pairs = lambda **more: {(r.sec1, r.sec2): r.by_gram for r in prose.near_duplicate_pairs(sents, **more).collect()}
    every = {(0, 1): False, (0, 4): False, (0, 5): False, (1, 4): False, (1, 5): False, (2, 3): True, (4, 5): False}
    assert pairs() == every
    assert pairs(cosine=0.75) == {(0, 4): False, (0, 5): False, (2, 3): True, (4, 5): False}
    assert "sentence-blocks" not in stored
