"""Literal rows with the odd cases of each measure and list, read by both engines."""

SECTIONS = ("doc_id long, sec int", [(1, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (4, 1)])
OBJECTS = (
    "doc_id long, id string, kind string, home int",
    [(1, "s1", "section", 1), (1, "s2", "section", 2), (1, "s3", "section", 3), (1, "f1", "figure", 2), (1, "t1", "table", 3), (2, "s1", "section", 1), (2, "s2", "section", 2), (2, "f1", "figure", 1), (4, "e1", "equation", 1)],
)
POINTERS = (
    "doc_id long, src int, target string, pos int",
    [
        (1, 0, "s1", 1), (1, 0, "s2", 2), (1, 0, "f1", 3), (1, 0, "s3", 4), (1, 0, "s1", 5), (1, 0, "s2", 6), (1, 2, "f1", 7), (1, 2, "t1", 8), (1, 1, "appendix:a", 9), (1, 2, "nowhere", 10), (1, 3, "s2", 11),
        (2, 1, "s2", 1), (2, 1, "f1", 2), (2, 2, "f1", 3),
    ],
)
DOCS = ("doc_id long, acknowledged boolean", [(1, False), (2, True), (3, False), (4, False), (5, False)])
LABELS = (
    "doc_id long, sent int, run int, label string",
    [(1, s, r, x) for s, xs in ((1, "superiority superiority other"), (2, "other other other"), (3, "design_choice prior_limitation other"), (4, "prior_limitation prior_limitation prior_limitation"), (5, "other superiority superiority")) for r, x in enumerate(xs.split())]
    + [(2, s, r, "superiority") for s in (1, 2) for r in range(3)]
    + [(3, s, r, "other") for s in (1, 2, 3, 4) for r in range(3)],
)
SUPPORTS = ("doc_id long, claim int, support int", [(1, 1, 4), (1, 3, 2), (1, 4, 5), (1, 5, None), (2, 1, 2)])
SENTENCES = (
    "doc_id long, sec int, sent int, text string, keys string",
    [
        (1, 1, 0, "DetectGPT [cite] is known.", "a"), (1, 1, 1, "Similarly, others follow [cite].", "b"), (1, 1, 2, "A sentence without any work.", ""), (1, 1, 3, "Likewise, more follow [cite].", "c"),
        (1, 1, 4, "Both are used [cite, cite].", "a,b"), (1, 1, 5, "It compares with DetectGPT in part [cite].", "b"), (1, 2, 0, "Unlike prior methods, it is fast [cite].", "d"), (1, 2, 1, "We extend prior methods [cite].", "d"),
        (1, 2, 2, "The same work twice [cite].", "d,d"), (1, 9, 0, "Out of scope [cite].", "z"), (2, 1, 0, "No citation here.", ""), (3, 1, 0, "MetaGPT2 is studied [cite].", "q"),
    ],
)
ROLES = ("doc_id long, sec int", [(1, 1), (1, 2), (1, 2), (2, 1), (3, 1)])
NAMES = ("doc_id long, cite_key string, name string", [(1, "a", "DetectGPT"), (1, "e", "AI"), (1, "b", "ab"), (3, "q", "MetaGPT2")])
TABLES = ("doc_id long, data_rows int, numeric_cells int", [(1, 2, 4), (1, 9, 90), (2, 2, 4), (3, 1, 9), (3, 5, 3), (4, 3, 5)])
EXHIBITS = ("doc_id long, kind string", [(4, "caption"), (4, "quotation"), (3, "environment")])
FIGURES = (
    "doc_id long, index int, has_image boolean, caption string",
    [(1, 0, True, "Results by size"), (1, 1, True, "Our approach"), (1, 2, True, "Overview of the system"), (1, 3, True, "Pipeline"), (2, 0, False, "Framework"), (2, 1, True, "Illustration of the idea"), (3, 0, True, "Losses")],
)
ELEMENTS = (
    "doc_id long, run int, text string, role string",
    [(1, 0, "Step 1", "label"), (1, 1, "(2) next", "label"), (1, 2, "Encoder", "label"), (1, 0, "Legend", "x"), (1, 1, "✓", "evaluative_mark"), (1, 2, "✗", "x"), (1, 0, " ", "example"), (2, 0, "Encoder", "label")],
)
RESULTS = (
    "doc_id long, key string, plane string, status string, score double",
    [
        (1, "cross_refs", "structure", "done", 1.0), (1, "macro_redundancy", "structure", "done", 0.0), (1, "argument_graph", "argument", "skipped", None), (1, "citation_isolation", "argument", "done", 0.5), (1, "figure_exposition", "artifacts", "na", None), (1, "evidence_gap", "artifacts", "na", None),
        (2, "cross_refs", "structure", "done", 9 / 11), (2, "macro_redundancy", "structure", "done", 2 / 68), (2, "citation_isolation", "argument", "done", 5 / 9), (2, "evidence_gap", "artifacts", "done", 1.0), (2, "argument_graph", "argument", "skipped", None),
        (3, "cross_refs", "structure", "done", 0.125), (3, "evidence_gap", "artifacts", "na", None), (4, "cross_refs", "structure", "error", None), (5, "evidence_gap", "artifacts", "done", 0.025),
    ],
)
UNITS = ("item string, unit int, runs string", [("1-1", 1, "FAIL,FAIL,FAIL"), ("1-1", 2, "FAIL,PASS,PASS"), ("1-1", 3, "PASS"), ("1-1", 4, "PASS,PASS,UNRESOLVED"), ("1-2", 1, "NA,NA,FAIL"), ("1-2", 2, "UNRESOLVED,UNRESOLVED,UNRESOLVED"), ("1-2", 3, "PASS,PASS")])
LAYOUT_EDGES = ("doc_id long, src int, target string", [(1, 1, "s2"), (1, 1, "s2"), (1, 2, "f1"), (1, 3, "f1"), (1, 2, "s2"), (1, 9, "s2"), (1, 1, "none"), (2, 1, "s2")])
POINTS = ("page int, point string, kind string, x double, y double, column int", [(1, "p1", "figure", 0.0, 100.0, 0), (1, "p2", "figure", 0.0, 100.0, 1), (1, "p3", "table", 0.0, 700.0, 0), (2, "p4", "figure", 0.0, 0.0, 0)])
ANCHORS = ("page int, anchor string, x double, y double, anchor_column int", [(1, "a1", 0.0, 90.0, 0), (1, "a2", 0.0, 130.0, 0), (1, "a3", 0.0, 500.0, 1), (1, "a4", 0.0, 650.0, 0), (2, "a5", 0.0, 800.0, 0)])
GALLERY = (
    "key string, title string, url string, created double, index int",
    [("k1", "A Long Enough Title", None, 1.0, 50), ("k2", "a long-enough title!", None, 2.0, 60), ("k3", "Short", "https://arxiv.org/abs/2401.12345", 1.0, None), ("k4", "Brief", "https://arxiv.org/pdf/2401.12345v2", 3.0, 10), ("k5", "Short", None, 1.0, 20), ("k6", "A long enough TITLE", None, 2.0, 70)],
)
TEXTS = (
    "doc_id long, src int, raw string",
    [
        (1, 1, "As Section 2 and Figure 1 show, Table 2 differs from Appendix B; see Sec. 2.1 and Figures 3."), (1, 2, "The Results and Discussion section repeats Figure 1, and the 'method of work' Section has more."),
        (1, 3, "Nothing here. Table 9 is missing, but Fig. 2 is not."), (2, 1, "See Section 1, the Setup section, and the setup section once more."), (2, 2, ""),
    ],
)
NUMBERED = ("doc_id long, kind string, number string, id string", [(1, "section", "1", "s1"), (1, "section", "2", "s2"), (1, "figure", "1", "f1"), (1, "figure", "2", "f2"), (1, "table", "2", "t2"), (2, "section", "1", "s1")])
HEADS = ("doc_id long, sec int, title string", [(1, 1, "Intro"), (1, 2, "Method of work"), (1, 3, "Results and Discussion"), (2, 1, "Setup (short)"), (2, 2, "Setup "), (2, 3, "the Setup")])
PASSAGES = (
    "id long, text string",
    [
        (1, "Shown before [3-5, 9] and [2], but [40-90] is too long and [7–7] none."), (2, "As said (Smith et al., 2020; Jones and Lee 2019b) and again (Brown, 2001)."), (3, "No citation (see below) and [x]."), (4, ""),
        (8, "As Lee et al. (2020) and Kim and Park (2019a) say (see Roe (the elder), 1999), App. A.1 and Section 2.7."), (5, "Tables 1, 2 and 3 with Figure 4, Equations (5) and (6), Algorithm 7, Sections 2.1-2.3."), (6, "One [1] against (Doe et al., 1999)."), (7, "Two [1] and [2] against (Doe et al., 1999)."),
    ],
)
CLAIMS = (
    "id long, text string",
    [
        (1, "No individual cases were inspected."), (2, "The result rests solely on aggregate numbers."), (3, "It does not show any concrete examples."), (4, "We show many cases."), (5, "not any specific failure cases have been reported"), (6, "A qualitative case study"),
        (7, "Sample outputs of the model"), (8, "System prompts used"), (9, "Accuracy by size"), (10, "Walkthrough"), (11, "Visualisations of attention"), (12, "only on aggregate scores"),
    ],
)
CELLS = ("id long, cell string", [(1, "12.5"), (2, "± 3"), (3, "1,234"), (4, "45 %"), (5, "(0.5)"), (6, "abc"), (7, ""), (8, "3 ± 0.2"), (9, "7x*"), (10, "a 5"), (11, "~10 ms"), (12, "2019-2020")])
TITLES = ("id long, title string", [(1, "Ethics Statement"), (2, "Reproducibility"), (3, "Related Work"), (4, "Prior  literature"), (5, "Background"), (6, "Method"), (7, "LLM use"), (8, "Previous studies on ethics"), (9, "Checklist"), (10, "Relations")])
ISSUES = ("id string, title string, labels string, created string, body string", [("gh-1", "Proposal: First", "proposal,testing", "2024-01-03", '**Plane:** Structure\n**What it is:** Repeats itself. \nProposed by A. Person. Thanks'), ("gh-2", "Second", "testing,accepted", "2024-01-01", None), ("gh-3", "Proposal:Third", "proposal", "2024-01-02", None), ("gh-4", "Fourth", "not-adopted,testing", "2024-01-05", None)])
LOCAL = ("id string, name string, issue_url string, created string", [("l1", "Local", None, "2024-01-04"), ("l2", "Known", "https://example.org/1", "2024-01-09"), ("l3", "Blank", "", "2024-01-06")])
PIECES = (
    "fb string, ann int, piece int, text string, x0 double, y0 double, x1 double, y1 double",
    [("a", 1, 1, "second", 5.0, 6.0, 9.0, 9.5), ("a", 1, 0, "first", 1.0, 7.0, 4.0, 8.0), ("a", 2, 0, "", 0.0, 0.0, 1.0, 1.0), ("a", 2, 1, None, 2.0, 2.0, 3.0, 3.0), ("b", 1, 0, "only", 1.0, 1.0, 2.0, 2.0)],
)
FOUND = ("doc_id long, title string", [(1, "§2 Method of Work"), (1, "method of work"), (1, "Results"), (1, "Elsewhere"), (1, None), (2, "Setup"), (2, "The setup, at last")])
REASONS = ("id long, why string", [(1, "no cue (none of the list)"), (2, "no cue (other)"), (3, "one work"), (4, "own work (we)"), (5, None)])
EDGES = ("doc_id long, claim int, support int", [(1, 1, 3), (1, 2, 1), (1, 3, 9), (2, 1, 2)])
LINES = ("doc_id long, sec int, sent int, text string", [(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 3, 0, "c"), (2, 1, 0, "x"), (2, 2, 0, "y")])
FLOATS = ("doc_id long, home int, kind string, at int, id string", [(1, 2, "figure", 50, "f2"), (1, 1, "figure", 70, "f1"), (1, 2, "figure", 10, "f3"), (1, 1, "table", 5, "t1"), (2, 1, "figure", 1, "g1")])
KEYS = ("id long, key string", [(1, " ABCD efgh 2345 "), (2, "abcd-efgh-2345"), (3, "short"), (4, "a_longer-key"), (5, "Bad Key !"), (6, "ABCDEFGH")])

ROWS = {
    "docs": DOCS, "sections": SECTIONS, "objects": OBJECTS, "pointers": POINTERS, "labels_": LABELS, "supports": SUPPORTS, "sents": SENTENCES, "roles": ROLES, "names": NAMES, "tables_": TABLES, "exhibits": EXHIBITS, "figures": FIGURES, "elements": ELEMENTS,
    "results": RESULTS, "units": UNITS, "edges": LAYOUT_EDGES, "points": POINTS, "anchors": ANCHORS, "gallery": GALLERY, "texts": TEXTS, "numbered": NUMBERED, "heads": HEADS, "passages": PASSAGES, "claims": CLAIMS, "cells": CELLS, "titles": TITLES, "issues": ISSUES, "local_": LOCAL,
    "pieces": PIECES, "found": FOUND, "reasons": REASONS, "floats": FLOATS, "keys_": KEYS,
}


def literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(name: str, fixture: tuple) -> str:
    fields = [f.split() for f in fixture[0].split(", ")]
    kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in fixture[1])
    columns = ", ".join(f'CAST(c{i} AS {kinds[k]}) AS "{n}"' for i, (n, k) in enumerate(fields))
    return f"{name} AS (SELECT {columns} FROM (VALUES {rows}) AS v({', '.join(f'c{i}' for i in range(len(fields)))}))"
