"""Submissions, short reports and overreach on literal rows, against results worked out by hand."""

from vellum.operators import listings, summaries
from vellum.operators import submissions as S

ANNOTATIONS = "fb string, ann int, kind string, title string, note string, pattern_name string, pattern_what string"
PIECES = "fb string, ann int, piece int, text string"
GOOD = (" Ann ", "Lab", "ann@example.org")


def _feedback(spark, annotations, pieces, disputed=(), senders=None):
    subs = spark.createDataFrame([(fb, *x) for fb, x in (senders or {"a": GOOD}).items()], "fb string, name string, affiliation string, email string")
    ann, pcs = spark.createDataFrame(annotations, ANNOTATIONS), spark.createDataFrame(pieces, PIECES)
    rows = S.feedback_rows(subs, ann, pcs, spark.createDataFrame(list(disputed), "fb string, nth int, finding string"))
    return {r.fb: r for r in rows.collect()}, S.proposals_in(rows, ann, pcs).collect()


def test_reasons_in_order(spark):
    senders = {"ok": GOOD, "bad": GOOD, "who": (" ", None, "x"), "mail": ("A", "B", "a b@c.d"), "none": GOOD, None: GOOD, "short": GOOD, "nul": (None, None, None)}
    ann = [("ok", 1, None, "T", "0123456789", None, None), ("bad", 1, "x", "  ", "0123456789", "", ""), ("none", 1, "x", "T", "short", "", ""), ("short", 1, "x", "T", "012345678", None, None), (None, 1, "x", "T", "0123456789", None, None)]
    pieces = [("ok", 1, 1, "p"), ("bad", 1, 1, None), ("short", 1, 1, ""), (None, 1, 1, "p"), ("stray", 1, 1, "p")]
    got, _ = _feedback(spark, ann, pieces, [("who", 1, "f"), ("mail", 1, "f")], senders)
    assert {k: r.reason for k, r in got.items()} == {"ok": None, "bad": "annotation", "who": "sender", "mail": "email", "none": "nothing", None: "nothing", "short": "annotation", "nul": "sender"}
    # An annotation without a piece is dropped before the rules look at it.
    assert (got["none"].flags, got["ok"].name, got["ok"].slops, got["ok"].quotes) == (0, "Ann", "T [other]: 0123456789", "p")


def test_lists_are_cut_before_empty_annotations_go(spark):
    ann = [("a", i, "other", f"T{i}", "0123456789", f"P{i}", "") for i in range(150)]
    pieces = [("a", i, 1, "x") for i in range(150) if i % 2] + [("a", 7, j, f"p{j}") for j in range(2, 60)]
    got, named = _feedback(spark, ann, pieces, [("a", i, "f") for i in range(300)])
    assert (got["a"].flags, got["a"].disputed, len(named)) == (50, 200, 50)
    (seventh,) = [r for r in named if r.ann == 7]
    assert seventh.quote == " / ".join(["x"] + [f"p{j}" for j in range(2, 41)])


def test_long_fields_are_cut(spark):
    ann = [("a", 1, "other", "  " + "t" * 90, "n" * 700, " " * 79 + "name", "w" * 400), ("a", 2, "other", "T", "n" * 20, "Name", None), ("a", 3, "x", "T", "n" * 20, "Name", None)]
    got, named = _feedback(spark, ann, [("a", 1, 2, "b" * 2000), ("a", 1, 1, "a" * 100), ("a", 2, 1, None), ("a", 2, 2, ""), ("a", 3, 1, "x")])
    # The title is cut first and trimmed then, so two of its characters are lost to the blanks.
    assert got["a"].slops.startswith("t" * 78 + " [other]: " + "n" * 600 + " | T [other]")
    assert got["a"].quotes == "a" * 100 + " | " + "b" * 1000 + " | x"
    by = {r.ann: r for r in named}
    assert by[1].name == "n" and by[1].what == "w" * 300 and by[1].quote == "n" * 600 + " — " + "a" * 100 + " / " + "b" * 497
    assert by[2].quote == "2 region(s) marked on the paper" and by[2].what == "n" * 20 and set(by) == {1, 2}


def test_nothing_at_all(spark):
    got, named = _feedback(spark, [], [], senders={"a": GOOD})
    assert got["a"].reason == "nothing" and (got["a"].slops, got["a"].quotes) == ("", "") and named == []


def test_proposals_and_their_bodies(spark):
    rows = spark.createDataFrame([(1, " abc ", "structure", "0123456789"), (2, "ab", "structure", None), (3, "abc", "Structure", " 012345678 "), (4, None, None, None), (5, "x" * 3000, None, "y" * 3000)], "id int, name string, plane string, what string")
    got = {r.id: r for r in S.checked_proposals(rows).collect()}
    assert {k: r.reason for k, r in got.items()} == {1: None, 2: "name", 3: "what", 4: "name", 5: None}
    assert (got[1].name, got[3].plane, len(got[5].name), len(got[5].what)) == ("abc", "other", 2000, 2000)
    from pyspark.sql import functions as F

    people = spark.createDataFrame([(1, "argument", "It repeats.", "Ann", "Lab"), (2, None, None, "", None)], "id int, plane string, what string, author string, affiliation string")
    issues = people.select(F.col("id").cast("string").alias("id"), F.lit("Proposal: X").alias("title"), F.array(F.lit("testing")).alias("labels"), F.lit("2024").alias("created"), S.proposal_body(*(F.col(c) for c in ("plane", "what", "author", "affiliation"))).alias("body"))
    local = spark.createDataFrame([], "id string, name string, issue_url string, created string")
    read = {r.id: (r.plane, r.what, r.author) for r in listings.proposals(issues, local).collect()}
    assert read == {"1": ("argument", "It repeats.", "Ann (Lab)"), "2": ("unassigned", "", "Anonymous")}


def test_votes_and_posts(spark):
    votes = spark.createDataFrame([("1-1", "t", 1), (" 5-4 ", "t ", 0), ("9-9", "t", 1), ("1-1", " ", 1), ("1-1", None, 1), ("1-1", "t", 2), ("1-1", "t", None), (None, "t", 1)], "item string, token string, v int")
    assert [r.reason for r in S.checked_votes(votes).collect()] == [None, None, "item", "token", "token", "value", "value", "item"]
    posts = spark.createDataFrame([("1-1", "case", "0123456789"), ("1-1", "case", " 012345678 "), ("1-1", "prompt", "0" * 19), ("1-1", "prompt", "0" * 5000), ("1-1", None, "0" * 50), ("", "case", None)], "item string, kind string, text string")
    got = S.checked_posts(posts).collect()
    assert [r.reason for r in got] == [None, "text", "text", None, "kind", "item"] and len(got[3].text) == 4000


def test_marks_count_once_a_user(spark):
    prompts = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    ups = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "a"), (3, "a")], "id int, token string")
    got = {r.id: (r.ups, r.mine) for r in S.seen_by(prompts, ups, "a").collect()}
    assert got == {1: (2, True), 2: (0, False), None: (0, False)}


def test_totals_of_a_log(spark):
    log = spark.createDataFrame([("2024-02-03 10:00:00",), ("2024-02-03",), ("2023-12-31 x",), ("2023-1-31 x",), (" 2020-01-01",), ("2020-01-01T00",), ("",), (None,)], "logged string")
    assert [tuple(r) for r in listings.totals(log, "logged").select("analyses", "since", "days").collect()] == [(8, "2023-12-31", 2)]
    assert [tuple(r) for r in listings.totals(log.limit(0), "logged").select("analyses", "since", "days").collect()] == [(0, None, 0)]


RESULTS = "doc_id int, key string, plane string, status string, score double, num double, den int"


def test_report_text_and_metrics(spark):
    results = spark.createDataFrame(
        [(1, "evidence_gap", "artifacts", "na", None, None, None), (1, "cross_refs", "structure", "done", 0.25, 1.0, 4), (1, "macro_redundancy", "structure", "skipped", None, None, None), (1, "argument_graph", "argument", "done", 0.5, 0.5, 1), (2, "cross_refs", "structure", "error", None, None, None)],
        RESULTS,
    )
    docs = summaries.heads(spark.createDataFrame([(1, "", "a.pdf", "latex"), (2, None, None, None)], "doc_id int, title string, fallback string, source string"))
    got = {r.doc_id: r.report for r in summaries.report_text(docs, results, summaries.measure_table(spark)).collect()}
    assert got[1].split("\n") == [
        "a.pdf",
        "  Index: 38 / 100  (partial)",
        "  structure  25",
        "  argument   50",
        "  artifacts  —",
        "    Cross-section references   done     0.250 (1/4)",
        "    Macro redundancy           skipped  —",
        "    Argument graph             done     0.500 (0.5/1)",
        "    Evidence gap               na       —",
    ]
    assert got[2].split("\n")[:2] == ["Untitled paper", "  Index: — / 100  (partial)"]
    maps = {r.doc_id: r.metrics for r in summaries.metrics(results.unionByName(results.filter("doc_id = 1 and key = 'cross_refs'"))).collect()}
    assert maps == {1: {"index": 38.0, "plane:structure": 25.0, "plane:argument": 50.0, "m:cross_refs": 25.0, "m:argument_graph": 50.0}, 2: {}}
    assert [r.fidelity for r in docs.orderBy("doc_id").collect()] == [summaries.FROM_LATEX, summaries.FROM_PDF]


def test_overreach(spark):
    text = "It works across all domains and beats RULER."
    rows = [
        (1, text, "ACROSS all domains", None, None),
        (2, text, "never said", None, None),
        (3, text, "RULER", None, None),
        (4, "a b c d e f g h i", "a b c d e f g h i", None, None),
        (5, "a b c d e f g h i", "a b c d e f g h", None, None),
        (6, text, None, "users", "all"),
        (7, text, None, "users", "all"),
        (8, text, None, "users", ""),
        (9, text, "works", None, None),
        (10, None, "works", None, None),
    ]
    claims = spark.createDataFrame([(c, 0, *x) for c, *x in rows], "claim int, run int, text string, phrase string, class string, qualifier string")
    covered = spark.createDataFrame([(6, "users", i) for i in "aab"] + [(7, "users", i) for i in "abc"], "claim int, class string, item string")
    limits = spark.createDataFrame([(9,), (9,), (11,)], "claim int")
    got = {r.claim: r.verdict for r in summaries.overreach(claims, covered, limits).collect()}
    assert {c for c, v in got.items() if v == "FAIL"} == {1, 5, 6} and len(got) == 10
