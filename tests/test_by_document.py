"""Sentences that are compared within documents: what is shuffled, and that nothing is lost by it."""

import itertools

from vellum.operators import prose


def _sentences(spark, lines):
    """One document a list, one section a line."""
    return spark.createDataFrame([(d, i, 0, s.split()) for d, ls in enumerate(lines) for i, s in enumerate(ls)], "doc_id long, sec int, sent int, words array<string>")


def test_grams_are_cut_behind_the_shuffle(spark):
    plan = prose.repeated_grams(_sentences(spark, [["a b c d e f g h i"]]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_shared_grams_are_found_with_one_shuffle(spark, monkeypatch):
    stored, keep = {}, prose.kept
    monkeypatch.setattr(prose, "kept", lambda df, name: stored.setdefault(name, df) and keep(df, name))
    text = "one two three four five six seven eight"
    got = prose.near_duplicate_sentences(_sentences(spark, [[text, "x " + text, text + " y", "one two three four"], [text], [text + " z", text + " z"]])).collect()
    assert sorted((r.doc_id, r.sec1, r.sec2) for r in got) == [(0, 0, 1), (0, 0, 2), (0, 1, 2), (2, 0, 1)]
    assert stored["shared-grams"]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_close_pairs_are_those_of_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(prose, "BLOCK", 4)
    stored, keep = {}, prose.kept
    monkeypatch.setattr(prose, "kept", lambda df, name: stored.setdefault(name, df) and keep(df, name))
    lines = [" ".join(f"w{(i * k) % 9}" for k in range(1, 2 + i % 5)) for i in range(13)] + ["the"] * 3 + [""]
    got = {(r.sec1, r.sec2): round(r.jaccard, 9) for r in prose.near_duplicate_pairs(_sentences(spark, [lines, ["only one"]])).collect()}
    sets = [set(s.split()) for s in lines]
    every = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] | sets[j]}
    assert got == {p: round(x, 9) for p, x in every.items() if x >= 0.2}
    assert stored["sentence-blocks"].count() == 5
