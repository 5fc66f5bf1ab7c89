from pyspark.sql import functions as F

from vellum.functions import scores, text


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_sentences(spark):
    cut = lambda s: _one(spark, text.split_sentences(F.col("t")), t=s)
    assert cut("See Fig. 2 for it. Next one? \"Yes.\" It is 3.5 long.") == ["See Fig. 2 for it.", "Next one?", '"Yes.', "It is 3.5 long."]
    assert cut("J. A. Smith came. e.g. This") == ["J.", "A. Smith came. e.g. This"]
    assert cut("First.\n\nSecond") == ["First.", "Second"]
    assert cut("") == []


def test_tokens(spark):
    assert _one(spark, text.tokens(F.col("t")), t="It's [cite] café state-of-the-art 3.5") == ["it's", "[cite]", "caf", "state-of-the-art", "3", "5"]


def test_ngrams(spark):
    grams = lambda n: len(_one(spark, text.ngrams(F.split("t", " ")), t=" ".join(map(str, range(n)))))
    assert [grams(n) for n in (1, 7, 8, 10)] == [0, 0, 1, 3]


def test_names_are_literal(spark):
    assert _one(spark, text.named(F.col("t"), F.col("n")), t="uses C++(x) now", n="C++(x)")
    assert not _one(spark, text.named(F.col("t"), F.col("n")), t="uses XNames", n="Name")


def test_scores(spark):
    df = spark.createDataFrame([(0.125,), (0.025,), (0.004,), (None,)], "s double")
    assert [r[0] for r in df.select(scores.index_of(F.col("s"))).collect()] == [12, 2, 0, None]
    assert [r[0] for r in df.select(scores.shown(F.col("s"))).collect()] == ["13", "3", "<1", None]
    assert [r[0] for r in spark.range(0, 80, 20).select(scores.band(F.col("id"))).collect()] == ["Low", "Moderate", "High", "Very high"]
    assert _one(spark, scores.truncated(F.col("t"), 3), t="abcd") == "abc…"
    assert _one(spark, scores.initials(F.col("t")), t="ada  lovelace king") == "AL"


def test_near_duplicate_pairs(spark):
    from vellum.operators import prose

    gram = "one two three four five six seven eight"
    long = " ".join(f"w{i}" for i in range(60))
    sents = spark.createDataFrame([(1, 0, 0, gram.split()), (1, 1, 0, (gram + " " + long).split()), (1, 2, 0, "red green blue".split()), (1, 3, 0, "blue red black white".split()), (1, 4, 0, "black".split()), (2, 0, 0, "red green blue".split())], "doc_id long, sec int, sent int, words array<string>")
    got = {(r.sec1, r.sec2): (round(r.jaccard, 4), r.by_gram) for r in prose.near_duplicate_pairs(sents).collect()}
    assert got == {(0, 1): (round(8 / 68, 4), True), (2, 3): (0.4, False), (3, 4): (0.25, False)}


def test_nulls_last_ranks_every_row(spark, tmp_path):
    from vellum.plans import catalog

    rows = [(k, None if k % 3 == 0 else float(k * 7919 % 501 - 50)) for k in range(1, 2501)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.queries()["leaderboard_nulls_last"](spark, str(tmp_path)).collect()
    shown = [(k, v if v is not None and v > 0 else None) for k, v in rows]
    for direction, sign in (("desc", -1), ("asc", 1)):
        expected = sorted(shown, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))
        assert [(r.s_suppkey, r.balance) for r in sorted((r for r in got if r.direction == direction), key=lambda r: r["rank"])] == expected
        assert sorted(r["rank"] for r in got if r.direction == direction) == list(range(1, 2501))


def test_verdicts_read_every_run(spark, tmp_path):
    from vellum.plans import catalog

    kinds = ["click", "click", "click", "error"], ["error"] * 5, ["signup", "signup", "click"], ["click"], ["signup", "signup", "error", "error", "error"]
    spark.createDataFrame([(10 * u + i, u, k) for u, own in enumerate(kinds) for i, k in enumerate(own)], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.final for r in catalog.queries()["unit_verdicts_all_runs"](spark, str(tmp_path)).collect()}
    assert got == {0: "UNRESOLVED", 1: "FAIL", 2: "NOT_APPLICABLE", 3: "UNRESOLVED", 4: "FAIL"}


def test_stops_are_looked_for_first(spark):
    plan = spark.createDataFrame([("",)], "t string").select(text.split_sentences(F.concat("t", "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(t#") == 1  # the block was evaluated in each branch before
    assert "\\.(?<=(?:^|[^A-Za-z])" in plan  # the look-behind was tried at every character
    block = "See Fig. 2 and etc. We use vs. Them i.e. this. J. Doe ran 3.5 km. Next.\n\nNo. 4 is Fig. A. Xfig. End, e.g. U.S. Law"
    got = spark.createDataFrame([(block,)], "t string").select(text.split_sentences(F.col("t")).alias("s")).first().s
    assert got == ["See Fig. 2 and etc. We use vs. Them i.e. this.", "J. Doe ran 3.5 km.", "Next.", "No. 4 is Fig. A. Xfig.", "End, e.g. U.S. Law"]
