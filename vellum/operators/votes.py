"""Votes, tallies, merges and newest-wins rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.scores import ratio


def majority(votes: DataFrame, by: list[str], label: str, order: str) -> DataFrame:
    """The label with most votes of each unit; on a tie for first place the earliest vote's label."""
    counts = votes.groupBy(*by, label).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max("n").alias("most"), F.max_by(label, "n").alias("top"), F.collect_list("n").alias("all"))
    first = votes.groupBy(*by).agg(F.min_by(label, order).alias("first"))
    tied = F.size(F.filter("all", lambda n: n == F.col("most"))) > 1
    return top.join(first, by).select(*by, F.when(tied, F.col("first")).otherwise(F.col("top")).alias("winner"), "most", tied.alias("tied"))


def present(votes: DataFrame, by: list[str], kind: str, run: str, runs: int) -> DataFrame:
    """Kinds that more than half of the runs report."""
    return votes.groupBy(*by, kind).agg(F.countDistinct(run).alias("votes")).filter(F.col("votes") * 2 > runs)


def verdict(runs: Column) -> Column:
    """Final verdict of a unit from its runs: unresolved below two runs or where passes and failures meet, else the strict majority."""
    n = lambda label: F.size(F.filter(runs, lambda x: x == label))
    return (
        F.when(F.size(runs) < 2, "UNRESOLVED")
        .when((n("FAIL") > 0) & (n("PASS") > 0), "UNRESOLVED")
        .when(n("FAIL") * 2 > F.size(runs), "FAIL")
        .when(n("PASS") * 2 > F.size(runs), "PASS")
        .when((n("NA") + n("NOT_APPLICABLE")) * 2 > F.size(runs), "NOT_APPLICABLE")
        .otherwise("UNRESOLVED")
    )


def verdicts(rows: DataFrame, by: list[str], label: Column) -> DataFrame:
    """(by, final): verdict() of all rows of each unit, from counts, so that no unit's runs are gathered."""
    f, p, na = (F.count_if(F.coalesce(x, F.lit(False))) for x in (label == "FAIL", label == "PASS", label.isin("NA", "NOT_APPLICABLE")))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), f.alias("f"), p.alias("p"), na.alias("na"))
    final = F.when(F.expr("n < 2 or (f > 0 and p > 0)"), "UNRESOLVED").when(F.expr("f * 2 > n"), "FAIL").when(F.expr("p * 2 > n"), "PASS").when(F.expr("na * 2 > n"), "NOT_APPLICABLE").otherwise("UNRESOLVED")
    return counts.select(*by, final.alias("final"))


def score_and_coverage(units: DataFrame, by: list[str], outcome: Column) -> DataFrame:
    """Counts of FAIL, PASS and UNRESOLVED, F/(F+P) and (F+P)/(F+P+U); anything else is not applicable and left out."""
    f, p, u = (F.count_if(outcome == x) for x in ("FAIL", "PASS", "UNRESOLVED"))
    counts = units.groupBy(*by).agg(f.alias("f"), p.alias("p"), u.alias("u"))
    decided = F.col("f") + F.col("p")
    return counts.withColumns({"score": ratio(F.col("f"), decided), "coverage": ratio(decided, decided + F.col("u"))})


def newest(rows: DataFrame, identity: list[str], created: str, *ties: str) -> DataFrame:
    """The newest row of each identity; `ties` decide among equally new ones, larger first."""
    order = W.partitionBy(*identity).orderBy(*(F.desc(c) for c in (created, *ties)))
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def latest_votes(votes: DataFrame, by: list[str], value: str, ts: str, *ties: str) -> DataFrame:
    """Last vote of each voter and item; a last vote of 0 takes it back."""
    last = votes.groupBy(*by).agg(F.max_by(value, F.struct(ts, *ties)).alias(value))
    return last.filter(F.col(value) != 0)


def tally(items: DataFrame, votes: DataFrame, item: str, value: str) -> DataFrame:
    """Votes up and down of every item, 0 for those without."""
    counts = votes.groupBy(item).agg(F.count_if(F.col(value) > 0).alias("up"), F.count_if(F.col(value) < 0).alias("down"))
    return items.join(counts, item, "left").select(item, F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"))


def toggled(events: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that were switched an odd number of times."""
    return events.groupBy(*by).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


def merge_contributors(*sources: tuple[DataFrame, bool]) -> DataFrame:
    """(name, n, kinds) by lower-cased name from tables (name, kind, n) in order of precedence; a table counts towards n or adds kinds only. Blank and anonymous names are skipped."""
    every = None
    for rank, (df, counts) in enumerate(sources):
        rows = df.select(F.trim("name").alias("name"), "kind", (F.col("n") if counts else F.lit(0)).cast("long").alias("n"), F.lit(rank).alias("rank"))
        every = rows if every is None else every.unionByName(rows)
    every = every.filter("name <> '' and lower(name) <> 'anonymous'")
    merged = every.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("rank", "name")).alias("name"), F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return merged.select("key", "name", "n", F.concat_ws(",", "kinds").alias("kinds"))


def daily(rows: DataFrame, at: str) -> DataFrame:
    """(day, n): rows by the date part of a time written as text; rows without a date are counted under null."""
    day = F.substring_index(at, " ", 1)
    return rows.groupBy(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).alias("day")).agg(F.count("*").alias("n"))
