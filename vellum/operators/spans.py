"""Runs, intervals and nearest matches within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.storage import kept, small_side

#: Units from zero up to which positions have cells of their own.
FARTHEST = float(1 << 52)
#: Spans of a key that each of its points is compared with.
MANY = 64


def longest_run(rows: DataFrame, by: list[str], order: list[str], holds: Column, least: int = 2) -> DataFrame:
    """(by, start, length): the longest run of consecutive rows that hold, the earliest on a tie, of at least `least`."""
    w = W.partitionBy(*by).orderBy(*order)
    numbered = rows.withColumns({"_n": F.row_number().over(w), "_h": F.coalesce(holds, F.lit(False))}).filter("_h")
    runs = numbered.withColumn("_run", F.col("_n") - F.row_number().over(w)).groupBy(*by, "_run").agg(F.min("_n").alias("start"), F.count("*").alias("length"))
    best = runs.filter(F.col("length") >= least).groupBy(*by).agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("best"))
    return best.select(*by, "best.start", "best.length")


def islands(rows: DataFrame, by: list[str], at: str, gap: int) -> DataFrame:
    """(by, first, last, n): maximal runs of positions at most `gap` apart."""
    w = W.partitionBy(*by).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_island")


def _cell(at: Column, unit: float) -> Column:
    """The cell of a position, those far out in the last one on their side."""
    return F.floor(F.least(F.greatest(at.cast("double") / unit, F.lit(-FARTHEST)), F.lit(FARTHEST))).cast("long")


def _covering(first: Column, last: Column) -> Column:
    """Structs (level, cell) of the fewest cells of doubling width, 2^level, that together are the cells from first to last; none where last comes before first.

    On each level that leaves at most one at either end, where a run of cells does not begin or end with a pair."""
    begin = lambda j: -F.call_function("shiftright", -first, j)
    end = lambda j: F.call_function("shiftright", last + 1, j)
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
    ends = lambda j: F.array(
        F.when((begin(j) < end(j)) & odd(begin(j)), F.struct(j.alias("level"), begin(j).alias("cell"))),
        F.when((begin(j) < end(j)) & odd(end(j)), F.struct(j.alias("level"), (end(j) - 1).alias("cell"))),
    )
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(last - first + 1, F.lit(1)).cast("double"))).cast("int") + 1)
    return F.array_compact(F.flatten(F.transform(levels, ends)))


def innermost(points: DataFrame, spans: DataFrame, by: list[str], point: str, unit: float = 1.0, many: int | None = None) -> DataFrame:
    """Each point (by, point) with the shortest span (by, span, first, last) around it, the first on a tie, and of equal ones the least by name; points outside all spans are left out, as are nulls.

    A point meets all spans of its key where those are at most `many` (MANY by default). The other keys are looked up by cells, so that none of them makes pairs of all its points and spans. Both ways give the same rows."""
    spans = spans.filter(F.col("first") <= F.col("last"))
    large = kept(spans.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > (MANY if many is None else many)).select(*by), "large")
    if large.isEmpty():
        return _met(points, spans, by, point)
    large = small_side(large)
    of = lambda df, how: df.join(large, by, how)
    return _met(of(points, "left_anti"), of(spans, "left_anti"), by, point).unionByName(_by_cells(of(points, "left_semi"), of(spans, "left_semi"), by, point, unit))


def _met(points: DataFrame, spans: DataFrame, by: list[str], point: str) -> DataFrame:
    inside = points.join(spans, by).filter(F.col(point).between(F.col("first"), F.col("last")))
    return inside.groupBy(*by, point).agg(F.min_by("span", F.struct(F.col("last") - F.col("first"), "first", "span")).alias("span"))


def _by_cells(points: DataFrame, spans: DataFrame, by: list[str], point: str, unit: float) -> DataFrame:
    """Positions lie in cells of `unit`. A span is some cells of doubling width, a number that grows with the logarithm of its length, and the two cells of its ends, in which positions are looked at.
    Of a cell only the best span is kept before the join, and a point asks the cells around it, one a level."""
    measured = spans.select(*by, "span", "first", "last", _cell(F.col("first"), unit).alias("_a"), _cell(F.col("last"), unit).alias("_b"))
    # Both ends of a span as cells of level -1, with their bounds; what lies between them as cells without.
    edges = F.transform(F.array_distinct(F.array("_a", "_b")), lambda c: F.struct(F.lit(-1).alias("level"), c.alias("cell")))
    cells = measured.withColumn("_c", F.explode(F.concat(edges, _covering(F.col("_a") + 1, F.col("_b") - 1))))
    bound = lambda c: F.when(F.col("_c.level") < 0, F.col(c))
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("length"), "first", "span")).alias("best")
    cells = kept(cells.groupBy(*by, F.col("_c.level").alias("level"), F.col("_c.cell").alias("cell"), bound("first").alias("from"), bound("last").alias("to")).agg(best), "cells")
    top = cells.agg(F.max("level")).first()[0]
    levels = F.sequence(F.lit(-1), F.lit(-1 if top is None else top))
    asked = points.select(*by, point).distinct().withColumn("level", F.explode(levels)).withColumn("cell", F.call_function("shiftright", _cell(F.col(point), unit), F.greatest("level", F.lit(0))))
    inside = asked.join(cells, [*by, "level", "cell"]).filter((F.col("level") >= 0) | F.col(point).between(F.col("from"), F.col("to")))
    return inside.groupBy(*by, point).agg(F.min("best").alias("best")).select(*by, point, "best.span")


def preceding(rows: DataFrame, others: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each row with the value of the last other row at or before it: one union and one window instead of a range join."""
    columns = [*by, at]
    both = rows.select(*columns, F.lit(1).alias("_own"), F.lit(None).cast(others.schema[value].dataType).alias(value)).unionByName(others.select(*columns, F.lit(0).alias("_own"), value))
    w = W.partitionBy(*by).orderBy(at, "_own").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_own = 1").drop("_own")


def nearest(points: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by, point, anchor): the closest anchor (x, y) of each point (x, y) on the same page, if near enough.

    An anchor may lie 14 above (a table 60), another column costs 400, and beyond 760 nothing is taken: fixed values."""
    pairs = points.join(anchors.withColumnsRenamed({"x": "ax", "y": "ay"}), by)
    dy = F.col("ay") - F.col("y")
    pairs = pairs.filter(dy >= F.when(F.col("kind") == "table", -60).otherwise(-14))
    distance = F.abs(dy) + F.when(F.col("column") != F.col("anchor_column"), 400).otherwise(0)
    return pairs.withColumn("d", distance).filter("d <= 760").groupBy(*by, "point").agg(F.min_by("anchor", F.struct("d", "anchor")).alias("anchor"))


def previous(rows: DataFrame, by: list[str], order: list[str], value: Column) -> Column:
    return F.lag(value).over(W.partitionBy(*by).orderBy(*order))


def union_rectangles(words: DataFrame, by: list[str]) -> DataFrame:
    """The bounding box of the words of each line."""
    return words.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
