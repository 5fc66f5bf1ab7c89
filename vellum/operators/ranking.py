"""Leaderboards: filters, ranks, shading thresholds and medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.storage import kept, small_side

#: Rows that one task ranks at a time.
RANK_BLOCK = 100_000


def leaderboard(rows: DataFrame, metric: str, key: str, n: int = 30, title: str | None = None, q: str = "", source: str | None = None, exclude: tuple[str, ...] = (), hide_partial: bool = False) -> DataFrame:
    """The first n rows by the metric, largest first, the key breaking ties, with distinct ranks."""
    pool = rows.filter(F.col(metric).isNotNull())
    if title and q:
        pool = pool.filter(F.lower(title).contains(q.lower()))
    if source and exclude:
        pool = pool.filter(~F.col(source).isin(*exclude))
    if hide_partial:
        pool = pool.filter("not partial")
    top = pool.orderBy(F.desc(metric), key).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(metric), key)))  # over n rows


def ranked(rows: DataFrame, order: list[str | Column], name: str = "rank", block: int | None = None) -> DataFrame:
    """All rows with their place in an order, from 1, distributed: rows are dealt by ranges of the order into blocks of some `block` rows, ranked within them, and moved on by the rows of the blocks before.

    The order should have no ties. Up to `block` rows are ranked at once; beyond, the dealt rows are stored, so that all steps see the same blocks."""
    block = RANK_BLOCK if block is None else block
    n = rows.count()
    if n <= block:
        return rows.withColumn(name, F.row_number().over(W.orderBy(*order)))
    dealt = kept(rows.repartitionByRange(-(-n // block), *order).withColumn("_block", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_block").agg(F.count("*").alias("n"))
    before = counts.select("_block", F.coalesce(F.sum("n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each block
    placed = dealt.join(small_side(kept(before, "blocks")), "_block").withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy("_block").orderBy(*order)))
    return placed.drop("_block", "_before")


def nulls_last(rows: DataFrame, column: str, key: str, descending: bool, block: int | None = None) -> DataFrame:
    """All rows with their rank by a column, nulls last in both directions, the key breaking ties."""
    value = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return ranked(rows, [value, key], block=block)


def shaded(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, threshold): the third largest positive value of each group, repeats counted, or the smallest of fewer."""
    ranked = rows.filter(F.col(value) > 0).withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value))))
    return ranked.filter("r <= 3").groupBy(*by).agg(F.min(value).alias("threshold"))


def upper_median(rows: DataFrame, by: list[str], value: str, block: int | None = None) -> DataFrame:
    """The middle value, of an even number the upper one of the two in the middle.

    Groups of more than `block` rows are counted in blocks between approximate percentiles, as many as the largest group needs, and only the rows of the
    block that holds the middle are ranked. The percentiles only set the bounds; the result is exact."""
    block = RANK_BLOCK if block is None else block
    rows = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    largest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block:
        w = W.partitionBy(*by)
        middle = rows.withColumns({"_r": F.row_number().over(w.orderBy("_v")), "_m": F.floor(F.count("*").over(w) / 2) + 1})
        return middle.filter("_r = _m").select(*by, F.col("_v").alias("median"))
    steps = math.ceil(math.log2(largest / block))
    at = [k / 2**steps for k in range(1, 2**steps)]
    bounds = rows.groupBy(*by).agg(F.percentile_approx("_v", at, max(1000, 8 << steps)).alias("_bounds"))  # a row for each group
    dealt = rows.join(bounds, by).withColumn("_block", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")
    counts = dealt.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy("_block")
    placed = counts.withColumns({"_upto": F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)), "_c": F.sum("_n").over(W.partitionBy(*by))})
    middle = F.floor(F.col("_c") / 2) + 1
    wanted = placed.filter((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_n") < middle)).select(*by, "_block", (middle - F.col("_upto") + F.col("_n")).alias("_r"))
    ranked = dealt.join(wanted, [*by, "_block"]).withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy("_v")))
    return ranked.filter("_rank = _r").select(*by, F.col("_v").alias("median"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def contributions(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each non-null part of a mean: value divided by the number of non-null values of its group."""
    return rows.filter(F.col(value).isNotNull()).withColumn("part", F.col(value) / F.count(value).over(W.partitionBy(*by)))
