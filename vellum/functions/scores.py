"""Numbers and labels of the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where there is nothing to divide by."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def index_of(score: Column) -> Column:
    """0 to 100, halves to the even neighbour."""
    return F.bround(score * 100, 0).cast("int")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def shown(score: Column) -> Column:
    """Percent as displayed: <1 for what rounds to nothing but is something."""
    return F.when((score > 0) & (score * 100 < 1), F.lit("<1")).otherwise(half_up(score * 100).cast("string"))


def band(index: Column) -> Column:
    return F.when(index.isNull(), None).when(index < 20, "Low").when(index < 40, "Moderate").when(index < 60, "High").otherwise("Very high")


def axis_top(most: Column) -> Column:
    """End of a percent axis: a tenth-round number somewhat above the largest value, 20 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(20), F.ceil(most * 1.15 / 10) * 10))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit("…"))).otherwise(text)


def initials(name: Column) -> Column:
    """First letters of the first two words."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
