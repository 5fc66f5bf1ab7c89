"""Places of all matches of a pattern in a text, as column functions that stay in the JVM.

The pieces between the matches and the matches themselves follow each other, so the place of each match is the sum of the
lengths before it. Sums run over an array in log2(n) rounds, each adding what stands 1, 2, 4, ... places before, so that
a text with many matches costs n log n and not n squared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import TOKEN, bound


def running_sums(numbers: Column) -> Column:
    """Sums of an array of integers up to each place; null for null, empty for empty."""

    def add(sums: Column, step: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), step)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0).cast("long")))

    def summed(wide: Column) -> Column:
        rounds = F.when(F.size(wide) > 1, F.ceil(F.log2(F.size(wide).cast("double"))).cast("int")).otherwise(0)
        return F.aggregate(F.slice(F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1), F.lit(1), rounds), wide, add)

    return bound(F.transform(numbers, lambda x: x.cast("long")), summed)


#: Up to so many matches of a text are placed by plain sums, more of them by running_sums.
FEW = 16


def match_spans(text: Column, pattern: str | Column) -> Column:
    """(at, end, match) structs of all matches, in order: characters from `at`, counted from 0, up to but without `end`.

    The pattern has to match at least one character. A null text gives null, a text without matches an empty array.
    Matches are marked in one pass, and the text is cut at the marks; a text that holds the mark itself is searched twice, for the matches and for what stands between them."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def searched(t: Column) -> Column:
        found = F.regexp_extract_all(t, pattern, F.lit(0))
        return bound(found, lambda m: F.struct(m.alias("found"), F.slice(F.split(t, pattern, -1), F.lit(1), F.size(m)).alias("between")))

    def marked(t: Column) -> Column:
        pieces = F.split(F.regexp_replace(t, pattern, F.lit("\0$0\0")), "\0", -1)
        nth = lambda rest: lambda _, i: i % 2 == rest
        return bound(pieces, lambda p: F.struct(F.filter(p, nth(1)).alias("found"), F.slice(F.filter(p, nth(0)), F.lit(1), F.shiftright(F.size(p), 1)).alias("between")))

    def placed(s: Column) -> Column:
        lengths = F.zip_with(s["between"], s["found"], lambda b, m: F.length(b) + F.length(m))
        plain = bound(lengths, lambda n: F.transform(n, lambda _, i: F.aggregate(F.slice(n, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x).cast("long")))
        ends = F.when(F.size(s["found"]) <= FEW, plain).otherwise(running_sums(lengths))
        return F.zip_with(s["found"], ends, lambda m, e: F.struct((e - F.length(m)).cast("int").alias("at"), e.cast("int").alias("end"), m.alias("match")))

    def every(t: Column) -> Column:
        parts = F.when(t.contains("\0"), searched(t)).otherwise(marked(t))
        nothing = F.array().cast("array<struct<at:int,end:int,match:string>>")
        return F.when(t.isNotNull(), bound(parts, lambda s: F.when(F.size(s["found"]) == 0, nothing).otherwise(placed(s))))

    return bound(text, every)


def token_spans(text: Column) -> Column:
    """(at, end, token) structs of the word tokens of a text, in lower case."""
    return F.transform(match_spans(text, TOKEN), lambda s: F.struct(s["at"].alias("at"), s["end"].alias("end"), F.lower(s["match"]).alias("token")))
