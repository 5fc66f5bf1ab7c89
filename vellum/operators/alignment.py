"""Where passages stand in documents that repeat them, and objects that stand for each other.

A passage is cut into runs of words, and each run is looked up among the runs of the documents' pages by an equality join
of hashes. The page that most runs meet is taken, with the one after it; then the runs are followed in order, each to its
occurrence closest to where the one before lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import CITE, MATH, REF
from vellum.operators.listings import plain_token
from vellum.storage import kept, small_side

# Words of a run, from one run to the next, the fewest words of a run, and how far apart the ends of a place may be.
RUN, STRIDE, LEAST = 5, 3, 3
FAR_TIMES, FAR_MORE = 3, 20
_STAND_INS = "|".join(s.replace("[", r"\[").replace("]", r"\]") for s in (CITE, MATH, REF))


def plain_words(text: Column) -> Column:
    """Words between white space in plain letters and digits, without those that hold none."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: plain_token(w)), lambda w: w != "")


def runs_of(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, words, total): runs of RUN words at every STRIDE, and the last ones, of each segment between stand-ins that has LEAST words or more; `at` counts a word for each stand-in, `total` is the count at the end."""
    segments = F.transform(F.split(text_col, _STAND_INS), lambda s: plain_words(s))
    cut = passages.select(F.col(id_col).alias("id"), F.posexplode(segments).alias("seg", "words")).withColumn("n", F.size("words"))
    order = W.partitionBy("id").orderBy("seg")
    placed = cut.withColumns({"before": F.coalesce(F.sum(F.col("n") + 1).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum(F.col("n") + 1).over(W.partitionBy("id"))}).filter(F.col("n") >= LEAST)
    size = F.least(F.lit(RUN), F.col("n"))
    starts = F.sequence(F.lit(0), F.col("n") - size, F.lit(STRIDE))
    tail = F.when((F.col("n") > size) & ((F.col("n") - size) % STRIDE != 0), F.array(F.col("n") - size)).otherwise(F.array().cast("array<int>"))
    each = placed.select("id", "before", "total", "words", size.alias("size"), F.explode(F.concat(starts, tail)).alias("i"))
    return each.select("id", (F.col("before") + F.col("i")).alias("at"), F.slice("words", F.col("i") + 1, F.col("size")).alias("words"), "total")


def located(passages: DataFrame, pages: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, doc_id, page, first, last, met): where passages stand in documents, as words of a page (counted from 0 among its plain words); pages (doc_id, page, text).

    met: the runs that were found there. Of pages that equally many runs meet the first is taken. Places whose ends lie further apart than a sentence could are left out.
    Hits are joined on hashes of whole runs and confirmed word by word; a passage and a document meet in one row, whose hits are those of two pages."""
    runs = kept(runs_of(passages, id_col, text_col).withColumn("h", F.xxhash64("words")).withColumnRenamed("words", "said"), "runs")
    sizes = [r[0] for r in runs.select(F.size("said")).distinct().collect()]  # three numbers at most
    words = pages.select("doc_id", "page", plain_words(F.col("text")).alias("w"))
    grams = [_grams(words, n) for n in sizes or [RUN]]
    every = grams[0]
    for more in grams[1:]:
        every = every.unionByName(more)
    hits = every.withColumn("h", F.xxhash64("words")).join(small_side(runs), "h").filter(F.col("words") == F.col("said"))
    hits = kept(hits.select("id", "doc_id", "page", "i", "at", "total", F.size("words").alias("size")), "hits")
    votes = hits.groupBy("id", "doc_id", "page").agg(F.countDistinct("at").alias("votes"))
    best = votes.groupBy("id", "doc_id").agg(F.min_by("page", F.struct(-F.col("votes"), "page")).alias("best"))
    near = hits.join(small_side(kept(best, "best")), ["id", "doc_id"]).filter((F.col("page") == F.col("best")) | (F.col("page") == F.col("best") + 1))
    found = near.groupBy("id", "doc_id", "total", "at", "size").agg(F.array_sort(F.collect_list(F.struct("page", "i"))).alias("where"))
    chained = found.groupBy("id", "doc_id", "total").agg(F.array_sort(F.collect_list(F.struct("at", "size", "where"))).alias("steps"))
    place = "struct<page:int,i:int,at:long,size:int>"

    def follow(state: Column, step: Column) -> Column:
        last = F.get(state, F.size(state) - 1)
        cost = lambda c: F.when(F.size(state) == 0, F.lit(0).cast("long")).when(c["page"] == last["page"], F.abs((c["i"] - last["i"]) - (step["at"] - last["at"]))).otherwise(F.lit(1_000_000) + c["i"])
        ranked = F.array_sort(F.transform(step["where"], lambda c: F.struct(cost(c).alias("cost"), c["page"].alias("page"), c["i"].alias("i"))))
        taken = F.get(ranked, F.lit(0))
        return F.concat(state, F.array(F.struct(taken["page"].cast("int").alias("page"), taken["i"].cast("int").alias("i"), step["at"].cast("long").alias("at"), step["size"].cast("int").alias("size"))))

    followed = chained.select("id", "doc_id", "total", F.explode(F.aggregate("steps", F.array().cast(f"array<{place}>"), follow)).alias("p")).select("id", "doc_id", "total", "p.*")
    spans = followed.groupBy("id", "doc_id", "total", "page").agg(F.min("i").alias("first"), F.max(F.col("i") + F.col("size") - 1).alias("last"), F.count("*").alias("met"))
    return spans.filter(F.col("last") - F.col("first") <= FAR_TIMES * F.col("total") + FAR_MORE).select("id", "doc_id", "page", "first", "last", "met")


def _grams(words: DataFrame, n: int) -> DataFrame:
    """(doc_id, page, i, words): all runs of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.slice("w", i, n))
    return words.filter(F.size("w") >= n).select("doc_id", "page", F.posexplode(runs).alias("i", "words"))


def matched_objects(own: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """(by, own_id, other_id, tier): objects (by, id, kind, number, title) of one side with those of another, one to one: by kind and printed number first, the rest by kind and title.

    Among objects that agree, the n-th of one side goes with the n-th of the other, in the order of their ids; what has no number or title does not agree in it. No object is taken twice."""

    def paired(a: DataFrame, b: DataFrame, on: Column, tier: str) -> DataFrame:
        numbered = lambda df, name: df.withColumn("key", on).filter("key is not null and key <> ''").withColumn("nth", F.row_number().over(W.partitionBy(*by, "kind", "key").orderBy("id"))).select(*by, "kind", "key", "nth", F.col("id").alias(name))
        return numbered(a, "own_id").join(numbered(b, "other_id"), [*by, "kind", "key", "nth"]).select(*by, "own_id", "other_id", F.lit(tier).alias("tier"))

    first = kept(paired(own, other, F.col("number"), "number"), "matched")
    taken = small_side(first)
    left = own.join(taken.select(*by, F.col("own_id").alias("id")), [*by, "id"], "left_anti")
    right = other.join(taken.select(*by, F.col("other_id").alias("id")), [*by, "id"], "left_anti")
    return first.unionByName(paired(left, right, plain_title(F.col("title")), "title"))


def plain_title(title: Column) -> Column:
    """A title without its number, in plain letters and digits."""
    return plain_token(F.regexp_replace(title, r"^§\S*\s*", ""))
