"""Reports in short: the table of measures, a report's head, its text, the metric asked for, and claims that reach past their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.measures import MEASURES, WORK_NAME, aggregate, plane_scores

# Names of the measures, and what is said of a report's source.
NAMES = {
    "cross_refs": "Cross-section references",
    "macro_redundancy": "Macro redundancy",
    "argument_graph": "Argument graph",
    "citation_isolation": "Citation isolation",
    "figure_exposition": "Figure exposition",
    "evidence_gap": "Evidence gap",
}
FROM_LATEX = "LaTeX source: labels, references and citations are read directly."
FROM_PDF = "PDF reconstruction: headings, captions, printed references and citations are recovered from the layout, as the paper does for PDF-only submissions."
UNTITLED = "Untitled paper"
# Words of an asserted phrase that count, and covered items up to which a class is too little.
LONGEST_PHRASE, FEW_ITEMS = 8, 2


def measure_table(spark: SparkSession) -> DataFrame:
    """(place, key, name, plane, method, unit, pair_accuracy, auroc): the six measures."""
    rows = [(i, key, NAMES[key], *rest) for i, (key, *rest) in enumerate(MEASURES)]
    return spark.createDataFrame(rows, "place int, key string, name string, plane string, method string, unit string, pair_accuracy double, auroc double")


def heads(docs: DataFrame) -> DataFrame:
    """docs (doc_id, title, fallback, source, ...) with the title shown and what is said of the source."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("fallback", F.lit("")), F.lit(UNTITLED))
    return docs.withColumns({"title": title, "fidelity": F.when(F.col("source") == "latex", FROM_LATEX).otherwise(FROM_PDF)}).drop("fallback")


def metrics(results: DataFrame) -> DataFrame:
    """(doc_id, metrics): one map for each paper, from `index`, `plane:...` and `m:...` to values up to 100; results as aggregate() takes them."""
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(name.alias("key"), value.cast("double").alias("value")))
    per_measure = results.groupBy("doc_id").agg(F.collect_list(entry(F.concat(F.lit("m:"), "key"), 100 * F.col("score"))).alias("ms"))
    per_plane = plane_scores(results).groupBy("doc_id").agg(F.collect_list(entry(F.concat(F.lit("plane:"), "plane"), 100 * F.col("score"))).alias("ps"))
    whole = aggregate(results).select("doc_id", F.array_compact(F.array(entry(F.lit("index"), F.col("index")))).alias("one"))
    # A paper holds each measure once; if it does not, the least value of the name stays.
    entries = F.array_sort(F.concat("one", "ps", "ms"))
    first = F.filter(entries, lambda e, i: (i == 0) | (e["key"] != F.get(entries, i - 1)["key"]))
    return whole.join(per_plane, "doc_id").join(per_measure, "doc_id").select("doc_id", F.map_from_entries(first).alias("metrics"))


def metric(name: str) -> Column:
    """The value of a metric out of metrics(); null where the paper has none."""
    return F.try_element_at("metrics", F.lit(name))


def padded(text: Column, width: int) -> Column:
    """A text filled with blanks up to a width; a longer one stays whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(text))))


def report_text(docs: DataFrame, results: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, report): each paper's report as lines: title, index, planes, measures in the order of the table.

    docs (doc_id, title); results (doc_id, key, plane, status, score, num, den); table as measure_table() makes it."""
    known = results.join(table.select("place", "key", "name"), "key")
    num = F.when(F.col("num") == F.floor("num"), F.floor("num").cast("string")).otherwise(F.col("num").cast("string"))
    ratio = F.when(F.col("score").isNull(), "—").otherwise(F.format_string("%.3f (%s/%s)", "score", num, "den"))
    line = F.concat(F.lit("    "), padded(F.col("name"), 26), F.lit(" "), padded(F.col("status"), 8), F.lit(" "), ratio)
    ms = known.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("ms"))
    value = F.when(F.col("score").isNull(), "—").otherwise(F.bround(100 * F.col("score")).cast("int").cast("string"))
    # Planes by the place of their first measure.
    planes = known.groupBy("doc_id", "plane").agg(F.min("place").alias("place"), F.avg(F.when(F.col("status") == "done", F.col("score"))).alias("score"))
    ps = planes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("  "), padded(F.col("plane"), 10), F.lit(" "), value).alias("line")))).alias("ps"))
    index = F.concat(F.lit("  Index: "), F.coalesce(F.col("index").cast("string"), F.lit("—")), F.lit(" / 100"), F.when(F.col("partial"), "  (partial)").otherwise(""))
    every = docs.select("doc_id", "title").join(aggregate(results), "doc_id").join(ps, "doc_id").join(ms, "doc_id")
    lines = F.concat(F.array(F.col("title"), index), F.transform("ps", lambda p: p["line"]), F.transform("ms", lambda m: m["line"]))
    return every.select("doc_id", F.array_join(lines, "\n").alias("report"))


def overreach(claims: DataFrame, covered: DataFrame, limits: DataFrame) -> DataFrame:
    """(claim, run, phrase_counts, n_items, verdict) of what each run asserts of a claim (claim, run, text, phrase, class, qualifier).

    A phrase counts if it stands in the claim, in any case, has at most LONGEST_PHRASE words and is no name of a work. FAIL: a phrase
    counts, or a class with a qualifier is covered by at most FEW_ITEMS different items (claim, class, item). A sentence that limits
    the same claim (claim) makes it PASS, as does everything else. Null texts, phrases and classes assert nothing."""
    items = covered.groupBy("claim", "class").agg(F.countDistinct("item").alias("n_items"))
    limited = limits.select("claim", F.lit(True).alias("limited")).distinct()
    phrase = F.trim(F.coalesce("phrase", F.lit("")))
    counts = (phrase != "") & F.coalesce(F.contains(F.lower("text"), F.lower(phrase)), F.lit(False)) & (F.size(F.split(phrase, r"\s+")) <= LONGEST_PHRASE) & ~phrase.rlike(f"^{WORK_NAME}$")
    both = claims.join(items, ["claim", "class"], "left").join(limited, "claim", "left").withColumns({"phrase_counts": counts, "n_items": F.coalesce("n_items", F.lit(0))})
    few = F.col("class").isNotNull() & (F.coalesce("qualifier", F.lit("")) != "") & (F.col("n_items") <= FEW_ITEMS)
    failed = (F.col("phrase_counts") | few) & F.col("limited").isNull()
    return both.select("claim", "run", "phrase_counts", "n_items", F.when(failed, "FAIL").otherwise("PASS").alias("verdict"))
