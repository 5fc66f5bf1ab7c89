"""How far the sources of a language differ in their words, by an inverted index of corrections to a baseline.

For each language the terms that enough of its documents hold make its vocabulary of V terms. A group, that is a source within a language,
gives a term of count c the smoothed rate p = 1 + floor(scale * (c + add) / (N + add * V)), with N the group's count of kept terms. Two groups
are as far apart as the sum of the differences of their rates over the whole vocabulary. Most counts are zero, so a pair starts at V times f,
the difference of its rates of zero, and only terms that one of the two holds correct it. With p_a, p_b a term's rates and z_a, z_b those of zero,
the correction is split: |p_a - z_b| - f for each term of a, which depends on the rate alone and is summed over a's rates with the number of terms that have them;
the same for b; and |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + f where both hold the term, which the term's postings emit, each pair of groups once and only where it is not zero.
Within a group the terms that it uses more than its language are ranked by a window.

All arithmetic is exact: rates by integer division of decimals of 38 digits, sums of integers. A posting list holds a term's groups, not its documents, so it is bounded
by the number of sources; corrections are summed in each task before they are shuffled.

Defined results: null texts, languages and sources are empty strings; each row is a document of its own, whatever its id; a group without kept terms, or a
language without any, takes part with zeros, its pairs with a value of 0 where V is 0; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import LOWER, UPPER, ascii_lower, kept, read, small_side

#: Fixed by the query's contract: a term, after A-Z have become a-z.
TERM = r"[^\x00-\x60\x7B-\x7F]+"


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; one scan, summed in each task before the shuffle."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.regexp_extract_all(ascii_lower(text(text_col)), F.lit(TERM), F.lit(0)).alias("terms"))
    # A row's terms once as they come and once without repeats: the first are occurrences, the second the document.
    both = rows.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    each = both.select("lang", "source", F.col("once").cast("long").alias("once"), F.explode("terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _rate(n: Column, total: Column, size: Column, add: int, scale: int) -> Column:
    whole = lambda c: c.cast("decimal(20,0)")
    above, below = F.lit(scale).cast("decimal(12,0)") * (whole(n) + add), whole(total) + add * whole(size)
    return 1 + F.call_function("div", above, below)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, add: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for each other source of the language, part `term` for the `top` terms that a group uses more than its language."""
    index = term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("postings"))
    index = kept(index.filter(F.col("docs") >= least_docs).select("lang", "term", "n", "postings"), "index")
    rows = index.select("lang", "term", F.col("n").alias("lang_n"), F.explode("postings").alias("p")).select("lang", "term", "lang_n", "p.*")
    every = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    langs = index.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = every.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("size", "lang_total", "total")))
    groups = groups.withColumn("z", F.when(F.col("size") > 0, _rate(zero, F.col("total"), F.col("size"), add, scale)).otherwise(zero))
    groups = kept(groups, "groups")
    rated = rows.join(small_side(groups), ["lang", "source"])
    rated = rated.withColumns({"p": _rate(F.col("n"), F.col("total"), F.col("size"), add, scale), "q": _rate(F.col("lang_n"), F.col("lang_total"), F.col("size"), add, scale)})
    rated = kept(rated.select("lang", "source", "term", "z", "p", "q"), "rates")
    values = _pair_values(groups, rated)
    terms = rated.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = values.withColumns({"part": F.lit("pair"), "rank": place}).select(*out)
    return pairs.unionByName(terms.withColumn("rank", place).filter(F.col("rank") <= top).withColumn("part", F.lit("term")).select(*out))


def _pair_values(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each group and each other source of its language."""
    side = lambda n: groups.select("lang", F.col("source").alias(f"s{n}"), F.col("z").alias(f"z{n}"), "size")
    couples = side(1).join(side(2).drop("size"), "lang").filter("s1 <> s2")
    apart = F.abs(F.col("z1") - F.col("z2"))
    least, most = F.least("s1", "s2"), F.greatest("s1", "s2")
    base = couples.filter("s1 < s2").select("lang", "s1", "s2", (F.col("size") * apart).alias("value"))
    alike = rated.groupBy("lang", F.col("source").alias("s1"), "p").agg(F.count("*").alias("terms"))
    alone = alike.join(couples.drop("size"), ["lang", "s1"]).select("lang", least.alias("s1"), most.alias("s2"), (F.col("terms") * (F.abs(F.col("p") - F.col("z2")) - apart)).alias("value"))
    postings = rated.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("postings"))
    left = postings.select("lang", "postings", F.posexplode("postings").alias("at", "a"))
    met = left.select("lang", "a", F.explode(F.slice("postings", F.col("at") + 2, F.size("postings"))).alias("b"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = met.select("lang", F.col("a.source").alias("s1"), F.col("b.source").alias("s2"), (gap("a.p", "b.p") - gap("a.p", "b.z") - gap("a.z", "b.p") + gap("a.z", "b.z")).alias("value"))
    summed = base.unionByName(alone.filter("value <> 0")).unionByName(both.filter("value <> 0")).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"))))
    return summed.select("lang", ways.alias("w"), "value").select("lang", "w.*", "value")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
r AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN vocabulary k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
w AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM r WHERE n > 0 AND p > q),
e AS (SELECT * FROM p UNION ALL SELECT * FROM w)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM e QUALIFY part = 'pair' OR rank <= 50
"""
