"""Benchmark decontamination on a distributed positional inverted index, in DataFrame functions only.

The index holds (row, position, term) for every corpus word that some benchmark item uses, written once in the order
of the corpus. Each window of an item is looked up from its rarest term; the offset-adjusted positions are
intersected with the list of its second rarest; what is left is intersected with the lists of all terms of the item.
Runs of matched positions that span a whole window are exact phrase matches. Proximity matches are found the same way
with some slack: with the window laid so that its rarest word fits (the first of equally rare ones), every other word
stands within `slop` words of its place; the second rarest is looked up first and the rest only where it is found.

Defined results: null and empty texts have no words, match nothing and are returned; rows that repeat an id are judged
one by one; an item without words has no window; rows with a null item id take part under that null and count as no
item; an empty benchmark leaves all documents clean. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import LOWER, UPPER, ascii_lower, kept, read, small_side

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def item_terms(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, m, width, j, term): word j of each item of m words; width is the length of its windows."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).dropDuplicates()
    items = items.withColumn("item", F.monotonically_increasing_id())
    return items.select("item", "item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(window)).alias("width"), F.posexplode("w").alias("j", "term"))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, pos, term_id), a row for each corpus word in the vocabulary (term, term_id), and for each document's first word or lack of words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("w"))
    rows = rows.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "term"))
    return kept(rows.join(vocabulary, "term", "left").filter("term_id is not null or pos is null or pos = 0").drop("term"), "postings")


def rarest_pairs(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(item, start, j1, t1, j2, t2): places and terms by which each window that can occur at all is looked up, rarest first."""
    counts = index.filter("term_id is not null").groupBy("term_id").agg(F.count("*").alias("cf"))
    ranked = terms.join(counts, "term_id", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("j") - F.col("width") + 1), F.least(F.col("j"), F.col("m") - F.col("width")))
    windows = ranked.withColumn("start", F.explode(starts)).groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct("cf", "j", "term_id"))).alias("l"))
    second = F.when(F.size("l") > 1, F.get("l", F.lit(1))).otherwise(F.get("l", F.lit(0)))
    windows = windows.filter(F.get("l", F.lit(0))["cf"] > 0).select("item", "start", F.get("l", F.lit(0)).alias("a"), second.alias("b"))
    return windows.select("item", "start", F.col("a.j").alias("j1"), F.col("a.term_id").alias("t1"), F.col("b.j").alias("j2"), F.col("b.term_id").alias("t2"))


def _rarest(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Occurrences of each lookup's rarest term, with the place where its second one must be."""
    postings = index.filter("term_id is not null").select("row", "pos", "term_id")
    found = postings.join(asked.withColumnRenamed("t1", "term_id"), "term_id").withColumn("shift", F.col("pos") - F.col("j1"))
    return found.select("row", "item", "shift", (F.col("shift") + F.col("j2")).alias("pos"), F.col("t2").alias("term_id"))


def phrase_matches(index: DataFrame, terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, item, item_id, first, last): maximal runs of document words that are covered by windows of one item, at one alignment."""
    seconds = small_side(asked.select(F.col("t2").alias("term_id")).distinct())
    postings = index.filter("term_id is not null").select("row", "pos", "term_id")
    second = postings.join(seconds, "term_id", "left_semi")
    aligned = kept(_rarest(index, asked).join(second, ["row", "pos", "term_id"], "left_semi").select("row", "item", "shift").distinct(), "alignments")
    rows = small_side(kept(aligned.select("row").distinct(), "rows"))
    wanted = aligned.join(small_side(terms), "item").select("row", "item", "item_id", "width", "shift", "j", "term_id", (F.col("shift") + F.col("j")).alias("pos"))
    matched = wanted.join(postings.join(rows, "row", "left_semi"), ["row", "pos", "term_id"], "left_semi")
    order = W.partitionBy("row", "item", "shift").orderBy("j")
    runs = matched.withColumn("run", F.col("j") - F.row_number().over(order)).groupBy("row", "item", "item_id", "width", "shift", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.filter(F.col("last") - F.col("first") + 1 >= F.col("width")).select("row", "item", "item_id", "first", "last")


def _near(wanted: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """The rows of wanted (row, term_id, at, ...) whose term stands within slop words of `at`, once for each place."""
    size = 2 * slop + 1
    near = F.array(*(F.floor((F.col("at") + d) / size) for d in (-slop, slop)))
    wanted = wanted.withColumn("bucket", F.explode(F.array_distinct(near)))
    return wanted.join(postings.withColumn("bucket", F.floor(F.col("pos") / size)), ["row", "term_id", "bucket"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop).drop("bucket", "pos")


def proximity_matches(index: DataFrame, terms: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """(row, item, item_id): items with a window all of whose words stand within slop words of their places, as counted from its rarest."""
    postings = index.filter("term_id is not null").select("row", "pos", "term_id")
    asked = small_side(kept(windows.select("item", "j1", "t1", "j2", "t2").distinct(), "lookups"))
    found = postings.join(asked.withColumnRenamed("t1", "term_id"), "term_id").withColumn("shift", F.col("pos") - F.col("j1"))
    found = found.select("row", "item", "j1", "j2", "shift", (F.col("shift") + F.col("j2")).alias("at"), F.col("t2").alias("term_id"))
    seconds = small_side(kept(windows.select(F.col("t2").alias("term_id")).distinct(), "second-terms"))
    pairs = kept(_near(found, postings.join(seconds, "term_id", "left_semi"), slop).select("row", "item", "j1", "j2", "shift").distinct(), "near-pairs")
    laid = pairs.join(small_side(windows.select("item", "start", "j1", "j2")), ["item", "j1", "j2"]).select("row", "item", "start", "shift")
    wanted = laid.join(small_side(terms), "item").filter("j >= start and j < start + width")
    wanted = wanted.select("row", "item", "item_id", "start", "shift", "width", "j", "term_id", (F.col("shift") + F.col("j")).alias("at"))
    rows = small_side(kept(pairs.select("row").distinct(), "near-rows"))
    placed = _near(wanted, postings.join(rows, "row", "left_semi"), slop).groupBy("row", "item", "item_id", "start", "shift", "width").agg(F.countDistinct("j").alias("n"))
    return placed.filter("n = width").select("row", "item", "item_id").distinct()


def prepare(docs: DataFrame, benchmark: DataFrame, window: int, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, the items' terms and the windows with their rarest pairs."""
    terms = kept(item_terms(benchmark, window), "item-terms")
    vocabulary = kept(terms.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "vocabulary")
    terms = kept(terms.join(vocabulary, "term").drop("term"), "item-terms")
    index = build_index(docs, small_side(vocabulary), **columns)
    return index, terms, kept(rarest_pairs(terms, index), "windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = 3, **columns: str) -> DataFrame:
    """(row, doc_id, n_words, spans, items, near) per document: spans of hit words as (first, last), the ids of the items found, and those of the items that match at least by proximity (none are sought where slop is None)."""
    index, terms, windows = prepare(docs, benchmark, window, **columns)
    asked = small_side(kept(windows.select("item", "j1", "t1", "j2", "t2").distinct(), "lookups"))
    found = phrase_matches(index, terms, asked).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.collect_set("item_id").alias("items"))
    every = index.filter("pos is null or pos = 0").select("row", "doc_id", "n_words")
    out = every.join(found, "row", "left")
    ids = found.schema["items"].dataType
    if slop is None:
        out = out.withColumn("near", F.lit(None).cast(ids))
    else:
        out = out.join(proximity_matches(index, terms, windows, slop).groupBy("row").agg(F.collect_set("item_id").alias("near")), "row", "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    return out.withColumns({"spans": F.sort_array(F.coalesce("spans", none)), "items": F.coalesce("items", F.array().cast(ids)), "near": F.coalesce("near", F.array().cast(ids))})


def hit_words(spans: Column) -> Column:
    """Words that sorted spans cover, each counted once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    new = lambda a, s: F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["end"] + 1) + 1)
    return F.aggregate(spans, start, lambda a, s: F.struct((a["n"] + new(a, s)).alias("n"), F.greatest(a["end"], s["last"]).alias("end")), lambda a: a["n"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM win),
grams AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - l + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, i, l FROM grams JOIN win USING (g, l)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
pos AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p FROM d),
cf AS (SELECT term, count(*) AS cf FROM pos GROUP BY term),
bi AS (SELECT row_number() OVER () AS item, * FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
bt AS (SELECT item, item_id, least(10, len(w)) AS width, len(w) AS m, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS j FROM bi),
bw AS (SELECT item, s, j, term, cf FROM bt LEFT JOIN cf USING (term), unnest(range(greatest(0, j - width + 1), least(j, m - width) + 1)) AS t(s)
       QUALIFY row_number() OVER (PARTITION BY item, s ORDER BY coalesce(cf, 0), j) = 1),
laid AS (SELECT r, item, s, p - j AS shift FROM bw JOIN pos USING (term)),
near AS (SELECT DISTINCT r, item_id FROM (
         SELECT l.r, bt.item_id, l.item, l.s, l.shift FROM laid l JOIN bt ON bt.item = l.item AND bt.j >= l.s AND bt.j < l.s + bt.width
         JOIN pos ON pos.r = l.r AND pos.term = bt.term AND abs(pos.p - l.shift - bt.j) <= 3
         GROUP BY l.r, bt.item_id, l.item, l.s, l.shift, bt.width HAVING count(DISTINCT bt.j) = bt.width)),
nn AS (SELECT r, count(item_id) AS n_near FROM near GROUP BY r)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN nn USING (r)
"""
