"""Sorted lists, roll-ups by section, submissions and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Labels of a proposal's status by precedence, the order in which they are listed, and the kinds of a list's limits.
STATUS_PRECEDENCE = ["accepted", "not-adopted", "testing", "under-review"]
STATUS_ORDER = ["accepted", "testing", "under-review", "not-adopted"]
RECENT, SHOWN, LATEST = 30, 12, 500
LEAST_QUOTE, LEAST_PROMPT = 10, 20
MAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
LEAST_WEIGHT = 4
# Fields in the body of an issue.
BODY_FIELDS = {"plane": r"\*\*Plane:\*\* (\w+)", "what": r"\*\*What it is:\*\* (.+)", "author": r"Proposed by (.+?)\."}


def status(labels: Column) -> Column:
    """The first status by precedence that is among the labels, else under-review."""
    return F.coalesce(*(F.when(F.array_contains(labels, s), s) for s in STATUS_PRECEDENCE), F.lit("under-review"))


def proposals(issues: DataFrame, local: DataFrame) -> DataFrame:
    """(id, name, status, created, plane, what, author, listed) of issues (id, title, labels, created, body) and of local proposals (id, name, issue_url, created) without an issue; plane, what and author are fields of an issue's body; listed: the status's place in the list."""
    field = lambda name: F.regexp_extract("body", BODY_FIELDS[name], 1)
    fields = [F.nullif(F.lower(field("plane")), F.lit("")).alias("plane"), F.coalesce(F.trim(field("what")), F.lit("")).alias("what"), F.coalesce(F.nullif(field("author"), F.lit("")), F.lit("Anonymous")).alias("author")]
    known = issues.select("id", F.regexp_replace("title", r"^Proposal:\s*", "").alias("name"), status(F.col("labels")).alias("status"), "created", *fields)
    own = local.filter("issue_url is null or issue_url = ''").select("id", "name", F.lit("under-review").alias("status"), "created", F.lit(None).cast("string").alias("plane"), F.lit("").alias("what"), F.lit("Anonymous").alias("author"))
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    return known.unionByName(own).withColumn("listed", place)


def recent(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The RECENT latest keys with their last place, newest first, the first SHOWN marked."""
    last = rows.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(RECENT)
    rank = F.row_number().over(W.orderBy(F.desc(at), key))  # over RECENT rows
    return last.withColumn("rank", rank).withColumn("shown", F.col("rank") <= SHOWN)


def latest(rows: DataFrame, at: str, *ties: str, n: int = LATEST) -> DataFrame:
    """The n newest rows, which is what the list shows; `ties` decide among equally new ones, larger first."""
    return rows.orderBy(*(F.desc(c) for c in (at, *ties))).limit(n)


def totals(rows: DataFrame, at: str) -> DataFrame:
    """(analyses, since, days) of a log, one row: all its rows, those with a bad or no date too, the first valid day and the number of those; `since` is null where no row has a day."""
    day = F.get(F.split(at, " "), F.lit(0))
    valid = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)
    by_day = rows.groupBy(valid.alias("day")).agg(F.count("*").alias("n"))  # days are few
    return by_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("analyses"), F.min("day").alias("since"), F.count("day").alias("days"))


def numbered_sentences(sents: DataFrame) -> DataFrame:
    """sents (doc_id, sec, sent, ...) with their number in the document, from 1."""
    return sents.withColumn("number", F.row_number().over(W.partitionBy("doc_id").orderBy("sec", "sent")))


def argument_texts(edges: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, claim, support, claim_text, support_text) of edges (doc_id, claim, support) by sentence number."""
    numbered = numbered_sentences(sents)
    claim = numbered.select("doc_id", F.col("number").alias("claim"), F.col("text").alias("claim_text"))
    support = numbered.select("doc_id", F.col("number").alias("support"), F.col("text").alias("support_text"))
    return edges.join(claim, ["doc_id", "claim"]).join(support, ["doc_id", "support"]).select("doc_id", "claim", "support", "claim_text", "support_text")


def by_section(rows: DataFrame, outline: DataFrame) -> DataFrame:
    """(doc_id, sec, n): rows (doc_id, title) counted by the section of the outline (doc_id, sec, title) with that title, in any case and without number, else the first one whose title holds it or is held by it; sec is null for others."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^§[\d.]+\s*", ""))
    asked = rows.withColumn("wanted", plain("title")).groupBy("doc_id", "wanted").agg(F.count("*").alias("n"))
    known = outline.select("doc_id", "sec", plain("title").alias("known"))
    # Titles are few, and rows are counted by title before they meet the outline.
    both = asked.join(known, (asked.doc_id == known.doc_id) & ((asked.wanted == known.known) | ((asked.wanted != "") & (known.known.contains(asked.wanted) | asked.wanted.contains(known.known)))), "left").drop(known.doc_id)
    tier = F.when(F.col("wanted") == F.col("known"), 0).otherwise(1)
    best = both.groupBy("doc_id", "wanted", "n").agg(F.min_by("sec", F.struct(tier, "sec")).alias("sec"))
    return best.groupBy("doc_id", "sec").agg(F.sum("n").alias("n"))


def map_positions(outline: DataFrame) -> DataFrame:
    """(doc_id, sec, weight, before): room of each section on a map of the document, at least LEAST_WEIGHT sentences, and that of those before it."""
    weight = outline.select("doc_id", "sec", F.greatest("n_sentences", F.lit(LEAST_WEIGHT)).alias("weight"))
    return weight.withColumn("before", F.coalesce(F.sum("weight").over(W.partitionBy("doc_id").orderBy("sec").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def monotone(rows: DataFrame, by: list[str], order: list[str], value: str, most: float = 100.0) -> DataFrame:
    """rows with their progress: the largest value so far, at most `most`, rounded to a tenth."""
    return rows.withColumn("progress", F.round(F.max(F.least(F.col(value), F.lit(most))).over(W.partitionBy(*by).orderBy(*order)), 1))


def feedback(pieces: DataFrame) -> DataFrame:
    """(fb, ann, quote, x0, y0, x1, y1) of pieces (fb, ann, piece, text, x0, y0, x1, y1): texts joined in order, or how many regions there are, and the box around them all."""
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("piece", "text"))))
    quote = F.concat_ws(" / ", F.transform(texts, lambda t: t["text"]))
    rolled = pieces.groupBy("fb", "ann").agg(quote.alias("quote"), F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return rolled.withColumn("quote", F.when(F.col("quote") == "", F.format_string("%d region(s) marked on the paper", "n")).otherwise(F.col("quote"))).drop("n")


def plain_token(word: Column) -> Column:
    """Ligatures taken apart, lower case, ASCII letters and digits only."""
    for whole, parts in {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}.items():
        word = F.replace(word, F.lit(whole), F.lit(parts))
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def report_key(key: Column) -> Column:
    """A key as it is stored: lower case without blanks, twelve characters in three groups; what has no such form stays, trimmed."""
    bare = F.replace(F.lower(F.trim(key)), F.lit(" "), F.lit(""))
    grouped = F.when(bare.rlike(r"^[a-z0-9]{12}$"), F.concat_ws("-", F.substring(bare, 1, 4), F.substring(bare, 5, 4), F.substring(bare, 9, 4))).otherwise(bare)
    return F.when(grouped.rlike(r"^[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}$|^[A-Za-z0-9_-]{8,40}$"), grouped).otherwise(F.trim(key))
