"""Submissions: cut to size, checked by rules, and those that break one set apart with its name; feedback rolled up, the proposals in it, votes and prompts.

What a submission may list is bounded (annotations, pieces, disputed findings), so every group gathered here is bounded too.
Rows of a list are cut by a rank of which Spark keeps only the first of each task before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.operators.listings import LEAST_PROMPT, LEAST_QUOTE, MAIL

# What a submission may list, lengths to which fields are cut, least lengths, planes, and items voted on.
MOST_ANNOTATIONS, MOST_PIECES, MOST_DISPUTED = 100, 40, 200
PIECE_TEXT, QUOTE, JOINED, FIELD = 1000, 600, 5000, 2000
ANNOTATION = {"kind": 40, "title": 80, "note": 600, "pattern_name": 80, "pattern_what": 300}
HUB_FIELDS = {"item": 8, "token": 64, "quote": 800, "prompt": 4000}
LEAST_NAME, LEAST_WHAT, LEAST_NOTE = 3, 10, 10
PLANES = ["structure", "argument", "artifacts", "other"]
ITEMS = ["1-1", "1-2", "1-3", "1-4", "2-1", "2-2", "2-3", "3-1", "4-1", "4-2", "4-3", "4-4", "4-5", "5-1", "5-2", "5-3", "5-4"]


def bare(text: Column) -> Column:
    """A text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def start(text: Column, n: int) -> Column:
    """The first n characters; null is empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `reason`, the name of the first rule that a row does not keep, or null; a rule whose condition is null is not kept."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(kept, F.lit(False)), name) for name, kept in rules.items())))


def listed(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key, which is all that a submission may list."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def checked_proposals(rows: DataFrame) -> DataFrame:
    """(id, name, plane, what, reason) of proposals (id, name, plane, what): fields trimmed and cut, an unknown plane being `other`."""
    field = {c: F.substring(bare(F.col(c)), 1, FIELD) for c in ("name", "plane", "what")}
    plane = F.when(field["plane"].isin(PLANES), field["plane"]).otherwise("other")
    cut = rows.select("id", field["name"].alias("name"), plane.alias("plane"), field["what"].alias("what"))
    return checked(cut, {"name": F.length("name") >= LEAST_NAME, "what": F.length("what") >= LEAST_WHAT})


def annotated(annotations: DataFrame, pieces: DataFrame) -> DataFrame:
    """(fb, ann, kind, title, note, pattern_name, pattern_what, n_pieces, texts): annotations of feedback with the texts of their pieces, in order.

    annotations (fb, ann, kind, title, note, pattern_name, pattern_what); pieces (fb, ann, piece, text). The first MOST_ANNOTATIONS
    of a feedback and the first MOST_PIECES of an annotation count; an annotation without a piece is dropped, after that."""
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "other").otherwise(F.col("kind"))
    cut = {c: start(kind if c == "kind" else F.col(c), n) for c, n in ANNOTATION.items()}
    cut |= {c: bare(cut[c]) for c in ("title", "pattern_name", "pattern_what")}
    own = listed(annotations, ["fb"], ["ann"], MOST_ANNOTATIONS).select("fb", "ann", *(v.alias(c) for c, v in cut.items()))
    texts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("piece", start(F.col("text"), PIECE_TEXT).alias("text")))))
    marked = listed(pieces, ["fb", "ann"], ["piece"], MOST_PIECES).groupBy("fb", "ann").agg(F.count("*").alias("n_pieces"), F.transform(texts, lambda t: t["text"]).alias("texts"))
    return own.join(marked, ["fb", "ann"])


def feedback_rows(submissions: DataFrame, annotations: DataFrame, pieces: DataFrame, disputed: DataFrame) -> DataFrame:
    """(fb, name, affiliation, email, flags, disputed, slops, quotes, reason): one row per submission (fb, name, affiliation, email).

    flags and disputed count what it marks and which findings (fb, nth, finding) it disputes; slops and quotes join titles, kinds
    and notes, and the texts of pieces, cut at JOINED characters. Rules, in this order: every annotation is named and described,
    the sender is named, the address is one, and there is something to submit. A submission with a null fb has nothing."""
    slop = F.concat("title", F.lit(" ["), "kind", F.lit("]: "), "note")
    of = annotated(annotations, pieces).groupBy("fb").agg(
        F.count("*").alias("flags"),
        F.bool_or((F.col("title") == "") | (F.length("note") < LEAST_NOTE)).alias("poor"),
        F.array_sort(F.collect_list(F.struct("ann", slop.alias("slop"), "texts"))).alias("all"),
    )
    against = listed(disputed, ["fb"], ["nth"], MOST_DISPUTED).groupBy("fb").agg(F.count("*").alias("disputed"))
    both = submissions.select("fb", "name", "affiliation", "email").join(of, "fb", "left").join(against, "fb", "left")
    joined = lambda texts: start(F.array_join(texts, " | "), JOINED)
    rows = both.select(
        "fb",
        bare(start(F.col("name"), 80)).alias("name"),
        bare(start(F.col("affiliation"), 120)).alias("affiliation"),
        bare(start(F.col("email"), 120)).alias("email"),
        F.coalesce("flags", F.lit(0)).alias("flags"),
        F.coalesce("disputed", F.lit(0)).alias("disputed"),
        joined(F.transform("all", lambda a: a["slop"])).alias("slops"),
        joined(F.flatten(F.transform("all", lambda a: a["texts"]))).alias("quotes"),
        F.coalesce("poor", F.lit(False)).alias("poor"),
    )
    rules = {"annotation": ~F.col("poor"), "sender": (F.col("name") != "") & (F.col("affiliation") != ""), "email": F.col("email").rlike(MAIL), "nothing": F.col("flags") + F.col("disputed") > 0}
    return checked(rows, rules).drop("poor")


def proposals_in(feedback: DataFrame, annotations: DataFrame, pieces: DataFrame) -> DataFrame:
    """(fb, ann, name, plane, what, quote, author): patterns named in accepted feedback (feedback_rows()) by annotations of the kind `other`."""
    named = annotated(annotations, pieces).filter("kind = 'other' and pattern_name <> ''")
    texts = start(F.array_join("texts", " / "), QUOTE)
    marks = F.when(texts == "", F.format_string("%d region(s) marked on the paper", "n_pieces")).otherwise(texts)
    note = F.when((F.col("note") != "") & (F.col("pattern_what") != ""), F.concat("note", F.lit(" — "))).otherwise("")
    what = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("pattern_what", "note", "pattern_name")))
    own = named.select("fb", "ann", F.col("pattern_name").alias("name"), F.lit("other").alias("plane"), what.alias("what"), F.concat(note, marks).alias("quote"))
    return own.join(feedback.filter("reason is null").select("fb", F.col("name").alias("author")), "fb")


def proposal_body(plane: Column, what: Column, author: Column, affiliation: Column) -> Column:
    """The body of an issue for a proposal, in the fields that listings.proposals() reads."""
    known = lambda c: F.coalesce(c, F.lit(""))
    or_else = lambda c, other: F.when(known(c) == "", other).otherwise(c)
    who = F.concat(or_else(author, "Anonymous"), F.when(known(affiliation) != "", F.concat(F.lit(" ("), affiliation, F.lit(")"))).otherwise(""))
    return F.concat(F.lit("**Plane:** "), or_else(plane, "unassigned"), F.lit("\n\n**What it is:** "), known(what), F.lit("\n\n---\nProposed by "), who, F.lit("."))


def hub_field(name: str) -> Column:
    """A field of the hub, trimmed and cut."""
    return F.substring(bare(F.col(name)), 1, HUB_FIELDS[name])


def checked_votes(votes: DataFrame) -> DataFrame:
    """votes (item, token, v, ...) with the reason why one does not count: an unknown item, no token, or a value other than 1, -1 and 0, which withdraws a vote."""
    cut = votes.withColumns({c: hub_field(c) for c in ("item", "token")})
    return checked(cut, {"item": F.col("item").isin(ITEMS), "token": F.col("token") != "", "value": F.col("v").isin(1, -1, 0)})


def checked_posts(posts: DataFrame) -> DataFrame:
    """posts (item, kind, text, ...), cases or prompts, with the reason why one is refused: its kind, its item, or too short a text."""
    text = F.when(F.col("kind") == "case", F.substring(bare(F.col("text")), 1, HUB_FIELDS["quote"])).otherwise(F.substring(bare(F.col("text")), 1, HUB_FIELDS["prompt"]))
    cut = posts.withColumns({"item": hub_field("item"), "text": text})
    least = F.when(F.col("kind") == "case", LEAST_QUOTE).otherwise(LEAST_PROMPT)
    return checked(cut, {"kind": F.col("kind").isin("case", "prompt"), "item": F.col("item").isin(ITEMS), "text": F.length("text") >= least})


def seen_by(prompts: DataFrame, ups: DataFrame, token: str | int) -> DataFrame:
    """prompts (id, ...) with ups, the number of users (id, token) who have it marked, and `mine`, whether the asking one has; marks count once a user."""
    once = ups.select("id", "token").filter("token is not null").distinct()
    counted = once.groupBy("id").agg(F.count("*").alias("ups"), F.bool_or(F.col("token") == token).alias("mine"))
    return prompts.join(counted, "id", "left").withColumns({"ups": F.coalesce("ups", F.lit(0)), "mine": F.coalesce("mine", F.lit(False))})
