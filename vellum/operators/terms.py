"""Terms and their definitions, sentences to be looked at, cues of style, and lines that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.matches import match_spans
from vellum.functions.text import CITE, MATH, REF, tokens

# An abbreviation, one in brackets, a hyphenated compound, a quoted term, a two-word metric, cues of a definition.
ABBREVIATION = r"\b[A-Z][A-Za-z]*[A-Z][A-Za-z0-9]*\b"
BRACKETED = r"\(([A-Z][A-Za-z]*[A-Z][A-Za-z0-9]*)\)"
COMPOUND = r"\b[a-z]+(?:-[a-z]+)+\b"
QUOTED = r"[“\"]([A-Za-z][A-Za-z \-]{2,40})[”\"]"
METRIC = r"\b[a-z]+ (?:rate|score|ratio|margin)\b"
DEFINING = r"(?i)\b(?:we call|is defined as|are defined as|denotes?|refers? to)\b"
LEAST_COMPOUND = 2
# Families of cues, their phrases (a * stands for one word) and the items they hint at.
CUES = [
    ("importance words", ["crucial", "pivotal", "paramount", "growing attention"], "5-1"),
    ("evaluative words", ["novel", "robust", "significantly", "state-of-the-art"], "1-2,5-3"),
    ("contrast frames", ["unlike", "rather than", "not * but"], "5-2"),
    ("interpretive tails", ["demonstrating that", "highlighting that", "suggesting that"], "5-3"),
    ("evidence talk", ["it is well established that", "extensive experiments show"], "5-4"),
    ("rule of three", ["novel efficient and scalable"], "1-1,1-2,5-4"),
    ("empty signposting", ["it is worth noting that", "in summary", "overall"], "4-1,4-4"),
    ("circular phrasing", ["the extraction module extracts"], "4-1,4-2,3-1"),
    ("scope limiting", ["beyond the scope", "left for future work"], "3-1,1-2,4-1"),
]
#: One sentence in so many is drawn.
DRAWN = 10
#: The cosine of word counts from which sentences that overlap repeat each other.
LEAST_COSINE = 0.75


def term_uses(sents: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, at, term, kind) of sentences (doc_id, sec, sent, text): abbreviations, hyphenated compounds, quoted terms and two-word metrics, each with its character."""
    return sents.select("doc_id", "sec", "sent", F.explode(_uses(F.col("text"))).alias("t")).select("doc_id", "sec", "sent", "t.*")


def _uses(text: Column) -> Column:
    """(at, term, kind) structs of a text; a pattern is tried only where its literals stand."""

    def of(pattern: str, kind: str, *literals: str, group: int = 0) -> Column:
        held = F.lit(not literals)
        for literal in literals:
            held = held | text.contains(literal)
        term = lambda s: F.regexp_extract(s["match"], pattern, group) if group else s["match"]
        return F.transform(match_spans(F.when(held, text).otherwise(""), pattern), lambda s: F.struct((s["at"] + group).alias("at"), term(s).alias("term"), F.lit(kind).alias("kind")))

    return F.when(text.isNotNull(), F.concat(of(ABBREVIATION, "abbreviation"), of(COMPOUND, "compound", "-"), of(QUOTED, "quoted", "“", '"', group=1), of(METRIC, "metric", " rate", " score", " ratio", " margin")))


def _expansions(text: Column) -> Column:
    """(term, expansion) structs of the abbreviations in brackets of a text whose letters begin the words just before, hyphens parting words."""

    def one(s: Column) -> Column:
        term = F.regexp_extract(s["match"], BRACKETED, 1)
        words = F.filter(F.split(F.substring(text, F.lit(1), s["at"]), r"[^A-Za-z]+"), lambda w: w != "")
        last = F.slice(words, F.greatest(F.size(words) - F.length(term) + 1, F.lit(1)), F.length(term))
        initials = F.array_join(F.transform(last, lambda w: F.substring(w, 1, 1)), "")
        return F.struct(term.alias("term"), F.array_join(last, " ").alias("expansion"), (F.lower(initials) == F.lower(term)).alias("fits"))

    return F.filter(F.transform(match_spans(F.when(text.contains("("), text), BRACKETED), one), lambda s: s["fits"])


def expansions(sents: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, term, expansion): abbreviations in brackets whose letters begin the words just before, hyphens parting words."""
    return sents.select("doc_id", "sec", "sent", F.explode(_expansions(F.col("text"))).alias("e")).select("doc_id", "sec", "sent", "e.term", "e.expansion")


def term_definitions(sents: DataFrame) -> DataFrame:
    """(doc_id, term, kind, n, first_sec, first_sent, def_sec, def_sent, how, verdict): terms with their uses, first use and first definition.

    Sentences are read once: uses and expansions are rows of one shuffle by document and term, and a term's first definition is that of its rows of all kinds.
    A term is defined by its expansion before a bracket, or in a sentence that uses it with a defining cue. Compounds count from LEAST_COMPOUND uses on. verdict: before where the definition comes no later than the first use, late, or none."""
    here = F.struct("sec", "sent")
    spelt = F.transform(_expansions(F.col("text")), lambda e: F.struct(F.lit(None).cast("int").alias("at"), e["term"].alias("term"), F.lit("expansion").alias("kind")))
    found = F.concat(_uses(F.col("text")), F.coalesce(spelt, F.array().cast("array<struct<at:int,term:string,kind:string>>")))
    rows = sents.select("doc_id", here.alias("here"), F.col("text").rlike(DEFINING).alias("cue"), F.explode(found).alias("t"))
    counted = rows.groupBy("doc_id", F.col("t.term").alias("term"), F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("here").alias("first"), F.min(F.when(F.col("cue"), F.col("here"))).alias("cued"))
    how = F.when(F.col("kind") == "expansion", "expansion").otherwise("cue")
    place = F.when(F.col("kind") == "expansion", F.col("first")).otherwise(F.col("cued"))
    of_term = F.min(F.when(F.col("doc_id").isNotNull() & place.isNotNull(), F.struct(place.alias("here"), (how == "cue").alias("later"), how.alias("how")))).over(W.partitionBy("doc_id", "term"))
    both = counted.withColumn("d", of_term).filter(F.col("kind") != "expansion").filter((F.col("kind") != "compound") | (F.col("n") >= LEAST_COMPOUND))
    verdict = F.when(F.col("d").isNull(), "none").when(F.col("d.here") <= F.col("first"), "before").otherwise("late")
    return both.select("doc_id", "term", "kind", "n", F.col("first.sec").alias("first_sec"), F.col("first.sent").alias("first_sent"), F.col("d.here.sec").alias("def_sec"), F.col("d.here.sent").alias("def_sent"), F.col("d.how").alias("how"), verdict.alias("verdict"))


def drawn_sentences(sents: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, sec, sent, candidate, drawn) of sentences of `least` tokens or more.

    Candidates hold no number, formula, citation, reference or term with a capital inside. Of a document's other sentences ceil(n / DRAWN) are drawn, those of the least hashes of document, place and text, so the draw can be repeated."""
    plain = ~F.col("text").rlike(r"[0-9]") & ~F.col("text").rlike(ABBREVIATION)
    for stand_in in (CITE, MATH, REF):
        plain = plain & ~F.col("text").contains(stand_in)
    mark = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in ("doc_id", "sec", "sent")), "text"))
    eligible = sents.filter(F.size("words") >= least).select("doc_id", "sec", "sent", plain.alias("candidate"), mark.alias("mark"))
    others = W.partitionBy("doc_id", "candidate")
    ranked = eligible.withColumns({"r": F.row_number().over(others.orderBy("mark", "sec", "sent")), "most": F.ceil(F.count("*").over(others) / DRAWN)})
    return ranked.select("doc_id", "sec", "sent", "candidate", (~F.col("candidate") & (F.col("r") <= F.col("most"))).alias("drawn"))


def cue_table(spark: SparkSession) -> DataFrame:
    """(family, phrase, words, first, items): the fixed cues, a row for each phrase."""
    rows = [(family, phrase, phrase.split(), phrase.split()[0], items.split(",")) for family, phrases, items in CUES for phrase in phrases]
    return spark.createDataFrame(rows, "family string, phrase string, words array<string>, first string, items array<string>")


def cue_matches(sents: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, at, family, phrase) of sentences (doc_id, sec, sent, words): cues by token place. A cue is met by its first word in a join with the table of cues, then word by word, a * being any word."""
    cues = F.broadcast(cue_table(sents.sparkSession))  # some thirty rows
    each = sents.select("doc_id", "sec", "sent", "words", F.posexplode("words").alias("at", "first"))
    met = each.join(cues.withColumnRenamed("words", "said"), "first").withColumn("here", F.slice("words", F.col("at") + 1, F.size("said")))
    agrees = (F.size("here") == F.size("said")) & F.forall(F.zip_with("here", "said", lambda h, s: (s == "*") | (h == s)), lambda x: x)
    return met.filter(agrees).select("doc_id", "sec", "sent", "at", "family", "phrase")


def cue_items(matches: DataFrame) -> DataFrame:
    """(doc_id, item, n): how many cues of a document hint at each item."""
    items = cue_table(matches.sparkSession).select("phrase", F.explode("items").alias("item"))
    return matches.join(F.broadcast(items), "phrase").groupBy("doc_id", "item").agg(F.count("*").alias("n"))


def stitched(lines: DataFrame) -> DataFrame:
    """(doc_id, n, text, lines) of lines (doc_id, n, text): a line that ends with a hyphen after a letter is joined with the next where that begins with a small letter, without the hyphen, and so on; n is the first line's."""
    w = W.partitionBy("doc_id").orderBy("n")
    goes_on = F.col("before").rlike(r"[A-Za-z]-$") & F.col("text").rlike(r"^[a-z]")
    marked = lines.withColumn("before", F.lag("text").over(w)).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("group", F.sum("new").over(w))
    following = F.lead("new").over(w)
    part = F.when(following == 0, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    return marked.withColumn("part", part).groupBy("doc_id", "group").agg(F.min("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]), "").alias("text"), F.count("*").alias("lines")).drop("group")


def repeated_sentences(pairs: DataFrame, sents: DataFrame, least: float = LEAST_COSINE, same: float = 0.85, most_new: int = 2) -> DataFrame:
    """pairs (doc_id, sec1, sent1, sec2, sent2, jaccard, by_gram) of sentences (doc_id, sec, sent, words) that repeat each other, with their cosine, new content words and numbers, and whether the later one fails.

    A pair repeats by a shared gram, or by overlap and a cosine of `least`. The later sentence fails at a cosine of `same` where it has at most `most_new` content words (four letters or more) and no number that the earlier one lacks.
    The cosine is that of word counts, which stand for vectors of sentences."""
    counts = F.transform(F.array_distinct("words"), lambda x: F.struct(x.alias("word"), F.size(F.filter("words", lambda y: y == x)).alias("n")))
    bags = sents.select("doc_id", "sec", "sent", "words", counts.alias("bag")).withColumn("norm", F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["n"] * x["n"])))
    side = lambda i: bags.withColumnsRenamed({"sec": f"sec{i}", "sent": f"sent{i}", "words": f"w{i}", "bag": f"b{i}", "norm": f"norm{i}"})
    both = pairs.join(side(1), ["doc_id", "sec1", "sent1"]).join(side(2), ["doc_id", "sec2", "sent2"])
    other = F.map_from_entries("b2")
    product = F.aggregate("b1", F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.element_at(other, x["word"]), F.lit(0)))
    fresh = F.array_except("w2", "w1")
    content = F.size(F.filter(fresh, lambda t: (F.length(t) >= 4) & ~t.rlike("[0-9]")))
    judged = both.withColumns({"cosine": F.round(product / (F.col("norm1") * F.col("norm2")), 9), "new_words": content, "new_number": F.exists(fresh, lambda t: t.rlike("[0-9]"))})
    judged = judged.filter(F.col("by_gram") | (F.col("cosine") >= least))
    fails = (F.col("cosine") >= same) & (F.col("new_words") <= most_new) & ~F.col("new_number")
    return judged.select("doc_id", "sec1", "sent1", "sec2", "sent2", "jaccard", "by_gram", "cosine", "new_words", "new_number", fails.alias("fails"))
