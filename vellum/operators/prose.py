"""Sections, sentences and redundancy of prose. Everything is keyed by doc_id; no document is ever gathered in one row or task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.matches import token_spans
from vellum.functions.scores import ratio
from vellum.functions.text import ngrams, split_sentences, tokens
from vellum.storage import kept, small_side

GRAM, LEAST_COVERED = 8, 0.5
#: Sentences of a document that are compared in one row with as many others.
BLOCK = 256


def sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, sec, line): each line of a text plays the part of a section."""
    return docs.select("doc_id", F.posexplode(F.split(text_col, "\n")).alias("sec", "line"))


def sentences(parts: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, text, words) from sections (doc_id, sec, line)."""
    split = parts.select("doc_id", "sec", F.posexplode(split_sentences(F.col("line"))).alias("sent", "text"))
    return split.withColumn("words", tokens(F.col("text")))


def outline(parts: DataFrame) -> DataFrame:
    """(doc_id, sec, n_words, n_sentences): words between white space and sentences of each section."""
    counted = parts.select("doc_id", "sec", split_sentences(F.col("line")).alias("s"))
    words = F.aggregate("s", F.lit(0), lambda n, s: n + F.size(F.split(F.trim(s), r"\s+")))
    return counted.select("doc_id", "sec", words.alias("n_words"), F.size("s").alias("n_sentences"))


def _hashed(sents: DataFrame, n: int) -> DataFrame:
    """(doc_id, sec, sent, w): sentences of n tokens or more by the hashes of their tokens."""
    return sents.filter(F.size("words") >= n).select("doc_id", "sec", "sent", F.transform("words", lambda x: F.xxhash64(x)).alias("w"))


def _hashed_grams(hashed: DataFrame, n: int) -> DataFrame:
    grams = hashed.select("doc_id", "sec", "sent", F.size("w").alias("n_tokens"), F.explode(ngrams(F.col("w"), n)).alias("g"))
    return grams.select("doc_id", "sec", "sent", "g.at", F.xxhash64("g.gram").alias("h1"), F.hash("g.gram").alias("h2"), "n_tokens")


def gram_rows(sents: DataFrame, n: int = GRAM) -> DataFrame:
    """(doc_id, sec, sent, at, h1, h2, n_tokens): each n-gram by two independent hashes of its tokens' hashes."""
    return _hashed_grams(_hashed(sents, n), n)


def grams_by_document(sents: DataFrame, n: int = GRAM) -> DataFrame:
    """gram_rows, those of a document in one task: sentences are shuffled and cut into grams behind it, so that a gram costs no row of the shuffle."""
    return _hashed_grams(_hashed(sents, n).repartition("doc_id"), n)


def repeated_grams(sents: DataFrame, n: int = GRAM) -> DataFrame:
    """gram_rows with the section and sentence `first` that each gram occurs in first, that section as src_sec if it is another one, and `new`, the tokens that a repeated gram covers and none before it in its sentence."""
    rows = grams_by_document(sents, n)
    first = F.first_value(F.struct("sec", "sent")).over(W.partitionBy("doc_id", "h1", "h2").orderBy("sec", "sent", "at"))
    rows = rows.withColumn("first", first).withColumn("src_sec", F.when(F.col("first.sec") != F.col("sec"), F.col("first.sec")))
    hit_at = F.when(F.col("src_sec").isNotNull(), F.col("at"))
    before = F.last(hit_at, ignorenulls=True).over(W.partitionBy("doc_id", "sec", "sent").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    new = F.when(hit_at.isNotNull(), F.least(F.lit(n), F.coalesce(hit_at - before, F.lit(n)))).otherwise(0)
    rows = rows.withColumn("new", new)
    return rows


def gram_sources(sents: DataFrame, n: int = GRAM) -> DataFrame:
    """(doc_id, sec, sent, n_tokens, src_sec, grams, met, src_sent, new) for each sentence of n tokens or more and each other section that grams of it occur in first.

    src_sec is null in the row of the grams that are new or come from the same section. met: the first place of such a gram; new: how many
    tokens these grams cover that no repeated gram before them in the sentence does. Rows of a document meet in one shuffle by its id, which all later steps by document and sentence use."""
    rows = repeated_grams(sents, n)
    return rows.groupBy("doc_id", "sec", "sent", "n_tokens", "src_sec").agg(F.count("*").alias("grams"), F.min("at").alias("met"), F.min_by("first.sent", "at").alias("src_sent"), F.sum("new").alias("new"))


def covered_runs(sents: DataFrame, judged: DataFrame, n: int = GRAM) -> DataFrame:
    """(doc_id, sec, sent, first, last): the maximal runs of tokens of flagged sentences that repeated grams cover."""
    hits = repeated_grams(sents, n).filter("src_sec is not null").select("doc_id", "sec", "sent", "at")
    order = W.partitionBy("doc_id", "sec", "sent").orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(order), F.lit(0))
    runs = hits.withColumn("new", F.when(gap > n, 1).otherwise(0)).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("doc_id", "sec", "sent", "run").agg(F.min("at").alias("first"), (F.max("at") + n - 1).alias("last")).drop("run")
    return spans.join(judged.filter("flagged").select("doc_id", "sec", "sent"), ["doc_id", "sec", "sent"], "left_semi")


def highlighted(runs: DataFrame, sents: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, at, end, excerpt): runs of tokens (doc_id, sec, sent, first, last) as ranges of characters of their sentences."""
    text = sents.select("doc_id", "sec", "sent", "text")
    placed = runs.join(text, ["doc_id", "sec", "sent"]).withColumn("spans", token_spans(F.col("text")))
    at, end = F.get("spans", F.col("first"))["at"], F.get("spans", F.col("last"))["end"]
    return placed.select("doc_id", "sec", "sent", at.alias("at"), end.alias("end"), F.substring("text", at + 1, end - at).alias("excerpt"))


def judged_sentences(sents: DataFrame, n: int = GRAM, least: float = LEAST_COVERED) -> DataFrame:
    """(doc_id, sec, sent, n_tokens, covered, coverage, flagged, src_sec, src_sent): every sentence of n tokens or more; flagged if mostly made of earlier sections' grams.

    The source is the section with most shared grams, the one met first on a tie, and its earliest sentence among them."""
    source = F.max_by(F.struct("src_sec", "src_sent"), F.when(F.col("src_sec").isNotNull(), F.struct("grams", -F.col("met")))).alias("source")
    rows = gram_sources(sents, n).groupBy("doc_id", "sec", "sent", "n_tokens").agg(F.sum("new").alias("covered"), source)
    coverage = ratio(F.col("covered"), F.col("n_tokens"))
    return rows.select("doc_id", "sec", "sent", "n_tokens", "covered", coverage.alias("coverage"), (coverage >= least).alias("flagged"), "source.*")


def flagged_sentences(sents: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, text, n_tokens, covered, coverage, src_sec, src_sent, src_text): the flagged of the judged sentences with their text and their source's."""
    flagged = judged.filter("flagged").drop("flagged")
    text = flagged.join(sents.select("doc_id", "sec", "sent", "text"), ["doc_id", "sec", "sent"])
    origin = sents.select("doc_id", F.col("sec").alias("src_sec"), F.col("sent").alias("src_sent"), F.col("text").alias("src_text"))
    return text.join(origin, ["doc_id", "src_sec", "src_sent"])


def macro_redundancy(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc_id, num, den, score, status) for every document; den counts the judged sentences, score is null without any."""
    units = judged.groupBy("doc_id").agg(F.count_if("flagged").alias("num"), F.count("*").alias("den"))
    every = docs.select("doc_id").join(units, "doc_id", "left")
    return every.select("doc_id", "num", "den", ratio(F.col("num"), F.col("den")).alias("score"), F.when(F.col("den").isNull(), "na").otherwise("done").alias("status"))


def redundancy_edges(flagged: DataFrame) -> DataFrame:
    """(doc_id, src_sec, sec, n): how many flagged sentences of a section come from which other one."""
    return flagged.groupBy("doc_id", "src_sec", "sec").agg(F.count("*").alias("n"))


def distinct_sentences(sents: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, words, copies): of a document's sentences with the same words, the first one and how many there are."""
    return sents.groupBy("doc_id", "words").agg(F.min(F.struct("sec", "sent")).alias("first"), F.count("*").alias("copies")).select("doc_id", "first.sec", "first.sent", "words", "copies")


def near_duplicate_sentences(sents: DataFrame, n: int = GRAM, least: float = 0.2) -> DataFrame:
    """(doc_id, sec1, sent1, sec2, sent2, jaccard): sentences of different sections of a document that share a gram, by the overlap of their word sets.

    The shared gram is an equality join on its hash within the document; sentences without one are never paired."""
    both = _overlaps(small_side(kept(_gram_pairs(sents, n), "gram-pairs")), sents)
    return both.filter(F.col("jaccard") >= least).select("doc_id", "sec1", "sent1", "sec2", "sent2", "jaccard")


def near_duplicate_pairs(sents: DataFrame, n: int = GRAM, least: float = 0.2, cosine: float | None = None) -> DataFrame:
    """(doc_id, sec1, sent1, sec2, sent2, jaccard, by_gram): sentences of different sections of a document that share a gram or whose word sets overlap by at least `least`, and whose word counts have a cosine of `cosine` or more, if given."""
    keys = ["doc_id", "sec1", "sent1", "sec2", "sent2"]
    pairs = _close_pairs(sents, least, cosine).withColumn("by_gram", F.lit(False)).unionByName(_gram_pairs(sents, n).withColumn("by_gram", F.lit(True)))
    both = _overlaps(small_side(kept(pairs.groupBy(*keys).agg(F.bool_or("by_gram").alias("by_gram")), "close-pairs")), sents)
    return both.filter(F.col("by_gram") | (F.col("jaccard") >= least)).select(*keys, "jaccard", "by_gram")


def _close_pairs(sents: DataFrame, least: float, cosine: float | None = None) -> DataFrame:
    """(doc_id, sec1, sent1, sec2, sent2): sentences of different sections of a document whose word sets overlap by at least `least`, and with a cosine of their counts, if given, as far as hashes of words tell.

    At a low `least` nearly all sentences of a document share a word, so a pair is compared where it is made, in the join of two blocks of BLOCK sentences, and only those that are close leave it. Blocks are made where the one shuffle by document leaves its sentences, and not stored."""
    hashed = sents.select("doc_id", "sec", "sent", F.transform("words", lambda x: F.xxhash64(x)).alias("h")).filter((F.size("h") > 0) & F.col("doc_id").isNotNull()).repartition("doc_id")
    sets = hashed.select("doc_id", "sec", "sent", F.array_distinct("h").alias("w"), "h")
    counts = F.transform("w", lambda x: F.size(F.filter("h", lambda y: y == x))) if cosine is not None else F.lit(None).cast("array<int>")
    block = F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("sec", "sent")) - 1) / BLOCK)
    blocks = sets.select("doc_id", "sec", "sent", "w", counts.alias("c")).withColumn("block", block).groupBy("doc_id", "block").agg(F.collect_list(F.struct("sec", "sent", "w", "c")).alias("s"))
    two = blocks.join(blocks.withColumnsRenamed({"block": "block2", "s": "s2"}).hint("merge"), "doc_id").filter("block <= block2")

    def alike(b: Column) -> Column:
        at = lambda x: F.coalesce(F.get(b["c"], (F.array_position(b["w"], x) - 1).cast("int")), F.lit(0))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        product = total(F.zip_with("a.w", "a.c", lambda x, n: (n * at(x)).cast("double")))
        square = lambda c: total(F.transform(c, lambda n: (n * n).cast("double")))
        return product >= F.sqrt(square(F.col("a.c")) * square(b["c"])) * cosine - 1e-6

    def close(b: Column) -> Column:
        n, m = F.size("a.w"), F.size(b["w"])
        same = F.size(F.array_intersect("a.w", b["w"]))
        near = (b["sec"] > F.col("a.sec")) & (F.least(n, m) >= F.greatest(n, m) * least - 1e-9) & (same * (1 + least) >= (n + m) * least - 1e-9)
        return near if cosine is None else near & alike(b)

    hits = two.select("doc_id", F.explode("s").alias("a"), "s2").select("doc_id", "a", F.explode(F.filter("s2", close)).alias("b"))
    return hits.select("doc_id", F.col("a.sec").alias("sec1"), F.col("a.sent").alias("sent1"), F.col("b.sec").alias("sec2"), F.col("b.sent").alias("sent2"))


def _gram_pairs(sents: DataFrame, n: int) -> DataFrame:
    """(doc_id, sec1, sent1, sec2, sent2): sentences of different sections of a document that share a gram."""
    same = W.partitionBy("doc_id", "h1", "h2")
    grams = grams_by_document(sents, n).select("doc_id", "h1", "h2", "sec", "sent", F.min("sec").over(same).alias("least"), F.max("sec").over(same).alias("most"))
    a = kept(grams.filter("least < most").select("doc_id", "sec", "sent", "h1", "h2").distinct(), "shared-grams")
    b = a.select("doc_id", "h1", "h2", F.col("sec").alias("sec2"), F.col("sent").alias("sent2"))
    return a.withColumnsRenamed({"sec": "sec1", "sent": "sent1"}).join(b, ["doc_id", "h1", "h2"]).filter("sec1 < sec2").select("doc_id", "sec1", "sent1", "sec2", "sent2").distinct()


def _overlaps(pairs: DataFrame, sents: DataFrame) -> DataFrame:
    """pairs with the overlap of their word sets."""
    words = sents.select("doc_id", "sec", "sent", F.array_distinct("words").alias("w"))
    left = words.withColumnsRenamed({"sec": "sec1", "sent": "sent1", "w": "w1"})
    right = words.withColumnsRenamed({"sec": "sec2", "sent": "sent2", "w": "w2"})
    both = pairs.join(left, ["doc_id", "sec1", "sent1"]).join(right, ["doc_id", "sec2", "sent2"])
    same = F.size(F.array_intersect("w1", "w2"))
    return both.withColumn("jaccard", ratio(same, F.size("w1") + F.size("w2") - same))
