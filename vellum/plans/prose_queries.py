"""Queries on the text of `documents`: each line of a text plays the part of a section (class: direct)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import prose
from vellum.storage import kept, spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.sentences(prose.sections(spread(_docs(spark, sf_dir))))


def _stored_sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are read more than once, cut once."""
    return kept(_sents(spark, sf_dir), "sentences")


def macro_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.macro_redundancy(_docs(spark, sf_dir), prose.judged_sentences(_sents(spark, sf_dir)))


def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.outline(prose.sections(spread(_docs(spark, sf_dir))))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _sents(spark, sf_dir).withColumn("n", F.size("words"))
    return counted.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"), F.count_if(F.col("n") >= 8).alias("units"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(_docs(spark, sf_dir)).select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def ngram_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prose.grams_by_document(_sents(spark, sf_dir))
    firsts = rows.groupBy("doc_id", "h1", "h2").agg(F.min(F.struct("sec", "sent", "at")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    return firsts.select("doc_id", "f.sec", "f.sent", "f.at", "n")


def flagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = _stored_sents(spark, sf_dir)
    return prose.flagged_sentences(sents, prose.judged_sentences(sents))


def redundancy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.redundancy_edges(prose.judged_sentences(_sents(spark, sf_dir)).filter("flagged"))


def near_duplicate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.near_duplicate_sentences(_stored_sents(spark, sf_dir))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.near_duplicate_pairs(_stored_sents(spark, sf_dir))


def findings_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven columns; a document without findings keeps one row with its note."""
    sents = _stored_sents(spark, sf_dir)
    judged = kept(prose.judged_sentences(sents), "judged")
    scored = prose.macro_redundancy(_docs(spark, sf_dir), judged)
    found = prose.flagged_sentences(sents, judged).select("doc_id", F.col("sec").alias("section"), F.col("text").alias("finding"), F.concat(F.lit("from section "), F.col("src_sec").cast("string")).alias("detail"))
    note = F.when(F.col("status") == "na", "No sentence of eight or more tokens was recovered.").otherwise("")
    return scored.join(found, "doc_id", "left").select(
        "doc_id", F.lit("macro_redundancy").alias("measure"), F.lit("structure").alias("plane"), F.round("score", 4).alias("measure_score"), "section", F.coalesce("finding", note).alias("finding"), F.coalesce("detail", F.lit("")).alias("detail")
    )


def cue_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    hit = lambda pattern: F.coalesce(F.col("text").rlike("(?U)" + pattern), F.lit(False))
    return turns.select("conv_id", "turn", hit(T.RELATION_CUES).alias("relation"), hit(T.SENTENCE_INITIAL_CUES).alias("initial"), hit(T.DEICTIC_WORKS).alias("deictic"), hit(T.FIRST_PERSON).alias("first_person"))


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = prose.outline(prose.sections(spread(_docs(spark, sf_dir))))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("n_words").alias("n_words"), F.sum("n_sentences").alias("n_sentences"), F.max("n_words").alias("largest"))


def _sql_chain() -> str:
    """The splitter for an engine without lookaround: each rule keeps the context that it reads."""
    q = lambda s: s.replace("'", "''")
    out = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
    for a in (a for a in T.ABBREVIATIONS if a.count(".") > 1):
        out = f"regexp_replace({out}, '(^|[^A-Za-z]){a.replace('.', chr(92) + '.')}', '\\1{a.replace('.', T.DOT)}', 'g')"
    single = "|".join(a[:-1].replace(".", r"\.") for a in T.ABBREVIATIONS if a.count(".") == 1)
    out = f"regexp_replace({out}, '(^|[^A-Za-z])({single})\\.', '\\1\\2{T.DOT}', 'g')"
    out = f"regexp_replace({out}, '\\b([A-Z])\\.(\\s+[A-Z][a-z])', '\\1{T.DOT}\\2', 'g')"
    out = f"regexp_replace({out}, '(\\d)\\.(\\d)', '\\1{T.DOT}\\2', 'g')"
    brk = q(r"""([.!?])["'”’)\]]*\s+(["'“‘(\[⟦]*[A-Z0-9⟦\[])""")
    return f"string_split(regexp_replace({out}, '{brk}', '\\1␞\\2', 'g'), '␞')"


TOKENS = "[lower(x) FOR x IN regexp_extract_all({}, '" + T.TOKEN.replace("'", "''") + "')]"
SENTS = f"""
parts AS (SELECT doc_id, i - 1 AS sec, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
cut AS (SELECT doc_id, sec, line, [y FOR y IN [trim(replace(x, '{T.DOT}', '.')) FOR x IN {_sql_chain()}] IF y <> ''] AS ss FROM parts),
s AS (SELECT doc_id, sec, i - 1 AS sent, ss[i] AS text, {TOKENS.format('ss[i]')} AS words FROM cut, unnest(range(1, len(ss) + 1)) AS t(i)),
grams AS (SELECT doc_id, sec, sent, p - 1 AS at_, array_to_string(words[p:p + 7], ' ') AS g FROM s, unnest(range(1, len(words) - 6)) AS t(p) WHERE len(words) >= 8),
firsts AS (SELECT doc_id, g, min({{'sec': sec, 'sent': sent, 'at_': at_}}) AS f, count(*) AS n FROM grams GROUP BY doc_id, g),
hits AS (SELECT x.doc_id, x.sec, x.sent, x.at_, f.sec AS src_sec, f.sent AS src_sent FROM grams x JOIN firsts USING (doc_id, g) WHERE f.sec <> x.sec),
cov AS (SELECT doc_id, sec, sent, count(DISTINCT p) AS covered FROM (SELECT doc_id, sec, sent, unnest(range(at_, at_ + 8)) AS p FROM hits) GROUP BY doc_id, sec, sent),
flag AS (SELECT s.doc_id, s.sec, s.sent, s.text, len(words) AS n_tokens, covered, covered / len(words) AS coverage FROM cov JOIN s USING (doc_id, sec, sent) WHERE covered / len(words) >= 0.5),
src AS (SELECT doc_id, sec, sent, src_sec, count(*) AS k, min(at_) AS met, arg_min(src_sent, at_) AS src_sent FROM hits GROUP BY doc_id, sec, sent, src_sec),
best AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY doc_id, sec, sent ORDER BY k DESC, met) = 1),
flagged AS (SELECT f.*, b.src_sec, b.src_sent, o.text AS src_text FROM flag f JOIN best b USING (doc_id, sec, sent) JOIN s o ON o.doc_id = f.doc_id AND o.sec = b.src_sec AND o.sent = b.src_sent),
units AS (SELECT doc_id, count(*) AS den FROM s WHERE len(words) >= 8 GROUP BY doc_id),
scored AS (SELECT doc_id, CASE WHEN den IS NOT NULL THEN coalesce(num, 0) END AS num, den, CASE WHEN den IS NOT NULL THEN coalesce(num, 0) / den END AS score, CASE WHEN den IS NULL THEN 'na' ELSE 'done' END AS status
           FROM (SELECT doc_id FROM documents) LEFT JOIN units USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS num FROM flag GROUP BY doc_id) USING (doc_id)),
outline AS (SELECT doc_id, sec, CAST(coalesce(list_sum([len(string_split_regex(x, '\\s+')) FOR x IN ss]), 0) AS BIGINT) AS n_words, len(ss) AS n_sentences FROM cut)
"""


def _sql(select: str) -> str:
    return f"WITH {SENTS} {select}"


def _cue(pattern: str) -> str:
    """The pattern with word boundaries that know letters beyond ASCII."""
    pattern = pattern.replace(r"(?i)\b(", r"(?i)(^|[^\p{L}\p{N}_])(")
    pattern = pattern[: -len(r"\b")] + r"($|[^\p{L}\p{N}_])"
    return f"coalesce(regexp_matches(text, '{pattern}'), false)"


QUERIES = {
    "macro_redundancy": (macro_redundancy, _sql("SELECT * FROM scored")),
    "section_outline": (section_outline, _sql("SELECT * FROM outline")),
    "document_stats": (document_stats, _sql("SELECT doc_id, count(*) AS n_sections, CAST(sum(n_words) AS BIGINT) AS n_words, CAST(sum(n_sentences) AS BIGINT) AS n_sentences, max(n_words) AS largest FROM outline GROUP BY doc_id")),
    "sentence_stats": (sentence_stats, _sql("SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(words)) AS BIGINT) AS n_tokens, max(len(words)) AS longest, count(*) FILTER (WHERE len(words) >= 8) AS units FROM s GROUP BY doc_id")),
    "token_counts": (token_counts, f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token"),
    "ngram_first_occurrence": (ngram_first_occurrence, _sql('SELECT doc_id, f.sec AS sec, f.sent AS sent, f.at_ AS "at", n FROM firsts WHERE n > 1')),
    "flagged_sentences": (flagged_sentences, _sql("SELECT * FROM flagged")),
    "redundancy_edges": (redundancy_edges, _sql("SELECT doc_id, src_sec, sec, count(*) AS n FROM flagged GROUP BY doc_id, src_sec, sec")),
    "near_duplicate_sentences": (
        near_duplicate_sentences,
        _sql(
            """, pairs AS (SELECT DISTINCT a.doc_id, a.sec AS sec1, a.sent AS sent1, b.sec AS sec2, b.sent AS sent2 FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.sec < b.sec),
            j AS (SELECT p.*, len(list_intersect(list_distinct(x.words), list_distinct(y.words))) AS i, len(list_distinct(x.words)) + len(list_distinct(y.words)) AS t
                  FROM pairs p JOIN s x ON x.doc_id = p.doc_id AND x.sec = sec1 AND x.sent = sent1 JOIN s y ON y.doc_id = p.doc_id AND y.sec = sec2 AND y.sent = sent2)
            SELECT doc_id, sec1, sent1, sec2, sent2, i / (t - i) AS jaccard FROM j WHERE i / (t - i) >= 0.2"""
        ),
    ),
    "near_duplicate_pairs": (
        near_duplicate_pairs,
        _sql(
            """, w AS (SELECT doc_id, sec, sent, unnest(list_distinct(words)) AS word FROM s), k AS (SELECT doc_id, sec, sent, len(list_distinct(words)) AS k FROM s),
            g AS (SELECT DISTINCT a.doc_id, a.sec AS sec1, a.sent AS sent1, b.sec AS sec2, b.sent AS sent2, true AS by_gram FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.sec < b.sec),
            i AS (SELECT a.doc_id, a.sec AS sec1, a.sent AS sent1, b.sec AS sec2, b.sent AS sent2, count(*) AS i FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND a.sec < b.sec GROUP BY ALL),
            j AS (SELECT i.*, i / (x.k + y.k - i) AS jaccard FROM i JOIN k x ON x.doc_id = i.doc_id AND x.sec = sec1 AND x.sent = sent1 JOIN k y ON y.doc_id = i.doc_id AND y.sec = sec2 AND y.sent = sent2)
            SELECT doc_id, sec1, sent1, sec2, sent2, jaccard, coalesce(by_gram, false) AS by_gram FROM j LEFT JOIN g USING (doc_id, sec1, sent1, sec2, sent2) WHERE by_gram OR jaccard >= 0.2"""
        ),
    ),
    "findings_export": (
        findings_export,
        _sql(
            """SELECT doc_id, 'macro_redundancy' AS measure, 'structure' AS plane, round(score, 4) AS measure_score, f.sec AS section,
            coalesce(f.text, CASE WHEN status = 'na' THEN 'No sentence of eight or more tokens was recovered.' ELSE '' END) AS finding,
            CASE WHEN f.sec IS NULL THEN '' ELSE 'from section ' || CAST(src_sec AS VARCHAR) END AS detail FROM scored LEFT JOIN flagged f USING (doc_id)"""
        ),
    ),
    "cue_matches": (cue_matches, f"SELECT conv_id, turn, {_cue(T.RELATION_CUES)} AS relation, {_cue(T.SENTENCE_INITIAL_CUES)} AS initial, {_cue(T.DEICTIC_WORKS)} AS deictic, {_cue(T.FIRST_PERSON)} AS first_person FROM conversations"),
}
