"""Inclusion, alignment, vectors, terms, cues and stitched lines over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.operators import alignment, measures, prose, terms, vectors
from vellum.plans import paper_tables
from vellum.plans.paper_queries import Over, between, matched, place
from vellum.plans.prose_queries import SENTS, TOKENS, _docs, _sents, _sql
from vellum.plans.table_queries import _t
from vellum.sources import inclusion
from vellum.storage import kept, small_side, spread

#: Vectors of as many following ids are averaged, so that neighbours are alike; single ones of the given table are not.
SMOOTH = 8
#: Characters of a line.
LINE = 60


def expanded_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main files of the papers with all that they include."""
    members = paper_tables.derived(spark, sf_dir, "members").select("archive", "path", F.encode("text", "utf-8").alias("content"))
    return inclusion.expanded_papers(members)


def linked_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps each page is from the first one: a link leads to the page whose number its page and the length of its address give."""
    pages = _t(spark, sf_dir, "pages")
    n = pages.count()
    links = pages.select(F.col("page_id").alias("node"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    edges = links.select("node", ((F.col("node") * 2 + F.length("href")) % n).alias("to"))
    starts = pages.agg(F.min("page_id").alias("node")).select(F.col("node").alias("start"), "node")
    return inclusion.reached(starts, edges)


def passages_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the items of the benchmark stand in the lines of the documents."""
    lines = prose.sections(spread(_docs(spark, sf_dir))).select("doc_id", F.col("sec").alias("page"), F.col("line").alias("text"))
    return alignment.located(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), lines)


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    near = rows.select(F.explode(F.sequence(F.col("vec_id") - SMOOTH + 1, F.col("vec_id"))).alias("id"), "vec_id", "e").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e"))).alias("es")).filter(F.size("es") == SMOOTH)
    total = F.aggregate("es", F.transform(F.get("es", F.lit(0))["e"], lambda x: F.lit(0.0)), lambda s, e: F.zip_with(s, e["e"], lambda x, y: x + y))
    return near.select("id", total.alias("vec"))


def similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged vectors at a cosine of 0.75, one for each different vector, with the overlap of their documents' content words and what the later one adds."""
    found, _ = vectors.classes(_smoothed(spark, sf_dir))
    pairs = kept(vectors.similar(found, 0.75), "pairs")
    words = _docs(spark, sf_dir).select("doc_id", F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 4)).alias("w"))
    ids = pairs.select(F.explode(F.array("id1", "id2")).alias("doc_id")).distinct()
    words = kept(words.join(ids, "doc_id", "left_semi"), "words")
    both = pairs.join(words.withColumnsRenamed({"doc_id": "id1", "w": "w1"}), "id1").join(words.withColumnsRenamed({"doc_id": "id2", "w": "w2"}), "id2")
    same = F.size(F.array_intersect("w1", "w2"))
    return both.select("id1", "id2", F.round("cosine", 9).alias("cosine"), F.round(same / F.greatest(F.size("w1") + F.size("w2") - same, F.lit(1)), 9).alias("jaccard"), F.size(F.array_except("w2", "w1")).alias("new_words"))


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the documents with their first use and definition."""
    return terms.term_definitions(_sents(spark, sf_dir))


def drawn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the documents that are candidates for deletion, and one in ten of the rest."""
    return terms.drawn_sentences(_sents(spark, sf_dir))


def document_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of style in the documents."""
    return terms.cue_matches(_sents(spark, sf_dir))


def _with_words(sents: DataFrame) -> DataFrame:
    return sents.withColumn("words", tokens(F.col("text")))


def stitched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in lines of equal length, words cut by hyphens, with their cut words made whole."""
    flat = _docs(spark, sf_dir).select("doc_id", F.translate("text", "\n", " ").alias("t"))
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / LINE).cast("int") - 1, F.lit(0)))
    cut = flat.select("doc_id", F.posexplode(F.transform(at, lambda i: F.struct(F.substring("t", i * LINE + 1, F.lit(LINE)).alias("text"), F.substring("t", i * LINE + LINE + 1, F.lit(1)).alias("ahead")))).alias("n", "l")).select("doc_id", "n", "l.*")
    hyphen = F.col("text").rlike("[A-Za-z]$") & F.col("ahead").rlike("[a-z]")
    return terms.stitched(cut.select("doc_id", "n", F.when(hyphen, F.concat("text", F.lit("-"))).otherwise(F.col("text")).alias("text")))


def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later sentences of a document that repeat an earlier one; sentences with the same words are one."""
    sents = kept(prose.distinct_sentences(_sents(spark, sf_dir)), "distinct-sentences")
    pairs = kept(prose.near_duplicate_pairs(sents, cosine=terms.LEAST_COSINE), "pairs")
    ends = F.explode(F.array(*(F.struct(F.col(f"sec{i}").alias("sec"), F.col(f"sent{i}").alias("sent")) for i in (1, 2))))
    ends = kept(pairs.select("doc_id", ends.alias("e")).select("doc_id", "e.*").distinct(), "ends")
    met = kept(sents.join(small_side(ends), ["doc_id", "sec", "sent"], "left_semi"), "met")  # few of the sentences, so that their words are joined for no others
    found = terms.repeated_sentences(pairs, met)
    copies = lambda i: met.select("doc_id", F.col("sec").alias(f"sec{i}"), F.col("sent").alias(f"sent{i}"), F.col("copies").alias(f"copies{i}"))
    return found.withColumn("jaccard", F.round("jaccard", 9)).join(copies(1), ["doc_id", "sec1", "sent1"]).join(copies(2), ["doc_id", "sec2", "sent2"])


def _plain(word: str) -> str:
    parts = "".join(f", '{a}', '{b}')" for a, b in [("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬅ", "ft"), ("ﬆ", "st")])
    return f"regexp_replace(lower({'replace(' * 7}{word}{parts}), '[^a-z0-9]', '', 'g')"


_WORDS = lambda text: f"[x FOR x IN [{_plain('y')} FOR y IN string_split_regex({text}, '\\s+')] IF x <> '']"
_VERDICT = "CASE WHEN d IS NULL THEN 'none' WHEN d.here <= first THEN 'before' ELSE 'late' END"
#: Letters beyond ASCII as a sign of words, which they are in Java's patterns, but not in RE2's.
_ASCII = "regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g')"
_TERMS = ", u AS (" + " UNION ALL ".join(
    f"SELECT doc_id, sec, sent, {place('p', 'm', 'i')}{' + 1' if kind == 'quoted' else ''} AS \"at\", {'g' if kind == 'quoted' else 'm'}[i] AS term, '{kind}' AS kind FROM (SELECT doc_id, sec, sent, {between('t', rx)} AS p, {matched('t', rx)} AS m, {matched('t', rx, 1 if kind == 'quoted' else 0)} AS g FROM plain), unnest(range(1, len(m) + 1)) AS r(i)"
    for kind, rx in (("abbreviation", terms.ABBREVIATION), ("compound", terms.COMPOUND), ("quoted", terms.QUOTED), ("metric", terms.METRIC))
) + f"""),
counted AS (SELECT doc_id, term, kind, count(*) AS n, min({{'sec': sec, 'sent': sent}}) AS first FROM u GROUP BY ALL HAVING kind <> 'compound' OR count(*) >= 2),
br AS (SELECT doc_id, sec, sent, g[i] AS term, [x FOR x IN string_split_regex(left(t, {place('p', 'm', 'i')}), '[^A-Za-z]+') IF x <> ''] AS w FROM (SELECT doc_id, sec, sent, t, {between('t', terms.BRACKETED)} AS p, {matched('t', terms.BRACKETED)} AS m, {matched('t', terms.BRACKETED, 1)} AS g FROM plain), unnest(range(1, len(m) + 1)) AS r(i)),
spelt AS (SELECT doc_id, term, {{'sec': sec, 'sent': sent}} AS here, 'expansion' AS how FROM br WHERE lower(array_to_string([x[1] FOR x IN w[greatest(len(w) - length(term) + 1, 1):]], '')) = lower(term)),
cued AS (SELECT doc_id, term, {{'sec': sec, 'sent': sent}} AS here, 'cue' AS how FROM u SEMI JOIN (SELECT doc_id, sec, sent FROM plain WHERE regexp_matches(t, '{terms.DEFINING}')) USING (doc_id, sec, sent)),
defined AS (SELECT doc_id, term, min({{'here': here, 'b': how = 'cue', 'how': how}}) AS d FROM (SELECT * FROM spelt UNION ALL SELECT * FROM cued) GROUP BY ALL)
SELECT doc_id, term, kind, n, first.sec AS first_sec, first.sent AS first_sent, d.here.sec AS def_sec, d.here.sent AS def_sent, d.how AS how, {_VERDICT} AS verdict FROM counted LEFT JOIN defined USING (doc_id, term)"""
_CUES = ", ".join(f"('{family}', '{phrase}', {phrase.split()}, '{items}')" for family, phrases, items in terms.CUES for phrase in phrases)
_CUED = f""", cues(family, phrase, said, items) AS (VALUES {_CUES}), t AS (SELECT doc_id, sec, sent, words, unnest(range(1, len(words) + 1)) AS i FROM s),
c AS (SELECT doc_id, sec, sent, i - 1 AS "at", family, phrase, items FROM t JOIN cues ON words[i] = said[1] WHERE len(words) >= i + len(said) - 1 AND len([x FOR x IN range(1, len(said) + 1) IF said[x] <> '*' AND said[x] <> words[i + x - 1]]) = 0)"""
_FOLDED = f"""WITH RECURSIVE item AS (SELECT item_id AS id, {_WORDS('text')} AS w FROM benchmark), sized AS (SELECT id, w, len(w) AS n, least(5, len(w)) AS size FROM item WHERE len(w) >= 3),
run AS (SELECT id, n + 1 AS total, i AS "at", size, array_to_string(w[i + 1:i + size], ' ') AS g FROM (SELECT *, unnest(list_distinct(range(0, n - size + 1, 3) || [n - size])) AS i FROM sized)),
line AS (SELECT doc_id, i - 1 AS page, {_WORDS('ls[i]')} AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
gram AS (SELECT doc_id, page, i, size, array_to_string(w[i + 1:i + size], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS i FROM line, (SELECT DISTINCT size FROM run) WHERE len(w) >= size)),
hit AS (SELECT id, doc_id, page, i, "at", total, run.size FROM gram JOIN run USING (g, size)),
vote AS (SELECT id, doc_id, page, count(DISTINCT "at") AS v FROM hit GROUP BY ALL), best AS (SELECT id, doc_id, page AS best FROM vote QUALIFY row_number() OVER (PARTITION BY id, doc_id ORDER BY v DESC, page) = 1),
near AS (SELECT hit.*, dense_rank() OVER (PARTITION BY id, doc_id ORDER BY "at") AS k FROM hit JOIN best USING (id, doc_id) WHERE page = best OR page = best + 1),
fold AS (SELECT id, doc_id, total, k, page, i, "at", size FROM near WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY id, doc_id ORDER BY page, i) = 1
    UNION ALL SELECT n.id, n.doc_id, n.total, n.k, n.page, n.i, n."at", n.size FROM fold f JOIN near n ON n.id = f.id AND n.doc_id = f.doc_id AND n.k = f.k + 1
    QUALIFY row_number() OVER (PARTITION BY n.id, n.doc_id ORDER BY CASE WHEN n.page = f.page THEN abs((n.i - f.i) - (n."at" - f."at")) ELSE 1000000 + n.i END, n.page, n.i) = 1)
SELECT id, doc_id, page, min(i) AS first, max(i + size - 1) AS last, count(*) AS met FROM fold GROUP BY id, doc_id, total, page HAVING max(i + size - 1) - min(i) <= 3 * total + 20"""

PAPERS = {
    "term_definitions": Over(("term_sents",), terms.term_definitions, ", plain AS (SELECT doc_id, sec, sent, text AS t FROM term_sents)" + _TERMS),
    "style_cues": Over(("term_sents",), lambda sents: terms.cue_matches(_with_words(sents)), f", s AS (SELECT doc_id, sec, sent, {TOKENS.format('text')} AS words FROM term_sents)" + _CUED + ' SELECT doc_id, sec, CAST(sent AS BIGINT) AS sent, "at", family, phrase FROM c'),
    "cue_items": Over(
        ("term_sents",), lambda sents: terms.cue_items(terms.cue_matches(_with_words(sents))), f", s AS (SELECT doc_id, sec, sent, {TOKENS.format('text')} AS words FROM term_sents)" + _CUED + " SELECT doc_id, item, count(*) AS n FROM (SELECT doc_id, unnest(string_split(items, ',')) AS item FROM c) GROUP BY ALL"
    ),
    "matched_objects": Over(
        ("own_objects", "other_objects"),
        lambda own, other: alignment.matched_objects(own, other, ["doc_id"]),
        f""", f AS (SELECT a.doc_id, a.id AS own_id, b.id AS other_id, 'number' AS tier FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY id) AS r FROM own_objects WHERE number IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY id) AS r FROM other_objects WHERE number IS NOT NULL) b
            ON a.doc_id = b.doc_id AND a.kind = b.kind AND a.number = b.number AND a.r = b.r),
        x AS (SELECT doc_id, id, kind, {_plain("regexp_replace(title, '^§[^ ]*\\s*', '')")} AS t FROM own_objects o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = o.doc_id AND own_id = id)), y AS (SELECT doc_id, id, kind, {_plain("regexp_replace(title, '^§[^ ]*\\s*', '')")} AS t FROM other_objects o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = o.doc_id AND other_id = id))
        SELECT * FROM f UNION ALL SELECT a.doc_id, a.id, b.id, 'title' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, t ORDER BY id) AS r FROM x) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, t ORDER BY id) AS r FROM y) b ON a.doc_id = b.doc_id AND a.kind = b.kind AND a.t = b.t AND a.r = b.r""",
    ),
    "rescored_index": Over(
        ("results", "changed_results"),
        lambda results, changed: measures.reaggregated(measures.aggregate(results), measures.rescored(results, changed), changed).withColumn("score", F.round("score", 12)),
        """, every AS (SELECT * FROM results ANTI JOIN changed_results USING (doc_id, key) UNION ALL SELECT * FROM changed_results),
        p AS (SELECT doc_id, plane, avg(score) FILTER (WHERE status = 'done') AS s FROM every GROUP BY doc_id, plane), a AS (SELECT doc_id, avg(s) AS score FROM p GROUP BY doc_id), b AS (SELECT doc_id, bool_or(status IN ('skipped', 'error')) AS partial FROM every GROUP BY doc_id)
        SELECT doc_id, round(score, 12) AS score, CAST(round_even(score * 100, 0) AS BIGINT) AS "index", partial FROM a JOIN b USING (doc_id)""",
    ),
}

QUERIES = {name: (over.query, over.oracle) for name, over in PAPERS.items()} | {
    "expanded_papers": (
        expanded_papers,
        "WITH RECURSIVE " + ", ".join(f"{n} AS ({paper_tables.INPUTS[n]})" for n in ("included", "file_pieces"))
        + """, walk AS (SELECT DISTINCT l_orderkey AS o, 1 AS n, CAST([] AS INT[]) AS place, [1] AS through FROM lineitem UNION ALL SELECT e.o, CAST(e.t AS INT), list_append(place, CAST(2 * e.nth - 1 AS INT)), list_append(through, CAST(e.t AS INT)) FROM walk w JOIN included e ON e.o = w.o AND e.n = w.n WHERE len(place) <= 15 AND NOT list_contains(through, CAST(e.t AS INT))),
        kept AS (SELECT o, n, min(place) AS place FROM walk GROUP BY o, n),
        cut AS (SELECT k.o, list_append(k.place, CAST(2 * i AS INT)) AS here, CASE WHEN len(place) > 0 AND i = 0 THEN chr(10) ELSE '' END || piece || CASE WHEN len(place) > 0 AND i = 3 THEN chr(10) ELSE '' END AS piece, i FROM kept k JOIN file_pieces USING (o, n))
        SELECT o AS archive, 'paper/main.tex' AS path, string_agg(piece, '' ORDER BY here) AS text, count(*) FILTER (WHERE i = 0) AS n_files FROM cut GROUP BY o""",
    ),
    "linked_depth": (
        linked_depth,
        """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT DISTINCT page_id AS node, (page_id * 2 + length(href)) % n AS dest FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), n),
        walk AS (SELECT min(page_id) AS start, min(page_id) AS node, 0 AS steps FROM pages UNION SELECT start, dest, steps + 1 FROM walk JOIN e USING (node) WHERE steps < 15) SELECT start, node, CAST(min(steps) AS BIGINT) AS steps FROM walk GROUP BY start, node""",
    ),
    "passages_located": (passages_located, _FOLDED),
    "similar_vectors": (
        similar_vectors,
        f"""WITH x AS (SELECT a.vec_id AS id, i, sum(CAST(b.embedding[i] AS DOUBLE)) AS v FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + {SMOOTH - 1}, range(1, 65) AS r(i) GROUP BY ALL HAVING count(*) = {SMOOTH}),
        e AS (SELECT id, list(v ORDER BY i) AS v FROM x GROUP BY id), c AS (SELECT v, min(id) AS id FROM e GROUP BY v), w AS (SELECT doc_id AS id, list_distinct([x FOR x IN {TOKENS.format('text')} IF length(x) >= 4]) AS w FROM documents),
        p AS (SELECT a.id AS id1, b.id AS id2, list_cosine_similarity(a.v, b.v) AS cosine FROM c a JOIN c b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.75)
        SELECT id1, id2, round(cosine, 9) AS cosine, round(len(list_intersect(x.w, y.w)) / greatest(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)), 1), 9) AS jaccard, len([t FOR t IN y.w IF NOT list_contains(x.w, t)]) AS new_words FROM p JOIN w x ON x.id = id1 JOIN w y ON y.id = id2""",
    ),
    "document_terms": (document_terms, _sql(f", plain AS (SELECT doc_id, sec, sent, {_ASCII} AS t FROM s)" + _TERMS)),
    "drawn_sentences": (
        drawn_sentences,
        _sql(
            f""", e AS (SELECT doc_id, sec, sent, NOT regexp_matches(text, '[0-9]') AND NOT regexp_matches({_ASCII}, '{terms.ABBREVIATION}') AND NOT contains(text, '[cite]') AND NOT contains(text, '[math]') AND NOT contains(text, '[ref]') AS candidate, md5(concat_ws(':', doc_id, sec, sent, text)) AS mark FROM s WHERE len(words) >= 8),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, candidate ORDER BY mark, sec, sent) AS r, count(*) OVER (PARTITION BY doc_id, candidate) AS n FROM e) SELECT doc_id, sec, sent, candidate, NOT candidate AND r <= ceil(n / 10) AS drawn FROM r"""
        ),
    ),
    "document_cues": (document_cues, _sql(_CUED + ' SELECT doc_id, sec, sent, "at", family, phrase FROM c')),
    "stitched_lines": (
        stitched_lines,
        f"""WITH l AS (SELECT doc_id, i AS n, substring(t, i * {LINE} + 1, {LINE}) AS text, substring(t, i * {LINE} + {LINE} + 1, 1) AS ahead FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents), unnest(range(0, greatest(CAST(ceil(length(t) / {LINE}) AS BIGINT), 1))) AS r(i)),
        g AS (SELECT *, lag(regexp_matches(text, '[A-Za-z]$') AND regexp_matches(ahead, '[a-z]')) OVER (PARTITION BY doc_id ORDER BY n) AS goes FROM l), k AS (SELECT *, count(*) FILTER (WHERE NOT coalesce(goes, false)) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM g)
        SELECT doc_id, min(n) AS n, string_agg(text, '' ORDER BY n) AS text, count(*) AS lines FROM k GROUP BY doc_id, k""",
    ),
    "repeated_sentences": (
        repeated_sentences,
        "WITH " + SENTS.replace("grams AS (SELECT doc_id, sec, sent, p - 1 AS at_, array_to_string(words[p:p + 7], ' ') AS g FROM s,", "one AS (SELECT doc_id, sec, sent, words, count(*) OVER (PARTITION BY doc_id, words) AS copies FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, words ORDER BY sec, sent) = 1),\ngrams AS (SELECT doc_id, sec, sent, p - 1 AS at_, array_to_string(words[p:p + 7], ' ') AS g FROM one,")
        + """, w AS (SELECT doc_id, sec, sent, word, count(*) AS c FROM (SELECT doc_id, sec, sent, unnest(words) AS word FROM one) GROUP BY ALL), k AS (SELECT doc_id, sec, sent, count(*) AS k, sqrt(sum(c * c)) AS norm FROM w GROUP BY ALL),
        g AS (SELECT DISTINCT a.doc_id, a.sec AS sec1, a.sent AS sent1, b.sec AS sec2, b.sent AS sent2, true AS by_gram FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.sec < b.sec),
        i AS (SELECT a.doc_id, a.sec AS sec1, a.sent AS sent1, b.sec AS sec2, b.sent AS sent2, count(*) AS i, sum(a.c * b.c) AS dot FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND a.sec < b.sec GROUP BY ALL),
        j AS (SELECT i.*, i / (x.k + y.k - i) AS jaccard, round(dot / (x.norm * y.norm), 9) AS cosine FROM i JOIN k x ON x.doc_id = i.doc_id AND x.sec = sec1 AND x.sent = sent1 JOIN k y ON y.doc_id = i.doc_id AND y.sec = sec2 AND y.sent = sent2),
        f AS (SELECT j.doc_id, sec1, sent1, sec2, sent2, round(jaccard, 9) AS jaccard, coalesce(by_gram, false) AS by_gram, cosine, [t FOR t IN list_distinct(y.words) IF NOT list_contains(x.words, t)] AS fresh, x.copies AS copies1, y.copies AS copies2
              FROM j LEFT JOIN g USING (doc_id, sec1, sent1, sec2, sent2) JOIN one x ON x.doc_id = j.doc_id AND x.sec = sec1 AND x.sent = sent1 JOIN one y ON y.doc_id = j.doc_id AND y.sec = sec2 AND y.sent = sent2 WHERE by_gram OR (jaccard >= 0.2 AND cosine >= 0.75)),
        h AS (SELECT * EXCLUDE (fresh), len([t FOR t IN fresh IF length(t) >= 4 AND NOT regexp_matches(t, '[0-9]')]) AS new_words, len([t FOR t IN fresh IF regexp_matches(t, '[0-9]')]) > 0 AS new_number FROM f)
        SELECT *, cosine >= 0.85 AND new_words <= 2 AND NOT new_number AS fails FROM h""",
    ),
}
