"""The measures, lists and references of papers that are written from the given tables (paper_tables.py), each with SQL over the same inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import citations
from vellum.functions import text as T
from vellum.operators import listings, measures, ranking, spans, votes
from vellum.plans import paper_tables
from vellum.sources import latex
from vellum.storage import kept

KINDS = ["enumerated_stage", "notation_key", "evaluative_mark", "example", "result", "definition"]


@dataclass(frozen=True)
class Over:
    """A result over inputs: build takes them in this order, sql follows a WITH clause of the same names."""

    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    sql: str

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(*(paper_tables.derived(spark, sf_dir, n) for n in self.inputs))

    @property
    def oracle(self) -> str:
        return paper_tables.with_inputs(self.inputs, self.sql)


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def between(text: str, pattern: str) -> str:
    return f"string_split_regex({text}, '{quoted(pattern)}')"


def matched(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, '{quoted(pattern)}', {group})"


def place(pieces: str, matches: str, i: str) -> str:
    """Where the i-th match begins: the lengths of what stands before it."""
    return f"CAST(list_sum([length(x) FOR x IN {pieces}[1:{i}]]) + coalesce(list_sum([length(x) FOR x IN {matches}[1:{i} - 1]]), 0) AS BIGINT)"


def _strings(items) -> DataFrame:
    return F.concat_ws(",", F.transform(items, lambda s: s.cast("string")))


def _object_references(sections, objects, pointers):
    return measures.object_references(sections, objects, pointers).select("doc_id", "id", "kind", "home", _strings("sources").alias("sources"), "own")


def _cross_refs(docs, sections, objects, pointers):
    return measures.cross_refs(docs, measures.object_references(sections, objects, pointers))


def _argument_graph(docs, labels, supports):
    runs = labels.groupBy("doc_id", "sent").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "label"))), lambda r: r["label"]).alias("runs"))
    return measures.argument_graph(docs, runs, supports)


def _cited(sents):
    cites = F.transform(F.filter(F.split("keys", ","), lambda k: k != ""), lambda k: F.array(k))
    return sents.select("doc_id", "sec", "sent", "text", cites.alias("cites"))


def _citing(sents, roles, names):
    sents = _cited(sents)
    lexicon = measures.work_lexicon(measures.in_sections(sents, roles), names)
    return measures.citing_sentences(sents, roles, lexicon)


def _citation_isolation(docs, sents, roles, names):
    return measures.citation_isolation(docs, _citing(sents, roles, names))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 12))


def _registry_tally(units):
    return votes.score_and_coverage(units.withColumn("final", votes.verdict(F.split("runs", ","))), ["item"], F.col("final"))


def _layout_edges(edges, objects, sections):
    """Section pairs by their number of pointers; ends that no object resolves are dropped."""
    homes = objects.select("doc_id", F.col("id").alias("target"), "home")
    known = sections.select("doc_id", F.col("sec").alias("src"))
    return edges.join(homes, ["doc_id", "target"]).join(known, ["doc_id", "src"], "left_semi").groupBy("doc_id", "src", "home").agg(F.count("*").alias("n")).withColumn("loop", F.col("src") == F.col("home"))


def _gallery(rows):
    """The newest analysis of each paper, papers being equal by title, or else by address, or else by key."""
    title = T.identity(F.col("title"))
    arxiv = F.regexp_extract("url", r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    ident = F.when(F.length(title) >= 12, F.concat(F.lit("t:"), title)).when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.concat(F.lit("k:"), F.col("key")))
    return votes.newest(rows.withColumn("ident", ident), ["ident"], "created", "key").select("key", "ident", "index")


def _citation_keys(passages):
    text = F.col("text")
    return passages.select("id", citations.style(text).alias("style"), _strings(citations.numeric_keys(text)).alias("numbers"), _strings(citations.named_keys(text)).alias("names"))


def _listed(passages):
    return passages.select("id", F.explode(citations.listed_references(F.col("text"))).alias("r")).select("id", "r.kind", "r.number")


def _proposals(issues, local):
    rows = listings.proposals(issues.withColumn("labels", F.split("labels", ",")), local)
    return ranking.ranked(rows, ["listed", F.desc("created"), "id"]).drop("listed")


_RATIO = "SELECT doc_id, CAST(n AS DOUBLE) AS num, CAST(d AS BIGINT) AS den, n / nullif(d, 0) AS score, CASE WHEN coalesce(d, 0) = 0 THEN 'na' ELSE 'done' END AS status FROM docs LEFT JOIN c USING (doc_id)"
ROAD = """, first AS (SELECT doc_id, min(sec) AS f FROM sections GROUP BY doc_id),
own AS (SELECT p.doc_id, p.pos, coalesce(o.home > f, false) AS forward, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS n FROM pointers p JOIN first ON first.doc_id = p.doc_id AND src = f LEFT JOIN objects o ON o.doc_id = p.doc_id AND o.id = p.target AND o.kind = 'section'),
run AS (SELECT doc_id, pos, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM own WHERE forward),
best AS (SELECT doc_id, r FROM run GROUP BY doc_id, r HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(n)) = 1),
road AS (SELECT run.doc_id, f AS src, pos FROM run JOIN best USING (doc_id, r) JOIN first USING (doc_id)),
used AS (SELECT * FROM pointers ANTI JOIN road USING (doc_id, src, pos) WHERE target NOT LIKE 'appendix:%'),
refs AS (SELECT o.doc_id, o.id, o.kind, o.home, coalesce(array_to_string(list_sort(list(DISTINCT src) FILTER (WHERE src <> home)), ','), '') AS sources, count(*) FILTER (WHERE src = home) AS own
         FROM objects o LEFT JOIN used u ON u.doc_id = o.doc_id AND u.target = o.id GROUP BY o.doc_id, o.id, o.kind, o.home)"""
COUNTED = ", c AS (SELECT doc_id, count(*) FILTER (WHERE sources = '') AS n, count(*) AS d FROM refs GROUP BY doc_id) " + _RATIO
_FINAL = """SELECT item, unit, CASE WHEN n < 2 OR (f > 0 AND p > 0) THEN 'U' WHEN f * 2 > n THEN 'F' WHEN p * 2 > n THEN 'P' WHEN na * 2 > n THEN 'N' ELSE 'U' END AS v
FROM (SELECT item, unit, len(r) AS n, len([x FOR x IN r IF x = 'FAIL']) AS f, len([x FOR x IN r IF x = 'PASS']) AS p, len([x FOR x IN r IF x = 'NA']) AS na FROM (SELECT *, string_split(runs, ',') AS r FROM units))"""
_WOVEN = f""", scope AS (SELECT doc_id, sec, sent, text, [k FOR k IN string_split(keys, ',') IF k <> ''] AS g FROM sents SEMI JOIN roles USING (doc_id, sec)),
parts AS (SELECT doc_id, g, i, right(p[i], 60) AS before FROM (SELECT doc_id, g, string_split(text, '[cite]') AS p FROM scope WHERE len(g) > 0), unnest(range(1, len(g) + 1)) AS t(i)),
ahead AS (SELECT doc_id, regexp_extract(before, '(?:^|[\\s(“"])({measures.WORK_NAME})(?:\\s+(?:et al\\.?|model|method|framework|reviewer|detector))?\\s*(?:\\([^)]*\\))?\\s*$', 1) AS name, g[i] AS k FROM parts),
clauses AS (SELECT doc_id, text, g, unnest(string_split_regex(text, '[,;]|\\band\\b')) AS c FROM scope WHERE len(g) > 0),
starts AS (SELECT doc_id, regexp_extract(c, '^\\s*(?:the\\s+)?({measures.WORK_NAME})\\b', 1) AS name, g[len(string_split(left(text, strpos(text, c) + length(c) - 1), '[cite]')) - 1] AS k FROM clauses WHERE len(string_split(c, '[cite]')) = 2),
every AS (SELECT doc_id, name, cite_key AS k FROM names WHERE length(name) >= 3 UNION ALL SELECT * FROM ahead UNION ALL SELECT * FROM starts WHERE k IS NOT NULL),
lexicon AS (SELECT doc_id, name, list_distinct(list(k)) AS ks FROM every WHERE name <> '' AND name NOT IN ({', '.join(f"'{n}'" for n in measures.NO_NAMES)}) GROUP BY doc_id, name),
cited AS (SELECT *, coalesce(lag(len(g) > 0) OVER (PARTITION BY doc_id, sec ORDER BY sent), false) AS prev, replace(text, '[cite]', ' ') AS rest FROM scope),
met AS (SELECT DISTINCT c.doc_id, sec, sent FROM cited c JOIN lexicon l ON l.doc_id = c.doc_id AND contains(rest, name) WHERE len(g) > 0 AND regexp_matches(rest, '(^|[^A-Za-z0-9])' || regexp_escape(name) || '($|[^A-Za-z0-9])') AND len([k FOR k IN ks IF NOT list_contains(g, k)]) > 0),
judged AS (SELECT c.doc_id, c.sec, c.sent, text, list_sort(list_distinct(g)) AS g, CASE WHEN len(list_distinct(g)) >= 2 THEN 'cites two or more works together' WHEN met.doc_id IS NOT NULL THEN 'names another work'
    WHEN NOT regexp_matches(text, '{T.FIRST_PERSON}') AND prev AND regexp_matches(trim(text), '{T.SENTENCE_INITIAL_CUES}') THEN 'links to the previous work by a relational cue'
    WHEN NOT regexp_matches(text, '{T.FIRST_PERSON}') AND regexp_matches(text, '{T.RELATION_CUES}') AND regexp_matches(text, '{T.DEICTIC_WORKS}') THEN 'relates the work to other works by a cue' END AS why
    FROM cited c LEFT JOIN met USING (doc_id, sec, sent) WHERE len(g) > 0)"""
_PRINTED = " UNION ALL ".join(f"SELECT doc_id, src, '{k}' AS kind, {between('raw', p)} AS p, {matched('raw', p)} AS m, {matched('raw', p, 1)} AS g FROM texts" for k, p in latex.PRINTED.items())
_LISTED = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, unnest(regexp_extract_all(g, '\\d+(?:\\.\\d+)*')) AS number FROM (SELECT id, unnest(regexp_extract_all(text, '{quoted(p)}', 1)) AS g FROM passages)" for k, p in citations.LISTED.items())

PAPERS = {
    "object_references": Over(("sections", "objects", "pointers"), _object_references, ROAD + " SELECT doc_id, id, kind, CAST(home AS BIGINT) AS home, sources, own FROM refs"),
    "cross_refs": Over(("docs", "sections", "objects", "pointers"), _cross_refs, ROAD + COUNTED),
    "argument_graph": Over(
        ("docs", "labels_", "supports"),
        _argument_graph,
        """, k AS (SELECT doc_id, sent, label, count(*) AS n, min(run) AS first FROM labels_ GROUP BY doc_id, sent, label),
        w AS (SELECT doc_id, sent, CASE WHEN count(*) FILTER (WHERE n = most) = 1 THEN arg_max(label, n) ELSE arg_min(label, first) END AS label FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, sent) AS most FROM k) GROUP BY doc_id, sent, most),
        c AS (SELECT doc_id, count(*) FILTER (WHERE support > claim) AS n, count(*) AS d FROM w JOIN supports USING (doc_id) WHERE claim = sent AND support IS NOT NULL AND label IN ('superiority', 'prior_limitation', 'design_choice')
              AND doc_id IN (SELECT doc_id FROM w GROUP BY doc_id HAVING count(*) >= 4) GROUP BY doc_id) """ + _RATIO,
    ),
    "citing_sentences": Over(("sents", "roles", "names"), lambda *x: _citing(*x).select("doc_id", "sec", "sent", _strings("keys").alias("keys"), "why"), _WOVEN + " SELECT doc_id, sec, CAST(sent AS BIGINT) AS sent, array_to_string(g, ',') AS keys, why FROM judged"),
    "citation_isolation": Over(
        ("docs", "sents", "roles", "names"), _citation_isolation, f"{_WOVEN}, c AS (SELECT doc_id, count(*) FILTER (WHERE why IS NULL) AS n, count(*) AS d FROM judged GROUP BY doc_id) SELECT x.*, coalesce(den < 8, false) AS weak FROM ({_RATIO}) AS x"
    ),
    "work_lexicon": Over(
        ("sents", "names"),
        lambda sents, names: measures.work_lexicon(_cited(sents), names).select("doc_id", "name", _strings(F.sort_array("keys")).alias("keys")),
        ", roles AS (SELECT DISTINCT doc_id, sec FROM sents)" + _WOVEN + " SELECT doc_id, name, array_to_string(list_sort(ks), ',') AS keys FROM lexicon",
    ),
    "figure_exposition": Over(
        ("docs", "elements"),
        lambda docs, elements: measures.figure_exposition(docs, elements, KINDS),
        """, k AS (SELECT doc_id, run, unnest([role, CASE WHEN regexp_matches(trim(text), '(?i)^\\s*(\\(?\\d+\\)|(stage|step|phase|round)\\s*[0-9IVX]+)') THEN 'enumerated_stage' WHEN regexp_matches(trim(text), '(?i)\\b(legend|denotes?)\\b') THEN 'notation_key' WHEN regexp_matches(trim(text), '[✓✗]') THEN 'evaluative_mark' END]) AS kind FROM elements WHERE trim(text) <> ''),
        p AS (SELECT doc_id, kind FROM k WHERE kind IN ('enumerated_stage', 'notation_key', 'evaluative_mark', 'example', 'result', 'definition') GROUP BY doc_id, kind HAVING count(DISTINCT run) * 2 > 3),
        c AS (SELECT e.doc_id, count(DISTINCT p.kind) AS n, 6 AS d FROM (SELECT DISTINCT doc_id FROM elements) e LEFT JOIN p USING (doc_id) GROUP BY e.doc_id) """ + _RATIO,
    ),
    "method_figure": Over(
        ("figures",),
        measures.method_figure,
        f""", g AS (SELECT doc_id, "index", 2 * CAST(regexp_matches(caption, '{measures.METHOD_GATE}') AS BIGINT) + CAST(regexp_matches(caption, '{measures.METHOD_WEAK}') AS BIGINT) AS gate FROM figures WHERE has_image)
        SELECT doc_id, CAST("index" AS BIGINT) AS "index", gate FROM g WHERE gate >= 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gate < 2, "index") = 1""",
    ),
    "evidence_gap": Over(
        ("docs", "tables_", "exhibits"),
        measures.evidence_gap,
        """, t AS (SELECT DISTINCT doc_id, 1 AS d FROM tables_ WHERE data_rows >= 2 AND numeric_cells >= 4), e AS (SELECT DISTINCT doc_id, true AS shown FROM exhibits),
        c AS (SELECT doc_id, CASE WHEN d IS NULL THEN NULL WHEN shown THEN 0 WHEN acknowledged THEN 0.5 ELSE 1 END AS n, d FROM docs LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id))
        SELECT doc_id, CAST(n AS DOUBLE) AS num, CAST(d AS BIGINT) AS den, CAST(n / d AS DOUBLE) AS score, CASE WHEN d IS NULL THEN 'na' ELSE 'done' END AS status FROM c""",
    ),
    "plane_scores": Over(("results",), lambda r: _rounded(measures.plane_scores(r)), " SELECT doc_id, plane, round(avg(score) FILTER (WHERE status = 'done'), 12) AS score, count(score) FILTER (WHERE status = 'done') AS items FROM results GROUP BY doc_id, plane"),
    "aggregate": Over(
        ("results",),
        lambda r: _rounded(measures.aggregate(r)),
        """, p AS (SELECT doc_id, plane, avg(score) FILTER (WHERE status = 'done') AS s FROM results GROUP BY doc_id, plane), a AS (SELECT doc_id, avg(s) AS score FROM p GROUP BY doc_id), b AS (SELECT doc_id, bool_or(status IN ('skipped', 'error')) AS partial FROM results GROUP BY doc_id)
        SELECT doc_id, round(score, 12) AS score, CAST(round_even(score * 100, 0) AS BIGINT) AS "index", partial FROM a JOIN b USING (doc_id)""",
    ),
    "registry_tally": Over(
        ("units",), _registry_tally, f", v AS ({_FINAL}), c AS (SELECT item, count(*) FILTER (WHERE v = 'F') AS f, count(*) FILTER (WHERE v = 'P') AS p, count(*) FILTER (WHERE v = 'U') AS u FROM v GROUP BY item) SELECT *, f / nullif(f + p, 0) AS score, (f + p) / nullif(f + p + u, 0) AS coverage FROM c"
    ),
    "layout_edges": Over(
        ("edges", "objects", "sections"),
        _layout_edges,
        " SELECT e.doc_id, CAST(src AS BIGINT) AS src, CAST(home AS BIGINT) AS home, count(*) AS n, src = home AS loop FROM edges e JOIN objects o ON o.doc_id = e.doc_id AND o.id = e.target SEMI JOIN sections s ON s.doc_id = e.doc_id AND s.sec = src GROUP BY e.doc_id, src, home",
    ),
    "nearest_anchor": Over(
        ("points", "anchors"),
        lambda points, anchors: spans.nearest(points, anchors, ["page"]),
        """, d AS (SELECT p.page, point, anchor, abs(a.y - p.y) + CASE WHEN "column" <> anchor_column THEN 400 ELSE 0 END AS d FROM points p JOIN anchors a USING (page) WHERE a.y - p.y >= CASE WHEN kind = 'table' THEN -60 ELSE -14 END)
        SELECT CAST(page AS BIGINT) AS page, point, anchor FROM d WHERE d <= 760 QUALIFY row_number() OVER (PARTITION BY page, point ORDER BY d, anchor) = 1""",
    ),
    "gallery": Over(
        ("gallery",),
        _gallery,
        """, i AS (SELECT *, left(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 80) AS t, regexp_extract(url, 'arxiv\\.org/(?:abs|pdf)/(\\d{4}\\.\\d{4,5})', 1) AS a FROM gallery),
        k AS (SELECT key, created, "index", CASE WHEN length(t) >= 12 THEN 't:' || t WHEN a <> '' THEN 'arxiv:' || a ELSE 'k:' || key END AS ident FROM i)
        SELECT key, ident, CAST("index" AS BIGINT) AS "index" FROM k QUALIFY row_number() OVER (PARTITION BY ident ORDER BY created DESC, key DESC) = 1""",
    ),
    "printed_references": Over(
        ("texts", "numbered"),
        lambda texts, numbered: latex.printed_references(texts, numbered),
        f""", f AS ({_PRINTED}), e AS (SELECT doc_id, src, kind, g[i] AS number, m[i] AS said, {place('p', 'm', 'i')} AS "at" FROM f, unnest(range(1, len(m) + 1)) AS t(i))
        SELECT e.doc_id, CAST(src AS BIGINT) AS src, id AS target, "at", said FROM e JOIN numbered USING (doc_id, kind, number) UNION ALL SELECT doc_id, src, 'appendix:' || number, "at", said FROM e WHERE kind = 'appendix'""",
    ),
    "title_mentions": Over(
        ("texts", "heads"),
        lambda texts, heads: latex.title_mentions(texts, heads),
        f""", p AS (SELECT t.doc_id, src, sec, raw, '(?i)\\b(?:the\\s+)?[“"'']?' || regexp_escape(trim(title)) || '[”"'']?\\s+section\\b' AS rx FROM texts t JOIN heads h ON h.doc_id = t.doc_id AND src <> sec AND length(trim(title)) >= 6 AND contains(lower(raw), lower(trim(title)))),
        x AS (SELECT doc_id, src, sec, string_split_regex(raw, rx) AS p, regexp_extract_all(raw, rx) AS m FROM p)
        SELECT doc_id, CAST(src AS BIGINT) AS src, 'sec:' || sec AS target, {place('p', 'm', 'i')} AS "at", m[i] AS said FROM x, unnest(range(1, len(m) + 1)) AS t(i)""",
    ),
    "citation_keys": Over(
        ("passages",),
        _citation_keys,
        f""", parts AS (SELECT id, g, i, trim(x[i]) AS part FROM (SELECT id, g, string_split(b[g], ',') AS x FROM (SELECT id, regexp_extract_all(text, '{citations.NUMBERS}', 1) AS b FROM passages), unnest(range(1, len(b) + 1)) AS t(g)), unnest(range(1, len(x) + 1)) AS u(i)),
        ends AS (SELECT id, g, i, regexp_matches(part, '[-–]') AS wide, CAST(regexp_extract(part, '^(\\d+)', 1) AS INT) AS a, CAST(regexp_extract(part, '(\\d+)$', 1) AS INT) AS b FROM parts),
        nums AS (SELECT id, g, i, unnest(CASE WHEN NOT wide THEN [a] WHEN b > a AND b - a < 30 THEN range(a, b + 1) ELSE [] END) AS k FROM ends),
        n AS (SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY g, i, k) AS numbers FROM nums GROUP BY id),
        named AS (SELECT id, g, i, lower(regexp_extract(x[i], '{quoted(citations.NAMED_WORK)}', 1) || regexp_extract(x[i], '{quoted(citations.NAMED_WORK)}', 2)) AS k FROM (SELECT id, g, string_split(b[g], ';') AS x FROM
            (SELECT id, regexp_extract_all(text, '{quoted(citations.WORK_GROUP)}', 1) AS b FROM passages), unnest(range(1, len(b) + 1)) AS t(g)), unnest(range(1, len(x) + 1)) AS u(i)),
        textual AS (SELECT id, i, lower(a[i] || y[i]) AS k FROM (SELECT id, {matched('text', citations.TEXTUAL_WORK, 1)} AS a, {matched('text', citations.TEXTUAL_WORK, 3)} AS y FROM passages), unnest(range(1, len(a) + 1)) AS t(i)),
        m AS (SELECT id, string_agg(k, ',' ORDER BY t, g, i) AS names FROM (SELECT id, 0 AS t, g, i, k FROM named UNION ALL SELECT id, 1, 0, i, k FROM textual) WHERE k <> '' GROUP BY id)
        SELECT id, CASE WHEN len(regexp_extract_all(text, '{citations.NUMBERS}')) > len(regexp_extract_all(text, '{quoted(citations.AUTHOR_YEAR)}')) THEN 'numeric' ELSE 'author-year' END AS style, coalesce(numbers, '') AS numbers, coalesce(names, '') AS names
        FROM passages LEFT JOIN n USING (id) LEFT JOIN m USING (id)""",
    ),
    "listed_references": Over(("passages",), _listed, f", r AS ({_LISTED} UNION ALL SELECT id, 'appendix', unnest({matched('text', citations.LETTERED, 1)}) FROM passages) SELECT * FROM r"),
    "listed_targets": Over(
        ("texts", "numbered"),
        latex.listed_targets,
        f""", passages AS (SELECT doc_id * 1000 + src AS id, raw AS text FROM texts), r AS ({_LISTED} UNION ALL SELECT id, 'appendix', unnest({matched('text', citations.LETTERED, 1)}) FROM passages),
        e AS (SELECT CAST(floor(id / 1000) AS BIGINT) AS doc_id, id % 1000 AS src, kind, number FROM r)
        SELECT e.doc_id, CAST(src AS BIGINT) AS src, e.kind, e.number, CASE WHEN e.kind = 'appendix' THEN 'appendix:' || e.number ELSE coalesce(a.id, b.id) END AS target FROM e LEFT JOIN numbered a ON a.doc_id = e.doc_id AND a.kind = e.kind AND a.number = e.number
        LEFT JOIN numbered b ON b.doc_id = e.doc_id AND b.kind = e.kind AND e.kind = 'section' AND b.number = string_split(e.number, '.')[1] WHERE e.kind = 'appendix' OR a.id IS NOT NULL OR b.id IS NOT NULL""",
    ),
    "wording": Over(
        ("claims",),
        lambda rows: rows.select("id", F.col("text").rlike(latex.ACKNOWLEDGED_GAP).alias("gap"), F.col("text").rlike(latex.EXHIBIT_CAPTIONS).alias("exhibit")),
        f" SELECT id, regexp_matches(text, '{latex.ACKNOWLEDGED_GAP}') AS gap, regexp_matches(text, '{latex.EXHIBIT_CAPTIONS}') AS exhibit FROM claims",
    ),
    "numeric_cells": Over(("cells",), lambda rows: rows.select("id", latex.numeric(F.col("cell")).alias("numeric")), f" SELECT id, regexp_matches(cell, '{latex.NUMERIC_CELL}') AS numeric FROM cells"),
    "section_kinds": Over(
        ("titles",),
        lambda rows: rows.select("id", F.col("title").rlike(latex.STATEMENTS).alias("statement"), F.col("title").rlike(latex.RELATED).alias("related")),
        f" SELECT id, regexp_matches(title, '{latex.STATEMENTS}') AS statement, regexp_matches(title, '{latex.RELATED}') AS related FROM titles",
    ),
    "proposals": Over(
        ("issues", "local_"),
        _proposals,
        """, p AS (SELECT id, regexp_replace(title, '^Proposal:\\s*', '') AS name, CASE WHEN list_contains(l, 'accepted') THEN 'accepted' WHEN list_contains(l, 'not-adopted') THEN 'not-adopted' WHEN list_contains(l, 'testing') THEN 'testing' ELSE 'under-review' END AS status, created,
            nullif(lower(regexp_extract(body, '\\*\\*Plane:\\*\\* (\\w+)', 1)), '') AS plane, coalesce(trim(regexp_extract(body, '\\*\\*What it is:\\*\\* (.+)', 1)), '') AS what, coalesce(nullif(regexp_extract(body, 'Proposed by (.+?)\\.', 1), ''), 'Anonymous') AS author
        FROM (SELECT *, string_split(labels, ',') AS l FROM issues) UNION ALL SELECT id, name, 'under-review', created, NULL, '', 'Anonymous' FROM local_ WHERE coalesce(issue_url, '') = '')
        SELECT *, row_number() OVER (ORDER BY list_position(['accepted', 'testing', 'under-review', 'not-adopted'], status), created DESC, id) AS rank FROM p""",
    ),
    "feedback": Over(
        ("pieces",),
        listings.feedback,
        " SELECT fb, CAST(ann AS BIGINT) AS ann, coalesce(string_agg(text, ' / ' ORDER BY piece) FILTER (WHERE text <> ''), count(*) || ' region(s) marked on the paper') AS quote, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM pieces GROUP BY fb, ann",
    ),
    "findings_by_section": Over(
        ("found", "heads"),
        listings.by_section,
        """, f AS (SELECT row_number() OVER () AS r, doc_id, lower(regexp_replace(coalesce(title, ''), '^§[\\d.]+\\s*', '')) AS w FROM found), h AS (SELECT doc_id, sec, lower(regexp_replace(title, '^§[\\d.]+\\s*', '')) AS k FROM heads),
        b AS (SELECT r, f.doc_id, arg_min(sec, {'far': w <> k, 'sec': sec}) AS sec FROM f LEFT JOIN h ON h.doc_id = f.doc_id AND (w = k OR (w <> '' AND (contains(k, w) OR contains(w, k)))) GROUP BY r, f.doc_id)
        SELECT doc_id, CAST(sec AS BIGINT) AS sec, count(*) AS n FROM b GROUP BY doc_id, sec""",
    ),
    "reason_histogram": Over(("reasons",), lambda rows: rows.groupBy(F.get(F.split("why", r" \("), F.lit(0)).alias("reason")).agg(F.count("*").alias("n")), " SELECT string_split(why, ' (')[1] AS reason, count(*) AS n FROM reasons GROUP BY 1"),
    "argument_texts": Over(
        ("supports", "sents"),
        lambda edges, sents: listings.argument_texts(edges.filter("support is not null"), sents),
        """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec, sent) AS k FROM sents)
        SELECT e.doc_id, CAST(claim AS BIGINT) AS claim, CAST(support AS BIGINT) AS support, a.text AS claim_text, b.text AS support_text FROM supports e JOIN n a ON a.doc_id = e.doc_id AND a.k = claim JOIN n b ON b.doc_id = e.doc_id AND b.k = support""",
    ),
    "float_numbers": Over(("floats",), lambda rows: latex.running_numbers(rows, "at").select("doc_id", "id", "kind", "number"), ' SELECT doc_id, id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY home, "at") AS number FROM floats'),
    "report_keys": Over(
        ("keys_",),
        lambda rows: rows.select("id", listings.report_key(F.col("key")).alias("key")),
        """, b AS (SELECT id, trim(key) AS t, replace(lower(trim(key)), ' ', '') AS k FROM keys_), g AS (SELECT id, t, CASE WHEN regexp_full_match(k, '[a-z0-9]{12}') THEN k[1:4] || '-' || k[5:8] || '-' || k[9:12] ELSE k END AS k FROM b)
        SELECT id, CASE WHEN regexp_full_match(k, '[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4}|[A-Za-z0-9_-]{8,40}') THEN k ELSE t END AS key FROM g""",
    ),
}


# The LaTeX reader over the same papers in their source; the SQL knows what was written and never reads LaTeX.


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the papers, stored, for what reads the papers themselves no more."""
    return kept(latex.sections(paper_tables.papers(spark, sf_dir)), "sections")


def latex_sections(spark, sf_dir):
    """Sections of the LaTeX papers with number and role."""
    found = _sections(spark, sf_dir)
    every = found.join(latex.numbers(found), ["doc_id", "sec"]).join(latex.roles(found), ["doc_id", "sec"], "left")
    return every.select("doc_id", "sec", "title", "starred", "kind", "number", "role")


def latex_sentences(spark, sf_dir):
    """Their sentences with stand-ins and citation keys."""
    sents = latex.sentences(latex.sections(paper_tables.papers(spark, sf_dir)))
    return sents.select("doc_id", "sec", "sent", "text", F.concat_ws(";", F.transform("cites", lambda g: F.concat_ws(",", g))).alias("cites"))


def latex_objects(spark, sf_dir):
    """Their sections, figures and tables with home, label and caption."""
    return latex.objects(latex.sections(paper_tables.papers(spark, sf_dir)))


def latex_object_numbers(spark, sf_dir):
    """Their printed numbers."""
    found = _sections(spark, sf_dir)
    return latex.object_numbers(found, latex.placed_objects(found))


def latex_pointers(spark, sf_dir):
    """Their references by label, number and title, in true order."""
    return latex.pointer_rows(latex.read_papers(paper_tables.papers(spark, sf_dir))).drop("at")


def latex_tables(spark, sf_dir):
    """Rows and numbers of their tables."""
    return latex.tables(latex.sections(paper_tables.papers(spark, sf_dir)))


def latex_exhibits(spark, sf_dir):
    """Their exhibits, counted by kind."""
    return latex.exhibits(_sections(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def paper_cross_refs(spark, sf_dir):
    """Cross-section references measured from the source on."""
    read = kept(latex.read_papers(paper_tables.papers(spark, sf_dir)), "read-papers")
    rows = lambda name: read.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*")
    return measures.cross_refs(read, measures.object_references(rows("sections").filter("kind = 'body'"), rows("objects"), rows("pointers")))


def paper_evidence_gap(spark, sf_dir):
    """Evidence gap measured from the source on."""
    found = _sections(spark, sf_dir)
    return measures.evidence_gap(latex.acknowledged_in(found), latex.tables(found), latex.exhibits(found))


def bibliography_names(spark, sf_dir):
    """Names of works in the papers' bibliographies."""
    bib = paper_tables.derived(spark, sf_dir, "bib").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda e: e["entry"]), "").alias("bib"))
    return latex.work_names(bib)


_SAID = [
    ("0", "'As Section [ref] shows, Figure ' || b || ' and Table 1 differ from [ref].'", "''", "true"), ("1", "'Section [ref] again, with Appendix B in Sec. ' || b || '.'", "''", "true"), ("2", "'Unlike prior methods [cite], it is fast.'", "'c' || s % 7", "true"),
    ("3", "'See the ' || coalesce(next_title, 'Final') || ' section.'", "''", "true"), ("4", "'Only Section 1' || b || ' is missing, 50% more.'", "''", "true"), ("5", "'More is in [ref].'", "''", "n = 1"),
]
_POINTED = [
    ("sec:' || a", "ref", "a <= kept"), ("f' || b", "number", "b <= kept"), ("t1'", "number", "true"), ("f' || a", "ref", "a <= kept"), ("sec:' || b", "ref", "b <= kept"), ("sec:' || a", "ref", "a <= kept"), ("appendix:B'", "number", "true"),
    ("NUMBER b", "number", ""), ("sec:' || (n + 1)", "name", "n < kept"), ("NUMBER CAST('1' || b AS BIGINT)", "number", ""), ("appendix:app'", "ref", "n = 1"),
]
_POINTERS = " UNION ALL ".join(
    f"SELECT x.o, x.n, {j} AS j, 'sec:' || y.n AS target, '{via}' AS via FROM tex_lines x JOIN tex_lines y ON y.o = x.o AND y.star = '' AND y.number = {target[7:].replace('b', 'x.b')}" if target.startswith("NUMBER") else f"SELECT o, n, {j} AS j, '{target} AS target, '{via}' AS via FROM tex_lines WHERE {holds}"
    for j, (target, via, holds) in enumerate(_POINTED)
)
_SOURCE = f""", sections AS (SELECT o AS doc_id, n AS sec FROM tex_lines),
objects AS (SELECT o AS doc_id, 'sec:' || n AS id, 'section' AS kind, n AS home, 's' || n AS alias, title AS caption FROM tex_lines UNION ALL SELECT o, 'f' || n, 'figure', n, 'f' || n, caption || n FROM tex_lines UNION ALL SELECT o, 't' || n, 'table', n, 't' || n, 'Numbers' FROM tex_lines),
pointed AS (SELECT o AS doc_id, CAST(n AS BIGINT) AS src, target, via, j FROM ({_POINTERS})),
pointers AS (SELECT doc_id, src, target, via, row_number() OVER (PARTITION BY doc_id, src ORDER BY j) - 1 AS pos FROM pointed)"""
_DOCS = ", docs AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem)"


def _source(sql: str) -> str:
    return paper_tables.with_inputs(("tex_lines",), sql)


SOURCES = {
    "latex_sections": (
        latex_sections,
        _source(
            """, r AS (SELECT *, CASE WHEN title = 'Related Work' THEN 'related' WHEN n = 1 THEN 'intro' END AS role FROM tex_lines)
            SELECT o AS doc_id, n AS sec, title, star = '*' AS starred, 'body' AS kind, CASE WHEN star = '' THEN CAST(CAST(number AS BIGINT) AS VARCHAR) END AS number, role FROM r
            UNION ALL SELECT DISTINCT l_orderkey, 0, 'Abstract', false, 'abstract', NULL, NULL FROM lineitem"""
        ),
    ),
    "latex_sentences": (
        latex_sentences,
        _source(
            " " + " UNION ALL ".join(f"SELECT o AS doc_id, n AS sec, {i} AS sent, {text} AS text, {cites} AS cites FROM tex_lines WHERE {holds}" for i, text, cites, holds in _SAID)
            + " UNION ALL SELECT l_orderkey, 0, 0, 'We study order ' || l_orderkey || '.', '' FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey, 0, 1, 'It has ' || count(*) || ' parts.', '' FROM lineitem GROUP BY l_orderkey"
        ),
    ),
    "latex_objects": (latex_objects, _source(_SOURCE + " SELECT * FROM objects")),
    "latex_object_numbers": (
        latex_object_numbers,
        _source(
            " SELECT o AS doc_id, 'section' AS kind, CAST(CAST(number AS BIGINT) AS VARCHAR) AS number, 'sec:' || n AS id FROM tex_lines WHERE star = '' UNION ALL SELECT o, 'figure', CAST(n AS VARCHAR), 'f' || n FROM tex_lines UNION ALL SELECT o, 'table', CAST(n AS VARCHAR), 't' || n FROM tex_lines"
        ),
    ),
    "latex_pointers": (latex_pointers, _source(_SOURCE + " SELECT * FROM pointers")),
    "latex_tables": (latex_tables, _source(" SELECT o AS doc_id, n AS home, CASE WHEN q % 2 = 0 THEN 3 ELSE 2 END AS data_rows, CASE WHEN q % 2 = 0 THEN 4 ELSE 3 END AS numeric_cells FROM tex_lines")),
    "latex_exhibits": (latex_exhibits, _source(" SELECT o AS doc_id, 'caption' AS kind, count(*) AS n FROM tex_lines WHERE n % 3 = 1 GROUP BY o")),
    "paper_cross_refs": (paper_cross_refs, _source(_SOURCE + _DOCS + ROAD + COUNTED)),
    "paper_evidence_gap": (
        paper_evidence_gap,
        _source(
            _DOCS + """, t AS (SELECT DISTINCT o AS doc_id, 1 AS d FROM tex_lines WHERE q % 2 = 0), e AS (SELECT DISTINCT o AS doc_id FROM tex_lines WHERE n % 3 = 1),
            c AS (SELECT doc_id, CASE WHEN d IS NULL THEN NULL WHEN e.doc_id IS NOT NULL THEN 0 ELSE 1 END AS n, d FROM docs LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)) SELECT doc_id, CAST(n AS DOUBLE) AS num, CAST(d AS BIGINT) AS den, CAST(n / d AS DOUBLE) AS score, CASE WHEN d IS NULL THEN 'na' ELSE 'done' END AS status FROM c"""
        ),
    ),
    "bibliography_names": (bibliography_names, paper_tables.with_inputs(("bib",), " SELECT doc_id, 'c' || n AS cite_key, 'G' || p % 9 || 'Net' AS name FROM bib WHERE p % 2 = 0 UNION ALL SELECT doc_id, 'c' || n, 'Doe' || s % 5 || ' et al' FROM bib")),
}

QUERIES = {name: (over.query, over.oracle) for name, over in PAPERS.items()} | SOURCES
