"""Submissions, short reports, printed lists and totals over rows written from the given tables (paper_tables.py), each with SQL over the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import listings, ranking, summaries, votes
from vellum.operators import submissions as S
from vellum.operators.measures import WORK_NAME
from vellum.plans.paper_queries import Over
from vellum.plans.paper_tables import LINES
from vellum.sources import references

ASKING = 7


def _hub_tally(ballots: DataFrame) -> DataFrame:
    """Votes up and down of each item, from the last accepted vote of each user."""
    good = S.checked_votes(ballots).filter("reason is null")
    items = good.sparkSession.createDataFrame([(i,) for i in S.ITEMS], "item string")
    return votes.tally(items, votes.latest_votes(good, ["token", "item"], "v", "event_id"), "item", "v")


def _proposed(submissions: DataFrame, annotations: DataFrame, pieces: DataFrame, disputed: DataFrame) -> DataFrame:
    return S.proposals_in(S.feedback_rows(submissions, annotations, pieces, disputed), annotations, pieces)


def _bodies(drafts: DataFrame) -> DataFrame:
    """Bodies of accepted proposals."""
    good = S.checked_proposals(drafts).filter("reason is null")
    author, group = F.when(F.col("id") % 3 > 0, F.concat(F.lit("Author "), "id")), F.when(F.col("id") % 2 > 0, F.lit("Group"))
    return good.select("id", S.proposal_body(F.col("plane"), F.col("what"), author, group).alias("body"))


def _reports(docs: DataFrame, results: DataFrame) -> DataFrame:
    return summaries.report_text(summaries.heads(docs), results, summaries.measure_table(docs.sparkSession))


def _metrics(results: DataFrame) -> DataFrame:
    """The index, one plane and one measure as metrics."""
    every = summaries.metrics(results)
    return every.select("doc_id", *(F.round(summaries.metric(m), 9).alias(a) for m, a in (("index", "index"), ("plane:argument", "plane"), ("m:cross_refs", "measure"))))


def _overreach(claims: DataFrame, covered: DataFrame, limits: DataFrame) -> DataFrame:
    """Final verdicts of the claims over their runs."""
    return votes.verdicts(summaries.overreach(claims, covered, limits), ["claim"], F.col("verdict"))


def _captions(lines: DataFrame) -> DataFrame:
    """Lines that begin a caption."""
    return lines.select("id", references.caption(F.col("text")).alias("c")).filter("c is not null").select("id", "c.*")


def _by_age(pages: DataFrame) -> DataFrame:
    """Pages from the newest on; those without a date count as the oldest."""
    return ranking.ranked(pages, [F.desc(F.coalesce("created", F.lit(0.0))), "page_id"])


def _trim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"


_ANNOTATED = f""", a AS (SELECT * FROM annotations QUALIFY row_number() OVER (PARTITION BY fb ORDER BY ann) <= 100),
    q AS (SELECT * FROM fb_pieces QUALIFY row_number() OVER (PARTITION BY fb, ann ORDER BY piece) <= 40),
    p AS (SELECT fb, ann, count(*) AS n, coalesce(list(substring(text, 1, 1000) ORDER BY piece) FILTER (WHERE text <> ''), []) AS texts FROM q GROUP BY fb, ann),
    m AS (SELECT fb, ann, n, texts, substring(CASE WHEN coalesce(kind, '') = '' THEN 'other' ELSE kind END, 1, 40) AS kind, {_trim('substring(title, 1, 80)')} AS title, substring(coalesce(note, ''), 1, 600) AS note,
        {_trim('substring(pattern_name, 1, 80)')} AS pattern_name, {_trim('substring(pattern_what, 1, 300)')} AS pattern_what FROM a JOIN p USING (fb, ann))"""
_FEEDBACK = _ANNOTATED + f""", f AS (SELECT fb, count(*) AS flags, bool_or(title = '' OR length(note) < 10) AS poor, string_agg(title || ' [' || kind || ']: ' || note, ' | ' ORDER BY ann) AS slops, flatten(list(texts ORDER BY ann)) AS quotes FROM m GROUP BY fb),
    d AS (SELECT fb, least(count(*), 200) AS disputed FROM disputed_ GROUP BY fb),
    x AS (SELECT fb, {_trim('substring(name, 1, 80)')} AS name, {_trim('substring(affiliation, 1, 120)')} AS affiliation, {_trim('substring(email, 1, 120)')} AS email, coalesce(flags, 0) AS flags, coalesce(disputed, 0) AS disputed,
        substring(coalesce(slops, ''), 1, 5000) AS slops, substring(coalesce(array_to_string(quotes, ' | '), ''), 1, 5000) AS quotes, poor FROM submissions LEFT JOIN f USING (fb) LEFT JOIN d USING (fb)),
    fr AS (SELECT * EXCLUDE poor, CASE WHEN poor THEN 'annotation' WHEN name = '' OR affiliation = '' THEN 'sender' WHEN NOT regexp_matches(email, '{S.MAIL}') THEN 'email' WHEN flags + disputed = 0 THEN 'nothing' END AS reason FROM x)"""
_DRAFTS = f""", c AS (SELECT id, substring({_trim('name')}, 1, 2000) AS name, CASE WHEN {_trim('plane')} IN ('structure', 'argument', 'artifacts', 'other') THEN {_trim('plane')} ELSE 'other' END AS plane, substring({_trim('what')}, 1, 2000) AS what FROM drafts),
    dr AS (SELECT *, CASE WHEN length(name) < 3 THEN 'name' WHEN length(what) < 10 THEN 'what' END AS reason FROM c)"""
_ITEMS = ", ".join(f"'{i}'" for i in S.ITEMS)
_BALLOTS = f""", b AS (SELECT event_id, substring({_trim('item')}, 1, 8) AS item, substring({_trim('token')}, 1, 64) AS token, v FROM ballots),
    bl AS (SELECT *, CASE WHEN item NOT IN ({_ITEMS}) THEN 'item' WHEN token = '' THEN 'token' WHEN v IS NULL OR v NOT IN (1, -1, 0) THEN 'value' END AS reason FROM b)"""
_TITLE = "coalesce(nullif(title, ''), nullif(fallback, ''), 'Untitled paper')"
_MEANS = ", p AS (SELECT doc_id, plane, avg(score) FILTER (WHERE status = 'done') AS s FROM measured GROUP BY doc_id, plane), a AS (SELECT doc_id, CAST(round_even(avg(s) * 100, 0) AS BIGINT) AS i FROM p GROUP BY doc_id)"
_PLACES = "(VALUES " + ", ".join(f"({i}, '{k}', '{n}')" for i, (k, n) in enumerate(summaries.NAMES.items())) + ") AS t(place, key, name)"

SUBMITTED = {
    "feedback_rows": Over(("submissions", "annotations", "fb_pieces", "disputed_"), S.feedback_rows, _FEEDBACK + " SELECT * FROM fr"),
    "feedback_proposals": Over(
        ("submissions", "annotations", "fb_pieces", "disputed_"),
        _proposed,
        _FEEDBACK + """ SELECT fb, ann, pattern_name AS name, 'other' AS plane, coalesce(nullif(pattern_what, ''), nullif(note, ''), pattern_name) AS what,
        CASE WHEN note <> '' AND pattern_what <> '' THEN note || ' — ' ELSE '' END || CASE WHEN len(texts) = 0 THEN n || ' region(s) marked on the paper' ELSE substring(array_to_string(texts, ' / '), 1, 600) END AS quote, fr.name AS author
        FROM m JOIN fr USING (fb) WHERE reason IS NULL AND kind = 'other' AND pattern_name <> ''""",
    ),
    "checked_proposals": Over(("drafts",), S.checked_proposals, _DRAFTS + " SELECT * FROM dr"),
    "proposal_bodies": Over(
        ("drafts",),
        _bodies,
        _DRAFTS + " SELECT id, '**Plane:** ' || plane || chr(10) || chr(10) || '**What it is:** ' || what || chr(10) || chr(10) || '---' || chr(10) || 'Proposed by ' || CASE WHEN id % 3 > 0 THEN 'Author ' || id ELSE 'Anonymous' END || CASE WHEN id % 2 > 0 THEN ' (Group)' ELSE '' END || '.' AS body FROM dr WHERE reason IS NULL",
    ),
    "checked_votes": Over(("ballots",), S.checked_votes, _BALLOTS + " SELECT * FROM bl"),
    "hub_tally": Over(
        ("ballots",),
        _hub_tally,
        _BALLOTS + f", l AS (SELECT token, item, arg_max(v, event_id) AS v FROM bl WHERE reason IS NULL GROUP BY token, item) SELECT i.item, count(*) FILTER (WHERE v > 0) AS up, count(*) FILTER (WHERE v < 0) AS down FROM (SELECT unnest([{_ITEMS}]) AS item) i LEFT JOIN l USING (item) GROUP BY i.item",
    ),
    "checked_posts": Over(
        ("posts",),
        S.checked_posts,
        f""", c AS (SELECT conv_id, turn, kind, item, substring({_trim('text')}, 1, CASE WHEN kind = 'case' THEN 800 ELSE 4000 END) AS text FROM posts)
        SELECT *, CASE WHEN kind IS NULL OR kind NOT IN ('case', 'prompt') THEN 'kind' WHEN item NOT IN ({_ITEMS}) THEN 'item' WHEN length(text) < CASE WHEN kind = 'case' THEN 10 ELSE 20 END THEN 'text' END AS reason FROM c""",
    ),
    "prompts_seen": Over(
        ("prompts_", "ups"),
        lambda prompts, ups: S.seen_by(prompts, ups, ASKING),
        f", u AS (SELECT id, count(DISTINCT token) AS ups, bool_or(token = {ASKING}) AS mine FROM ups WHERE token IS NOT NULL GROUP BY id) SELECT id, text, coalesce(ups, 0) AS ups, coalesce(mine, FALSE) AS mine FROM prompts_ LEFT JOIN u USING (id)",
    ),
    "report_heads": Over(("report_docs",), summaries.heads, f" SELECT doc_id, {_TITLE} AS title, source, CASE WHEN source = 'latex' THEN '{summaries.FROM_LATEX}' ELSE '{summaries.FROM_PDF}' END AS fidelity FROM report_docs"),
    "report_texts": Over(
        ("report_docs", "measured"),
        _reports,
        _MEANS + f""", k AS (SELECT r.*, t.place, t.name FROM measured r JOIN {_PLACES} USING (key)),
        ms AS (SELECT doc_id, bool_or(status IN ('skipped', 'error')) AS partial, string_agg('    ' || rpad(name, 26, ' ') || ' ' || rpad(status, 8, ' ') || ' ' || CASE WHEN score IS NULL THEN '—' ELSE printf('%.3f', score) || ' (' || num || '/' || den || ')' END, chr(10) ORDER BY place) AS lines FROM k GROUP BY doc_id),
        pl AS (SELECT doc_id, plane, min(place) AS place FROM k GROUP BY doc_id, plane),
        ps AS (SELECT doc_id, string_agg('  ' || rpad(plane, 10, ' ') || ' ' || CASE WHEN s IS NULL THEN '—' ELSE CAST(CAST(round_even(100 * s, 0) AS BIGINT) AS VARCHAR) END, chr(10) ORDER BY place) AS lines FROM p JOIN pl USING (doc_id, plane) GROUP BY doc_id)
        SELECT doc_id, {_TITLE} || chr(10) || '  Index: ' || coalesce(CAST(i AS VARCHAR), '—') || ' / 100' || CASE WHEN partial THEN '  (partial)' ELSE '' END || chr(10) || ps.lines || chr(10) || ms.lines AS report
        FROM report_docs JOIN a USING (doc_id) JOIN ps USING (doc_id) JOIN ms USING (doc_id)""",
    ),
    "metric_values": Over(
        ("measured",),
        _metrics,
        _MEANS + """ SELECT doc_id, CAST(any_value(i) AS DOUBLE) AS "index", round(any_value(100 * s) FILTER (WHERE plane = 'argument'), 9) AS plane, round(any_value(c), 9) AS measure
        FROM p JOIN a USING (doc_id) LEFT JOIN (SELECT doc_id, 100 * min(score) AS c FROM measured WHERE key = 'cross_refs' GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""",
    ),
    "overreach": Over(
        ("asserted", "covered", "limits"),
        _overreach,
        f""", i AS (SELECT claim, class, count(DISTINCT item) AS n FROM covered GROUP BY claim, class),
        v AS (SELECT a.claim, CASE WHEN a.claim IN (SELECT claim FROM limits) THEN FALSE ELSE (phrase <> '' AND contains(lower(text), lower(phrase)) AND len(string_split_regex(phrase, '\\s+')) <= 8 AND NOT regexp_matches(phrase, '^{WORK_NAME}$'))
            OR (a.class IS NOT NULL AND qualifier <> '' AND coalesce(n, 0) <= 2) END AS fails FROM asserted a LEFT JOIN i ON i.claim = a.claim AND i.class = a.class),
        c AS (SELECT claim, count(*) AS n, count(*) FILTER (WHERE fails) AS f FROM v GROUP BY claim)
        SELECT claim, CASE WHEN f > 0 AND f < n THEN 'UNRESOLVED' WHEN f > 0 THEN 'FAIL' ELSE 'PASS' END AS final FROM c""",
    ),
    "printed_names": Over(
        ("ref_lines", "styles"),
        references.printed_names,
        f""" SELECT o AS doc_id, CASE WHEN o % 2 = 0 THEN 'ref' || n ELSE 'doe' || s % 5 || 1990 + n || 'b' END AS cite_key, CASE p % 3 WHEN 0 THEN 'G' || p % 9 || 'Net' ELSE 'Two MixedName' || CASE WHEN o % 2 = 0 THEN chr(10) ELSE ' ' END || 'here' END AS name FROM {LINES} WHERE p % 3 <> 1""",
    ),
    "caption_starts": Over(
        ("caption_lines",),
        _captions,
        " SELECT id, CASE lower(left(text, 3)) WHEN 'fig' THEN 'figure' WHEN 'tab' THEN 'table' ELSE 'algorithm' END AS kind, regexp_extract(text, 'A?[0-9]+') AS number FROM caption_lines WHERE NOT starts_with(text, 'In') AND NOT contains(text, 'shows')",
    ),
    "log_totals": Over(
        ("log",),
        lambda log: listings.totals(log, "logged"),
        ", d AS (SELECT CASE WHEN regexp_matches(logged, '^[0-9]{4}-[0-9]{2}-[0-9]{2}( |$)') THEN left(logged, 10) END AS day FROM log) SELECT count(*) AS analyses, min(day) AS since, count(DISTINCT day) AS days FROM d",
    ),
    "gallery_newest": Over(("pages_",), _by_age, " SELECT *, row_number() OVER (ORDER BY coalesce(created, 0) DESC, page_id) AS rank FROM pages_"),
}

QUERIES = {name: (over.query, over.oracle) for name, over in SUBMITTED.items()}
