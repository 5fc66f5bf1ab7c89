"""Lists, roll-ups, printed references and citations: on driver tables of the same shape."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.matches import match_spans, token_spans
from vellum.functions.text import TOKEN, tokens
from vellum.operators import listings, prose, ranking, spans
from vellum.plans import prose_queries, table_queries
from vellum.plans.paper_queries import between, matched, place
from vellum.plans.prose_queries import TOKENS, _docs, _sents, _sql, _stored_sents
from vellum.plans.table_queries import _t

LINK = '<a href="([^"]*)"'


def covered_runs(spark, sf_dir):
    """Runs of repeated tokens in the flagged sentences."""
    sents = _stored_sents(spark, sf_dir)
    return prose.covered_runs(sents, prose.judged_sentences(sents))


def highlight_ranges(spark, sf_dir):
    """The same runs as ranges of characters."""
    sents = _stored_sents(spark, sf_dir)
    return prose.highlighted(prose.covered_runs(sents, prose.judged_sentences(sents)), sents)


def token_places(spark, sf_dir):
    """Every token of every sentence with its characters."""
    sents = _sents(spark, sf_dir).select("doc_id", "sec", "sent", F.posexplode(token_spans(F.col("text"))).alias("nth", "s"))
    return sents.select("doc_id", "sec", "sent", "nth", "s.at", "s.end", "s.token")


def link_mentions(spark, sf_dir):
    """Links of each page in the order in which they stand, with their characters; an address that comes again is a further mention of it."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.explode(match_spans(F.col("html"), LINK)).alias("s"))
    links = pages.select("page_id", "s.at", "s.end", F.regexp_extract("s.match", LINK, 1).alias("href"))
    return links.withColumn("mention", F.row_number().over(W.partitionBy("page_id", "href").orderBy("at")))


def sentence_numbers(spark, sf_dir):
    return listings.numbered_sentences(_sents(spark, sf_dir)).select("doc_id", "sec", "sent", "number")


def map_positions(spark, sf_dir):
    return listings.map_positions(prose_queries.section_outline(spark, sf_dir))


def gallery_sorts(spark, sf_dir):
    """Suppliers by balance, those without one last in either direction, by stand-ins of -1 and 999 as far as balances lie between them."""
    rows = _t(spark, sf_dir, "supplier").withColumn("index", F.when(F.col("s_acctbal").between(0, 998), F.col("s_acctbal")))
    high = ranking.nulls_last(rows.withColumn("v", F.coalesce("index", F.lit(-1.0))), "v", "s_suppkey", True).withColumn("sort", F.lit("high"))
    low = ranking.nulls_last(rows.withColumn("v", F.coalesce("index", F.lit(999.0))), "v", "s_suppkey", False).withColumn("sort", F.lit("low"))
    return high.unionByName(low).select("s_suppkey", "sort", "index", "rank")


def recent_list(spark, sf_dir):
    """The latest thirty users by their last event."""
    return listings.recent(_t(spark, sf_dir, "events"), "user_id", "event_id")


def latest_500(spark, sf_dir):
    return listings.latest(_t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


def contributors_order(spark, sf_dir):
    """Contributors by falling number and name."""
    rows = table_queries.contributors_merge(spark, sf_dir)
    return ranking.ranked(rows.select("name", "n"), [F.desc("n"), F.lower("name"), "name"])


def prompts_by_ups(spark, sf_dir):
    """Users of each item by their positive votes."""
    ups = table_queries._votes(spark, sf_dir).groupBy("item", "user_id").agg(F.count_if(F.col("v") == 1).alias("ups"))
    return ups.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("ups"), "user_id")))


def valid_turns(spark, sf_dir):
    """Turns as submissions: users' are prompts, others' quotes; what is too short is set apart with the reason."""
    turns = _t(spark, sf_dir, "conversations").withColumn("n", F.length(F.trim(F.coalesce("text", F.lit("")))))
    reason = F.when(~F.col("role").isin("user", "assistant"), "role").when((F.col("role") == "user") & (F.col("n") < listings.LEAST_PROMPT), "prompt").when(F.col("n") < listings.LEAST_QUOTE, "quote")
    return turns.select("conv_id", "turn", reason.alias("reason"), reason.isNull().alias("valid"))


def shared_content(spark, sf_dir):
    """Each turn against the one before: the share of its content words (four letters or more) that stand there; from 40 percent on it is held back."""
    words = F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 4))
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"))
    before = F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))
    shared = turns.withColumn("v", before).filter("v is not null and size(w) > 0")
    share = F.size(F.array_intersect("w", "v")) / F.size("w")
    return shared.select("conv_id", "turn", share.alias("share"), (share >= 0.4).alias("held"))


def progress(spark, sf_dir):
    """Each user's largest value so far, at most 100."""
    return listings.monotone(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value").drop("value")


def located_share(spark, sf_dir):
    """Documents of each source, and those of them that labels locate."""
    seen = _t(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("seen"))
    return _t(spark, sf_dir, "documents").select("doc_id", "source").join(seen, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("seen")).alias("located"))


def line_boxes(spark, sf_dir):
    """The box around the lines of each order and flag, quantity and discount being places."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + F.col("l_linenumber")).alias("x1"), F.col("l_tax").alias("y1"))
    return spans.union_rectangles(lines, ["l_orderkey", "l_returnflag"])


def plain_tokens(spark, sf_dir):
    """Words between white space, in plain letters and digits, and their number."""
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", r"\s+")).alias("word"))
    return words.select(listings.plain_token(F.col("word")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


_LIGATURES = "".join(f", '{a}', '{b}')" for a, b in [("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬅ", "ft"), ("ﬆ", "st")])

QUERIES = {
    "covered_runs": (
        covered_runs,
        _sql(
            """, r AS (SELECT *, at_ - lag(at_) OVER (PARTITION BY doc_id, sec, sent ORDER BY at_) > 8 AS fresh FROM hits),
            k AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id, sec, sent ORDER BY at_) AS run FROM r)
            SELECT doc_id, sec, sent, min(at_) AS "first", max(at_) + 7 AS "last" FROM k SEMI JOIN flag USING (doc_id, sec, sent) GROUP BY doc_id, sec, sent, run"""
        ),
    ),
    "highlight_ranges": (
        highlight_ranges,
        _sql(
            f""", r AS (SELECT *, at_ - lag(at_) OVER (PARTITION BY doc_id, sec, sent ORDER BY at_) > 8 AS fresh FROM hits),
            k AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id, sec, sent ORDER BY at_) AS run FROM r),
            w AS (SELECT doc_id, sec, sent, min(at_) + 1 AS a, max(at_) + 8 AS b FROM k SEMI JOIN flag USING (doc_id, sec, sent) GROUP BY doc_id, sec, sent, run),
            x AS (SELECT w.*, text, {between('text', TOKEN)} AS p, {matched('text', TOKEN)} AS m FROM w JOIN s USING (doc_id, sec, sent)),
            y AS (SELECT *, {place('p', 'm', 'a')} AS "at", {place('p', 'm', 'b')} + length(m[b]) AS "end" FROM x)
            SELECT doc_id, sec, sent, "at", "end", substring(text, "at" + 1, "end" - "at") AS excerpt FROM y"""
        ),
    ),
    "token_places": (
        token_places,
        _sql(
            f""", x AS (SELECT doc_id, sec, sent, {between('text', TOKEN)} AS p, {matched('text', TOKEN)} AS m FROM s),
            y AS (SELECT doc_id, sec, sent, i - 1 AS nth, {place('p', 'm', 'i')} AS "at", m[i] AS token FROM x, unnest(range(1, len(m) + 1)) AS t(i))
            SELECT doc_id, sec, sent, nth, "at", "at" + length(token) AS "end", lower(token) AS token FROM y"""
        ),
    ),
    "link_mentions": (
        link_mentions,
        f"""WITH x AS (SELECT page_id, {between('html', LINK)} AS p, {matched('html', LINK)} AS m, regexp_extract_all(html, '{LINK}', 1) AS h FROM pages),
        y AS (SELECT page_id, {place('p', 'm', 'i')} AS "at", {place('p', 'm', 'i')} + length(m[i]) AS "end", h[i] AS href FROM x, unnest(range(1, len(m) + 1)) AS t(i))
        SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY "at") AS mention FROM y""",
    ),
    "sentence_numbers": (sentence_numbers, _sql("SELECT doc_id, sec, sent, row_number() OVER (PARTITION BY doc_id ORDER BY sec, sent) AS number FROM s")),
    "map_positions": (
        map_positions,
        _sql("SELECT doc_id, sec, greatest(n_sentences, 4) AS weight, CAST(coalesce(sum(greatest(n_sentences, 4)) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM outline"),
    ),
    "gallery_sorts": (
        gallery_sorts,
        """WITH s AS (SELECT s_suppkey, CASE WHEN s_acctbal BETWEEN 0 AND 998 THEN s_acctbal END AS "index" FROM supplier)
        SELECT s_suppkey, 'high' AS sort, "index", row_number() OVER (ORDER BY coalesce("index", -1) DESC, s_suppkey) AS rank FROM s
        UNION ALL SELECT s_suppkey, 'low', "index", row_number() OVER (ORDER BY coalesce("index", 999), s_suppkey) FROM s""",
    ),
    "recent_list": (recent_list, "SELECT user_id, max(event_id) AS event_id, row_number() OVER (ORDER BY max(event_id) DESC, user_id) AS rank, row_number() OVER (ORDER BY max(event_id) DESC, user_id) <= 12 AS shown FROM events GROUP BY user_id QUALIFY rank <= 30"),
    "latest_500": (latest_500, "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500"),
    "contributors_order": (contributors_order, f"SELECT name, n, row_number() OVER (ORDER BY n DESC, lower(name), name) AS rank FROM ({table_queries.QUERIES['contributors_merge'][1]})"),
    "prompts_by_ups": (
        prompts_by_ups,
        """WITH u AS (SELECT event_id % 17 AS item, user_id, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS ups FROM events GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY item ORDER BY ups DESC, user_id) AS rank FROM u""",
    ),
    "valid_turns": (
        valid_turns,
        """WITH t AS (SELECT *, length(trim(coalesce(text, ''))) AS n FROM conversations),
        r AS (SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN role = 'user' AND n < 20 THEN 'prompt' WHEN n < 10 THEN 'quote' END AS reason FROM t) SELECT *, reason IS NULL AS valid FROM r""",
    ),
    "shared_content": (
        shared_content,
        f"""WITH t AS (SELECT conv_id, turn, list_distinct([x FOR x IN {TOKENS.format('text')} IF length(x) >= 4]) AS w FROM conversations),
        b AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t)
        SELECT conv_id, turn, len(list_intersect(w, v)) / len(w) AS share, len(list_intersect(w, v)) / len(w) >= 0.4 AS held FROM b WHERE v IS NOT NULL AND len(w) > 0""",
    ),
    "progress": (progress, "SELECT user_id, event_id, round(max(least(value, 100)) OVER (PARTITION BY user_id ORDER BY event_id), 1) AS progress FROM events"),
    "located_share": (located_share, "SELECT source, count(*) AS total, count(l.doc_id) AS located FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"),
    "line_boxes": (line_boxes, "SELECT l_orderkey, l_returnflag, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + l_linenumber) AS x1, max(l_tax) AS y1 FROM lineitem GROUP BY l_orderkey, l_returnflag"),
    "plain_tokens": (
        plain_tokens,
        f"""SELECT token, count(*) AS n FROM (SELECT regexp_replace(lower({'replace(' * 7}word{_LIGATURES}), '[^a-z0-9]', '', 'g') AS token
        FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)) WHERE token <> '' GROUP BY token""",
    ),
}
