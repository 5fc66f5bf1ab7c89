"""The same operators on driver tables of the same shape (class: transposed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.scores import axis_top, band, index_of, ratio, shown
from vellum.functions.text import tokens
from vellum.operators import ranking, spans, vectors, votes
from vellum.streaming import jobs


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unreferenced_objects(spark, sf_dir):
    """Documents that no label points at."""
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left_anti")


def unreferenced_share(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("seen"))
    counts = docs.select("doc_id", "lang").join(labels, "doc_id", "left").groupBy("lang").agg(F.count_if(F.col("seen").isNull()).alias("num"), F.count("*").alias("den"))
    return counts.withColumn("score", ratio(F.col("num"), F.col("den")))


def reference_sources(spark, sf_dir):
    """Each part's distinct suppliers, and its lines in orders of the supplier that is its number modulo ten."""
    lines = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    found = _t(spark, sf_dir, "part").select("p_partkey").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")
    home = F.col("p_partkey") % 10
    outside = F.when(F.col("l_suppkey") != home, F.col("l_suppkey"))
    return found.groupBy("p_partkey").agg(F.countDistinct(outside).alias("n_sources"), F.min(outside).alias("first_source"), F.count_if(F.col("l_suppkey") == home).alias("own"))


def longest_run(spark, sf_dir):
    """Each user's longest run of events of no errors."""
    return spans.longest_run(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")


def event_islands(spark, sf_dir):
    """Runs of a user's events with ids at most 300 apart."""
    return spans.islands(_t(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 300)


def preceding_purchase(spark, sf_dir):
    """Each error with its user's last purchase before it."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    rows = events.filter("event_type = 'error'").select("user_id", "event_id")
    return spans.preceding(rows, events.filter("event_type = 'purchase'").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


def innermost_span(spark, sf_dir):
    """For each order and quantity, the narrowest price span of its lines that holds it."""
    lines = _t(spark, sf_dir, "lineitem")
    ranges = lines.select("l_orderkey", F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("span"), (F.col("l_quantity") - F.col("l_linenumber")).alias("first"), (F.col("l_quantity") + 2 * F.col("l_linenumber")).alias("last"))
    points = lines.select("l_orderkey", F.col("l_quantity").alias("at")).distinct()
    return spans.innermost(points, ranges, ["l_orderkey"], "at")


def previous_turn_context(spark, sf_dir):
    """Does the turn before, in the same conversation, come from a user?"""
    turns = _t(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", F.coalesce(spans.previous(turns, ["conv_id"], ["turn"], F.col("role") == "user"), F.lit(False)).alias("after_user"))


def shallow_edges(spark, sf_dir):
    """Each assistant turn with the other turn of its conversation that shares most words with it, the earliest on a tie; shallow if that comes later."""
    words = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_distinct(tokens(F.col("text"))).alias("w"))
    other = words.select("conv_id", F.col("turn").alias("support"), F.col("w").alias("v")).filter(F.size("v") >= 3)
    pairs = words.filter("role = 'assistant'").join(other, "conv_id").filter("turn <> support").withColumn("shared", F.size(F.array_intersect("w", "v")))
    best = pairs.groupBy("conv_id", "turn").agg(F.max_by(F.struct("support", "shared"), F.struct("shared", -F.col("support"))).alias("b"))
    return best.select("conv_id", F.col("turn").alias("claim"), "b.support", "b.shared", (F.col("b.support") > F.col("turn")).alias("shallow"))


def majority_vote(spark, sf_dir):
    return votes.majority(_t(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


def presence_vote(spark, sf_dir):
    """Kinds of events that more than half of five runs saw, a run being the event id modulo 5."""
    events = _t(spark, sf_dir, "events").withColumn("run", F.col("event_id") % 5)
    return votes.present(events, ["user_id"], "event_type", "run", 5)


def unit_verdicts(spark, sf_dir):
    """Final verdict of each user from the first three events as runs, in order."""
    events = _t(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "signup", "NA").otherwise("PASS")
    ranked = events.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))).filter("r <= 3")
    runs = ranked.groupBy("user_id").agg(F.collect_list(label).alias("runs"))
    return runs.select("user_id", votes.verdict(F.col("runs")).alias("final"))


def unit_verdicts_all_runs(spark, sf_dir):
    """Final verdict of each user with every event as a run."""
    label = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "signup", "NA").otherwise("PASS")
    return votes.verdicts(_t(spark, sf_dir, "events"), ["user_id"], label)


def score_coverage(spark, sf_dir):
    """Failing, passing and unresolved documents of each source."""
    joined = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    outcome = F.when(F.col("quality").isNull(), "NOT_APPLICABLE").when(F.col("toxic") == 1, "UNRESOLVED").when(F.col("quality") == 0, "FAIL").otherwise("PASS")
    return votes.score_and_coverage(joined, ["source"], outcome)


def mean_of_means_index(spark, sf_dir):
    """Languages as measures, sources as papers: mean quality by source and language, then by source, as an index with its band."""
    joined = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    planes = joined.groupBy("source", "lang").agg(F.avg(F.col("quality").cast("double")).alias("s"))
    score = planes.groupBy("source").agg(F.round(F.avg("s"), 10).alias("score"), F.count("*").alias("items"))
    return score.withColumn("index", index_of(F.col("score"))).withColumns({"band": band(F.col("index")), "shown": shown(F.col("score")), "axis": axis_top(F.col("index")).cast("double")})


def plane_contributions(spark, sf_dir):
    """What each language's mean adds to its source's index."""
    joined = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    planes = joined.groupBy("source", "lang").agg(F.avg(F.col("quality").cast("double")).alias("score"))
    return ranking.contributions(planes, ["source"], "score").select("source", "lang", F.round("part", 10).alias("part"))


def newest_wins_dedup(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_trunc("hour", "ts").cast("string").alias("hour"))
    return votes.newest(rows, ["user_id", "event_type"], "hour", "event_id").select("event_id", "user_id", "event_type", "value")


def leaderboard_topn(spark, sf_dir):
    return ranking.leaderboard(_t(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", title="c_name", q="customer", source="c_mktsegment", exclude=("MACHINERY",)).select("c_custkey", "c_name", "c_acctbal", "rank")


def leaderboard_nulls_last(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").withColumn("balance", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    down = ranking.nulls_last(rows, "balance", "s_suppkey", True).select("s_suppkey", "balance", F.lit("desc").alias("direction"), "rank")
    return down.unionByName(ranking.nulls_last(rows, "balance", "s_suppkey", False).select("s_suppkey", "balance", F.lit("asc").alias("direction"), "rank"))


def top3_threshold(spark, sf_dir):
    return ranking.shaded(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal")


def upper_median(spark, sf_dir):
    return ranking.upper_median(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")


def source_facets(spark, sf_dir):
    return ranking.facets(_t(spark, sf_dir, "documents"), "source")


def daily_counts(spark, sf_dir):
    return votes.daily(_t(spark, sf_dir, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "at")


def rate_limit_window(spark, sf_dir):
    """Each event's hits of its user in the day up to it, and whether more than three are too many. Unlike the exact limiter it also counts refused hits."""
    events = _t(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    hits = F.count("*").over(W.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0))
    return events.select("event_id", "user_id", hits.alias("hits"), (hits > 3).alias("over"))


def rate_limited(spark, sf_dir):
    """Each event of a user, and whether it is accepted: at most three accepted ones lie within a day."""
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return jobs.rate_limited(events, "user_id", "s", "event_id", 86400, 3).select("event_id", F.col("key").cast("long").alias("user_id"), "accepted")


def _votes(spark, sf_dir):
    value = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type") == "error", -1).when(F.col("event_type") == "signup", 0).otherwise(1)
    return _t(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 17).alias("item"), value.alias("v"))


def vote_upsert(spark, sf_dir):
    return votes.latest_votes(_votes(spark, sf_dir), ["user_id", "item"], "v", "event_id")


def vote_tally(spark, sf_dir):
    items = spark.range(20).withColumnRenamed("id", "item")
    return votes.tally(items, vote_upsert(spark, sf_dir), "item", "v")


def hub_rank(spark, sf_dir):
    order = [F.desc(F.col("up") - F.col("down")), F.desc("up"), F.col("item")]
    return vote_tally(spark, sf_dir).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # over the items


def prompt_toggles(spark, sf_dir):
    return votes.toggled(_votes(spark, sf_dir), ["user_id", "item"]).groupBy("item").agg(F.count("*").alias("ups"))


def contributors_merge(spark, sf_dir):
    curated = _t(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("team").alias("kind"), F.lit(1).alias("n"))
    recorded = _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("feedback"))
    proposed = _t(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.lit("pattern").alias("kind"), F.lit(0).alias("n"))
    again = _t(spark, sf_dir, "customer").select(F.upper("c_mktsegment").alias("name"), F.lit("pattern").alias("kind"), F.lit(5).alias("n")).distinct()
    return votes.merge_contributors((curated, True), (recorded, True), (proposed, False), (again, False))


def two_source_merge(spark, sf_dir):
    """The labelled documents, and those of the others whose language is not English."""
    labels, docs = _t(spark, sf_dir, "labels").select("doc_id"), _t(spark, sf_dir, "documents").select("doc_id", "lang")
    mirror = docs.join(labels, "doc_id", "left_semi").withColumn("origin", F.lit("mirror"))
    live = docs.filter("lang <> 'en'").join(mirror, "doc_id", "left_anti").withColumn("origin", F.lit("live"))
    return mirror.unionByName(live)


def html_outline(spark, sf_dir):
    """Headings, paragraphs, links and text length of each page (extension)."""
    page = _t(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    count = lambda tag: F.size(F.regexp_extract_all("html", F.lit(f"<{tag}[ >]"), F.lit(0)))
    return page.select("page_id", F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("h1"), count("p").alias("n_p"), count("a").alias("n_a"), F.length(F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))).alias("n_text"))


def nav_links(spark, sf_dir):
    """Links of each page with their place (extension)."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("at", "href"))


def url_labels(spark, sf_dir):
    """Host label and kind of each page's address."""
    host = F.regexp_replace(F.lower("url"), r"^https?://(www\.)?", "")
    host = F.regexp_extract(host, r"^[^/]*", 0)
    parts = F.split(host, r"\.")
    label = F.when(F.size(parts) >= 2, F.initcap(F.get(parts, F.size(parts) - 2))).otherwise("Link")
    return _t(spark, sf_dir, "pages").select("page_id", label.alias("label"), F.regexp_extract("url", r"/([a-z]{2})/(\d+)", 2).alias("number"))


def props_json(spark, sf_dir):
    """A number out of each event's JSON, by type (extension)."""
    k = F.get_json_object("props", "$.k").cast("long")
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"), F.max(k).alias("most"))


def tumbling(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "value")


def sliding(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def session(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def embedding_neighbours(spark, sf_dir):
    """The five nearest vectors by cosine of every vector whose id is divisible by 100: this stated set of queries goes to all rows."""
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = vectors.nearest(rows.filter("id % 100 = 0"), rows, 5)
    return found.select("query", F.col("id").alias("vec_id"), F.round("cosine", 6).alias("cosine"), "rank")


_VOTES = "v AS (SELECT event_id, user_id, event_id % 17 AS item, CASE WHEN event_type = 'error' THEN -1 WHEN event_type = 'signup' THEN 0 ELSE 1 END AS v FROM events), latest AS (SELECT user_id, item, arg_max(v, event_id) AS v FROM v GROUP BY user_id, item HAVING arg_max(v, event_id) <> 0)"
_TALLY = f"{_VOTES}, tally AS (SELECT i AS item, count(*) FILTER (WHERE v > 0) AS up, count(*) FILTER (WHERE v < 0) AS down FROM range(20) t(i) LEFT JOIN latest ON item = i GROUP BY i)"
_PLANES = "planes AS (SELECT source, lang, avg(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)"

QUERIES = {
    "unreferenced_objects": (unreferenced_objects, "SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id)"),
    "unreferenced_share": (unreferenced_share, "SELECT lang, count(*) FILTER (WHERE l.doc_id IS NULL) AS num, count(*) AS den, count(*) FILTER (WHERE l.doc_id IS NULL) / count(*) AS score FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang"),
    "reference_sources": (
        reference_sources,
        "SELECT p_partkey, count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey <> p_partkey % 10) AS n_sources, min(l_suppkey) FILTER (WHERE l_suppkey <> p_partkey % 10) AS first_source, count(*) FILTER (WHERE l_suppkey = p_partkey % 10) AS own FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey",
    ),
    "longest_run": (
        longest_run,
        """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        g AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS r FROM n WHERE event_type <> 'error'),
        runs AS (SELECT user_id, r, min(n) AS start, count(*) AS length FROM g GROUP BY user_id, r HAVING count(*) >= 2)
        SELECT user_id, start, length FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1""",
    ),
    "event_islands": (
        event_islands,
        """WITH m AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER w <= 300 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
        SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island""",
    ),
    "preceding_purchase": (
        preceding_purchase,
        "SELECT e.user_id, e.event_id, p.value FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id WHERE e.event_type = 'error'",
    ),
    "innermost_span": (
        innermost_span,
        """WITH r AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS span, l_quantity - l_linenumber AS first, l_quantity + 2 * l_linenumber AS last FROM lineitem),
        p AS (SELECT DISTINCT l_orderkey, l_quantity AS "at" FROM lineitem)
        SELECT l_orderkey, "at", span FROM p JOIN r USING (l_orderkey) WHERE "at" BETWEEN first AND last QUALIFY row_number() OVER (PARTITION BY l_orderkey, "at" ORDER BY last - first, first, span) = 1""",
    ),
    "previous_turn_context": (previous_turn_context, "SELECT conv_id, turn, role, coalesce(lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn), false) AS after_user FROM conversations"),
    "shallow_edges": (
        shallow_edges,
        """WITH w AS (SELECT conv_id, turn, role, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\[(?:cite|math|ref)\\]|[A-Za-z0-9]+(?:[''’\\-][A-Za-z0-9]+)*')]) AS w FROM conversations),
        p AS (SELECT a.conv_id, a.turn AS claim, b.turn AS support, len(list_intersect(a.w, b.w)) AS shared FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE a.role = 'assistant' AND len(b.w) >= 3)
        SELECT conv_id, claim, support, shared, support > claim AS shallow FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, claim ORDER BY shared DESC, support) = 1""",
    ),
    "majority_vote": (
        majority_vote,
        """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), m AS (SELECT user_id, max(n) AS most FROM c GROUP BY user_id),
        t AS (SELECT user_id, most, count(*) > 1 AS tied, min(event_type) AS top FROM m JOIN c USING (user_id) WHERE n = most GROUP BY user_id, most), f AS (SELECT user_id, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN tied THEN first ELSE top END AS winner, most, tied FROM t JOIN f USING (user_id)""",
    ),
    "presence_vote": (presence_vote, "SELECT user_id, event_type, count(DISTINCT event_id % 5) AS votes FROM events GROUP BY user_id, event_type HAVING count(DISTINCT event_id % 5) * 2 > 5"),
    "unit_verdicts": (
        unit_verdicts,
        """WITH r AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'F' WHEN 'signup' THEN 'N' ELSE 'P' END AS l FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3),
        c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE l = 'F') AS f, count(*) FILTER (WHERE l = 'P') AS p, count(*) FILTER (WHERE l = 'N') AS na FROM r GROUP BY user_id)
        SELECT user_id, CASE WHEN n < 2 OR (f > 0 AND p > 0) THEN 'UNRESOLVED' WHEN f * 2 > n THEN 'FAIL' WHEN p * 2 > n THEN 'PASS' WHEN na * 2 > n THEN 'NOT_APPLICABLE' ELSE 'UNRESOLVED' END AS final FROM c""",
    ),
    "unit_verdicts_all_runs": (
        unit_verdicts_all_runs,
        """WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'signup') AS na FROM events GROUP BY user_id), d AS (SELECT *, n - f - na AS p FROM c)
        SELECT user_id, CASE WHEN n < 2 OR (f > 0 AND p > 0) THEN 'UNRESOLVED' WHEN f * 2 > n THEN 'FAIL' WHEN p * 2 > n THEN 'PASS' WHEN na * 2 > n THEN 'NOT_APPLICABLE' ELSE 'UNRESOLVED' END AS final FROM d""",
    ),
    "score_coverage": (
        score_coverage,
        """WITH c AS (SELECT source, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS f, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS p, count(*) FILTER (WHERE toxic = 1) AS u FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
        SELECT *, f / nullif(f + p, 0) AS score, (f + p) / nullif(f + p + u, 0) AS coverage FROM c""",
    ),
    "mean_of_means_index": (
        mean_of_means_index,
        f"""WITH {_PLANES}, s AS (SELECT source, round(avg(s), 10) AS score, count(*) AS items FROM planes GROUP BY source), i AS (SELECT *, CAST(round_even(score * 100, 0) AS BIGINT) AS "index" FROM s)
        SELECT *, CASE WHEN "index" < 20 THEN 'Low' WHEN "index" < 40 THEN 'Moderate' WHEN "index" < 60 THEN 'High' ELSE 'Very high' END AS band,
        CASE WHEN score > 0 AND score * 100 < 1 THEN '<1' ELSE CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS shown, CAST(least(100, greatest(20, ceil("index" * 1.15 / 10) * 10)) AS DOUBLE) AS axis FROM i""",
    ),
    "plane_contributions": (plane_contributions, f"WITH {_PLANES} SELECT source, lang, round(s / count(*) OVER (PARTITION BY source), 10) AS part FROM planes"),
    "newest_wins_dedup": (newest_wins_dedup, "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('hour', ts) DESC, event_id DESC) = 1"),
    "leaderboard_topn": (leaderboard_topn, "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE lower(c_name) LIKE '%customer%' AND c_mktsegment <> 'MACHINERY' ORDER BY rank LIMIT 30"),
    "leaderboard_nulls_last": (
        leaderboard_nulls_last,
        """WITH b AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier)
        SELECT * FROM (SELECT s_suppkey, balance, 'desc' AS direction, row_number() OVER (ORDER BY balance DESC NULLS LAST, s_suppkey) AS rank FROM b
        UNION ALL SELECT s_suppkey, balance, 'asc' AS direction, row_number() OVER (ORDER BY balance ASC NULLS LAST, s_suppkey) AS rank FROM b) WHERE rank <= 1000""",
    ),
    "top3_threshold": (top3_threshold, "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, min(c_acctbal) AS threshold FROM (SELECT * FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) <= 3) GROUP BY c_nationkey"),
    "upper_median": (upper_median, "SELECT o_orderpriority, list_sort(list(o_totalprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM orders GROUP BY o_orderpriority"),
    "source_facets": (source_facets, "SELECT source, count(*) AS n FROM documents GROUP BY source"),
    "daily_counts": (daily_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY day"),
    "rate_limit_window": (
        rate_limit_window,
        "WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) SELECT event_id, user_id, count(*) OVER w AS hits, count(*) OVER w > 3 AS over FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)",
    ),
    "rate_limited": (
        rate_limited,
        """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, n, true AS accepted, [s] AS taken FROM e WHERE n = 1
            UNION ALL SELECT user_id, event_id, n, ok, CASE WHEN ok THEN list_append(recent, s) ELSE recent END FROM (SELECT e.*, [x FOR x IN taken IF e.s - x <= 86400] AS recent, len([x FOR x IN taken IF e.s - x <= 86400]) < 3 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
        SELECT event_id, user_id, accepted FROM r""",
    ),
    "vote_upsert": (vote_upsert, f"WITH {_VOTES} SELECT user_id, item, CAST(v AS BIGINT) AS v FROM latest"),
    "vote_tally": (vote_tally, f"WITH {_TALLY} SELECT * FROM tally"),
    "hub_rank": (hub_rank, f"WITH {_TALLY} SELECT *, row_number() OVER (ORDER BY up - down DESC, up DESC, item) AS rank FROM tally"),
    "prompt_toggles": (prompt_toggles, f"WITH {_VOTES} SELECT item, count(*) AS ups FROM (SELECT user_id, item FROM v GROUP BY user_id, item HAVING count(*) % 2 = 1) GROUP BY item"),
    "contributors_merge": (
        contributors_merge,
        """WITH r AS (SELECT r_name AS name, 'team' AS kind, 1 AS n, 0 AS rank FROM region UNION ALL SELECT c_mktsegment, 'feedback', count(*), 1 FROM customer GROUP BY c_mktsegment
        UNION ALL SELECT lower(n_name), 'pattern', 0, 2 FROM nation UNION ALL SELECT DISTINCT upper(c_mktsegment), 'pattern', 0, 3 FROM customer)
        SELECT lower(name) AS key, arg_min(name, rank) AS name, CAST(sum(n) AS BIGINT) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM r GROUP BY lower(name)""",
    ),
    "two_source_merge": (two_source_merge, "SELECT doc_id, lang, CASE WHEN l.doc_id IS NULL THEN 'live' ELSE 'mirror' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NOT NULL OR lang <> 'en'"),
    "html_outline": (
        html_outline,
        """SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, len(regexp_extract_all(html, '<p[ >]')) AS n_p, len(regexp_extract_all(html, '<a[ >]')) AS n_a,
        length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS n_text FROM pages""",
    ),
    "nav_links": (nav_links, """SELECT page_id, i - 1 AS "at", a[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages), unnest(range(1, len(a) + 1)) AS t(i)"""),
    "url_labels": (
        url_labels,
        r"""WITH h AS (SELECT page_id, url, string_split(regexp_extract(regexp_replace(lower(url), '^https?://(www\.)?', ''), '^[^/]*'), '.') AS p FROM pages)
        SELECT page_id, CASE WHEN len(p) >= 2 THEN upper(p[-2][1]) || p[-2][2:] ELSE 'Link' END AS label, regexp_extract(url, '/([a-z]{2})/(\d+)', 2) AS number FROM h""",
    ),
    "props_json": (props_json, "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"),
    "tumbling": (tumbling, "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL"),
    "sliding": (sliding, "SELECT strftime(date_trunc('hour', ts) - o * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events, range(2) t(o) GROUP BY start"),
    "session": (
        session,
        """WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
    "embedding_neighbours": (
        embedding_neighbours,
        """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.e, q.e), 6) AS cosine, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.e, q.e) DESC, e.vec_id) AS rank
        FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id QUALIFY rank <= 5""",
    ),
}
