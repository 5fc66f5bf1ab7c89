"""Files written from the given tables and read again by the readers: reports, registry runs, logs, sheets, archives and answers.

Spark writes the files to the shared folder; the SQL knows what was written and reads none of them."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import answers
from vellum.plans.paper_queries import Over
from vellum.plans.paper_tables import INPUTS, LINES, ONE_PASS, one_of
from vellum.sources import files, reports
from vellum.storage import folder

_KEYS = ("cross_refs", "macro_redundancy", "argument_graph", "citation_isolation", "figure_exposition", "evidence_gap")

# Reports by order, of which some run still, some can't be parsed and some aren't shown; their findings; registry runs by customer; a log by event and a sheet by order; texts for archives; answers by event.
INPUTS |= {
    "job_heads": f"""SELECT o_orderkey AS doc_id, concat('job-', o_orderkey) AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'running' ELSE 'done' END AS status, o_orderkey % 11 = 0 AS broken, concat('Label ', o_custkey) AS label, o_orderkey % 3 > 0 AS gallery,
        CAST(o_orderkey % 1000 AS DOUBLE) AS created, CASE WHEN o_custkey % 3 = 0 THEN concat('Paper "', o_orderkey, '"') END AS title, {one_of('o_custkey', 'https://arxiv.org/abs/2401.1', 'https://www.openreview.net/forum?id=a', 'http://aclanthology.org/x', 'https://www.example.org/x', 'localhost', '')} AS url,
        {one_of('o_orderkey', 'upload', 'arxiv source', 'link')} AS route, CASE WHEN o_orderkey % 10 = 3 THEN 'Given' END AS given, CAST(o_orderkey % 101 AS INT) AS idx, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END AS partial FROM orders""",
    "job_findings": " UNION ALL ".join(f"""SELECT o AS doc_id, {one_of('n - 1', *_KEYS)} AS key, {r} AS nth, {one_of(f'(p + {r})', 'A "quoted" text, with a comma', 'Plain text', '')} AS text, CASE WHEN s % 3 > 0 THEN concat('why ', q) END AS why,
        CASE WHEN d % 2 = 0 THEN concat('§', n, ' Part') END AS section, CAST(s % 4 AS INT) AS page, CAST((s + q) % 3 AS INT) AS page2, CAST(q AS DOUBLE) AS x FROM {LINES} WHERE n <= 6 AND p % 3 > {r}""" for r in (0, 1)),
    "run_meta": "SELECT concat('1-', c_custkey) AS item, c_name AS title, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 4 END AS pre_fail, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 END AS pre_pass, CASE WHEN c_custkey % 3 > 1 THEN 2 END AS pre_open FROM customer",
    "run_units": f"SELECT concat('1-', o_custkey) AS item, concat('u', o_orderkey) AS id, {one_of('o_orderkey', 'FAIL', 'PASS', 'UNRESOLVED', 'NOT_APPLICABLE', 'PASS')} AS final FROM orders",
    "log_rows": "SELECT event_id, event_type AS kind, concat('2025-01-', 10 + event_id % 18) AS at, concat('k', user_id) AS key, concat('name ', user_id) AS name, CAST(1000 + event_id % 9000 AS STRING) AS value, concat('secret', user_id) AS _token FROM events",
    "sheet_rows": f"SELECT o_orderkey AS id, {one_of('o_orderkey', 'click', 'purchase', 'view')} AS kind, concat('2024-01-', 10 + o_orderkey % 18) AS at, concat('k', o_custkey) AS key, concat('Sheet, \"', o_custkey, '\"') AS name, CAST(1000 + o_orderkey % 9000 AS STRING) AS value FROM orders",
    "answer_rows": f"""SELECT event_id, {one_of('event_id', *'0123456')} AS form, concat('{{"b": ', user_id, ', "a": {{"z": "x {{y}}", "k": ', event_id % 90, '}}}}') AS json FROM events""",
}
ONE_PASS["job_findings"] = f"""SELECT o AS doc_id, {one_of('n - 1', *_KEYS)} AS key, nth, {one_of('(p + nth)', 'A "quoted" text, with a comma', 'Plain text', '')} AS text, CASE WHEN s % 3 > 0 THEN concat('why ', q) END AS why,
        CASE WHEN d % 2 = 0 THEN concat('§', n, ' Part') END AS section, CAST(s % 4 AS INT) AS page, CAST((s + q) % 3 AS INT) AS page2, CAST(q AS DOUBLE) AS x FROM {LINES} LATERAL VIEW explode(array(0, 1)) AS nth WHERE n <= 6 AND p % 3 > nth"""


def _reports(heads: DataFrame, measured: DataFrame, found: DataFrame) -> DataFrame:
    """(value): reports as lines of JSON; those to be broken lose their end."""
    pages = F.transform(F.array("page", "page2"), lambda p: F.struct(p.alias("p"), F.array(F.array("x", "x", F.col("x") + 1, F.col("x") + 2)).alias("r")))
    instance = F.struct("nth", "text", "why", F.col("section").alias("section_title"), F.when(F.col("page") < 3, pages).alias("pdf"))
    # Measures and findings meet by report, within the row: a join by report and measure would shuffle both again.
    instances = found.groupBy("doc_id").agg(F.collect_list(F.struct("key", instance.alias("i"))).alias("found"))
    listed = measured.groupBy("doc_id").agg(F.collect_list(F.struct("key", "plane", "status", "score", "num", "den")).alias("listed"))
    of = lambda m: F.transform(F.filter("found", lambda f: f["key"] == m["key"]), lambda f: f["i"])
    ordered = lambda m: F.array_sort(of(m), lambda a, b: a["nth"] - b["nth"])
    held = lambda m: F.when(F.exists("found", lambda f: f["key"] == m["key"]), ordered(m)).alias("instances")
    measure = lambda m: F.struct(*(m[c].alias(c) for c in ("key", "plane", "status", "score", "num", "den")), F.array(F.concat(m["status"], F.lit(", noted")), F.lit("second note")).alias("notes"), held(m))
    measures = listed.join(instances, "doc_id", "left").select("doc_id", F.transform("listed", measure).alias("measures"))
    document = F.struct("title", "url", "route")
    result = F.struct(F.struct(F.col("idx").alias("index"), "partial").alias("index"), document.alias("document"), "measures")
    report = F.to_json(F.struct("key", "status", "label", "created", "gallery", F.col("given").alias("source_label"), result.alias("result")))
    return heads.join(measures, "doc_id").select(F.when(F.col("broken"), F.substring(report, F.lit(1), F.length(report) - 5)).otherwise(report).alias("value"))


def _jobs(heads: DataFrame, measured: DataFrame, found: DataFrame) -> DataFrame:
    """Reports written as compressed lines and read again."""
    spark = heads.sparkSession
    path = folder(spark, "jobs")
    _reports(heads, measured, found).write.option("compression", "gzip").text(path)
    return reports.read_reports(spark, path, lines=True)


def _results(heads, measured, found):
    rows = reports.measure_results(_jobs(heads, measured, found))
    return rows.select("doc_id", "key", "plane", "status", "score", "num", "den", F.greatest(F.size("instances"), F.lit(0)).alias("n_instances"))


def _gallery(heads, measured, found):
    shown = reports.gallery(_jobs(heads, measured, found))
    return shown.select("key", "title", "url", "created", "index", "partial", "source", *(F.round(F.col("planes")[p], 9).alias(p) for p in ("structure", "argument", "artifacts")))


def _findings(heads, measured, found):
    """The export, written as CSV and read again."""
    rows = reports.findings(reports.measure_results(_jobs(heads, measured, found)))
    path = folder(heads.sparkSession, "csv")
    reports.write_csv(rows, path)
    return reports.read_csv(heads.sparkSession, path, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes))


def _marks(heads, measured, found):
    rows = reports.first_page_marks(reports.measure_results(_jobs(heads, measured, found)))
    return rows.select("doc_id", "measure", F.array_join(F.transform("rect", lambda v: v.cast("int").cast("string")), " ").alias("rect"), "note")


def _runs(meta: DataFrame, units: DataFrame) -> DataFrame:
    """Registry runs written, a line each, and their scores."""
    spark = meta.sparkSession
    listed = units.groupBy("item").agg(F.collect_list(F.struct("id", "final")).alias("units"))
    pre = F.when(F.coalesce("pre_fail", "pre_pass", "pre_open").isNotNull(), F.struct(F.col("pre_fail").alias("FAIL"), F.col("pre_pass").alias("PASS"), F.col("pre_open").alias("UNRESOLVED")))
    path = folder(spark, "runs")
    meta.join(listed, "item", "left").select(F.to_json(F.struct(F.struct("item", "title", pre.alias("pre")).alias("meta"), "units")).alias("value")).write.text(path)
    return reports.run_scores(*reports.read_runs(spark, path, lines=True)).withColumns({c: F.round(c, 9) for c in ("score", "coverage")})


def _logged(log: DataFrame, sheet: DataFrame) -> DataFrame:
    """Clicks of a log that was added to twice, then those of a sheet with other keys."""
    spark = log.sparkSession
    lines, table = folder(spark, "log"), folder(spark, "sheet")
    for part in (0, 1):
        reports.append_log(log.filter(F.col("event_id") % 2 == part).drop("event_id"), lines)
    reports.write_csv(sheet.drop("id"), table)
    return reports.first_of(reports.read_log(spark, lines, "click"), reports.read_sheet(spark, table, "click"))


def _packed(form: int, name: str, data: bytes) -> bytes:
    """An archive in one of five forms: zip, tar, gzip, the file itself, and a zip that is none."""
    out = io.BytesIO()
    if form == 0:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for path in (name, "notes/copy.txt", "../outside.txt"):
                z.writestr(path, data)
    elif form == 1:
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
            for path in (name, "../outside.txt"):
                member = tarfile.TarInfo(path)
                member.size = len(data)
                t.addfile(member, io.BytesIO(data))
    elif form == 2:
        return gzip.compress(data, mtime=0)
    else:
        return data if form == 3 else b"PK" + data
    return out.getvalue()


def _archives(docs: DataFrame) -> DataFrame:
    """Whole texts in archives, unpacked: kind of each archive, and length and hash of each file in it."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [_packed(i % 5, "main.tex", (text or "").encode()) for i, text in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame({"path": [f"a{i}" + (".gz" if i % 5 == 2 else "") for i in b["doc_id"]], "content": data})

    packed = docs.select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    members = files.unpack(packed.withColumn("path", F.concat(files.kind_of(F.col("content"), F.col("path")), F.lit("/"), "path")))
    parts = F.split("archive", "/")
    return members.select(parts[1].alias("archive"), parts[0].alias("kind"), F.regexp_extract("path", "[^/]+/?[^/]*$", 0).alias("file"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), F.col("error").isNotNull().alias("failed"))


def _answers(rows: DataFrame) -> DataFrame:
    """Answers around JSON in seven forms, of which the last two hold none, read leniently."""
    json = F.col("json")
    text = (
        F.when(F.col("form") == "0", json).when(F.col("form") == "1", F.concat(F.lit("\n```json\n"), json, F.lit("\n```\n")))
        .when(F.col("form") == "2", F.concat(F.lit("<think>Is it {this}?\nNo.</think>\n"), json)).when(F.col("form") == "3", F.concat(F.lit("Here it is:\n"), json, F.lit("\nThat is all.")))
        .when(F.col("form") == "4", F.concat(F.lit("```\n"), json, F.lit("```"))).when(F.col("form") == "5", F.lit("I can't say.")).otherwise(F.concat(F.lit("It is "), F.expr("left(json, length(json) - 1)")))
    )
    found = rows.select("event_id", answers.parsed(text).alias("v"))
    return found.select("event_id", F.try_variant_get("v", "$.a.k", "long").alias("k"), answers.canonical(F.col("v")).alias("json"), answers.answer_key(F.col("v")).alias("key"))


_JOBS = """, h AS (SELECT * FROM job_heads WHERE status = 'done' AND NOT broken), m AS (SELECT h.key AS job, m.*, m.status || ', noted' AS note FROM measured m JOIN h USING (doc_id)),
    f AS (SELECT m.job, m.key AS measure, f.* EXCLUDE (doc_id, key) FROM job_findings f JOIN m ON m.doc_id = f.doc_id AND m.key = f.key)"""
_SOURCES = "'arXiv', 'OpenReview', 'ACL', 'Example', 'Link'"
_READ = ("job_heads", "measured", "job_findings")

WRITTEN = {
    "reports_read": Over(_READ, _results, _JOBS + ", n AS (SELECT job, measure, count(*) AS n FROM f GROUP BY job, measure) SELECT m.job AS doc_id, key, plane, status, score, num, den, coalesce(n, 0) AS n_instances FROM m LEFT JOIN n ON n.job = m.job AND n.measure = m.key"),
    "gallery_read": Over(
        _READ,
        _gallery,
        _JOBS + f""", p AS (SELECT job, {', '.join(f"round(avg(score) FILTER (WHERE status = 'done' AND plane = '{p}'), 9) AS {p}" for p in ('structure', 'argument', 'artifacts'))} FROM m GROUP BY job)
        SELECT h.key, coalesce(title, label) AS title, url, created, idx AS index, coalesce(partial, FALSE) AS partial, coalesce(given, CASE WHEN route = 'arxiv source' OR contains(url, 'arxiv') THEN 'arXiv' WHEN url = '' THEN CASE route WHEN 'upload' THEN 'Upload' ELSE 'Example' END
            ELSE [{_SOURCES}][CAST(list_position(['https://arxiv.org/abs/2401.1', 'https://www.openreview.net/forum?id=a', 'http://aclanthology.org/x', 'https://www.example.org/x', 'localhost'], url) AS INT)] END) AS source, structure, argument, artifacts
        FROM h JOIN p ON p.job = h.key WHERE gallery""",
    ),
    "findings_read": Over(
        _READ,
        _findings,
        _JOBS + """ SELECT m.job AS doc_id, m.key AS measure, plane, round(score, 4) AS measure_score, coalesce(section, '') AS section,
            CASE WHEN page IS NULL OR page > 2 THEN '' WHEN page = page2 THEN CAST(page + 1 AS VARCHAR) ELSE least(page, page2) + 1 || ' ' || greatest(page, page2) + 1 END AS pdf_pages,
            CASE WHEN nth IS NULL THEN note || '; second note' ELSE text END AS finding, coalesce(why, '') AS detail FROM m LEFT JOIN f ON f.job = m.job AND f.measure = m.key""",
    ),
    "page_marks": Over(
        _READ,
        _marks,
        _JOBS + """, p AS (SELECT *, 0 AS k FROM f WHERE page = 0 UNION ALL SELECT *, 1 FROM f WHERE page < 3 AND page2 = 0)
        SELECT job AS doc_id, measure, CAST(x AS INT) || ' ' || CAST(x AS INT) || ' ' || CAST(x + 1 AS INT) || ' ' || CAST(x + 2 AS INT) AS rect, coalesce(why, text) AS note FROM p QUALIFY row_number() OVER (PARTITION BY job ORDER BY measure, nth, k) <= 40""",
    ),
    "runs_read": Over(
        ("run_meta", "run_units"),
        _runs,
        """, c AS (SELECT item, count(*) FILTER (WHERE final = 'FAIL') AS f, count(*) FILTER (WHERE final = 'PASS') AS p, count(*) FILTER (WHERE final = 'UNRESOLVED') AS u FROM run_units GROUP BY item),
        t AS (SELECT item, coalesce(f, 0) + coalesce(pre_fail, 0) AS f, coalesce(p, 0) + coalesce(pre_pass, 0) AS p, coalesce(u, 0) + coalesce(pre_open, 0) AS u FROM run_meta LEFT JOIN c USING (item))
        SELECT *, round(f / nullif(f + p, 0), 9) AS score, round((f + p) / nullif(f + p + u, 0), 9) AS coverage FROM t""",
    ),
    "log_read": Over(
        ("log_rows", "sheet_rows"),
        _logged,
        ', b AS (SELECT kind, "at", key, name, value, 0 AS r FROM log_rows UNION ALL SELECT kind, "at", key, name, value, 1 FROM sheet_rows) SELECT kind, "at", key, name, value FROM b WHERE kind = \'click\' QUALIFY row_number() OVER (PARTITION BY key ORDER BY r, "at", name, value) = 1',
    ),
    "answers_read": Over(
        ("answer_rows",),
        _answers,
        """, j AS (SELECT event_id, CASE WHEN form < '5' THEN '{"a":{"k":' || event_id % 90 || ',"z":"x {y}"},"b":' || user_id || '}' END AS json FROM answer_rows JOIN events USING (event_id))
        SELECT event_id, CASE WHEN json IS NOT NULL THEN event_id % 90 END AS k, json, sha256(json) AS key FROM j""",
    ),
}


def archive_members(spark, sf_dir):
    return _archives(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_ARCHIVES = """WITH d AS (SELECT doc_id, doc_id % 5 AS form, coalesce(text, '') AS text FROM documents),
    f AS (SELECT *, unnest(CASE form WHEN 0 THEN ['main.tex', 'notes/copy.txt'] WHEN 1 THEN ['main.tex'] ELSE ['a' || doc_id] END) AS file FROM d)
    SELECT CASE WHEN form = 2 THEN 'a' || doc_id || '.gz' ELSE 'a' || doc_id END AS archive, CASE form WHEN 0 THEN 'zip' WHEN 1 THEN 'tar' WHEN 2 THEN 'gzip' WHEN 3 THEN CASE WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN contains(left(text, 20000), '\\documentclass') THEN 'tex' ELSE 'unknown' END ELSE 'zip' END AS kind,
    CASE WHEN form < 4 THEN file END AS file, CASE WHEN form < 4 THEN strlen(text) END AS n_bytes, CASE WHEN form < 4 THEN sha256(text) END AS sha256, form = 4 AS failed FROM f"""

QUERIES = {name: (over.query, over.oracle) for name, over in WRITTEN.items()} | {"archive_members": (archive_members, _ARCHIVES)}
