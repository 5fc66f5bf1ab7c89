"""Finished reports, registry runs, logs, and the writers of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEASURE = "struct<key:string,name:string,plane:string,status:string,score:double,num:double,den:bigint,weak:boolean,notes:array<string>,instances:array<struct<text:string,why:string,caption:string,section_title:string,coverage:double,source_title:string,pdf:array<struct<p:int,r:array<array<double>>>>>>>"
REPORT = f"id string, key string, status string, label string, created double, gallery boolean, source_label string, ai_generated boolean, result struct<index:struct<score:double,index:int,partial:boolean>,document:struct<title:string,url:string,route:string,source:string>,measures:array<{MEASURE}>>"
UNIT = "struct<id:string,sec:string,kind:string,text:string,runs:array<string>,final:string,final_reason:string>"
RUN = f"meta struct<item:string,paper:string,side:string,title:string,n_runs:int,F:int,P:int,U:int,NA:int,pre:struct<FAIL:int,PASS:int,UNRESOLVED:int,NOT_APPLICABLE:int>>, units array<{UNIT}>"


def read_reports(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Finished reports of a folder tree, each a file job.json, or with `lines` each a line of any file, which large files can be split by; what can't be parsed is passed over."""
    read = spark.read.schema(REPORT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true")
    read = read if lines else read.option("multiLine", "true").option("pathGlobFilter", "job.json")
    return read.json(path).filter("status = 'done' and result is not null")


def first_of(*tables: DataFrame) -> DataFrame:
    """Rows by key from several tables, an earlier table winning; of equal keys in one table, the least row written as JSON."""
    every = None
    for rank, df in enumerate(tables):
        ranked = df.withColumn("_rank", F.lit(rank))
        every = ranked if every is None else every.unionByName(ranked, allowMissingColumns=True)
    order = W.partitionBy("key").orderBy("_rank", F.to_json(F.struct("*")))
    return every.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_rank", "_nth")


def measure_results(reports: DataFrame) -> DataFrame:
    """(doc_id, key, plane, status, score, num, den, notes, instances), doc_id being the report's key."""
    return reports.select(F.col("key").alias("doc_id"), F.explode("result.measures").alias("m")).select("doc_id", "m.key", "m.plane", "m.status", "m.score", "m.num", "m.den", "m.notes", "m.instances")


def source_label(url: Column, route: Column) -> Column:
    """Where a paper came from, in a word."""
    url, route = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(route, F.lit("")))
    host = F.split(F.get(F.split(F.regexp_replace(url, r"^https?://(www\.)?", ""), "/"), F.lit(0)), r"\.")
    return (
        F.when(url.contains("arxiv") | route.contains("arxiv"), "arXiv").when(url.contains("openreview"), "OpenReview").when(url.contains("aclanthology"), "ACL")
        .when(url != "", F.when(F.size(host) >= 2, F.initcap(F.get(host, F.size(host) - 2))).otherwise("Link"))
        .when(route.contains("upload"), "Upload").otherwise("Example")
    )


def gallery(reports: DataFrame) -> DataFrame:
    """(key, title, url, created, index, partial, source, planes) of the reports shown; planes maps a plane to its score."""
    from vellum.operators.measures import plane_scores

    planes = plane_scores(measure_results(reports)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("plane", "score"))).alias("planes"))
    shown = reports.filter("gallery").select("key", F.coalesce("result.document.title", "label").alias("title"), "result.document.url", "created", "result.index.index", F.coalesce("result.index.partial", F.lit(False)).alias("partial"), F.coalesce("source_label", source_label(F.col("result.document.url"), F.col("result.document.route"))).alias("source"))
    return shown.join(planes, shown["key"] == planes["doc_id"], "left").drop("doc_id")


def findings(results: DataFrame) -> DataFrame:
    """The seven export columns, one row per finding; a measure without any keeps a row with its notes."""
    rows = results.select("doc_id", F.col("key").alias("measure"), "plane", F.round("score", 4).alias("measure_score"), "notes", F.explode_outer("instances").alias("i"))
    pages = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("i.pdf", lambda p: p["p"] + 1))), lambda p: p.cast("string")), " ")
    text = F.coalesce("i.text", "i.caption", F.when(F.col("i").isNull(), F.array_join("notes", "; ")))
    return rows.select("doc_id", "measure", "plane", "measure_score", F.coalesce("i.section_title", F.lit("")).alias("section"), F.coalesce(pages, F.lit("")).alias("pdf_pages"), F.coalesce(text, F.lit("")).alias("finding"), F.coalesce("i.why", F.lit("")).alias("detail"))


def first_page_marks(results: DataFrame, most: int = 40) -> DataFrame:
    """(doc_id, measure, rect, note): the first marks on the first page of each report, in order."""
    from pyspark.sql import Window as W

    rows = results.select("doc_id", F.col("key").alias("measure"), F.posexplode("instances").alias("n", "i"))
    copied = F.concat(F.floor(F.col("i.coverage") * 100 + 0.5).cast("string"), F.lit("% copied from "), F.coalesce("i.source_title", F.lit("an earlier section")))
    note = F.coalesce("i.why", copied, "i.text", "i.caption", F.lit(""))
    rows = rows.select("doc_id", "measure", "n", note.alias("note"), F.posexplode("i.pdf").alias("k", "loc")).filter("loc.p = 0").select("doc_id", "measure", "n", "k", "note", F.posexplode("loc.r").alias("j", "rect"))
    order = W.partitionBy("doc_id").orderBy("measure", "n", "k", "j")
    short = F.when(F.length("note") > 180, F.concat(F.substring("note", 1, 180), F.lit("…"))).otherwise(F.col("note"))
    return rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("doc_id", "measure", "rect", short.alias("note"))


def read_runs(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Registry runs, a file each or with `lines` a line each: (item, meta columns) and (item, id, sec, kind, text, runs, final)."""
    runs = spark.read.schema(RUN).option("multiLine", str(not lines).lower()).json(path)
    return runs.select("meta.*"), runs.select("meta.item", F.explode("units").alias("u")).select("item", "u.*")


def run_scores(meta: DataFrame, units: DataFrame) -> DataFrame:
    """(item, f, p, u, score, coverage): final verdicts and those decided before, not-applicable ones left out."""
    from vellum.functions.scores import ratio

    counts = units.groupBy("item").agg(*(F.count_if(F.col("final") == v).alias(n) for n, v in (("f", "FAIL"), ("p", "PASS"), ("u", "UNRESOLVED"))))
    both = meta.select("item", "pre").join(counts, "item", "left")
    total = lambda n, v: F.coalesce(n, F.lit(0)) + F.coalesce(F.col(f"pre.{v}"), F.lit(0))
    out = both.select("item", total("f", "FAIL").alias("f"), total("p", "PASS").alias("p"), total("u", "UNRESOLVED").alias("u"))
    decided = F.col("f") + F.col("p")
    return out.withColumns({"score": ratio(F.col("f"), decided), "coverage": ratio(decided, decided + F.col("u"))})


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind from an append-only log of JSON lines."""
    return spark.read.schema("kind string, at string, key string, name string, value string").json(path).filter(F.col("kind") == kind)


def read_sheet(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of one kind from a table with a head line, its quotes doubled."""
    return spark.read.option("header", "true").option("escape", '"').schema("kind string, at string, key string, name string, value string").csv(path).filter(F.col("kind") == kind)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log as JSON lines, without helper columns, whose names begin with an underscore."""
    rows.select([c for c in rows.columns if not c.startswith("_")]).write.mode("append").json(path)


def write_views(views: dict[str, DataFrame], path: str) -> None:
    """Every view as JSON in a folder of its own, without helper columns, replaced as a whole when the write commits."""
    for name, df in views.items():
        df.select([c for c in df.columns if not c.startswith("_")]).write.mode("overwrite").json(f"{path}/{name}")


def write_mirror(reports: DataFrame, log: DataFrame, path: str) -> None:
    """A static copy of the views under `path`: gallery, findings and totals of a log (at, ...), of the reports shown, each of which has a folder jobs/of=<key> of its own; one without a key is left out.

    Rows go to the task of their key before they are written, so that a key's folder holds one file; keys are short and safe as folder names (listings.report_key)."""
    from vellum.operators.listings import totals

    shown = reports.filter("gallery and key is not null")
    write_views({"gallery": gallery(shown), "findings": findings(measure_results(shown)), "stats": totals(log, "at")}, path)
    shown.withColumn("of", F.col("key")).repartition("of").write.mode("overwrite").partitionBy("of").json(f"{path}/jobs")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows with a head line, quotes doubled, blanks at the ends of values kept."""
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of write_csv; empty strings, which are quoted, and nulls, which are not, stay apart. Values must not hold line ends, so that files can be split."""
    return spark.read.schema(schema).option("header", "true").option("escape", '"').option("nullValue", "\0").csv(path)
