"""The six measures of a paper's quality, and the index, as relational plans over a corpus.

Inputs are the tables that the readers make: sections, sentences, objects, pointers, tables, exhibits, figures and
judgements. Every input has doc_id; no measure reads across documents, so each plan shuffles by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.scores import index_of, ratio

# Measures and their planes; published pair accuracy and AUROC of each.
MEASURES = [
    ("cross_refs", "structure", "rule", "objects", 0.905, 0.895),
    ("macro_redundancy", "structure", "rule", "sentences", 0.723, 0.727),
    ("argument_graph", "argument", "llm", "key claims", 0.586, 0.584),
    ("citation_isolation", "argument", "rule", "citing sentences", 0.793, 0.782),
    ("figure_exposition", "artifacts", "llm", "content kinds", 0.809, 0.786),
    ("evidence_gap", "artifacts", "rule", "paper", 0.764, 0.765),
]
# Claim labels, kinds of figure content, and figure patterns.
CLAIMS = ("superiority", "prior_limitation", "design_choice")
FIGURE_KINDS = 6
STAGE = r"(?i)^\s*(\(?\d+\)|[①-⑳]|(stage|step|phase|round)\s*[0-9IVX]+\b)"
KEY = r"(?i)\blegend\b|\bdenotes?\b|^\s*\S+\s*(box|arrow|line|icon|node|color|colour)\s*[=:]"
MARK = r"[✓✔✗✘❌✅👍👎]"
METHOD_GATE = r"(?i)\b(overview|pipeline|framework|architecture|workflow|schematic)\b"
METHOD_WEAK = r"(?i)\b(our (method|approach|system|model|framework)|proposed|illustration of|method|approach)\b"
# Names of works, and capitalised words that are none.
WORK_NAME = r"(?:[A-Z][A-Za-z0-9]*[A-Z0-9][A-Za-z0-9]*|[A-Z]{2,}[a-z0-9]*)(?:[-‑][A-Za-z0-9]+)*"
NO_NAMES = [
    "AI", "LLM", "LLMs", "NLP", "ML", "RL", "API", "GPU", "GPUs", "SOTA", "CNN", "RNN", "USA", "US", "UK", "EU",
    "PDF", "URL", "SQL", "HTML", "JSON", "CPU", "TPU", "IID", "OOD", "QA", "IR", "CV", "NN", "DNN", "MLP", "LM",
    "LMs", "VLM", "VLMs", "MLLM", "MLLMs", "RAG", "KV", "FPR", "TPR", "AUC", "AUROC", "F1", "IEEE", "ACM", "ICLR", "NeurIPS",
    "ICML", "ACL", "EMNLP", "CVPR", "ECCV", "ICCV", "AAAI", "IJCAI", "NAACL", "COLING", "KDD", "WWW", "SIGIR", "arXiv",
]


def _scored(df: DataFrame, num: Column, den: Column) -> DataFrame:
    return df.select("doc_id", num.cast("double").alias("num"), den.cast("long").alias("den"), ratio(num, den).alias("score"), F.when(F.coalesce(den, F.lit(0)) == 0, "na").otherwise("done").alias("status"))


def _road(sections: DataFrame, objects: DataFrame, pointers: DataFrame) -> DataFrame:
    """roadmap with the first section. Sections and objects come to the pointers as a row for each document, and what is compared stays within its rows, so that inputs dealt by document are not shuffled again."""
    first = sections.groupBy("doc_id").agg(F.min("sec").alias("first"))
    homes = objects.filter("kind = 'section'").groupBy("doc_id").agg(F.collect_list(F.struct("id", "home")).alias("homes"))
    own = pointers.join(first.join(homes, "doc_id", "left"), "doc_id").filter(F.col("src").between(F.col("first"), F.col("first")))
    order = W.partitionBy("doc_id").orderBy("pos")
    forward = F.coalesce(F.exists("homes", lambda h: (h["id"] == F.col("target")) & (h["home"] > F.col("first"))), F.lit(False))
    own = own.select("doc_id", "first", "pos", forward.alias("forward")).withColumn("n", F.row_number().over(order))
    runs = own.filter("forward").withColumn("run", F.col("n") - F.row_number().over(order))
    run = W.partitionBy("doc_id", "run")
    runs = runs.withColumn("size", F.struct(F.count("*").over(run).alias("len"), (-F.min("n").over(run)).alias("start")))
    longest = runs.withColumn("best", F.max("size").over(W.partitionBy("doc_id")))
    return longest.filter("size.len >= 2 and size = best").select("doc_id", "first", "pos")


def roadmap(sections: DataFrame, objects: DataFrame, pointers: DataFrame) -> DataFrame:
    """(doc_id, pos): pointers of the longest run of forward section pointers in the first section, the earliest on a tie, if it has two or more."""
    return _road(sections, objects, pointers).select("doc_id", "pos")


def object_references(sections: DataFrame, objects: DataFrame, pointers: DataFrame) -> DataFrame:
    """(doc_id, id, kind, home, sources, own): the other sections that point at each object, and its pointers from home; roadmap and appendix pointers don't count.

    Objects and pointers are rows of one window, which inputs dealt by document need not be shuffled for."""
    road = _road(sections, objects, pointers).groupBy("doc_id").agg(F.min("first").alias("first"), F.collect_set("pos").alias("road"))
    counted = pointers.filter(~F.col("target").startswith("appendix:") & F.col("doc_id").isNotNull()).join(road, "doc_id", "left")
    counted = counted.filter(~F.coalesce((F.col("src") == F.col("first")) & F.array_contains("road", F.col("pos")), F.lit(False)))
    things = objects.select("doc_id", "id", F.struct("kind", "home").alias("thing"), F.lit(None).cast(pointers.schema["src"].dataType).alias("src"))
    rows = things.unionByName(counted.select("doc_id", F.col("target").alias("id"), "src"), allowMissingColumns=True)
    w = W.partitionBy("doc_id", "id")
    each = rows.withColumns({"srcs": F.collect_list("src").over(w), "last": F.lag("thing").over(w.orderBy("thing"))})
    each = each.filter(F.col("thing").isNotNull() & ~F.col("thing").eqNullSafe(F.col("last"))).select("doc_id", "id", "thing.kind", "thing.home", "srcs")
    others = F.sort_array(F.array_distinct(F.filter("srcs", lambda s: s != F.col("home"))))
    return each.select("doc_id", "id", "kind", "home", others.alias("sources"), F.size(F.filter("srcs", lambda s: s == F.col("home"))).cast("long").alias("own"))


def cross_refs(docs: DataFrame, references: DataFrame) -> DataFrame:
    """Objects that no other section refers to, of all objects."""
    counts = references.groupBy("doc_id").agg(F.count_if(F.size("sources") == 0).alias("n"), F.count("*").alias("d"))
    return _scored(docs.select("doc_id").join(counts, "doc_id", "left"), F.col("n"), F.col("d"))


def vote(labels: Column, fallback: Column) -> Column:
    """The label with most votes, the first run's on a tie, the fallback without any; labels are in the order of the runs."""
    given = F.filter(labels, lambda x: x.isNotNull())
    counts = F.transform(F.array_distinct(given), lambda x: F.struct(F.size(F.filter(given, lambda y: y == x)).alias("n"), x.alias("label")))
    most = F.array_max(F.transform(counts, lambda c: c["n"]))
    top = F.filter(counts, lambda c: c["n"] == most)
    return F.when(F.size(given) == 0, fallback).when(F.size(top) == 1, F.get(top, F.lit(0))["label"]).otherwise(F.get(given, F.lit(0)))


def argument_graph(docs: DataFrame, labels: DataFrame, supports: DataFrame, least_sentences: int = 4) -> DataFrame:
    """Claims whose chosen support comes later, of the claims with a support. labels (doc_id, sent, runs array) of the introduction, sent from 1; supports (doc_id, claim, support)."""
    enough = labels.groupBy("doc_id").agg(F.count("*").alias("c")).filter(F.col("c") >= least_sentences).select("doc_id")
    claims = labels.join(enough, "doc_id").filter(vote(F.col("runs"), F.lit("other")).isin(*CLAIMS)).select("doc_id", F.col("sent").alias("claim"))
    edges = claims.join(supports.filter("support is not null"), ["doc_id", "claim"])
    counts = edges.groupBy("doc_id").agg(F.count_if(F.col("support") > F.col("claim")).alias("n"), F.count("*").alias("d"))
    return _scored(docs.select("doc_id").join(counts, "doc_id", "left"), F.col("n"), F.col("d"))


def in_sections(sents: DataFrame, roles: DataFrame) -> DataFrame:
    """sents of the sections that roles (doc_id, sec) lists; these come to them as a row for each document, so that sentences dealt by document are not shuffled again."""
    listed = roles.groupBy("doc_id").agg(F.collect_set("sec").alias("_listed"))
    return sents.join(listed, "doc_id").filter(F.array_contains("_listed", F.col("sec"))).drop("_listed")


def work_lexicon(sents: DataFrame, work_names: DataFrame) -> DataFrame:
    """(doc_id, name, keys): names of cited works, from the bibliography, from words just before a citation, and from clauses that begin with a name and hold one citation.

    Sentences are read once for both."""
    keep = lambda c: (~c.isin(*NO_NAMES)) & (c != "")
    listed = work_names.filter(keep(F.col("name")) & (F.length("name") >= 3)).select("doc_id", "name", F.array("cite_key").alias("keys"))
    text, cites = F.col("text"), F.col("cites")
    count = lambda c: F.size(F.split(c, r"\[cite\]")) - 1

    def ahead(before: Column, i: Column) -> Column:
        name = F.regexp_extract(F.right(before, F.lit(60)), r"(?:^|[\s(“\"])(" + WORK_NAME + r")(?:\s+(?:et al\.?|model|method|framework|reviewer|detector))?\s*(?:\([^)]*\))?\s*$", 1)
        return F.when(i < F.size(cites), F.struct(name.alias("name"), F.get(cites, i).alias("keys")))

    def begun(clause: Column) -> Column:
        upto = F.substring(text, F.lit(1), F.position(clause, text) + F.length(clause) - 1)
        keys = F.get(cites, count(upto) - 1)
        name = F.regexp_extract(clause, r"^\s*(?:the\s+)?(" + WORK_NAME + r")\b", 1)
        return F.when((count(clause) == 1) & keys.isNotNull(), F.struct(name.alias("name"), keys.alias("keys")))

    found = F.concat(F.transform(F.split(text, r"\[cite\]"), ahead), F.transform(F.split(text, r"[,;]|(?U)\band\b"), begun))
    said = sents.filter(F.size("cites") > 0).select("doc_id", F.explode(F.array_compact(found)).alias("f")).select("doc_id", "f.name", "f.keys").filter(keep(F.col("name")))
    return listed.unionByName(said).groupBy("doc_id", "name").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))


def citing_sentences(sents: DataFrame, roles: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, text, keys, why): citing sentences of introduction and related work; why is null for isolated ones.

    roles (doc_id, sec) lists the sections in question. The names of a document come to its sentences as one row, and are met by their first word before the exact test."""
    scope = in_sections(sents, roles).withColumn("keys", F.array_distinct(F.flatten("cites")))
    scope = scope.withColumn("prev", F.coalesce(F.lag(F.size("keys") > 0).over(W.partitionBy("doc_id", "sec").orderBy("sent")), F.lit(False)))
    word = F.regexp_extract("name", "[A-Za-z0-9]+", 0)
    names = lexicon.groupBy("doc_id").agg(F.collect_list(F.struct("name", F.col("keys").alias("nkeys"), word.alias("word"))).alias("names"))
    citing = scope.filter(F.size("keys") > 0).join(names, "doc_id", "left")
    outside = F.replace(F.col("text"), F.lit(T.CITE), F.lit(" "))
    words = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0)))
    meets = lambda s: lambda n: F.array_contains(s["words"], n["word"]) & (F.size(F.array_except(n["nkeys"], F.col("keys"))) > 0) & T.named(s["text"], n["name"])
    met = T.bound(outside, lambda t: T.bound(F.struct(t.alias("text"), words(t).alias("words")), lambda s: F.exists("names", meets(s))))
    first = F.col("text").rlike(T.FIRST_PERSON)
    why = (
        F.when(F.size("keys") >= 2, "cites two or more works together")
        .when(met, "names another work")
        .when(~first & F.col("prev") & F.trim("text").rlike(T.SENTENCE_INITIAL_CUES), "links to the previous work by a relational cue")
        .when(~first & F.col("text").rlike(T.RELATION_CUES) & F.col("text").rlike(T.DEICTIC_WORKS), "relates the work to other works by a cue")
    )
    return citing.select("doc_id", "sec", "sent", "text", F.sort_array("keys").alias("keys"), why.alias("why"))


def citation_isolation(docs: DataFrame, citing: DataFrame, least: int = 8) -> DataFrame:
    """Isolated citing sentences of all citing ones; weak below `least` of them."""
    counts = citing.groupBy("doc_id").agg(F.count_if(F.col("why").isNull()).alias("n"), F.count("*").alias("d"))
    every = docs.select("doc_id").join(counts, "doc_id", "left")
    scored = _scored(every, F.col("n"), F.col("d"))
    return scored.withColumn("weak", F.coalesce(F.col("den") < least, F.lit(False)))


def method_figure(figures: DataFrame) -> DataFrame:
    """(doc_id, index, gate): the first figure with an image that a caption pattern calls a method figure, strong patterns before weak."""
    gate = 2 * F.col("caption").rlike(METHOD_GATE).cast("int") + F.col("caption").rlike(METHOD_WEAK).cast("int")
    candidates = figures.filter("has_image").withColumn("gate", gate).filter("gate >= 1")
    tier = F.when(F.col("gate") >= 2, 0).otherwise(1)
    return candidates.groupBy("doc_id").agg(F.min_by(F.struct("index", "gate"), F.struct(tier, F.col("index"))).alias("f")).select("doc_id", "f.*")


def figure_exposition(docs: DataFrame, elements: DataFrame, kinds: list[str], runs: int = 3) -> DataFrame:
    """Kinds of content that most runs see in the figure, of six. elements (doc_id, run, text, role); patterns on the text count beside the role."""
    text = F.trim("text")
    pattern = F.when(text.rlike(STAGE), "enumerated_stage").when(text.rlike(KEY), "notation_key").when(text.rlike(MARK), "evaluative_mark")
    seen = elements.filter(text != "").select("doc_id", "run", F.explode(F.array_compact(F.array("role", pattern))).alias("kind")).filter(F.col("kind").isin(*kinds))
    present = seen.groupBy("doc_id", "kind").agg(F.countDistinct("run").alias("votes")).filter(F.col("votes") * 2 > runs)
    judged = elements.select("doc_id").distinct().join(present.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    judged = judged.select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(FIGURE_KINDS).alias("d"))
    return _scored(docs.select("doc_id").join(judged, "doc_id", "left"), F.col("n"), F.col("d"))


def evidence_gap(docs: DataFrame, tables: DataFrame, exhibits: DataFrame) -> DataFrame:
    """1 for result tables without an exhibit, 0.5 where the text acknowledges that, 0 with an exhibit; docs has doc_id and acknowledged."""
    results = tables.filter("data_rows >= 2 and numeric_cells >= 4").groupBy("doc_id").agg(F.lit(1).alias("d"))
    shown = exhibits.select("doc_id").distinct().withColumn("shown", F.lit(True))
    every = docs.join(results, "doc_id", "left").join(shown, "doc_id", "left")
    num = F.when(F.col("d").isNull(), None).when(F.col("shown"), 0.0).when(F.col("acknowledged"), 0.5).otherwise(1.0)
    return _scored(every, num, F.col("d"))


def _mean(values: Column) -> Column:
    """Mean of an array of doubles, added in its order, null for none: sums of doubles depend on the order, which shuffles do not keep."""
    return ratio(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values))


def plane_scores(results: DataFrame) -> DataFrame:
    """(doc_id, plane, score, items): mean of the plane's finished measures, added in the order of size; results (doc_id, key, plane, status, score)."""
    done = F.when(F.col("status") == "done", F.col("score"))
    return results.groupBy("doc_id", "plane").agg(_mean(F.array_sort(F.collect_list(done))).alias("score"), F.count(done).alias("items"))


def aggregate(results: DataFrame) -> DataFrame:
    """(doc_id, score, index, partial): mean of the plane means; na measures are left out, skipped and failed ones make it partial.

    Planes are added in the order of MEASURES, so that an index at a half does not change from run to run."""
    planes = list(dict.fromkeys(m[1] for m in MEASURES))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, planes)), F.col("plane")), F.lit(0)), F.lit(len(planes) + 1))
    scored = F.when(F.col("score").isNotNull(), F.struct(place.alias("place"), "plane", "score"))
    means = plane_scores(results).groupBy("doc_id").agg(_mean(F.transform(F.array_sort(F.collect_list(scored)), lambda p: p["score"])).alias("score"))
    partial = results.groupBy("doc_id").agg(F.bool_or(F.col("status").isin("skipped", "error")).alias("partial"))
    return partial.join(means, "doc_id").select("doc_id", "score", index_of(F.col("score")).alias("index"), "partial")


def rescored(results: DataFrame, changed: DataFrame) -> DataFrame:
    """results (doc_id, key, plane, status, score) with the rows of `changed`, of the same columns, in place of those of the same paper and measure."""
    return results.join(changed.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti").unionByName(changed)


def reaggregated(before: DataFrame, results: DataFrame, changed: DataFrame) -> DataFrame:
    """aggregate() of all papers, computed anew from the rescored results only for those that `changed` touches, and as `before` for the rest."""
    touched = changed.select("doc_id").distinct()
    return before.join(touched, "doc_id", "left_anti").unionByName(aggregate(results.join(touched, "doc_id", "left_semi")))


def read_scores(rows: DataFrame, raw: str) -> DataFrame:
    """rows with status and score of a measure's answer in JSON: error where it can't be read, na where it holds no score, else done; one bad row does not sink the rest."""
    value = F.get_json_object(raw, "$.score")
    score = F.expr(f"try_cast(get_json_object(`{raw}`, '$.score') AS double)")
    bad = F.col(raw).isNotNull() & (F.get_json_object(raw, "$").isNull() | (value.isNotNull() & score.isNull()))
    return rows.withColumns({"status": F.when(bad, "error").when(score.isNull(), "na").otherwise("done"), "score": score})
