"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes what its predecessor kept and passes on the columns of documents; the last returns the pieces of the
packed sequences. A stage's result is written and read again before the next begins, so a lost executor never
costs more than a stage. Decisions are about rows, told apart by their place in the files that a stage reads: `docs` is
a table read from files or another source that gives the same rows in the same order each time.

Defined results: a null text is an empty one, which the classifier judges like any other; rows with a null id are
treated like others, and give way to rows with an id where only one may stay; of rows that repeat an id, each is judged by its own
text; of equal texts the row with the largest id stays, of linked ones the row with the smallest, of equal ids the last
and the first row; columns beyond doc_id and text pass through unread, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontamination, exact_dedup, minhash_dedup, packing, quality
from vellum.llm.common import kept, read, release, scratch, small_side


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and that column's name, which no other column has."""
    name = "row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _without(docs: DataFrame, row: str, rejected: DataFrame, columns: list[str]) -> DataFrame:
    """docs without the rows whose numbers are in `rejected`, its only column; these are the smaller side, broadcast when few enough."""
    ids = kept(rejected.toDF(row), "rejected")
    return docs.join(small_side(ids), row, "left_anti").select([F.col(f"`{c}`") for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of the given documents, accepts."""
    rows, row = _numbered(docs)
    scores = quality.score(rows, read(spark, sf_dir, "labels"), row_col=row)
    return _without(rows, row, scores.filter(F.col("score") < quality.ACCEPT).select("row"), docs.columns)


def one_of_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    rows, row = _numbered(docs)
    found = exact_dedup.exact_dedup(rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("id"), "text"), id_col="id")
    return _without(rows, row, found.filter("not kept").select("doc_id.row"), docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    rows, row = _numbered(docs)
    found = kept(minhash_dedup.near_dedup(rows, id_col=row).filter("not kept").select(F.col("doc_id").alias("row"), "component_id"), "linked")
    every = found.unionByName(found.select(F.col("component_id").alias("row"), "component_id").distinct())
    every = kept(every.join(rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id")), "row"), "linked")
    first = kept(every.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("component_id", F.col("first.row").alias("stays")), "first")
    return _without(rows, row, every.join(small_side(first), "component_id").filter("row <> stays").select("row"), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows, row = _numbered(docs)
    found = decontamination.decontaminate(rows, read(spark, sf_dir, "benchmark"), slop=None, id_col=row)
    return _without(rows, row, found.filter(F.size("spans") > 0).select("doc_id"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", one_of_exact_copies),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Classifier, tokenizer and near-duplicate links are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage has written is removed when the next one's result is there."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as own:
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
            own.remove(docs._kept_at)
        if before is not None:
            release(before)
        before = docs
    return docs
