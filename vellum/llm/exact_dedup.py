"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are grouped by text length, then by a hash of the first characters, and only rows whose
(length, prefix) group holds another row are hashed whole. Rows move between machines as
(id, length, hashes), never with their text, unless there are so many surviving groups that they can't be broadcast.

Defined results: a null text counts as empty; empty texts equal one another; of equal texts the
largest id stays; rows that repeat an id and its text all carry that id, count in group_size and are
all kept; a null id loses against any other, and a group of null ids only has a null keep_id and is kept.
Further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import LOWER, UPPER, ascii_lower, kept, read, small_side


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, digest: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; texts are compared with A-Z lower-cased.

    The digest is null for rows that no other row can equal, unless `digest` asks for all of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("n", F.octet_length(text))
    # Lengths that several rows have; of these rows, the prefixes that several have; only the rest is read whole.
    lengths = rows.groupBy("n").agg(F.count("*").alias("c")).filter("c > 1").select("n", F.lit(True).alias("same_length"))
    rows = rows.join(small_side(kept(lengths, "lengths")), "n", "left")
    rows = rows.withColumn("p", F.when(F.col("same_length"), F.xxhash64(ascii_lower(F.substring(text, 1, prefix)))))
    groups = rows.filter("same_length").groupBy("n", "p").agg(F.count("*").alias("c")).filter("c > 1").select("n", "p", F.lit(True).alias("shared"))
    groups = small_side(kept(groups, "prefix-groups"))
    hashed = F.sha2(ascii_lower(text), 256)
    slim = rows.join(groups, ["n", "p"], "left").select(
        "doc_id", "n", F.coalesce("shared", F.lit(False)).alias("shared"), (hashed if digest else F.when(F.col("shared"), hashed)).alias("text_sha256")
    )
    slim = kept(slim, "full-hashes")
    # Groups are summed before they meet their rows again, few enough to be broadcast or else joined where a large group can be split.
    groups = slim.filter("shared").groupBy("n", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = small_side(kept(groups, "groups"))
    found = slim.join(groups, ["n", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    kept_ = F.coalesce(alone | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept_.alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), digest=True)


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
