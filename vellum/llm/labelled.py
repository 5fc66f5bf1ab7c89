"""Labelled rows for the classifiers: a bounded, repeatable sample that leaves out the held-out fifth, with weights that keep the classes' shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Bytes of the longest text that is learned from.
LONGEST = 1 << 17


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int = LONGEST) -> DataFrame:
    """(doc_id, text, y, weight) of at most `most` labelled rows of each class, the same ones in every run: those with the smallest hash of the id. Texts of more than `longest` bytes are not learned from.

    Ids whose labels contradict each other have none. Of rows that repeat an id, the one with the least text counts.
    weight: how many learnable labels of its class a row stands for, so that a class's weights add up to its counted labels whether or not it was cut."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    counted = known.groupBy("y").agg(F.count("*").alias("n"))  # two rows
    weight = (F.col("n") / F.least(F.col("n"), F.lit(most))).alias("weight")
    chosen = parts[0].unionByName(parts[1]).join(F.broadcast(counted), "y").select("doc_id", "y", weight)  # at most 2 x most rows of 20 bytes
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text")).select("doc_id", "text", "y", "weight")
