"""What the corpus operators share: reading tables, folding case, and the stored tables of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.storage import BROADCAST_BYTES, kept, release, remove, scratch, shared_dir, small_side

__all__ = ["BROADCAST_BYTES", "LOWER", "UPPER", "ascii_lower", "kept", "read", "release", "remove", "scratch", "shared_dir", "small_side"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
