"""Tables that outlive executors: written to the cluster's shared folder and read again; and joins with a side of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast up to so many bytes of rows, counted beforehand; beyond them it is shuffled.
BROADCAST_BYTES = 16 << 20

#: Rows of an Arrow batch while a table is written: texts and sets of shingles may be long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a single local machine may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, for files to be written. It is removed with the scope it was made in, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    fs, target = _path(spark, path)
    fs.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    It is removed with the scope it was made in, at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    fs, target = _path(spark, path)
    fs.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def release(*tables: DataFrame) -> None:
    """Remove kept tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._kept_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables kept inside are removed at the end; the list of their paths is given, from which one that is to stay can be taken."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its source has fewer parts than that, as a small file does; a large source stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def _width(column: Column, kind: T.DataType) -> Column | None:
    """Bytes of a value beyond its eight-byte slot, None where there are none."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        parts = [w for f in kind.fields if (w := _width(column[f.name], f.dataType)) is not None]
        return F.lit(8 * len(kind.fields) + 8) + sum(parts, F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        plain = _width(F.lit(None).cast(inner), inner) is None
        each = F.size(column) * 8 if plain else F.aggregate(column, F.lit(0), lambda n, x: n + 8 + _width(x, inner).cast("int"))
        return F.coalesce(F.greatest(each, F.lit(0)), F.lit(0)) + 24
    return None


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast if its rows take at most `limit` bytes, BROADCAST_BYTES by default, and else for a join by shuffles: Spark would go by the size of its files, which packed columns make far smaller than the rows that the driver would hold.

    Pass a kept() table: counting it reads footers, and lengths are only summed where the slots alone would fit."""
    limit = BROADCAST_BYTES if limit is None else limit
    slots = 8 * (len(df.columns) + 1)
    n = df.count()
    if n * slots > limit:
        return df.hint("merge")
    more = [w for f in df.schema.fields if (w := _width(F.col(f"`{f.name}`"), f.dataType)) is not None]
    extra = df.agg(F.sum(sum(more, F.lit(0)).cast("long"))).first()[0] or 0 if more else 0
    return F.broadcast(df) if n * slots + extra <= limit else df.hint("merge")
