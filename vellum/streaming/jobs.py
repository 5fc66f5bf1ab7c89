"""Streams over the logs, and the batch form of the exact rate limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vellum.storage import exists, kept, remove, small_side

WINDOW, LIMIT = 3600, 20
VOTE = "token string, item string, v int, ts long"
#: Parts of the store of votes, each rewritten as a whole; its manifest has a row for each.
BUCKETS = 256


def accept(stamps: deque, now: float, window: int, limit: int) -> bool:
    """Takes a hit unless `limit` accepted ones lie within the window; only accepted hits are remembered."""
    while stamps and now - stamps[0] > window:
        stamps.popleft()
    if len(stamps) >= limit:
        return False
    stamps.append(now)
    return True


def rate_limited(events: DataFrame, key: str, ts: str, event_id: str, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """(key, event_id, ts, accepted) in batch: keys are dealt out and sorted, and a task reads on with the last key's at most `limit` stamps. All hits of keys with no more than `limit` are accepted without that."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.col(ts).cast("double").alias("ts"))
    many = small_side(kept(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key"), "keys"))
    few = rows.join(many, "key", "left_anti").withColumn("accepted", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, stamps = None, deque()
        for pdf in batches:
            taken = []
            for k, t in zip(pdf["key"], pdf["ts"], strict=True):
                if k != last:
                    last, stamps = k, deque()
                taken.append(accept(stamps, t, window, limit))
            yield pdf.assign(accepted=taken)

    judged = rows.join(many, "key", "left_semi").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return few.unionByName(judged.mapInPandas(run, "key string, event_id long, ts double, accepted boolean"))


def rate_limited_stream(events: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """The same on a stream (key string, event_id long, ts double): each key's state is its accepted stamps, at most `limit`; it goes after a quiet window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stamps = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        taken = [accept(stamps, t, window, limit) for t in pdf["ts"]]
        state.update((list(stamps),))
        state.setTimeoutDuration(2 * window * 1000)
        yield pdf.assign(accepted=taken)[["key", "event_id", "ts", "accepted"]]

    return events.groupBy("key").applyInPandasWithState(run, "key string, event_id long, ts double, accepted boolean", "stamps array<double>", "append", "ProcessingTimeTimeout")


def daily_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """(day, kind, n) of a growing log of JSON lines (kind, at); days close once they are late enough."""
    log = spark.readStream.schema("kind string, at string").json(path)
    timed = log.withColumn("ts", F.try_to_timestamp("at", F.lit("yyyy-MM-dd HH:mm:ss"))).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "kind", "n")


def merge_votes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Last vote (token, item, v, ts) of each token and item, of equally late ones the larger; taken back votes stay as 0 so that older ones can't return."""
    every = new if old is None else old.unionByName(new)
    return every.groupBy("token", "item").agg(F.max_by(F.struct("v", "ts"), F.struct("ts", "v")).alias("last")).select("token", "item", "last.v", "last.ts")


def _versions(spark: SparkSession, path: str, epoch: int) -> dict[int, int]:
    """Bucket and version of a manifest; none before the first."""
    if epoch < 0:
        return {}
    return dict(map(tuple, spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/{epoch}").collect()))  # a row for each bucket


def upsert_votes(batch: DataFrame, epoch: int, path: str, buckets: int = BUCKETS) -> None:
    """Merge a batch of votes (token, item, v, ts) into the store below path, as version `epoch`.

    Votes are dealt to `buckets` buckets by token and item. Only buckets that the batch touches are read and written, to a folder of the version; a manifest that is written last says which version
    of each bucket holds. A batch that is run again writes the same version. What the manifest before the last one alone had is removed."""
    spark = batch.sparkSession
    rows = batch.select("token", "item", "v", "ts").withColumn("bucket", F.pmod(F.xxhash64("token", "item"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most as many as buckets
        held = _versions(spark, path, epoch - 1)
        known = [f"{path}/data/{held[b]}/bucket={b}" for b in touched if b in held]
        old = spark.read.schema(VOTE).parquet(*known) if known else None
        merged = merge_votes(old, rows.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64("token", "item"), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{epoch}")
        now = held | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{epoch}")
    finally:
        rows.unpersist()
    if epoch >= 2:
        before = _versions(spark, path, epoch - 2) if exists(spark, f"{path}/manifest/{epoch - 2}/_SUCCESS") else {}
        for bucket, version in before.items():
            if held.get(bucket) != version:
                remove(spark, f"{path}/data/{version}/bucket={bucket}")
        remove(spark, f"{path}/manifest/{epoch - 2}")


def stored_votes(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """(token, item, v, ts): the votes that hold after a version, taken back ones left out."""
    held = _versions(spark, path, epoch)
    paths = [f"{path}/data/{version}/bucket={bucket}" for bucket, version in held.items()]
    rows = spark.read.schema(VOTE).parquet(*paths) if paths else spark.createDataFrame([], VOTE)
    return rows.filter("v <> 0")


def vote_stream(votes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the merged votes of a stream below path, a version for each batch; see upsert_votes()."""
    return votes.writeStream.foreachBatch(lambda batch, epoch: upsert_votes(batch, epoch, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
