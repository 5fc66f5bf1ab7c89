import random
from collections import defaultdict

from vellum.streaming import jobs


def _expected(rows, window, limit):
    taken, out = defaultdict(list), {}
    for key, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in taken[key] if ts - t <= window]
        out[event] = len(recent) < limit
        taken[key] = recent + [ts] * out[event]
    return out


def _rows():
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(3)}", i, float(rng.randrange(20_000))) for i in range(600)]
    return rows + [("edge", 1000 + i, 3600.0 * i) for i in range(3)]


def test_exact_limiter_in_batch(spark):
    rows = _rows()
    got = jobs.rate_limited(spark.createDataFrame(rows, "k string, e long, t double"), "k", "t", "e", 3600, 4)
    assert {r.event_id: r.accepted for r in got.collect()} == _expected(rows, 3600, 4)


def test_exact_limiter_on_a_stream(spark, tmp_path):
    rows = sorted(_rows(), key=lambda r: r[2])
    for n, at in enumerate(range(0, len(rows), 300)):
        spark.createDataFrame(rows[at : at + 300], "key string, event_id long, ts double").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else batches for timeouts never end
    source = spark.readStream.schema("key string, event_id long, ts double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = jobs.rate_limited_stream(source, 3600, 4).writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.event_id: r.accepted for r in spark.table("limited").collect()} == _expected(rows, 3600, 4)


def test_daily_counts(spark, tmp_path):
    rows = [("a", "2025-01-01 10:00:00"), ("a", "2025-01-01 11:00:00"), ("b", "2025-01-02 00:00:00"), ("a", "bad")]
    spark.createDataFrame(rows, ["kind", "at"]).write.json(f"{tmp_path}/log")
    query = jobs.daily_stream(spark, f"{tmp_path}/log").writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(str(r.day), r.kind, r.n) for r in spark.table("daily").collect()} >= {("2025-01-01", "a", 2), ("2025-01-02", "b", 1)}


def _files(path):
    return {str(f.relative_to(path)): f.stat().st_size for f in path.rglob("*.parquet")}


def test_votes(spark, tmp_path):
    schema = "token string, item string, v int, ts long"
    many = [(f"t{i}", f"i{i % 7}", 1, 1) for i in range(3000)]
    batches = [many + [("t", "1-1", 1, 1), ("u", "1-1", 1, 2)], [("t", "1-1", 0, 3), ("u", "1-1", -1, 1), ("w", "1-2", -1, 5), ("w", "1-2", 1, 5)], [("t", "1-1", 1, 2), ("u", "1-1", -1, 9)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = tmp_path / "out"
    jobs.vote_stream(source, str(out), f"{tmp_path}/cp", buckets=64).awaitTermination(120)
    expected = {}
    for rows in batches:
        for token, item, v, ts in rows:
            if (ts, v) > expected.get((token, item), (-1, 0))[:2]:
                expected[token, item] = (ts, v)
    got = {(r.token, r.item): (r.ts, r.v) for r in jobs.stored_votes(spark, str(out), 2).collect()}
    assert got == {k: x for k, x in expected.items() if x[1] != 0}
    # Each batch wrote the buckets that it touched, at most one for each of its votes, and not the store.
    written = {n: sum(size for f, size in _files(out).items() if f.startswith(f"data/{n}/")) for n in range(3)}
    assert 0 < written[2] < written[0] / 10
    assert len({f.split("/")[2] for f in _files(out) if f.startswith("data/2/")}) <= 2
    assert sorted(p.name for p in (out / "manifest").iterdir()) == ["1", "2"]
    # What version 1 replaced went with version 2; a batch that is run again writes the same.
    before = jobs.stored_votes(spark, str(out), 2).collect()
    jobs.upsert_votes(spark.createDataFrame(batches[2], schema), 2, str(out), 64)
    assert sorted(before) == sorted(jobs.stored_votes(spark, str(out), 2).collect())
    jobs.upsert_votes(spark.createDataFrame([], schema), 3, str(out), 64)
    assert sorted(before) == sorted(jobs.stored_votes(spark, str(out), 3).collect())
