"""Repeated passages by the phrases of a prefix-free parsing, grouped by hashes instead of sorted.

A window of 200 bytes chooses its trigger, the gram in it with the least rolling hash, so the choice follows from the
window's bytes alone. Consecutive windows with the same trigger form a phrase. Equal windows lie in phrases with the same trigger,
so the dictionary of phrases, with counts, decides most of the text: a phrase whose trigger occurs once holds nothing
that repeats, and a phrase that itself occurs twice repeats throughout. Phrases that share a trigger without being
equal, as at the ends of a repeat, are cut into parts that are compared in the same way, and only parts that share
their core without being equal are resolved window by window. What is asked of the suffix order is which suffixes
agree in their first 200 bytes; those are neighbours in it, and here they are grouped by a hash of that prefix within their
trigger: suffix arrays of dictionary and parse are not built, and no order of the whole corpus is sorted. Texts are parsed
in segments; what is still asked of a text after that, its open parts and windows, is gathered by text, some 50 bytes for each open window.

Defined results: a null or empty text has no bytes; texts shorter than the width lose nothing; rows that repeat an id
are documents of their own, and equal ones remove each other; a null id stays null; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import kept, read, release, small_side

WIDTH, GRAM, SEGMENT = 200, 40, 1 << 18
#: Windows of a part of a phrase.
PART = 16
#: Bytes up to which the shared triggers are broadcast; beyond them the phrases are shuffled.
BROADCAST = 48 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Roller:
    """Hashes of all substrings of a segment, from running sums modulo 2^64."""

    def __init__(self, width: int, longest: int = SEGMENT) -> None:
        self.values = np.array(_BYTE_VALUES, dtype=np.uint64)
        self.up, self.down = (np.full(longest + width + 2, b, np.uint64) for b in (_BASE, _INVERSE))
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, out=powers)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        h = (sums[stop] - sums[start]) * self.down[: len(sums)][start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


_BYTE_VALUES = [int.from_bytes(sha256(bytes([i])).digest()[:8], "little") for i in range(256)]


def phrases(raw: bytes, roller: Roller, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(trigger, content, start, windows, left) arrays of the phrases of each segment; the trigger begins `left` bytes after the start."""
    every = np.frombuffer(raw, np.uint8)
    for at in range(0, max(0, len(raw) - width + 1), SEGMENT):
        part = every[at : at + SEGMENT + width - 1]
        sums = roller.sums(part)
        n = len(part) - gram + 1
        grams = roller.hashes(sums, slice(0, n), slice(gram, gram + n))
        # The place in the low bits makes the leftmost of equal grams the least.
        least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        size, span = 1, width - gram + 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = span - size
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        windows = np.diff(np.append(start, len(place)))
        place = place[start]
        content = roller.hashes(sums, start, start + windows + width - 1) + (place - start).astype(np.uint64) * np.uint64(_BASE) + windows.astype(np.uint64)
        yield grams[place].view(np.int64), content.view(np.int64), start + at, windows, place - start


def _keyed(docs: DataFrame) -> DataFrame:
    """Equal rows have the same key, and the same passages to remove."""
    return docs.withColumns({"key": F.xxhash64("doc_id", "text"), "size": F.coalesce(F.octet_length("text"), F.lit(0))})


def dictionary_records(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, size, trigger, content, start, windows, left) per phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(width)
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                for trigger, content, start, windows, left in phrases((text or "").encode(), roller, width, gram):
                    n = len(start)
                    same = [pa.array(np.full(n, batch.column(c)[i].as_py())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [same[0].cast(pa.int64()), same[1].cast(pa.int32()), pa.array(trigger), pa.array(content), pa.array(start).cast(pa.int32()), pa.array(windows).cast(pa.int16()), pa.array(left).cast(pa.int16())],
                        names=["key", "size", "trigger", "content", "start", "windows", "left"],
                    )

    return docs.select("key", "size", "text").mapInArrow(run, "key long, size int, trigger long, content long, start int, windows smallint, left smallint")


def _located(docs: DataFrame, asked: DataFrame, run, schema: str) -> DataFrame:
    """Runs over (key, size, text, asked) rows, asked being the list of all rows of `asked` for that text, no more than it has phrases or parts.

    Only texts that are asked for at all are shuffled, where their keys are few enough to be broadcast."""
    names = [c for c in asked.columns if c not in ("key", "size")]
    asked = kept(asked.groupBy("key", "size").agg(F.collect_list(F.struct(*names)).alias("asked")), "asked")
    return docs.join(small_side(kept(asked.select("key", "size"), "asked-keys")), ["key", "size"], "left_semi").join(asked, ["key", "size"]).select("key", "size", "text", "asked").mapInArrow(run, schema)


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for at in range(0, len(whole), 64):
            yield from zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True)


def _parts(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(core, full, key, size, start, windows, count) of the asked phrases cut into parts of up to PART windows.

    Parts are aligned to the trigger. The core is what all windows of a part have in common, so windows of two phrases
    can only be equal where the cores of their parts are; where the full parts are equal, all their windows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(width, 4 * width)
        for key, size, text, asked_ in _each_text(batches):
            raw, out = np.frombuffer(text.encode(), np.uint8), []
            for p in asked_:
                sums = roller.sums(raw[p["start"] : p["start"] + p["windows"] + width - 1])
                # Windows are numbered by the bytes they reach to the left of the trigger: most in the first.
                most, least = p["left"], p["left"] - p["windows"] + 1
                part = np.arange(least // PART, most // PART + 1)
                high, low = np.minimum(most, part * PART + PART - 1), np.maximum(least, part * PART)
                core = roller.hashes(sums, p["left"] - part * PART, p["left"] - part * PART - PART + width + 1)
                full = roller.hashes(sums, p["left"] - high, p["left"] - low + width)
                salt = np.uint64(p["trigger"] & (2**64 - 1)) + part.astype(np.uint64) * np.uint64(_BASE)
                out.append((core ^ salt * np.uint64(_INVERSE), full + (high * 512 + low + 256).astype(np.uint64) * np.uint64(_BASE), p["start"] + p["left"] - high, high - low + 1, np.full(len(part), p["count"])))
            core, full, start, windows, count = (np.concatenate(x) for x in zip(*out, strict=True))
            n = len(core)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(np.full(n, key)), pa.array(np.full(n, size)).cast(pa.int32()), pa.array(start).cast(pa.int32()), pa.array(windows).cast(pa.int16()), pa.array(count)],
                names=["core", "full", "key", "size", "start", "windows", "count"],
            )

    return _located(docs, asked, run, "core long, full long, key long, size int, start int, windows smallint, count long")


def _windows(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(core, prefix, key, size, start, count) of every window of the asked parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(width, 4 * width)
        for key, size, text, asked_ in _each_text(batches):
            raw, out = np.frombuffer(text.encode(), np.uint8), []
            for p in asked_:
                n = p["windows"]
                sums = roller.sums(raw[p["start"] : p["start"] + n + width - 1])
                prefix = roller.hashes(sums, slice(0, n), slice(width, width + n)).view(np.int64)
                out.append((np.full(n, p["core"]), prefix, np.arange(p["start"], p["start"] + n), np.full(n, p["count"])))
            core, prefix, start, count = (np.concatenate(x) for x in zip(*out, strict=True))
            n = len(start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(core), pa.array(prefix), pa.array(np.full(n, key)), pa.array(np.full(n, size)).cast(pa.int32()), pa.array(start).cast(pa.int32()), pa.array(count)], names=["core", "prefix", "key", "size", "start", "count"]
            )

    return _located(docs, asked, run, "core long, prefix long, key long, size int, start int, count long")


def _several(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).filter("n > 1").select(by)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, size, first, last) maximal byte ranges, last exclusive, that windows cover which start anywhere else too; docs has key, size and text."""
    span = lambda df: df.select("key", "size", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (width - 1)).alias("last"))
    records = kept(dictionary_records(docs, width, gram), "phrases")
    triggers = small_side(kept(_several(records, "trigger"), "triggers"), BROADCAST)
    shared = kept(records.join(triggers, "trigger", "left_semi"), "shared")
    release(records)
    # Phrases that are equal throughout.
    classes = kept(shared.groupBy("trigger", "content").agg(F.count("*").alias("count"), F.min(F.struct("key", "size", "start", "windows", "left")).alias("one")), "classes")
    whole = span(shared.join(classes.filter("count > 1").select("trigger", "content"), ["trigger", "content"], "left_semi"))
    # Parts that are equal throughout, of phrases that share a trigger.
    parts = kept(_parts(docs, classes.join(_several(classes, "trigger"), "trigger", "left_semi").select("trigger", "count", "one.*"), width), "parts")
    variants = parts.groupBy("core", "full").agg(F.sum("count").alias("count"), F.min(F.struct("key", "size", "start", "windows")).alias("one"))
    variants = kept(variants, "variants")
    equal = span(parts.filter("count = 1").join(variants.filter("count > 1").select("core", "full"), ["core", "full"], "left_semi"))
    # Single windows, of parts that share a core.
    windows = kept(_windows(docs, variants.join(_several(variants, "core"), "core", "left_semi").select("core", "count", "one.*"), width), "windows")
    repeats = windows.groupBy("core", "prefix").agg(F.sum("count").alias("n")).filter("n > 1").select("core", "prefix")
    single = windows.filter("count = 1").join(repeats, ["core", "prefix"], "left_semi").withColumn("windows", F.lit(1))
    return merged(merged(whole).unionByName(merged(span(single))).unionByName(equal))


def merged(spans: DataFrame) -> DataFrame:
    """The maximal ranges that the spans (key, size, first, last) of each text cover together."""
    order = W.partitionBy("key", "size").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("key", "size", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept holds the bytes that stay, which need not be valid UTF-8."""
    docs = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    spans = repeated_spans(docs, width, gram).groupBy("key", "size").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = kept(spans, "spans")
    # Texts that lose nothing need not be shuffled, where the keys of the others are few enough to be broadcast.
    keys = small_side(kept(spans.select("key", "size"), "span-keys"))
    whole = docs.join(keys, ["key", "size"], "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    joined = docs.join(keys, ["key", "size"], "left_semi").join(spans, ["key", "size"]).select("doc_id", "text", "spans").unionByName(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                rows = [cut_out((t or "").encode(), s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                n, removed, runs, left = zip(*rows, strict=True)
                digests = [sha256(x).hexdigest() for x in left]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(digests), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_out(raw: bytes, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """Length, bytes removed, maximal runs removed, and what stays."""
    left, at, runs = [], 0, 0
    for s in sorted(spans or [], key=lambda s: s["first"]):
        if s["first"] > at or not runs:
            runs += 1
            left.append(raw[at : s["first"]])
        at = max(at, s["last"])
    left.append(raw[at:])
    rest = b"".join(left)
    return len(raw), len(raw) - len(rest), runs, rest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


SQL = None
