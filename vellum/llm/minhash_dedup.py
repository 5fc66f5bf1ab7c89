"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Every document becomes its set of distinct word shingles, hashed to 64 bits. One hash of each shingle fills all
bins of the signature; an empty bin copies the first filled one of its own fixed random order (Shrivastava, 2017).
Bands of the signature are the buckets. Within a bucket only edges from one hub to the others are tried, so
candidates grow with the members and not with their square. Each candidate is confirmed on the full sets.

A bucket whose members are not all linked after that may hide links between two non-hubs, so its members outside its
largest component are held against the rest of it, in blocks of bounded size. A first pass over the sketches (a byte of
each bin) says which members have any partner that may be similar enough, in the first bucket that the two share; a
second one compares the full sets of those. A block returns only links that join two components, fewer than it has
members, however many pairs are alike; no pair is passed over unless its members are joined already. With 48 bands of
5 bins, a pair at similarity 0.75 shares no bucket with a probability of 2e-6; the sketches are held to five standard
deviations below the similarity asked for, which a pair at it misses with a probability of 3e-7. Equal sets are found by
their hash and are one node.

Defined results: no words, or null text: an empty set, linked with nothing. Fewer words than a shingle: the whole
sequence is one shingle. Ids are cast to long, and those that cannot be are null. Rows with a null id are returned with
a null component and are kept. Rows that repeat an id are one node whatever their texts; each is returned. Further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import kept, read, release, small_side
from vellum.llm.components import components

BANDS, BINS_PER_BAND = 48, 5
#: Rows, and shingles in all, of a bucket that are compared in one task.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Rows whose sets a task makes or compares at a time.
SLICE = 256
#: How far, in standard deviations, the share of equal bins may lie below the similarity asked for.
DEVIATIONS = 5
#: Bytes of distinct words whose hashes a task remembers at a time.
WORD_CACHE = 16 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _WordHashes(dict):
    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + 40
        if self.size > WORD_CACHE:
            self.clear()
            self.size = len(word) + 40
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(k, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = _mixed(s + h[i : len(h) - width + 1 + i] * _ODD[i % len(_ODD)])
    return np.unique(s)


def search_orders(bins: int) -> np.ndarray:
    """For each bin, the fixed random order in which it looks for a filled one."""
    rng = np.random.default_rng(bins)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(s: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The least hash of each bin; s is sorted and not empty, and bins are equal ranges of hashes."""
    bins = len(orders)
    edges = np.array([(i << 64) // bins for i in range(bins)], dtype=np.uint64)
    at = np.append(np.searchsorted(s, edges), len(s))
    full = at[:-1] < at[1:]
    values = s[np.minimum(at[:-1], len(s) - 1)]
    if not full.all():
        order = orders[~full]
        values[~full] = values[order[np.arange(len(order)), full[order].argmax(axis=1)]]
    return values


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _ODD[0]
    for i in range(rows.shape[1]):
        h = _mixed(h + rows[:, i] * _ODD[i % len(_ODD)])
    return h.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sketch) per row; the sketch is a byte of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, orders = _WordHashes(), search_orders(bands * per_band)
        for batch in batches:
            n, key, lists, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes, k)
                n.append(len(s))
                key.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig = signature(s, orders) if len(s) else None
                lists.append(band_keys(sig, bands) if len(s) else None)
                sketches.append(sig.astype(np.uint8).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"]
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents with these ids."""
    wanted = small_side(kept(ids.select(F.col("id").alias("doc_id")).distinct(), "candidates"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            sets = [shingle_set(text.as_py(), hashes, k).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "id long, shingles binary")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those edges (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return edges.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Edges from the hub of each bucket to the others, where the set sizes allow a link. The hub is the member with most company in all its buckets: the text that the others are copies of, where that is there."""
    hubs = members.groupBy("key").agg(F.max(F.struct("company", -F.col("id"), "n")).alias("hub"))
    edges = members.join(hubs.select("key", (-F.col("hub.col2")).alias("hub"), F.col("hub.n").alias("m")), "key").filter("id <> hub").filter(_sizes_allow(F.col("m"), F.col("n"), percent))
    return edges.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _sizes_allow(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _shared(keys: DataFrame) -> DataFrame:
    """Rows (id, key) of buckets with several members, and their number c."""
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = BANDS, per_band: int = BINS_PER_BAND, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; the smallest id of each component is kept. block: rows of a bucket that are compared in one task."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = kept(signatures(docs, shingle, bands, per_band), "signatures")
    live = signed.filter("doc_id is not null and n_shingles > 0")
    classes = kept(live.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1").select("set_key", "rep"), "equal-sets")
    classes = small_side(classes)
    nodes = live.join(classes, "set_key", "left").filter("rep is null or rep = doc_id").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch")
    shared = kept(_shared(nodes.select("id", F.explode("bands").alias("key"))), "buckets")
    facts = kept(shared.groupBy("id").agg(F.sum("c").alias("company")).join(nodes, "id"), "members")
    members = kept(shared.select("id", "key").join(facts.select("id", "n", "company"), "id"), "buckets")
    release(shared)
    tried = kept(_stars(members, percent), "edges")
    ids = F.explode(F.array("a", "b")).alias("id")
    sets = kept(_sets(docs, tried.select(ids), shingle), "sets")
    links = kept(_confirmed(tried, sets, percent), "links")
    release(tried, sets)
    labels = components(links)
    unsettled = kept(_screened(_blocks(members, labels, facts, block), percent), "unsettled")
    sets = kept(_sets(docs, unsettled.select("id"), shingle), "sets")
    more = kept(_joining(unsettled, sets, percent).distinct(), "links")
    release(members, facts, unsettled, sets)
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = live.select("doc_id", "set_key").join(classes, "set_key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("id"))
    named = named.join(labels, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _blocks(members: DataFrame, labels: DataFrame, facts: DataFrame, block: int) -> DataFrame:
    """The members of buckets that span components, dealt to pairs (i, j) of blocks of the bucket: all of them, and, marked `outer`, those outside the largest component."""
    placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_component = placed.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    buckets = by_component.groupBy("key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("parts"), F.max(F.struct("c", -F.col("component"), "s")).alias("main")).filter("parts > 1")
    parts = lambda c, s: F.ceil(F.greatest(c / block, s / BLOCK_SHINGLES))
    buckets = buckets.select("key", (-F.col("main.col2")).alias("main"), parts(F.col("c"), F.col("s")).alias("inner"), parts(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("outer_parts"))
    rows = placed.join(small_side(kept(buckets, "open-buckets")), "key").join(facts.select("id", "bands", "sketch"), "id")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    names = ["key", "i", "j", "id", "n", "component", "outer", "bands", "sketch"]
    inside = rows.withColumns({"outer": F.lit(False), "i": F.pmod(F.xxhash64("id"), F.col("inner"))}).withColumn("j", upto("outer_parts"))
    outside = rows.filter("component <> main").withColumns({"outer": F.lit(True), "j": F.pmod(F.xxhash64("id"), F.col("outer_parts"))}).withColumn("i", upto("inner"))
    return inside.select(names).unionByName(outside.select(names))


def _screened(blocks: DataFrame, percent: int) -> DataFrame:
    """The rows of a block that have a partner across it whose sketch agrees in about as many bins as similar sets do, and with whom no earlier band is shared."""
    names = ["key", "i", "j", "id", "n", "component", "outer"]

    def run(group: pa.Table) -> pa.Table:
        outer, n, component = (group[c].to_numpy() for c in ("outer", "n", "component"))
        wanted, rows = np.flatnonzero(outer), np.flatnonzero(~outer)
        active = np.zeros(len(outer), bool)
        if len(wanted) and len(rows):
            sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(outer), -1)
            keys = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(outer), -1)
            inside, j = sketch[rows], percent / 100
            least = inside.shape[1] * j - DEVIATIONS * (inside.shape[1] * j * (1 - j)) ** 0.5
            for w in wanted:
                good = (component[rows] != component[w]) & (100 * np.minimum(n[rows], n[w]) >= percent * np.maximum(n[rows], n[w]))
                good = np.flatnonzero(good)
                found = rows[good[(inside[good] == sketch[w]).sum(1) >= least]]
                before = int(np.argmax(keys[w] == group["key"][0].as_py()))
                found = found[~(keys[found, :before] == keys[w, :before]).any(1)]
                if len(found):
                    active[found] = active[w] = True
        return group.select(names).filter(pa.array(active))

    return blocks.groupBy("key", "i", "j").applyInArrow(run, "key long, i long, j long, id long, n long, component long, outer boolean")


def _joining(unsettled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) on full sets between the outer rows of a block and the others, as many as join components that the block's links so far have not joined."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["outer"].to_numpy(), kind="stable")  # the inside first
        group = group.take(pa.array(order))
        ids, n, label = group["id"].to_numpy(), group["n"].to_numpy(), group["component"].to_numpy().copy()
        inside = int((~group["outer"].to_numpy()).sum())
        starts = np.cumsum([0, *n])
        codes = np.unique(np.frombuffer(b"".join(group["shingles"].to_pylist()), np.uint64), return_inverse=True)[1]
        here, marked, links = codes[: starts[inside]], np.zeros(codes.max(initial=0) + 1, bool), []
        for w in range(inside, len(ids)):
            if inside and (label[:inside] != label[w]).any():
                own = codes[starts[w] : starts[w + 1]]
                marked[own] = True
                same = np.add.reduceat(marked[here], starts[:inside], dtype=np.int64)
                marked[own] = False
                for r in np.flatnonzero(100 * same >= percent * (n[:inside] + n[w] - same)):
                    if label[r] != label[w]:
                        links.append((min(ids[r], ids[w]), max(ids[r], ids[w])))
                        label[label == label[r]] = label[w]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return unsettled.drop("n").join(sets.withColumn("n", (F.length("shingles") / 8).cast("long")), "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))


SQL = None
