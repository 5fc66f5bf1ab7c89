"""Harmonic packing of token sequences.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths of at most capacity/k, and each of its
sequences takes exactly k pieces, whatever they are. So a piece's sequence follows from its number within its class,
and numbers are dealt by all workers at once: each block of rows counts its pieces by class, running sums of these
small counts give each block its first number, and the rest is arithmetic. Documents are cut where a class would
waste more than `waste` of the piece: into a piece that fills the next smaller class and a remainder. Only the last,
unfilled sequence of each class is left over; these pieces, whose number is bounded by the capacity alone, are packed
together first-fit by falling length.

Defined results: a null text is an empty one, and a document has its end token at least; rows that repeat an id are
packed one by one; a null id stays null; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import kept, read

#: Bytes of white-space-free chunks and their ids that a task remembers at a time, and bytes of text that it encodes at a time.
CHUNK_CACHE, ENCODE_BYTES = 48 << 20, 1 << 20
#: Rows whose texts a task holds as Python strings at a time.
SLICE = 256
#: Bytes that a remembered chunk takes besides its own.
CHUNK_BYTES = 120


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of whole texts from the ids of their chunks, for byte-level tokenizers that drop case and white space.

    Chunks lie between ASCII white space, and commas and stops between letters, digits and blanks are chunks too: no
    token reaches across these. A chunk of lower-case letters is one pre-token, so the model alone encodes it."""

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.size = Tokenizer.from_file(path), {}, 0
        self.model, self.end = self.tokenizer.model, np.uint32(end_id).tobytes()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.symbols = [chr(i) if i in plain else chr(next(others)) for i in range(256)]  # what byte-level models read for each byte
        self.joins = np.array([i < 128 and not (chr(i).isalnum() or chr(i) in " \t\n\r\v\f") for i in range(256)])

    def chunks(self, text: str) -> list[bytes]:
        raw = text.encode()
        if b"<|" in raw:  # special tokens have their case
            return raw.split()
        raw = raw.lower()
        codes = np.frombuffer(b" " + raw + b" ", np.uint8)
        at = np.flatnonzero((codes == 44) | (codes == 46))
        beside = np.concatenate([codes[at - 1], codes[at + 1]])
        if not self.joins[beside].any() and (not (beside > 127).any() or all(c.isalpha() for c in set(text.lower()) if c > "\x7f")):
            raw = raw.replace(b",", b" , ").replace(b".", b" . ")
        return raw.split()

    def learn(self, new: list[bytes]) -> None:
        general = []
        for c in new:
            if c.isalpha() and c.islower():
                self.known[c] = np.array([t.id for t in self.model.tokenize(c.decode())], "<u4").tobytes()
            elif (w := c.decode()).isalpha() and w.lower() == w and is_normalized("NFC", w):
                self.known[c] = np.array([t.id for t in self.model.tokenize("".join([self.symbols[b] for b in c]))], "<u4").tobytes()
            else:
                general.append(c)
        for at in range(0, len(general), 10_000):
            part = general[at : at + 10_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False), strict=True):
                self.known[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """One array of ids for each text, the end token last."""
        chunks = [self.chunks(t) for t in texts]
        distinct = set().union(*chunks)
        new = list(distinct - self.known.keys())
        more = sum(map(len, new)) * 3 + CHUNK_BYTES * len(new)
        if self.size + more > CHUNK_CACHE and self.known:
            self.known.clear()
            new, self.size = list(distinct), 0
            more = sum(map(len, new)) * 3 + CHUNK_BYTES * len(new)
        self.size += more
        self.learn(new)
        for own in chunks:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, own)) + self.end, "<u4")


def cut(n: int, capacity: int, waste: float = 1 / 32) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of n tokens."""
    out, at, exact = [], 0, int(capacity**0.5)
    while at < n:
        left = min(n - at, capacity)
        k = capacity // left
        if left >= exact and capacity // k - left > waste * left:
            k += 1
            left = capacity // k
        out.append((at, left, k))
        at += left
    return out


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, waste: float, with_ids: bool) -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, doc_tokens, class[, ids]) for docs (row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, end_id)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            texts = ["" if t is None else t for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= ENCODE_BYTES):
                    size += len(texts[to])
                    to += 1
                rows, starts, lengths, crcs, totals, classes, ids = [], [], [], [], [], [], []
                for i, tokens in enumerate(encoder.encode(texts[at:to]), at):
                    for start, length, k in cut(len(tokens), capacity, waste):
                        piece = tokens[start : start + length]
                        rows.append(i)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(crc32(piece.tobytes()))
                        totals.append(len(tokens))
                        classes.append(k)
                        if with_ids:
                            ids.append(piece.astype(np.int32))
                take = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)), pa.array(classes, pa.int32())]
                names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = to

    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, class int" + ", ids array<int>" * with_ids
    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, waste: float = 1 / 32, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = kept(token_pieces(rows, tokenizer or tokenizer_file(), end_id, capacity, waste, with_ids), "pieces")
    # The upper bits of row are the input partition: the block that deals its own numbers.
    pieces = pieces.withColumn("block", F.shiftright("row", 33))
    counts = kept(pieces.groupBy("class", "block").agg(F.count("*").alias("n")), "class-counts")
    totals = counts.groupBy("class").agg(F.sum("n").alias("total")).withColumn("bins", F.floor(F.col("total") / F.col("class")))
    # At most capacity classes, so these windows and the broadcast are bounded.
    totals = totals.withColumn("first_id", F.sum("bins").over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)))
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = pieces.join(firsts.drop("n"), ["class", "block"])
    numbered = numbered.withColumn("number", F.col("first") + F.row_number().over(W.partitionBy("class", "block").orderBy("row", "start")) - 1)
    numbered = numbered.join(F.broadcast(totals), "class").withColumn("bin", F.floor(F.col("number") / F.col("class")))
    numbered = kept(numbered.drop("block", "first", "total"), "numbered")
    full = numbered.filter("bin < bins").withColumn("sequence_id", F.coalesce("first_id", F.lit(0)) + F.col("bin"))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    totals = totals.agg(F.sum("bins").alias("base")).withColumn("key", F.lit(0))
    rest = numbered.filter("bin >= bins").withColumn("key", F.lit(0)).join(F.broadcast(totals), "key")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    placed = _first_fit(rest.select("key", "row", "start", "length", "base"), capacity)
    rest = rest.join(F.broadcast(placed), ["row", "start"])
    return full.select(*names, "sequence_id", "offset").unionByName(rest.select(*names, "sequence_id", "offset"))


def _first_fit(rest: DataFrame, capacity: int) -> DataFrame:
    """(row, start, sequence_id, offset) of the last pieces of all classes, fewer than the sum of the classes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "start"], ascending=[False, True, True])
        room, ids, offsets, first, last = [], [], [], 0, None
        for n in pdf["length"]:
            first = first if n == last else 0  # equal lengths go on where the one before fitted
            while first < len(room) and room[first] < n:
                first += 1
            if first == len(room):
                room.append(capacity)
            ids.append(first)
            offsets.append(capacity - room[first])
            room[first] -= n
            last = n
        return pd.DataFrame({"row": pdf["row"], "start": pdf["start"], "sequence_id": pdf["base"] + np.array(ids, dtype=np.int64), "offset": np.array(offsets, dtype=np.int64)})

    return rest.groupBy("key").applyInPandas(run, "row long, start long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


SQL = None
