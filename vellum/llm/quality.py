"""Quality classifier by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages. Each passage becomes frequencies of pairs of byte classes and a few word statistics,
then a hidden layer; a gated attention network weighs the passages, and the weighted sum is classified. Only whole
documents have labels. Fitting uses at most `most` labelled rows of each class and texts of at most 128 KiB (the bound on
what goes to the driver: their passages), weighted by the class's counted share of all learnable labels. Scoring runs over whole texts in Arrow batches with the small fitted model.

Defined results: a null or empty text is one empty passage and gets that passage's score; without any labelled row of
both classes every score is 0.5; ids whose labels contradict each other have none; rows that repeat an id are scored one
by one, and the least of their texts is learned from; a null id is not held out; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import read
from vellum.llm.labelled import held_out, sample

#: Bytes of a passage, moved to the next white space.
PASSAGE = 768
CLASSES = 12


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower case, upper case, digit, beyond ASCII, blank, line break, stop, comma, and four kinds of other marks."""
    table = np.full(256, 8, np.int64)
    for c in range(256):
        ch = chr(c)
        if c >= 128:
            table[c] = 3
        elif ch.islower():
            table[c] = 0
        elif ch.isupper():
            table[c] = 1
        elif ch.isdigit():
            table[c] = 2
        elif ch in " \t":
            table[c] = 4
        elif ch in "\n\r\v\f":
            table[c] = 5
        elif ch in ".;:?":
            table[c] = 6
        elif ch in ",'\"-()":
            table[c] = 7
        elif ch in "!":
            table[c] = 9
        elif ch in "|<>{}[]=\\/_~^`":
            table[c] = 10
        elif ch in "#$%&*+@":
            table[c] = 11
    return table


def passages(text: str | None, table: np.ndarray, size: int = PASSAGE) -> np.ndarray:
    """A row of features for each passage of the whole text."""
    raw = (text or "").encode()
    codes = table[np.frombuffer(raw, np.uint8)]
    starts = [0]
    while len(raw) - starts[-1] > size:
        at = starts[-1] + size
        stop = min(at + size, len(raw))
        found = [i for i in (raw.find(b" ", at, stop), raw.find(b"\n", at, stop)) if i >= 0]
        starts.append(min(found) + 1 if found else stop)
    if len(starts) > 1 and starts[-1] == len(raw):
        starts.pop()
    n = len(starts)
    which = np.repeat(np.arange(n), np.diff([*starts, len(raw)]))
    pairs = np.bincount(which[1:] * CLASSES**2 + codes[:-1] * CLASSES + codes[1:], minlength=n * CLASSES**2).reshape(n, -1).astype(np.float32) if len(raw) > 1 else np.zeros((n, CLASSES**2), np.float32)
    rest = np.zeros((n, 5), np.float32)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw)], strict=True)):
        words = raw[a:b].split()
        if words:
            rest[i] = len(set(words)) / len(words), sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words), min(4.0, (b - a) / len(words) / 8), np.log1p(len(words)) / 5, len(set(map(len, words))) / 12
    return np.hstack([np.sqrt(pairs / np.maximum(1, pairs.sum(1, keepdims=True))), rest])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Hidden layer w, gated attention v, u, a, and output o, each with its offset as the last row."""

    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    o: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """x: passages; first: where each bag begins. The last of the results are the scores."""
        h = np.tanh(x @ self.w[:-1] + self.w[-1])
        t, g = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * g) @ self.a
        bag = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
        p = np.exp(e - np.maximum.reduceat(e, first)[bag])
        p /= np.add.reduceat(p, first)[bag]
        z = np.add.reduceat(h * p[:, None], first)
        return h, t, g, p, bag, z, _sigmoid(z @ self.o[:-1] + self.o[-1])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]


def fit(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, epochs: int = 30, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, weight: np.ndarray | None = None) -> Attention:
    """Adam on the mean log loss of the bags, weighted if weights are given; these are scaled to a mean of 1."""
    weight = np.ones(len(bags), np.float32) if weight is None else (weight / weight.mean()).astype(np.float32)
    rng = np.random.default_rng(7)
    d = bags[0].shape[1]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
    m = Attention(init(d + 1, hidden), init(hidden, hidden), init(hidden, hidden), init(hidden), init(hidden + 1))
    names = ("w", "v", "u", "a", "o")
    moments = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = [bags[i] for i in order[at : at + batch]]
            x, first = np.vstack(own), np.cumsum([0, *map(len, own[:-1])])
            h, t, g, p, bag, z, s = m.forward(x, first)
            ds = (weight[order[at : at + batch]] * (s - y[order[at : at + batch]]) / len(own)).astype(np.float32)
            dz = ds[:, None] * m.o[:-1]
            dh = p[:, None] * dz[bag]
            dp = (h * dz[bag]).sum(1)
            de = p * (dp - np.add.reduceat(p * dp, first)[bag])
            dt, dg = de[:, None] * m.a * g * (1 - t**2), de[:, None] * m.a * t * g * (1 - g)
            dh += dt @ m.v.T + dg @ m.u.T
            dh *= 1 - h**2
            grads = {"w": np.vstack([x.T @ dh, dh.sum(0)]), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "o": np.append(z.T @ ds, ds.sum())}
            step += 1
            for k in names:
                value, (m1, m2), grad = getattr(m, k), moments[k], grads[k] + decay * getattr(m, k)
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad**2 - m2)
                value -= rate * (1 - epoch / epochs) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return m


def _bags(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = [passages(t, table) for t in texts]
    return np.vstack(own), np.cumsum([0, *map(len, own[:-1])])


def train(docs: DataFrame, labels: DataFrame, most: int) -> Attention | None:
    """The model, from at most 2 x most labelled documents; None without both classes."""
    table = _byte_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 64) for whole in batches for i in range(0, len(whole), 64)):
            bags = [passages(t.as_py(), table).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(bags, pa.binary())], names=["doc_id", "y", "weight", "bag"])

    found = sample(docs, labels, "quality", most).mapInArrow(run, "doc_id long, y int, weight double, bag binary").toArrow().sort_by([("doc_id", "ascending"), ("bag", "ascending")])
    y = found["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    width = CLASSES**2 + 5
    return fit([np.frombuffer(b, np.float16).reshape(-1, width).astype(np.float32) for b in found["bag"].to_pylist()], y.astype(np.float32), weight=found["weight"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2000, row_col: str | None = None) -> DataFrame:
    """(doc_id, held_out, score[, row]) for every row; row is a number (long) that tells rows apart, where ids may repeat or be null."""
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row)
    model, table = train(docs, labels, most), _byte_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                s = np.full(len(batch), 0.5) if model is None else model.score(*_bags(batch.column(1).to_pylist(), table))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), batch.column(2)], names=["doc_id", "score", "row"])

    return docs.mapInArrow(run, "doc_id long, score double, row long").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", *["row"] * bool(row_col))


#: Rows that score lower are rejected.
ACCEPT = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


SQL = None
