"""Toxicity by a weighted finite-state pattern grammar.

Small transducers for insults, threats, negation, reported speech and targets read the words of a clause. Each is a
table (state, symbol) -> (state, symbol, weight); composing them gives one machine. The insult transducer follows an
address ("you ...", "you are such a ...") and tells an insult said of its target from one that merely stands there; the
threat transducer follows intent ("will ...") and tells a threat from a mention of violence. Negations and
reporting verbs mark what they govern. The target transducer holds a match back until a target follows it or the clause
ends, so a target counts on either side. Every match is written out as one of 32 kinds (address, insult, intent or violence; negated or
not, reported or not, aimed or not), with its lexicon weight; documents are scored by the matches of their clauses, never
by words alone.

The function words of the grammar are fixed lists. The insult lexicon is learned: word beginnings whose document
counts in labelled toxic and other rows differ beyond chance. The weight of each kind of match is learned by logistic
regression. Both use at most `most` labelled rows of each class and texts of at most 128 KiB; in the regression a row is weighted by its class's counted
share of all learnable labels, so that scores keep the classes' shares. The lexicon compares rates within the classes.

Defined results: a null or empty text has no clause and gets the score of a document without matches; without labelled
rows of both classes the lexicon is empty and every score is 0.5 or less; ids whose labels contradict each other have none;
rows that repeat an id are scored one by one, and the least of their texts is learned from; a null id is not held out; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import kept, read
from vellum.llm.labelled import held_out, sample

THREATS = "kill hurt destroy beat crush burn töten schlagen vernichten tuer frapper détruire matar golpear destruir"
TARGETS = "you your yourself u du dich dir ihr euch dein tu toi te vous ton ta tú ti usted tus"
INTENTS = "will shall going gonna should must werde wirst wird werden soll vais va vas vamos voy debe i'll we'll"
COPULAS = "are is were be being you're ur bist seid ist es est êtes sont eres son sois sos"
NEGATIONS = "not never no don't isn't aren't without nicht nie kein keine ne pas jamais sans nunca jamás sin"
REPORTS = "said says wrote claims called quoted reported sagte schrieb nannte dit écrit déclaré dijo escribió llamó"

#: Words that a negation governs, and that an address or an intent reaches.
SCOPE, REACH = 3, 4
#: Bytes of distinct words whose symbols a task remembers at a time, each with some more for its tag.
WORD_CACHE, TAG_BYTES = 32 << 20, 200
PREFIX_MIN, PREFIX_MAX = 4, 10

Table = dict[tuple, tuple]


@dataclass(frozen=True)
class Transducer:
    """moves: (state, symbol) -> (state, symbol, weight); a symbol without a move passes unchanged and keeps the state."""

    start: tuple
    moves: Table

    def step(self, state: tuple, symbol: str) -> tuple:
        return self.moves.get((state, symbol), (state, symbol, 0.0))


def compose(a: Transducer, b: Transducer, alphabet: set[str]) -> Transducer:
    """Reads what a reads, writes what b writes from a's output; weights add. Only states that can be reached are built."""
    start, moves, todo = (a.start, b.start), {}, [(a.start, b.start)]
    seen = {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            to_a, middle, w = a.step(state[0], symbol)
            to_b, out, v = b.step(state[1], middle)
            moves[state, symbol] = ((to_a, to_b), out, w + v)
            if (to_a, to_b) not in seen:
                seen.add((to_a, to_b))
                todo.append((to_a, to_b))
    return Transducer(start, moves)


#: other, insult, threat, target, copula, intent, negation, report, end of clause
ALPHABET = {"o", "I", "T", "Y", "B", "M", "N", "R", "."}
#: A: insult said of the one addressed; I: insult; V: violence intended; T: violence mentioned.
MATCHES = "AIVT"
KINDS = [f"{k}{n}{r}{y}" for k in MATCHES for n in ("", "n") for r in ("", "r") for y in ("", "y")]


def _following(opens: str, extends: str, plain: str, led: str, symbols: set[str]) -> Transducer:
    """Writes `led` for a `plain` that comes within REACH words of `opens`, counted anew from each `extends` in between."""
    moves: Table = {}
    for k in range(REACH + 1):
        for s in symbols:
            after = 0 if s == "." else REACH if s == opens or (s == extends and k) else max(0, k - 1)
            moves[(k,), s] = ((after,), led if s == plain and k else s, float(s == plain))
    return Transducer((0,), moves)


def _target(symbols: set[str]) -> Transducer:
    """Marks matches of a clause with a target before or after them. A match waits until it is known, so it may be written at a later symbol, one at each."""
    moves: Table = {}
    matches = sorted(s for s in symbols if s[0] in MATCHES)
    for seen, waiting in [(1, "")] + [(0, w) for w in ["", *matches]]:
        for s in symbols:
            if s in matches:
                moves[(seen, waiting), s] = ((1, ""), s + "y", 0.0) if seen else ((0, s), waiting or "o", 0.0)
            elif s == "Y":
                moves[(seen, waiting), s] = ((1, ""), waiting + "y" if waiting else s, 0.0)
            elif s == ".":
                moves[(seen, waiting), s] = ((0, ""), waiting or s, 0.0)
    return Transducer((0, ""), moves)


def numbered(machine: Transducer) -> Transducer:
    """The same machine with numbers for states."""
    names: dict[tuple, int] = {machine.start: 0}
    for (state, _), (to, _, _) in machine.moves.items():
        names.setdefault(state, len(names))
        names.setdefault(to, len(names))
    return Transducer(0, {(names[a], s): (names[b], out, w) for (a, s), (b, out, w) in machine.moves.items()})


def grammar() -> Transducer:
    """The composed machine: reads symbols of words, writes the kind of each match, or other symbols."""
    found = ALPHABET | set(MATCHES)
    negation: Table = {}
    for left in range(SCOPE + 1):
        for s in found:
            left_after = 0 if s == "." else SCOPE if s == "N" else max(0, left - 1)
            negation[(left,), s] = ((left_after,), s + "n" if s in MATCHES and left else s, 0.0)
    negated = found | {s + "n" for s in MATCHES}
    reported = Transducer((0,), {((f,), s): ((int(s == "R" or (f and s != ".")),), s + "r" if f and s[0] in MATCHES else s, 0.0) for f in (0, 1) for s in negated})
    marked = negated | {s + "r" for s in negated if s[0] in MATCHES}
    machine = compose(_following("Y", "B", "I", "A", ALPHABET), _following("M", "M", "T", "V", ALPHABET | {"A"}), ALPHABET)
    for part in (Transducer((0,), negation), reported, _target(marked)):
        machine = compose(machine, part, ALPHABET)
    return numbered(machine)


class Tagger(dict):
    """Raw word -> (symbol, weight, ends a clause); words are looked up by their longest learned beginning."""

    def __init__(self, insults: dict[str, float]) -> None:
        self.insults, self.size = insults, 0
        self.fixed = {w: s for s, words in (("T", THREATS), ("B", COPULAS), ("Y", TARGETS), ("M", INTENTS), ("N", NEGATIONS), ("R", REPORTS)) for w in words.split()}

    def __missing__(self, raw: str) -> tuple[str, float, bool]:
        self.size += 4 * len(raw) + TAG_BYTES
        if self.size > WORD_CACHE:
            self.clear()
            self.size = 4 * len(raw) + TAG_BYTES
        core = re.sub(r"^\W+|\W+$", "", raw.lower())
        symbol, weight = self.fixed.get(core, "o"), 0.0
        whole = core + "$"
        for n in range(min(len(whole), PREFIX_MAX), PREFIX_MIN - 1, -1):
            if whole[:n] in self.insults:
                symbol, weight = "I", self.insults[whole[:n]]
                break
        self[raw] = tag = symbol, weight, raw[-1] in ".,;:!?)]}\"”»"
        return tag


def clause_features(text: str | None, tagger: Tagger, machine: Transducer) -> np.ndarray:
    """For each kind of match: log of 1 + matches, and of 1 + the sum of their weights; then 1."""
    out = np.zeros(2 * len(KINDS) + 1)
    out[-1] = 1
    tags = list(map(tagger.__getitem__, text.split())) if text else []
    if any(t[0] == "I" or t[0] == "T" for t in tags):
        state, waiting = machine.start, []  # weights of the matches that are not yet written
        for symbol, weight, ends in [*tags, ("o", 0.0, True)]:
            if symbol in "IT":
                waiting.append(weight)
            for s in (symbol, ".") if ends else (symbol,):
                state, kind, _ = machine.step(state, s)
                at = _KIND.get(kind)
                if at is not None:
                    out[at] += 1
                    out[len(KINDS) + at] += waiting.pop(0)
        out[:-1] = np.log1p(out[:-1])
    return out


_KIND = {k: i for i, k in enumerate(KINDS)}


def learn_insults(labelled: DataFrame, least: float = 25.0) -> dict[str, float]:
    """Word beginnings (a final $ marks the whole word) with a log-likelihood ratio of at least `least`, and their log odds."""
    totals = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    a_all, b_all = totals.get(1, 0), totals.get(0, 0)
    if not a_all or not b_all:
        return {}
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"(?U)^\W+|\W+$", ""))))
    words = labelled.select("doc_id", "y", word.alias("word")).filter(F.length("word") >= PREFIX_MIN - 1).withColumn("word", F.concat("word", F.lit("$")))
    lengths = F.sequence(F.lit(PREFIX_MIN), F.least(F.length("word"), F.lit(PREFIX_MAX)))
    starts = words.select("doc_id", "y", F.explode(lengths).alias("n"), "word").select("doc_id", "y", F.substring("word", F.lit(1), F.col("n")).alias("p")).distinct()
    counts = starts.groupBy("p").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    n, a, b = a_all + b_all, F.col("a"), F.col("b")
    seen = a + b
    ratio = 2 * (part(a, seen * a_all / n) + part(b, seen * b_all / n) + part(a_all - a, (n - seen) * a_all / n) + part(b_all - b, (n - seen) * b_all / n))
    odds = F.log((a + 0.5) / (a_all + 1)) - F.log((b + 0.5) / (b_all + 1))
    found = counts.withColumns({"ratio": ratio, "odds": odds}).filter(F.col("ratio") >= least).filter("odds >= 1.5").orderBy(F.desc("ratio"), F.desc(F.length("p")), "p").collect()
    chosen: dict[str, float] = {}
    longer: set[str] = set()  # all beginnings of those chosen
    for r in found:  # the strongest beginning of each family of words
        own = [r["p"][:n] for n in range(1, len(r["p"]) + 1)]
        if r["p"] not in longer and not any(c in chosen for c in own):
            chosen[r["p"]] = float(r["odds"])
            longer.update(own)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton's method, weighted if weights are given; these are scaled to a mean of 1. The last column is the offset."""
    weight = np.ones(len(x)) if weight is None else weight / weight.mean()
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / len(x) + penalty
        move = np.linalg.solve(hessian, x.T @ (weight * (p - y)) / len(x) + penalty @ w)
        w -= move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, n_matches) for every row; n_matches counts the insults and threats of all kinds."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = kept(sample(docs, labels, "toxic", most), "labelled")
    insults, machine = learn_insults(labelled), grammar()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(insults)
        for batch in batches:
            x = [clause_features(t.as_py(), tagger, machine) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], names=["y", "weight", "x"])

    found = labelled.mapInArrow(features, "y int, weight double, x array<double>").toArrow() if insults else None
    weights = np.zeros(2 * len(KINDS) + 1)
    if found is not None and len(found):
        weights = logistic(np.array(found["x"].to_pylist()), found["y"].to_numpy().astype(float), weight=found["weight"].to_numpy())
    else:
        weights[-1] = -0.01

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(insults)
        for batch in batches:
            x = np.array([clause_features(t.as_py(), tagger, machine) for t in batch.column(1)]).reshape(-1, len(weights))
            s = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            n = np.rint(np.expm1(x[:, : len(KINDS)]).sum(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(n)], names=["doc_id", "score", "n_matches"])

    return docs.mapInArrow(run, "doc_id long, score double, n_matches long").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "n_matches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


SQL = None
