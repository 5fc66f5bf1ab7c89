"""Grouping of spelling variants with forward and backward minimal acyclic automata.

Two words that differ by one inserted, deleted or replaced code point agree in a half: if the shorter has m code points
and the error lies behind the first m // 2 of them, these are the same in both words, else the last m - m // 2 are
(Mihov and Schulz, 2004). So each word goes to the block of each half that it may share with another, forward ones by
its beginning and backward ones by its end read backwards. The rest of a block's words form a minimal acyclic automaton
whose edges carry how many words come before them, so that walking a word gives its number, and with it its count. Each
word of m code points is completed from its half with one error, replaced or inserted; what is longer finds the
shorter one the other way round. Where both halves agree, which a doubled letter allows, only the forward block reports.

Words are counted by Spark with a partial sum in each task. A task holds the words of one block, never the vocabulary; a block of more than
`BLOCK` words is divided by the same rule once more: the rest that holds the error agrees in its own first or last half.

Defined results: a null text is an empty one; a null id is written as an empty string where ids decide which code point
is left out; rows that repeat an id are read one by one; counts of a word are summed over all rows; words without a near one have no form,
no form_n, an n_near of 0 and are their own root; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import ascii_lower, kept, read, small_side

#: Fixed by the query's contract: a run of letters, after A-Z have become a-z.
RUN = "[a-zÀ-ÿ]+"
#: Code points of a text that are cut into runs at a time; longer texts are divided where no run goes on.
PIECE = 1 << 16
#: Words of a block; larger ones are divided.
BLOCK = 5000
#: Rows of an output batch.
ROWS = 20_000


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): runs of letters, of which every so-manieth, by the checksum of document and run, lacks one code point; long and frequent ones only."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), ascii_lower(F.col(text_col).cast("string")).alias("text"))
    pieces = F.when(F.length("text") > PIECE, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}{RUN[:-1]}*"), F.lit(0))).otherwise(F.array("text"))
    runs = rows.select("id", F.explode(pieces).alias("piece")).select("id", F.explode(F.regexp_extract_all("piece", F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= least_length)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """Minimal acyclic automaton of distinct sorted words; a word's number is its place among them."""

    def __init__(self, words: list[str]) -> None:
        self.states: list[tuple[bool, dict]] = []  # final, {character: (state, words before it)}
        self._sizes: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, list]] = [(False, [])]
        before = ""

        def freeze(final: bool, edges: list) -> int:
            key = (final, *edges)
            if key not in known:
                numbered, n = {}, int(final)
                for character, state in edges:
                    numbered[character] = (state, n)
                    n += self._sizes[state]
                known[key] = len(self.states)
                self.states.append((final, numbered))
                self._sizes.append(n)
            return known[key]

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                state = freeze(*path.pop())
                path[-1][1].append((before[len(path) - 1], state))

        for word in words:
            same = 0
            while same < len(before) and before[same] == word[same]:  # a sorted word never ends within the one before
                same += 1
            close(same)
            path += [(False, []) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            before = word
        close(0)
        self.start = freeze(*path[0])

    def number(self, word: str, state: int | None = None, n: int = 0) -> int:
        """The number of what leads from the state through the word to an end, -1 where nothing does."""
        states = self.states
        state = self.start if state is None else state
        for character in word:
            step = states[state][1].get(character)
            if step is None:
                return -1
            state, n = step[0], n + step[1]
        return n if states[state][0] else -1

    def near(self, word: str) -> Iterator[int]:
        """Numbers of the words that come of this one by one replaced or one inserted character, each once."""
        state, n = self.start, 0
        for i in range(len(word) + 1):
            here, rest = word[i : i + 1], word[i:]
            edges = self.states[state][1]
            for character, (to, before) in edges.items():
                if character != here:  # inserted before an equal one is the same as after it
                    found = [self.number(rest, to, n + before)] + ([self.number(rest[1:], to, n + before)] if here else [])
                    yield from (x for x in found if x >= 0)
            step = edges.get(here)
            if step is None:
                return
            state, n = step[0], n + step[1]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pairs of near words, both ways, from rows that come block by block, each block's words sorted."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("back", "m", "part", "half", "cut", "turned", "n")), strict=True)

    out: tuple[list, list, list] = ([], [], [])

    def put(word: str, near: str, n: int) -> None:
        out[0].append(word)
        out[1].append(near)
        out[2].append(n)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
        for column in out:
            column.clear()
        return made

    for (back, m, part, _), block in groupby(rows(), key=lambda r: r[:4]):
        found = [r[4:] for r in block]
        if len(found) < 2:
            continue
        cut = found[0][0]
        rests = [turned[cut:] for _, turned, _ in found]
        automaton, size, quarter = Automaton(rests), m - cut, (m - cut) // 2
        for (_, x, n), rest in zip(found, rests, strict=True):
            if len(x) != m:
                continue
            for number in automaton.near(rest):
                _, y, y_n = found[number]
                if (back and y[len(y) - size :] == rest) or (part == 2 and y[cut : cut + quarter] == rest[:quarter]):
                    continue  # the other half agrees too
                put(x[::-1] if back else x, y[::-1] if back else y, y_n)
                if len(y) > m:
                    put(y[::-1] if back else y, x[::-1] if back else x, n)
            if len(out[0]) >= ROWS:
                yield batch()
    if out[0]:
        yield batch()


def near_pairs(found: DataFrame, least_length: int = 6, block: int | None = None) -> DataFrame:
    """(word, near, near_n) for words (word, n): every word with every other at one edit, once each way. `found` is read twice."""
    block = BLOCK if block is None else block
    length = F.length("word")

    def half(back: bool, m: Column) -> Column:
        cut = m - F.floor(m / 2).cast("int") if back else F.floor(m / 2).cast("int")
        return F.struct(F.lit(back).alias("back"), m.alias("m"), cut.alias("cut"), (F.reverse("word") if back else F.col("word")).alias("turned"))

    every = F.array(*(half(back, m) for back in (False, True) for m in (length, length - 1)))
    rows = found.select("n", F.explode(every).alias("h")).select("n", "h.*").filter(F.col("m") >= least_length)
    rows = rows.withColumn("half", F.substring("turned", F.lit(1), F.col("cut")))
    large = rows.groupBy("back", "m", "half").agg(F.count("*").alias("size")).filter(F.col("size") > block).select("back", "m", "half", F.lit(True).alias("large"))
    rows = rows.join(small_side(kept(large, "large-blocks")), ["back", "m", "half"], "left")
    quarter = F.floor((F.col("m") - F.col("cut")) / 2).cast("int")
    first = F.struct(F.lit(1).alias("part"), F.concat("half", F.substring("turned", F.col("cut") + 1, quarter)).alias("half"))
    last = F.struct(F.lit(2).alias("part"), F.concat("half", F.substring("turned", F.length("turned") - (F.col("m") - F.col("cut") - quarter) + 1, F.length("turned"))).alias("half"))
    parts = F.when(F.col("large"), F.array(first, last)).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("half").alias("half"))))
    dealt = rows.select("back", "m", "cut", "turned", "n", F.explode(parts).alias("p")).select("back", "m", "p.*", "cut", "turned", "n")
    dealt = dealt.repartition("back", "m", "part", "half").sortWithinPartitions("back", "m", "part", "half", "turned")
    return dealt.mapInArrow(_pairs, "word string, near string, near_n long")


def variants(found: DataFrame, least_length: int = 6, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n). A word's form is its most frequent near word where that is so many times as frequent."""
    found = kept(found, "words")
    best = near_pairs(found, least_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    joined = found.join(best, "word", "left")
    form_n = -F.col("best.col1")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form_n >= times * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("form_n"))).alias("f"))
    formed = kept(formed.select("word", "n", "n_near", "f.*"), "forms")
    # Counts rise along forms, so a chain is short; each round doubles how far a root is followed.
    roots = kept(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = kept(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not roots.filter("moved").head(1):
            break
        roots = roots.drop("moved")
    return formed.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(read(spark, sf_dir, "documents")))


#: DuckDB has no CRC-32; tests/llm/test_words.py holds the operator against a brute-force version.
SQL = None
