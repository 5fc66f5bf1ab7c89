"""Fuzzy search for short license notices: exact seeds, then bounded-error matching.

A text is brought to words, lower case and one blank apart. A notice of k allowed edits is cut into k + 1 pieces; whatever matches it with at most k edits
holds one of the pieces unchanged (pigeonhole). One automaton of all pieces (Aho and Corasick, 1975) finds them in one pass; each hit opens the window in which its notice
could lie, windows of a notice that meet are joined and widened to whole words, and there the regex library looks for the notice with at most k edits, from word to word. Nothing
is looked for outside the windows, and nothing is missed there. A phrase's exact places are counted within its windows too.

A task holds one batch of rows; of a text it keeps the bytes, not a list of its words.

Defined results: a null text is an empty one, without words, matches or labels; matches of a notice are the ones found from left to right, not overlapping; exact places of
a phrase may share words; rows that repeat an id are read one by one; a null id stays null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import read

#: Fixed by the query's contract: phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Further notices, each with the label that it adds.
NOTICES = PHRASES | {
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
#: One edit is allowed for so many characters of a notice.
EDIT_EVERY = 11

#: Bytes between words, given that A-Z have become a-z: every byte of a character beyond ASCII belongs to a word.
_GAPS = re.compile(rb"[^a-z0-9\x80-\xff]+")


def normal(text: str | None) -> str:
    """Words in lower case (A-Z only), a blank before, between and after them."""
    inner = _GAPS.sub(b" ", (text or "").encode("utf-8", "replace").lower()).strip(b" ").decode()
    return f" {inner} " if inner else " "


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece): the notice in edits + 1 parts of nearly equal length."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds notices in normal() texts."""

    def __init__(self, notices: dict[str, str], phrases: dict[str, str], edit_every: int) -> None:
        self.notices = [(text, label, len(text) // edit_every, text in phrases) for text, label in notices.items()]
        self.patterns = [regex.compile(rf"(?e)(?<!\S)(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={k}}}(?!\S)") for text, _, k, _ in self.notices]
        seeds = defaultdict(list)
        for i, (text, _, k, _) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                seeds[piece].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice, the parts of the text in which it can stand, in order, apart from each other and from blank to blank."""
        hits = defaultdict(list)
        for end, (length, of) in self.automaton.iter(text):
            for i, at in of:
                hits[i].append(end + 1 - length - at)
        out: dict[int, list[list[int]]] = {}
        for i, starts in hits.items():
            notice, _, k, _ = self.notices[i]
            joined: list[list[int]] = []
            for start in sorted(starts):
                a, b = max(0, start - k - 1), min(len(text), start + len(notice) + k + 1)
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            whole: list[list[int]] = []
            for a, b in joined:
                a, b = text.rfind(" ", 0, a + 1), text.find(" ", b - 1) + 1
                if whole and max(a, 0) < whole[-1][1]:
                    whole[-1][1] = b or len(text)
                else:
                    whole.append([max(a, 0), b or len(text)])
            out[i] = whole
        return out

    def scan(self, text: str) -> tuple[list[dict], list[dict]]:
        """(matches, places): fuzzy matches of all notices; exact places of phrases."""
        matches, places = [], []
        for i, windows in self.windows(text).items():
            notice, label, k, phrase = self.notices[i]
            words_of = _WordNumbers(text)
            for a, b in windows:
                found, said = [], f" {notice} "
                for m in self.patterns[i].finditer(text, a, b):
                    found.append((m.start(), m.end(), sum(m.fuzzy_counts), m.group()))
                at = text.find(said, a, b) if phrase else -1
                exact = []
                while at >= 0:
                    exact.append(at + 1)
                    at = text.find(said, at + 1, b)
                for start, end, edits, group in found:
                    inner = group.strip(" ")
                    first = words_of(start + len(group) - len(group.lstrip(" ")))
                    matches.append({"label": label, "notice": notice, "first_word": first, "last_word": first + inner.count(" "), "edits": edits, "similarity": 1 - edits / len(notice), "text": inner})
                numbers = _WordNumbers(text, a, words_of.before(a))
                places += [{"label": label, "word": numbers(at)} for at in exact]
        return matches, places


class _WordNumbers:
    """The number of the word that starts at a place, for places asked in rising order."""

    def __init__(self, text: str, at: int = 0, blanks: int = 0) -> None:
        self.text, self.at, self.blanks = text, at, blanks

    def before(self, at: int) -> int:
        """Blanks before the place, or before where counting has come to if that is later."""
        if at > self.at:
            self.blanks += self.text.count(" ", self.at, at)
            self.at = at
        return self.blanks - self.text.count(" ", at, self.at)

    def __call__(self, at: int) -> int:
        return self.before(at) - 1


_MATCH = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("text", pa.string())])
_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None, edit_every: int = EDIT_EVERY) -> DataFrame:
    """(doc_id, n_words, matches, places) per row.

    matches: label, notice, first_word, last_word (from 0), edits, similarity and text of each fuzzy match of `notices`; places: label and first word of each exact place of `phrases`, which are among the notices."""
    notices, phrases = notices or NOTICES, PHRASES if phrases is None else phrases
    if missing := phrases.keys() - notices.keys():
        raise ValueError(f"phrases that are no notices: {sorted(missing)}")
    if short := [x for x in notices if x != normal(x).strip(" ") or len(x) < 2]:
        raise ValueError(f"notices have to be words in lower case, one blank apart: {short}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases, edit_every)
        for b in batches:
            counts, matches, places = [], [], []
            for value in b.column(1):
                text = normal(value.as_py())
                counts.append(text.count(" ") - 1)
                m, p = scanner.scan(text)
                matches.append(m)
                places.append(p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(matches, pa.list_(_MATCH)), pa.array(places, pa.list_(_PLACE))], ["doc_id", "n_words", "matches", "places"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    match = "struct<label: string, notice: string, first_word: bigint, last_word: bigint, edits: int, similarity: double, text: string>"
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words bigint, matches array<{match}>, places array<struct<label: string, word: bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    places = F.col("places.word")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "matches.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.similarity"), F.lit(0.0))).alias("score"),
    )


#: Matching with errors is not SQL; tests/llm/test_words.py holds the operator against a brute-force version.
SQL = None
