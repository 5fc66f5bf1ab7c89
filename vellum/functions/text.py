"""Sentences, tokens, n-grams and cue patterns as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins for citations, formulas and references, and the abbreviations whose full stops end no sentence.
CITE, MATH, REF = "[cite]", "[math]", "[ref]"
ABBREVIATIONS = [
    "e.g.", "i.e.", "et al.", "etc.", "vs.", "cf.", "Fig.", "Figs.", "Eq.", "Eqs.", "Sec.", "Secs.",
    "Tab.", "No.", "approx.", "resp.", "w.r.t.", "Dr.", "Prof.", "Mr.", "Ms.", "St.", "Ref.", "Refs.",
    "App.", "Appx.", "Thm.", "Def.", "Prop.", "Alg.", "Ch.", "pp.", "vol.", "Jan.", "Feb.", "Aug.",
    "Sept.", "Oct.", "Nov.", "Dec.", "Inc.", "Corp.", "Ltd.", "U.S.",
]
DOT = "․"
TOKEN = r"\[(?:cite|math|ref)\]|[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
SENTENCE_BREAK = r"""(?<=[.!?])["'”’)\]]*\s+(?=["'“‘(\[⟦]*[A-Z0-9⟦\[])"""
#: The same break with the stop itself, which is looked for first.
SENTENCE_STOP = SENTENCE_BREAK.replace("(?<=[.!?])", "([.!?])")

# Cue patterns.
RELATION_CUES = (
    r"(?i)\b(unlike|in contrast to|by contrast|contrary to|whereas|similar(ly)? to|likewise|analogous to|"
    r"akin to|compared (to|with)|extends?|extending|builds? (on|upon)|building on|inspired by|"
    r"improves? (on|upon)|generali[sz]es?|complements?|complementary to|instead of|rather than|"
    r"as in|as with|differs? from|departs? from)\b"
)
SENTENCE_INITIAL_CUES = (
    r"(?i)^(similarly|likewise|in contrast|by contrast|conversely|alternatively|building on|following|"
    r"extending|in the same vein|along (this|these|the same) lines?|complementary|subsequently|"
    r"more recently|later|concurrently|relatedly|in a similar|a related|another line|other (work|works|studies))\b"
)
DEICTIC_WORKS = (
    r"(?i)\b(these|those|such|prior|previous|earlier|above|aforementioned|existing|other|both)\s+"
    r"(methods?|works?|approaches|studies|models|systems|techniques|detectors|papers|efforts|lines?|"
    r"frameworks|benchmarks|baselines)\b"
)
FIRST_PERSON = r"(?i)\b(we|our|ours|us|this (paper|work|study|article))\b"


def _quoted(text: str) -> str:
    return text.replace(".", r"\.")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def where(text: Column, test: Callable[[Column], Column], body: Callable[[Column], Column]) -> Column:
    """body of the texts that pass the test, the others as they are; the text is evaluated once."""
    return bound(text, lambda t: F.when(test(t), body(t)).otherwise(t))


def _protected(text: Column) -> Column:
    """Full stops of abbreviations, initials and decimals become DOT. Each pattern begins with the stop itself and looks back over it, so that nothing is tried at other characters."""
    single = [_quoted(a[:-1]) for a in ABBREVIATIONS if a.count(".") == 1]

    def several(out: Column) -> Column:
        for a in (a for a in ABBREVIATIONS if a.count(".") > 1):
            out = F.regexp_replace(out, r"(?<![A-Za-z])" + _quoted(a), a.replace(".", DOT))
        return out

    def stops(text: Column) -> Column:
        out = where(text, lambda t: t.rlike(r"\.[A-Za-z]\."), several)  # as every abbreviation with several stops has it
        return F.regexp_replace(out, r"\.(?<=(?:^|[^A-Za-z])(?:" + "|".join(single) + r")\.|(?U:\b)[A-Z]\.(?=(?U:\s)+[A-Z][a-z])|\d\.(?=\d))", DOT)

    return where(text, lambda t: t.contains("."), stops)


def _sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph; white space becomes single blanks first, where it isn't yet. A mark is set at the breaks where the text does not hold it already."""
    flat = F.trim(where(paragraph, lambda p: p.rlike(r"[\t-\r]|  "), lambda p: F.regexp_replace(p, r"[\t-\r]\s*| \s+", " ")))

    def cut(text: Column) -> Column:
        marked = F.split(F.regexp_replace(text, SENTENCE_STOP, "$1\0"), "\0")
        return F.when(text.contains("\0"), F.split(text, SENTENCE_BREAK)).otherwise(marked)

    return F.transform(bound(_protected(flat), cut), lambda s: F.trim(F.replace(s, F.lit(DOT), F.lit("."))))


def split_sentences(block: Column) -> Column:
    """Sentences of a block of text, an array; paragraphs end at blank lines, closing quotes after a stop go with the break. The block is evaluated once."""

    def cut(block: Column) -> Column:
        several = F.flatten(F.transform(F.split(block, r"\n\s*\n"), _sentences))
        return F.when(block.rlike(r"\n\s*\n"), several).otherwise(_sentences(block))

    return F.filter(bound(F.coalesce(block, F.lit("")), cut), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case word tokens; a stand-in is one token."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def ngrams(words: Column, n: int = 8) -> Column:
    """(at, gram) structs of all n-grams, at from 0; an empty array for fewer words."""
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.struct(i.alias("at"), F.slice(words, i + 1, n).alias("gram")))
    return F.when(F.size(words) >= n, every).otherwise(F.slice(every, 1, 0))


def named(text: Column, name: Column) -> Column:
    """True where the text holds the name as a whole word, whatever characters the name has."""
    return F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), name, F.lit(r"\E(?![A-Za-z0-9])")))


def identity(title: Column) -> Column:
    """Lower case, letters and digits only, cut to 80: by which titles are compared."""
    return F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]+", ""), 1, 80)
