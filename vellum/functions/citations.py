"""Citations and printed references in running text, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A bracket of numbers, a year, a named work, the two styles, works in brackets and in running text, lettered appendices, and printed references with lists of numbers.
NUMBERS = r"\[(\d{1,3}(?:\s*[-–,]\s*\d{1,3})*)\]"
YEAR = r"(?:19|20)\d{2}[a-z]?"
AUTHOR_YEAR = r"(?:et al\.?,?\s*\(?(?:19|20)\d{2}|\((?:[A-Z][A-Za-z\-]+[^()]{0,40}?,\s*(?:19|20)\d{2}))"
NAMED_WORK = r"([A-Z][A-Za-z\-'’À-ž]+)(?:\s+et al\.?|\s*(?:,|and|&)\s*[A-Z][A-Za-z\-'’À-ž]+)*[,\s]*\(?(" + YEAR + r")"
WORK_GROUP = r"\(((?:[^()]|\([^()]*\))*?" + YEAR + r"[^()]*)\)"
TEXTUAL_WORK = r"\b([A-Z][A-Za-z\-'’]+)((?:\s+et al\.?)|(?:\s+(?:and|&)\s+[A-Z][A-Za-z\-'’]+))?\s*\((" + YEAR + r")\)"
LETTERED = r"\b(?:Appendi(?:x|ces)|App\.)\s*([A-Z](?:\.\d+)*)\b"
LISTED = {
    "section": r"\b(?:Sections?|Secs?\.|§)\s*(\d+(?:\.\d+)*(?:\s*(?:,|and|&|–|-)\s*\d+(?:\.\d+)*)*)",
    "figure": r"\b(?:Figures?|Figs?\.)\s*(\d+(?:\s*(?:,|and|&|–|-)\s*\d+)*)",
    "table": r"\b(?:Tables?|Tabs?\.)\s*(\d+(?:\s*(?:,|and|&|–|-)\s*\d+)*)",
    "algorithm": r"\b(?:Algorithms?|Algs?\.)\s*(\d+)",
    "equation": r"\b(?:Equations?|Eqs?\.)\s*\(?(\d+\)?(?:\s*(?:,|and|&|–|-)\s*\(?\d+\)?)*)",
}
#: A range of numbers in brackets counts as one if it is shorter than this.
LONGEST_RANGE = 30


def style(text: Column) -> Column:
    """numeric where more brackets of numbers than named works with years stand in the text, else author-year."""
    return F.when(F.regexp_count(text, F.lit(NUMBERS)) > F.regexp_count(text, F.lit(AUTHOR_YEAR)), "numeric").otherwise("author-year")


def numeric_keys(text: Column) -> Column:
    """The numbers cited in brackets, in order; short ranges are filled."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(1)), lambda g: F.split(g, r"\s*,\s*")))

    def numbers(part: Column) -> Column:
        first, last = F.regexp_extract(part, r"^(\d+)", 1).cast("int"), F.regexp_extract(part, r"(\d+)$", 1).cast("int")
        spans = part.rlike(r"[-–]")
        return F.when(spans & (last > first) & (last - first < LONGEST_RANGE), F.sequence(first, F.greatest(first, last))).when(~spans, F.array(first)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, numbers))


def named_keys(text: Column) -> Column:
    """Surname and year, in lower case, of the works in round brackets, which may hold brackets themselves, in order; then of those named in running text before a year in brackets."""
    groups = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(WORK_GROUP), F.lit(1)), lambda g: F.split(g, ";")))
    grouped = F.transform(groups, lambda p: F.concat(F.regexp_extract(p, NAMED_WORK, 1), F.regexp_extract(p, NAMED_WORK, 2)))
    textual = F.transform(F.regexp_extract_all(text, F.lit(TEXTUAL_WORK), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, TEXTUAL_WORK, 1), F.regexp_extract(m, TEXTUAL_WORK, 3)))
    return F.filter(F.transform(F.concat(grouped, textual), F.lower), lambda k: k != "")


#: Any of the printed references: none holds another's first word, so that one pass finds what a pass for each kind would. Their kinds by the first letters.
PRINTED_LIST = r"\b(?:" + "|".join(p.removeprefix(r"\b") for p in (*LISTED.values(), LETTERED)) + ")"
FIRST_LETTERS = {"S": "section", "§": "section", "F": "figure", "T": "table", "Al": "algorithm", "E": "equation", "Ap": "appendix"}


def listed_references(text: Column) -> Column:
    """(kind, number) structs of printed references in order, those of appendices with letters; a range stands for its two ends."""

    def numbered(match: Column) -> Column:
        kind = F.coalesce(*(F.when(match.startswith(begin), kind) for begin, kind in FIRST_LETTERS.items()))
        digits = F.regexp_extract_all(match, F.lit(r"\d+(?:\.\d+)*"), F.lit(0))
        numbers = F.when(match.startswith("Ap"), F.array(F.regexp_extract(match, LETTERED, 1))).otherwise(digits)
        return F.transform(numbers, lambda n: F.struct(kind.alias("kind"), n.alias("number")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PRINTED_LIST), F.lit(0)), numbered))
