"""Printed reference lists: their entries, the keys under which texts cite them, and the names by which works go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A numbered entry's start, the first author, a surname at the start, a year, a name before a colon and how far into an entry it is looked for, a caption's start.
NUMBERED = r"\n?\[(\d{1,3})\]\s*"
FIRST_AUTHOR = r"^\s*([^,.]+?)[,.]"
SURNAME = r"^\s*([A-Z][A-Za-z\-'’À-ž]+)"
YEAR = r"\b((?:19|20)\d{2}[a-z]?)\b"
SHORT_NAME = r"(?U)(?:^|[.?]\s+)([A-Z][\w\-]*(?:\s[\w\-]+){0,2}):\s"
NAME_WITHIN, LEAST_NAME = 260, 3
CAPTION = r"(?i)^(Figure|Fig\.|Table|Tab\.|Algorithm|Alg\.)\s*([A-Z]?\d{1,3})\s*[:.|]\s*"
#: An entry begins on a line that starts less than this right of the list's leftmost line.
INDENT = 3.0


def caption(line: Column) -> Column:
    """(kind, number) of a line that begins a caption, the kind being figure, table or algorithm; null for other lines."""
    begin = F.lower(F.substring(F.regexp_extract(line, CAPTION, 1), 1, 3))
    kind = F.when(begin == "fig", "figure").when(begin == "tab", "table").otherwise("algorithm")
    return F.when(line.rlike(CAPTION), F.struct(kind.alias("kind"), F.regexp_extract(line, CAPTION, 2).alias("number")))


def numbered_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, cite_key, entry) of lists whose entries begin with a number in brackets; lines (doc_id, line, text). What stands before the first number is no entry."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    lists = lines.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("whole"))  # one paper's list
    keys = F.regexp_extract_all("whole", F.lit(NUMBERED), F.lit(1))
    bodies = F.slice(F.split("whole", NUMBERED, -1), F.lit(2), F.size(keys))
    pairs = F.zip_with(keys, bodies, lambda k, b: F.struct(F.concat(F.lit("ref"), k.cast("int").cast("string")).alias("cite_key"), b.alias("entry")))
    return lists.select("doc_id", F.explode(pairs).alias("e")).select("doc_id", "e.*")


def hanging_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, cite_key, entry) of lists whose entries begin at the left margin; lines (doc_id, line, x0, text). The key is the first author's surname and the year; an entry without a year, or without a name, has none and is left out."""
    own = W.partitionBy("doc_id")
    begins = F.abs(F.col("x0") - F.min("x0").over(own)) < INDENT
    nth = lines.withColumn("begins", begins).withColumn("nth", F.count_if("begins").over(own.orderBy("line")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    entries = nth.groupBy("doc_id", "nth").agg(F.array_join(ordered, " ").alias("entry"))
    tokens = F.filter(F.split(F.regexp_extract("entry", FIRST_AUTHOR, 1), r"\s+"), lambda t: t != "")
    author = F.coalesce(F.when(F.size(tokens) > 0, F.element_at(tokens, -1)), F.nullif(F.regexp_extract("entry", SURNAME, 1), F.lit("")))
    year = F.nullif(F.regexp_extract("entry", YEAR, 1), F.lit(""))
    return entries.select("doc_id", F.lower(F.concat(author, year)).alias("cite_key"), "entry").filter("cite_key is not null")


def short_names(entries: DataFrame) -> DataFrame:
    """(doc_id, cite_key, name): names that stand before a colon near the start of an entry, if they hold a capital after their first character."""
    name = F.regexp_extract(F.substring("entry", 1, NAME_WITHIN), SHORT_NAME, 1)
    named = entries.select("doc_id", "cite_key", name.alias("name"))
    return named.filter((F.length("name") >= LEAST_NAME) & F.substring("name", 2, NAME_WITHIN).rlike("[A-Z]"))


def printed_names(lines: DataFrame, styles: DataFrame) -> DataFrame:
    """short_names() of every paper's list (doc_id, line, x0, text) in the style of its citations (doc_id, style): numeric, or author-year otherwise."""
    known = lines.join(styles, "doc_id", "left").withColumn("numeric", F.coalesce(F.col("style") == "numeric", F.lit(False)))
    return short_names(numbered_entries(known.filter("numeric")).unionByName(hanging_entries(known.filter("not numeric"))))
