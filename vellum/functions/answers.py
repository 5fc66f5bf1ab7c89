"""JSON in answers of models, which may stand in a fence, after a block of reasoning, or in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fences, blocks of reasoning, and the widest braces.
FENCE = r"^```(?:json)?\s*|\s*```$"
REASONING = r"(?s)<think>.*?</think>"
BRACES = r"(?s)\{.*\}"

_EDGES = r"^\s+|\s+$"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def strictly(text: Column) -> Column:
    """The text as a variant if it is one JSON value and nothing else, else null. The parser passes over what follows a value, so the text has to stand both in a list and in an object: only a whole value can."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))), "$.v", "variant")
    return F.when(listed.isNotNull(), held)


def parsed(answer: Column) -> Column:
    """The answer's JSON as a variant: the text without fence and reasoning if that is JSON, else what stands between its first and last brace; null where neither is."""
    bare = _trimmed(F.regexp_replace(F.regexp_replace(_trimmed(answer), FENCE, ""), REASONING, ""))
    return F.coalesce(strictly(bare), strictly(F.regexp_extract(bare, BRACES, 0)))


def canonical(value: Column) -> Column:
    """A variant as JSON with its keys in order and without blanks, equal for equal values."""
    return F.to_json(value)


def answer_key(value: Column) -> Column:
    """The SHA-256 of a variant's canonical text."""
    return F.sha2(canonical(value), 256)
