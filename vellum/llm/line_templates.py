"""Line dedup by a log-template tree, in DataFrame functions only.

As in a fixed-depth parse tree (He et al., 2017), a line goes to the leaf of its number of tokens and its first tokens,
those with a digit generalised. Within a leaf that enough documents reach, a token that enough documents have at its
place is constant and any other is a variable field. A template is what remains; if enough of its tokens are constant
and enough different documents hold it, all its lines are dropped. Exact copies of a text count as one document, so
that copies of a document do not make its own lines recurring.

Defined results: lines end at a line feed; null and empty texts are one line and come back as they are (null as null);
lines of fewer than `least_tokens` tokens are dropped where all of their tokens are constant (blank lines and short lines
with a digit stay), or always stay with `short` off; rows that repeat an id are treated one by one; a null id stays null;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import kept, read, release, small_side

FIELD = "<*>"


def masked_tokens(line: Column) -> Column:
    """Tokens between blanks, those with a digit generalised; lines without digits are spared the replacement."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)
    return F.filter(F.split(masked, " "), lambda t: t != "")


def _without(lines: Column, drops: Column) -> Column:
    """Lines but those at the places in drops. Places that stay are found by one hash set, and both arrays are made once, so the time goes with the number of lines."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    both = F.array(F.struct(lines.alias("lines"), stay.alias("stay")))
    return F.get(F.transform(both, lambda b: F.transform(b["stay"], lambda i: F.get(b["lines"], i))), F.lit(0))


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least_tokens: int = 4, least_docs: int = 5, constant: float = 0.6, short: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # What lines are found again by: rows with the same id and text have the same lines to drop.
    key = [F.xxhash64("doc_id", "text").alias("key"), F.length("text").alias("size")]
    # Hashes and tokens are made before lines become rows: each text is hashed and each line cut once, whatever is read of them later.
    lines = F.transform(F.split("text", "\n"), masked_tokens)
    cut = rows.select(*key, F.xxhash64("text").alias("copy"), lines.alias("lines"))
    tokens = cut.select("key", "size", "copy", F.posexplode("lines").alias("at", "tokens")).filter(F.size("tokens") >= (1 if short else least_tokens))
    tokens = tokens.withColumns({"leaf": F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)), "variant": F.xxhash64("tokens")})
    leaves = tokens.select("leaf", "copy").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("leaf")
    leaves = small_side(kept(leaves, "leaves"))
    lines = kept(tokens.join(leaves, "leaf", "left_semi"), "leaf-lines")
    # A line's tokens are judged once for each variant of the leaf, a row for each token: no leaf is gathered in a row or task.
    variants = kept(lines.groupBy("leaf", "variant", "copy").agg(F.first("tokens").alias("tokens")), "variants")
    token = F.transform("tokens", lambda t: F.when(t != FIELD, F.xxhash64(t)))
    support = variants.select("leaf", F.posexplode(token).alias("place", "token")).filter("token is not null")
    # A copy may hold several variants of a leaf that agree in a token; it counts once.
    several = variants.groupBy("leaf", "copy").agg(F.count("*").alias("c")).filter("c > 1").select("leaf", "copy")
    twice = variants.join(small_side(kept(several, "several")), ["leaf", "copy"], "left_semi").select("leaf", "copy", F.posexplode(token).alias("place", "token")).filter("token is not null")
    twice = twice.groupBy("leaf", "copy", "place", "token").agg((1 - F.count("*")).alias("n")).filter("n < 0")
    counted = support.withColumn("n", F.lit(1).cast("long")).unionByName(twice.select("leaf", "place", "token", "n"))
    constants = counted.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_docs).select("leaf", "place", "token", F.lit(True).alias("fixed"))
    distinct = variants.groupBy("leaf", "variant").agg(F.first("tokens").alias("tokens"))
    judged = distinct.select("leaf", "variant", F.size("tokens").alias("n"), F.posexplode(token).alias("place", "token")).join(small_side(kept(constants, "constants")), ["leaf", "place", "token"], "left")
    fields = F.sort_array(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).alias("token"))))
    parsed = judged.groupBy("leaf", "variant", "n").agg(F.count("fixed").alias("fixed"), F.xxhash64(fields).alias("template"))
    enough = F.when(F.col("n") < least_tokens, F.col("n")).otherwise(constant * F.col("n"))
    parsed = kept(parsed.filter(F.col("fixed") >= enough).select("leaf", "variant", "template"), "templates")
    held = variants.select("leaf", "variant", "copy").join(small_side(parsed), ["leaf", "variant"]).select("leaf", "template", "copy").distinct()
    recurring = kept(held.groupBy("leaf", "template").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("leaf", "template"), "recurring")
    dropped = kept(parsed.join(small_side(recurring), ["leaf", "template"], "left_semi").select("leaf", "variant"), "dropped")
    drops = lines.join(small_side(dropped), ["leaf", "variant"], "left_semi")
    drops = small_side(kept(drops.groupBy("key", "size").agg(F.collect_set("at").alias("drops")), "drops"))
    release(lines, variants)
    every = rows.withColumns({"key": key[0], "size": key[1]}).join(drops, ["key", "size"], "left")
    lines = F.split("text", "\n")
    return every.select(
        "doc_id", F.coalesce(F.size(lines), F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.concat_ws("\n", _without(lines, F.col("drops")))).alias("text")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(read(spark, sf_dir, "documents"))


def query_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lines of one to three tokens left out of the tree."""
    return drop_templates(read(spark, sf_dir, "documents"), short=False)


SQL_LONG_LINES = r"""
WITH l AS (SELECT doc_id, text, i - 1 AS pos, lines[i] AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
t AS (SELECT doc_id, text, pos, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN string_split(line, ' ') IF x <> ''] AS tokens FROM l),
k AS (SELECT *, concat_ws(chr(31), len(tokens), tokens[1], tokens[2], tokens[3]) AS leaf FROM t WHERE len(tokens) >= 4),
leaves AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT text) >= 5),
s AS (SELECT * FROM k SEMI JOIN leaves USING (leaf)),
places AS (SELECT DISTINCT leaf, text, i, tokens[i] AS token FROM s, unnest(range(1, len(tokens) + 1)) AS u(i)),
constants AS (SELECT leaf, i, token FROM places GROUP BY leaf, i, token HAVING count(*) >= 5),
marked AS (SELECT s.doc_id, s.text, s.pos, s.leaf, u.i, len(s.tokens) AS n, CASE WHEN c.token IS NOT NULL AND c.token <> '<*>' THEN c.token ELSE '<*>' END AS w
           FROM s, unnest(range(1, len(s.tokens) + 1)) AS u(i) LEFT JOIN constants c ON c.leaf = s.leaf AND c.i = u.i AND c.token = s.tokens[u.i]),
parsed AS (SELECT doc_id, text, pos, leaf, string_agg(w, ' ' ORDER BY i) AS template FROM marked GROUP BY doc_id, text, pos, leaf, n HAVING count(*) FILTER (WHERE w <> '<*>') >= 0.6 * n),
recurring AS (SELECT leaf, template FROM parsed GROUP BY leaf, template HAVING count(DISTINCT text) >= 5),
drops AS (SELECT doc_id, pos FROM parsed SEMI JOIN recurring USING (leaf, template)),
n AS (SELECT doc_id, count(*) AS n_dropped FROM drops GROUP BY doc_id),
left_over AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN drops USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN n_dropped IS NULL THEN d.text ELSE coalesce(x.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN left_over x USING (doc_id)
"""

SQL = SQL_LONG_LINES.replace("WHERE len(tokens) >= 4", "WHERE len(tokens) >= 1").replace(">= 0.6 * n)", ">= CASE WHEN n < 4 THEN n ELSE 0.6 * n END)")
