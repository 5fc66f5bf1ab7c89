"""Papers written from the given tables, as inputs of the measures: every order is a paper and each of its lines a section.

Each input is one SELECT that Spark and DuckDB both run, so that a query and its SQL begin with the same rows: they grow
with the tables, and only what the operators make of them is compared. No backslash stands in a literal, since the two
engines read it differently."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that one task holds of the papers it is dealt.
LINES_A_TASK = 250_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: o: paper, n: section, k: sections of the paper; p, s, q, d: numbers that vary from line to line.
LINES = (
    "(SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS k,"
    " l_partkey AS p, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, l_returnflag AS flag, l_linestatus AS state FROM lineitem) AS x"
)


def one_of(number: str, *texts: str) -> str:
    """The text whose place is the number modulo their count."""
    quoted = ["'" + t.replace("'", "''") + "'" for t in texts]
    return f"CASE {number} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(quoted[:-1])) + f" ELSE {quoted[-1]} END"


def written(template: str) -> str:
    """An expression that writes the template, whose <...> are expressions themselves."""
    parts = []
    for i, part in enumerate(re.split(r"<([^<>]+)>", template)):
        if i % 2:
            parts.append(part)
            continue
        for piece in re.split(r"([\\\n])", part):
            parts += ["chr(92)"] if piece == "\\" else ["chr(10)"] if piece == "\n" else ["'" + piece.replace("'", "''") + "'"] if piece else []
    return f"concat({', '.join(parts)})"


_X = "(p * 7919 + s * 31 + o * 17 + q)"
_VERDICT = lambda e: f"CASE WHEN ({e}) % 9 < 4 THEN 'FAIL' WHEN ({e}) % 9 < 7 THEN 'PASS' WHEN ({e}) % 9 = 7 THEN 'NA' ELSE 'UNRESOLVED' END"
_A, _B, _C = (_VERDICT(e) for e in ("o_orderkey", "o_orderkey + o_custkey % 2", "o_orderkey + o_custkey % 5"))
_CITING = ["DetectGPT [cite] is known.", "Similarly, others follow [cite].", "Both are used [cite, cite].", "It compares with DetectGPT in part [cite].", "Unlike prior methods, it is fast [cite].", "We extend prior methods [cite].", "A sentence without any work."]

INPUTS = {
    "docs": "SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS acknowledged FROM orders",
    "sections": f"SELECT o AS doc_id, n AS sec FROM {LINES}",
    "objects": f"SELECT o AS doc_id, concat('s', n) AS id, 'section' AS kind, n AS home FROM {LINES} UNION ALL SELECT o, concat('f', n), CASE flag WHEN 'A' THEN 'figure' WHEN 'R' THEN 'table' ELSE 'equation' END, n FROM {LINES}",
    "pointers": " UNION ALL ".join(f"SELECT o AS doc_id, n AS src, concat('{'f' if i in (2, 4) else 's'}', CAST(floor({_X} / {7**i}) AS BIGINT) % 8 + 1) AS target, {i} AS pos FROM {LINES}" for i in range(6)) + f" UNION ALL SELECT o, n, 'appendix:a', 6 FROM {LINES} WHERE q % 3 = 0",
    "labels_": " UNION ALL ".join(f"SELECT o AS doc_id, n AS sent, {r} AS run, CASE (p + n * 3 + {r} * s) % 6 WHEN 0 THEN 'superiority' WHEN 1 THEN 'prior_limitation' WHEN 2 THEN 'design_choice' ELSE 'other' END AS label FROM {LINES}" for r in range(3)),
    "supports": f"SELECT o AS doc_id, n AS claim, CASE WHEN s % 4 <> 0 THEN s % k + 1 END AS support FROM {LINES}",
    "sents": f"""SELECT o AS doc_id, n AS sec, 0 AS sent, concat('Section ', n, ' begins here', CASE WHEN q % 2 = 0 THEN ' [cite].' ELSE '.' END) AS text, CASE WHEN q % 2 = 0 THEN concat('c', s % 5) ELSE '' END AS keys FROM {LINES}
        UNION ALL SELECT o, n, 1, {one_of('p', *_CITING)}, CASE p % 7 WHEN 2 THEN concat('c', s % 5, ',c', (s + q) % 5) WHEN 6 THEN '' ELSE concat('c', q % 5) END FROM {LINES}""",
    "roles": f"SELECT o AS doc_id, n AS sec FROM {LINES} WHERE n <= 2 OR s % 3 = 0",
    "names": f"SELECT o AS doc_id, concat('c', p % 5) AS cite_key, CASE s % 5 WHEN 0 THEN 'DetectGPT' WHEN 1 THEN 'AI' WHEN 2 THEN 'ab' ELSE concat('MetaGPT', p % 3) END AS name FROM {LINES}",
    "tables_": f"SELECT o AS doc_id, q % 4 AS data_rows, d AS numeric_cells FROM {LINES}",
    "exhibits": f"SELECT o AS doc_id, {one_of('n', 'caption', 'quotation', 'environment')} AS kind FROM {LINES} WHERE d = 0",
    "figures": f"SELECT o AS doc_id, n - 1 AS index, flag <> 'A' AS has_image, {one_of('p', 'Results by size', 'Our approach', 'Overview of the system', 'Pipeline', 'Framework', 'Illustration of the idea', 'Losses')} AS caption FROM {LINES}",
    "elements": f"SELECT o AS doc_id, n % 3 AS run, {one_of('p', 'Step 1', '(2) next', 'Encoder', 'Legend', '✓', '✗', ' ', 'x denotes y')} AS text, {one_of('s', 'example', 'result', 'definition', 'evaluative_mark', 'notation_key', 'label', 'x')} AS role FROM {LINES}",
    "results": f"""SELECT o AS doc_id, {one_of('n', 'cross_refs', 'macro_redundancy', 'argument_graph', 'citation_isolation', 'figure_exposition', 'evidence_gap')} AS key, {one_of('n', 'structure', 'structure', 'argument', 'argument', 'artifacts', 'artifacts')} AS plane,
        CASE WHEN flag = 'N' THEN {one_of('s', 'na', 'skipped', 'error')} ELSE 'done' END AS status, CASE WHEN flag <> 'N' THEN CAST(d AS DOUBLE) / 10 END AS score FROM {LINES}""",
    "units": f"SELECT concat('1-', o_orderkey % 17) AS item, o_orderkey AS unit, CASE o_custkey % 3 WHEN 0 THEN {_A} WHEN 1 THEN concat({_A}, ',', {_B}) ELSE concat({_A}, ',', {_B}, ',', {_C}) END AS runs FROM orders",
    "edges": f"SELECT o AS doc_id, n AS src, concat(CASE WHEN d < 5 THEN 's' ELSE 'f' END, s % 8 + 1) AS target FROM {LINES}",
    "points": f"SELECT o AS page, concat('p', n) AS point, CASE flag WHEN 'R' THEN 'table' ELSE 'figure' END AS kind, CAST(0 AS DOUBLE) AS x, CAST(q AS DOUBLE) * 16 AS y, n % 2 AS column FROM {LINES}",
    "anchors": f"SELECT o AS page, concat('a', n) AS anchor, CAST(0 AS DOUBLE) AS x, CAST(s % 50 AS DOUBLE) * 16 + n AS y, s % 2 AS anchor_column FROM {LINES}",
    "gallery": """SELECT concat('k', page_id) AS key, CASE page_id % 3 WHEN 0 THEN concat('A Long Enough Title ', page_id % 20) WHEN 1 THEN concat('a long-enough title! ', page_id % 20) ELSE 'Short' END AS title,
        CASE page_id % 4 WHEN 0 THEN concat('https://arxiv.org/abs/2401.1', 1000 + page_id % 30) WHEN 1 THEN url END AS url, CAST(page_id % 7 AS DOUBLE) AS created, CASE WHEN page_id % 9 <> 0 THEN length(html) % 101 END AS index FROM pages""",
    "texts": f"SELECT o AS doc_id, n AS src, {written('As Section <s % 5 + 1> and Figure <p % 12> show, Table <q % 6> differs from Appendix <CASE WHEN d = 5 THEN chr(66) ELSE chr(65) END>; see Sec. <n>.1 and Figures <n>, the Part <s % 5 + 1> of work section, and Figure <p % 12> once more, after the part <s % 5 + 1> of work Section.')} AS raw FROM {LINES}",
    "numbered": " UNION ALL ".join(f"SELECT o AS doc_id, '{kind}' AS kind, CAST(n AS STRING) AS number, concat('{kind[0]}', n) AS id FROM {LINES}" for kind in ("section", "figure", "table")),
    "heads": f"SELECT o AS doc_id, n AS sec, concat('Part ', n, ' of work') AS title FROM {LINES}",
    "passages": f"""SELECT o * 100 + n AS id, concat({written('Shown before [<n>-<n + s % 40>, <q>] and [<p % 90>]')}, CASE WHEN s % 2 = 0 THEN {written(', as said (Smith et al., <1990 + n>; Jones and Lee 2019b) and (Doe et al., 2001)')} ELSE {written(', as Lee et al. (<2000 + n>) and Kim and Park (2019a) say (see Roe (the elder), 1999) in App. A.<n>')} END,
        {written('. Tables <n>, <q> and <s % 9> with Figure <n>, Equations (<n>) and (<q>), Algorithm <n>, Sections <n>.1-<n>.3.')}) AS text FROM {LINES}""",
    "claims": f"""SELECT p_partkey AS id, concat({one_of('p_partkey', 'No individual cases were inspected.', 'The result rests solely on aggregate numbers.', 'It does not show any concrete examples.', 'We show many cases.', 'not any specific failure cases have been reported', 'A qualitative case study',
        'Sample outputs of the model', 'System prompts used', 'Accuracy by size', 'Walkthrough', 'Visualisations of attention', 'only on aggregate scores')}, ' ', p_name) AS text FROM part""",
    "cells": f"""SELECT o * 100 + n AS id, CASE p % 12 WHEN 0 THEN concat(q, '.5') WHEN 1 THEN concat('± ', q) WHEN 2 THEN concat(n, ',', 100 + q) WHEN 3 THEN concat(q, ' %') WHEN 4 THEN concat('(0.', q, ')') WHEN 5 THEN concat('abc', q) WHEN 6 THEN ''
        WHEN 7 THEN concat(q, ' ± 0.', d) WHEN 8 THEN concat(q, 'x*') WHEN 9 THEN concat('a ', q) WHEN 10 THEN concat('~', q, ' ms') ELSE concat(2000 + q, '-', 2020) END AS cell FROM {LINES}""",
    "titles": f"SELECT p_partkey AS id, concat({one_of('p_partkey', 'Ethics Statement', 'Reproducibility', 'Related Work', 'Prior  literature', 'Background', 'Method', 'LLM use', 'Previous studies on ethics', 'Checklist', 'Relations')}, ' ', p_name) AS title FROM part",
    "issues": f"""SELECT concat('gh-', o_orderkey) AS id, concat({one_of('o_custkey', 'Proposal: ', '', 'Proposal:')}, 'Pattern ', o_custkey) AS title, {one_of('o_orderkey', 'proposal,testing', 'testing,accepted', 'proposal', 'not-adopted,testing', 'proposal,under-review')} AS labels,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'No fields here.' ELSE concat('**Plane:** ', o_orderstatus, 'lane', chr(10), '**What it is:** It repeats ', o_custkey, ' times. ', chr(10), 'Proposed by ', o_orderpriority, '. Thanks.') END AS body,
        CAST(CAST(o_orderdate AS DATE) AS STRING) AS created FROM orders""",
    "local_": "SELECT concat('l', c_custkey) AS id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('https://example.org/', c_custkey) ELSE '' END AS issue_url, concat('2024-01-', 10 + c_custkey % 20) AS created FROM customer",
    "pieces": f"SELECT concat('fb', o) AS fb, n % 2 AS ann, n AS piece, CASE d WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('piece ', p) END AS text, CAST(q AS DOUBLE) AS x0, CAST(d AS DOUBLE) AS y0, CAST(q + n AS DOUBLE) AS x1, CAST(d + 5 AS DOUBLE) AS y1 FROM {LINES}",
    "found": f"SELECT o AS doc_id, CASE p % 5 WHEN 0 THEN concat('§', n, ' Part ', n, ' of work') WHEN 1 THEN concat('part ', s % 5 + 1, ' of work') WHEN 2 THEN 'Elsewhere' WHEN 3 THEN NULL ELSE 'work' END AS title FROM {LINES}",
    "reasons": f"SELECT o AS doc_id, {one_of('p + n', 'no cue (none of the list)', 'no cue (other)', 'one work', 'own work (we)')} AS why FROM {LINES} UNION ALL SELECT o, NULL FROM {LINES} WHERE d = 0",
    "floats": f"SELECT o AS doc_id, n AS home, CASE flag WHEN 'A' THEN 'figure' ELSE 'table' END AS kind, (p % 97) * 100 + n AS at, concat('x', n) AS id FROM {LINES}",
    "keys_": "SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN concat(' ABCD efgh ', 1000 + page_id % 9000, ' ') WHEN 1 THEN concat('abcd-efgh-', 1000 + page_id % 9000) WHEN 2 THEN 'short' WHEN 3 THEN concat('a_longer-key', page_id) WHEN 4 THEN 'Bad Key !' ELSE concat('ABCDEFGH', page_id % 10) END AS key FROM pages",
}

# Papers in LaTeX. A last section of more than two may be a statement, which the reader leaves out; a: a section of the paper, b: one that may not be there, kept: sections without the statement.
_STATEMENT = "CASE WHEN n = k AND k > 2 AND p % 5 = 0 THEN 1 ELSE 0 END"
TEX_LINES = f"""(SELECT *, lead(title) OVER (PARTITION BY o ORDER BY n) AS next_title, k - max(statement) OVER (PARTITION BY o) AS kept FROM (
    SELECT *, {_STATEMENT} AS statement, p % k + 1 AS a, s % (k + 2) + 1 AS b, CASE WHEN state = 'F' AND n > 2 THEN '*' ELSE '' END AS star, {one_of('n', 'Overview of part ', 'Qualitative example ', 'Results by size ')} AS caption,
    CASE WHEN n = 1 THEN 'Introduction' WHEN n = 2 AND s % 3 = 0 THEN 'Related Work' WHEN {_STATEMENT} = 1 THEN 'Ethics Statement' ELSE concat('Topic ', n, ' on ', p) END AS title FROM {LINES}) AS y) AS z"""
TEX_SECTION = written(r"""\section<star>{<title>}\label{s<n>}
As Section~\ref{s<a>} shows, Figure <b> and Table 1 differ from \cref{f<a>,s<b>}. Section~\ref{s<a>} again, with Appendix B in Sec.~<b>. \emph{Unlike} prior methods \cite{c<s % 7>}, it is fast.
See the <coalesce(next_title, 'Final')> section. Only Section 1<b> is missing, 50\% more.<CASE WHEN n = 1 THEN concat(' More is in ', chr(92), 'ref{app}.') ELSE '' END> % hidden \ref{s1}
\begin{figure}\caption{<caption><n>}\label{f<n>}\end{figure}
\begin{table}\caption{Numbers}\label{t<n>}\begin{tabular}{ll}\hline a & b \\ <q> & 0.<d> \\ x & <q>\% \\ \cmidrule{1-2}<CASE WHEN q % 2 = 0 THEN concat(d, ' & n/a ', chr(92), chr(92)) ELSE '' END>\specialrule{1pt}{2pt}{3pt}\end{tabular}\end{table}
""")
BIB_ENTRY = written("""@article{c<n>,
 title={<CASE WHEN p % 2 = 0 THEN concat('G', p % 9, 'Net') ELSE 'Plain words' END>: a study},
 author={Doe<s % 5>, Jane and Roe, R.},
}
""")
INPUTS |= {
    "tex_lines": f"SELECT o, n, k, p, s, q, d, statement, a, b, star, caption, title, next_title, kept, sum(CASE WHEN star = '' THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY n) AS number FROM {TEX_LINES} WHERE statement = 0",
    "tex_sections": f"SELECT o AS doc_id, n, k, {TEX_SECTION} AS part FROM {TEX_LINES}",
    "bib": f"SELECT o AS doc_id, n, s, p, {BIB_ENTRY} AS entry FROM {LINES}",
}

# Files that include each other: three mentions in each, one of a file that may not be there and one of the main file, and one in a comment.
_NAME = lambda t: f"CASE WHEN {t} = 1 THEN 'main' WHEN ({t}) % 2 = 0 THEN concat('f', {t}) ELSE concat('sub/f', {t}, '.tex') END"
_ONE, _TWO, _THREE = "p % k + 1", "s % (k + 2) + 1", "1"
FILE_PIECES = [written("<CASE WHEN n = 1 THEN concat(chr(92), 'documentclass{x}', chr(92), 'begin{document}') ELSE '' END>Begin <p> "), "' middle '", "' then '", written("\nend <q>")]
INPUTS |= {
    "members": f"""SELECT o AS archive, CASE WHEN n = 1 THEN 'paper/main.tex' WHEN n % 2 = 0 THEN concat('paper/f', n, '.tex') ELSE concat('paper/sub/f', n, '.tex') END AS path,
        concat({FILE_PIECES[0]}, {written(r"\input{")}, {_NAME(_ONE)}, {written(r"} middle \include{./")}, {_NAME(_TWO)}, {written(r"} then \input ")}, {_NAME(_THREE)}, {written(chr(10) + r"% \input{main}")}, {FILE_PIECES[3]}) AS text FROM {LINES}""",
    "included": " UNION ALL ".join(f"SELECT o, n, {i} AS nth, {t} AS t FROM {LINES} WHERE {t} <= k" for i, t in ((1, _ONE), (2, _TWO), (3, _THREE))),
    "file_pieces": " UNION ALL ".join(f"SELECT o, n, {i} AS i, {piece} AS piece FROM {LINES}" for i, piece in enumerate(FILE_PIECES)),
    "term_sents": f"""SELECT o AS doc_id, n AS sec, 0 AS sent, {one_of('p', 'The Self-Recall Error (SRE) grows.', 'SRE is high, and the error rate is low.', 'We call it RAGx, the data-driven one.', 'A data-driven method and a rule-based one.', 'The "hidden slot" denotes a place.', 'The hidden slot of RAGx, or "hidden slot".', 'Large Model Index (LMX) is not spelt so.', 'The Large Model Index (LMI) is; LMI and LMX differ.')} AS text FROM {LINES}
        UNION ALL SELECT o, n, 1, {one_of('s', 'It is crucial and pivotal.', 'A novel method, unlike others.', 'It is not fast but robust, demonstrating that it works.', 'Overall, it is worth noting that this is left for future work.', 'Nothing to see here at all today.', 'SRE refers to an error; it is well established that it grows.', 'Rather than that, a novel, efficient, and scalable one.')} FROM {LINES}""",
    "own_objects": f"SELECT o AS doc_id, concat('a', n) AS id, {one_of('n', 'section', 'figure')} AS kind, CASE WHEN p % 3 > 0 THEN CAST(s % 4 AS STRING) END AS number, concat('§', n, ' Part ', q % 3) AS title FROM {LINES}",
    "other_objects": f"SELECT o AS doc_id, concat('b', n) AS id, {one_of('s', 'section', 'figure')} AS kind, CASE WHEN q % 3 > 0 THEN CAST(p % 4 AS STRING) END AS number, concat('part ', d % 3) AS title FROM {LINES}",
    "changed_results": f"SELECT o AS doc_id, 'figure_exposition' AS key, 'artifacts' AS plane, {one_of('s', 'done', 'error', 'done')} AS status, CASE WHEN s % 3 <> 1 THEN CAST(d AS DOUBLE) / 20 END AS score FROM {LINES} WHERE n = 5 AND q % 2 = 0",
}

# Feedback by supplier, its lines being pieces of 150 annotations, of which one takes many; a ninth of the annotations has no piece. Proposals by part, votes by event, posts by turn, marks by order.
_ANN = "CASE WHEN d = 0 THEN 0 ELSE p % 150 END"
INPUTS |= {
    "submissions": """SELECT s_suppkey AS fb, CASE WHEN s_suppkey % 9 = 1 THEN '  ' ELSE s_name END AS name, CASE WHEN s_suppkey % 11 <> 2 THEN concat(' Group ', s_nationkey) END AS affiliation,
        CASE s_suppkey % 5 WHEN 3 THEN concat('s', s_suppkey, ' at example.org') WHEN 4 THEN concat('s', s_suppkey, '@example') ELSE concat('s', s_suppkey, '@example.org ') END AS email FROM supplier""",
    "annotations": f"""SELECT s AS fb, a AS ann, {one_of('a', 'other', '', 'citation_isolation', 'other')} AS kind, CASE WHEN s % 7 = 3 AND a = 5 THEN '  ' ELSE concat(' Title ', a) END AS title,
        CASE WHEN s % 17 = 4 AND a = 0 THEN 'Too short' ELSE concat('It is noted ', q, ' times here, in words that go on for a while.') END AS note,
        CASE WHEN a % 3 = 0 THEN concat('Pattern ', a % 10, ' ') END AS pattern_name, CASE WHEN a % 6 = 0 THEN concat(' What it is: ', q) ELSE '' END AS pattern_what
        FROM (SELECT s, {_ANN} AS a, max(q) AS q FROM {LINES} WHERE s % 13 <> 6 GROUP BY s, {_ANN}) AS w""",
    "fb_pieces": f"SELECT s AS fb, {_ANN} AS ann, o * 100 + n AS piece, CASE d WHEN 1 THEN NULL WHEN 2 THEN '' ELSE concat('piece ', p, ' of ', o) END AS text FROM {LINES} WHERE s % 13 <> 6 AND {_ANN} % 9 <> 4",
    "disputed_": f"SELECT s AS fb, o * 100 + n AS nth, concat('f', p) AS finding FROM {LINES} WHERE flag <> 'N' AND s % 13 <> 6",
    "drafts": f"SELECT p_partkey AS id, {one_of('p_partkey', 'ab ', ' abc', 'A pattern', '', 'Other pattern')} AS name, CASE WHEN p_size % 3 > 0 THEN {one_of('p_size', 'structure', 'Argument', ' artifacts ', 'other')} END AS plane, CASE p_partkey % 7 WHEN 0 THEN ' too short ' WHEN 1 THEN NULL WHEN 2 THEN '0123456789' ELSE concat(' ', p_name, ' is noticed ') END AS what FROM part",
    "ballots": "SELECT event_id, concat(event_id % 6, '-', user_id % 6) AS item, CASE WHEN user_id % 10 > 0 THEN concat('t', user_id, ' ') ELSE ' ' END AS token, CASE WHEN event_id % 7 < 6 THEN event_id % 7 % 4 - 1 END AS v FROM events",
    "posts": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'case' ELSE role END AS kind, concat(turn % 6, '-', conv_id % 6) AS item, CASE conv_id % 5 WHEN 0 THEN ' Of nine ' WHEN 1 THEN ' exactly twenty chars' ELSE text END AS text FROM conversations",
    "prompts_": "SELECT c_custkey AS id, c_name AS text FROM customer",
    "ups": "SELECT o_custkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 50 END AS token FROM orders",
    "report_docs": "SELECT o_orderkey AS doc_id, CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('On order ', o_orderkey) END AS title, CASE WHEN o_custkey % 8 < 4 THEN concat('order-', o_orderkey) END AS fallback, CASE o_orderstatus WHEN 'F' THEN 'latex' WHEN 'O' THEN 'pdf' END AS source FROM orders",
    "measured": f"""SELECT o AS doc_id, {one_of('n - 1', 'cross_refs', 'macro_redundancy', 'argument_graph', 'citation_isolation', 'figure_exposition', 'evidence_gap')} AS key, {one_of('n - 1', 'structure', 'structure', 'argument', 'argument', 'artifacts', 'artifacts')} AS plane,
        CASE WHEN flag = 'N' THEN {one_of('s', 'na', 'skipped', 'error')} ELSE 'done' END AS status, CASE WHEN flag <> 'N' THEN CAST(d AS DOUBLE) / 10 END AS score, d AS num, 10 AS den FROM {LINES} WHERE n <= 6""",
    "asserted": " UNION ALL ".join(f"""SELECT o * 100 + n AS claim, {r} AS run, concat('Our method is always better across domains than RULER on ', q, ' sets, and it holds for all kinds of data that one can think of.') AS text,
        {one_of(f'(p + {r} * s)', 'Across domains', 'RULER', 'holds for all kinds of data that one can', 'not in the claim', '', 'always better')} AS phrase, CASE WHEN s % 4 > 0 THEN concat('class ', (p + {r} * q) % 3) END AS class, CASE WHEN q % 3 > 0 THEN 'all' ELSE '' END AS qualifier FROM {LINES}""" for r in range(3)),
    "covered": " UNION ALL ".join(f"SELECT o * 100 + n AS claim, concat('class ', {i} % 3) AS class, concat('item ', (q + {i} * s) % 5) AS item FROM {LINES} WHERE (p + {i}) % 2 = 0" for i in range(10)),
    "limits": f"SELECT o * 100 + n AS claim FROM {LINES} WHERE d = 3 UNION ALL SELECT o * 100 + n FROM {LINES} WHERE d = 3 AND q > 25",
}

# Printed lists of references, two lines an entry, numbered in every other paper; lines that may begin a caption; a log with days that are none; pages as a list by age.
_REF_FIRST = written("<CASE WHEN o % 2 = 0 THEN concat('[', n, '] ') ELSE '' END>Jane Doe<s % 5>, R. Roe. <CASE p % 3 WHEN 0 THEN concat('G', p % 9, 'Net: a study') WHEN 1 THEN 'Plain words: a study' ELSE 'Two MixedName' END>")
_REF_SECOND = written("<CASE WHEN p % 3 = 2 THEN 'here: on ' ELSE 'of ' END><q> things, <1990 + n>b.")
INPUTS |= {
    "ref_lines": f"SELECT o AS doc_id, 2 * n AS line, CAST(72 + q % 3 AS DOUBLE) AS x0, {_REF_FIRST} AS text FROM {LINES} UNION ALL SELECT o, 2 * n + 1, CAST(84 AS DOUBLE), {_REF_SECOND} FROM {LINES}",
    "styles": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'numeric' ELSE 'author-year' END AS style FROM orders",
    "caption_lines": f"SELECT o * 100 + n AS id, CASE WHEN d > 0 THEN concat({one_of('p', 'Figure ', 'fig. A', 'TABLE', 'Tab. ', 'Algorithm ', 'Alg.', 'In Table ')}, q, {one_of('s', ': what', '. What', ' | what', ' shows what', ' : what')}) END AS text FROM {LINES}",
    "log": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('on ', event_id) WHEN 2 THEN '2020-1-01 00:00:00' WHEN 3 THEN concat('20', 24 + event_id % 2, '-0', 1 + user_id % 9, '-', 10 + user_id % 18) ELSE concat('2025-0', 1 + user_id % 9, '-', 10 + event_id % 18, ' 10:00:00') END AS logged FROM events",
    "pages_": "SELECT page_id, CASE WHEN page_id % 4 > 0 THEN CAST(page_id % 50 AS DOUBLE) END AS created FROM pages",
}

# Inputs of which a line makes several rows, as Spark reads them: the rows of INPUTS in one pass over the lines, where a UNION ALL numbers the lines again in each of its branches.
_ROWS = lambda *rows: f"LATERAL VIEW inline(array({', '.join(f'struct({r})' for r in rows)})) AS"
ONE_PASS = {
    "objects": f"SELECT o AS doc_id, concat(letter, n) AS id, kind, n AS home FROM {LINES} {_ROWS("'s', 'section'", "'f', CASE flag WHEN 'A' THEN 'figure' WHEN 'R' THEN 'table' ELSE 'equation' END")} letter, kind",
    "pointers": f"""SELECT o AS doc_id, n AS src, target, pos FROM {LINES} {_ROWS(*(f"concat('{'f' if i in (2, 4) else 's'}', CAST(floor({_X} / {7**i}) AS BIGINT) % 8 + 1), {i}" for i in range(6)), "CASE WHEN q % 3 = 0 THEN 'appendix:a' END, 6")} target, pos WHERE pos < 6 OR target IS NOT NULL""",
    "sents": f"""SELECT o AS doc_id, n AS sec, sent, text, keys FROM {LINES} {_ROWS(
        "0, concat('Section ', n, ' begins here', CASE WHEN q % 2 = 0 THEN ' [cite].' ELSE '.' END), CASE WHEN q % 2 = 0 THEN concat('c', s % 5) ELSE '' END",
        f"1, {one_of('p', *_CITING)}, CASE p % 7 WHEN 2 THEN concat('c', s % 5, ',c', (s + q) % 5) WHEN 6 THEN '' ELSE concat('c', q % 5) END",
    )} sent, text, keys""",
    "numbered": f"SELECT o AS doc_id, kind, CAST(n AS STRING) AS number, concat(left(kind, 1), n) AS id FROM {LINES} {_ROWS(*(f"'{kind}'" for kind in ('section', 'figure', 'table')))} kind",
}

_FROM = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
_OF_LINES = "l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice l_quantity l_discount l_returnflag l_linestatus".split()


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input of INPUTS over the tables of a folder."""
    return select(spark, sf_dir, ONE_PASS.get(name, INPUTS[name]))


def _dealt(lines: DataFrame) -> DataFrame:
    """The columns of LINES, dealt by paper: to as many tasks as Spark takes, or more where each would get over LINES_A_TASK lines.

    Where the cores don't hold the lines at once, the number is fixed: Spark would join tasks by their bytes until a task holds millions of lines.
    A line travels as one column, so that Spark does not choose other columns for each input: all inputs of a query share one shuffle."""
    key, *others = _OF_LINES
    packed = lines.select(key, F.array(F.struct(*others)).alias("line"))
    tasks = -(-lines.count() // LINES_A_TASK)
    spark = lines.sparkSession
    fixed = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))) if tasks > spark.sparkContext.defaultParallelism else None
    return (packed.repartition(fixed, key) if fixed else packed.repartition(key)).select(key, F.inline("line"))


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the tables of a folder; each is known to the session under a name of its folder, so that queries over several folders do not meet. Those of lineitem are read by paper."""
    mark = re.sub(r"\W", "_", sf_dir)
    for table in {m[1] for m in _FROM.findall(sql)}:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (_dealt(rows) if table == "lineitem" else rows).createOrReplaceTempView(f"{table}_{mark}")
    return spark.sql(_FROM.sub(rf"\1 \2_{mark}", sql))


def with_inputs(names: tuple[str, ...], sql: str) -> str:
    """The SQL of a query over inputs."""
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names) + sql


def over_inputs(names: tuple[str, ...], build: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that builds its result from the inputs, in their order."""
    return lambda spark, sf_dir: build(*(derived(spark, sf_dir, n) for n in names))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, tex): the papers in LaTeX."""
    parts = derived(spark, sf_dir, "tex_sections").groupBy("doc_id").agg(F.max("k").alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]), "").alias("parts"))
    head = F.format_string("\\documentclass{article}\n\\begin{document}\n\\begin{abstract}We study order %d. It has %d parts.\\end{abstract}\n", "doc_id", "k")
    return parts.select("doc_id", F.concat(head, "parts", F.lit("\\appendix\n\\section{More}\\label{app}\nSee \\ref{s1}.\n\\end{document}\n")).alias("tex"))
