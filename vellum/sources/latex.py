"""LaTeX text to the tables of the measures, in column functions over a whole corpus.

Only what the measures read is recovered: sections, sentences with citation keys, labelled objects, pointers,
tables and exhibits. Macros are not expanded; unknown commands lose their backslash word and keep their argument."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.citations import listed_references
from vellum.functions.matches import match_spans
from vellum.functions.text import bound, split_sentences, tokens, where

# Titles of statements, back matter, roles of sections, exhibits, acknowledged gaps, numeric cells, rules of tables, references by label and printed ones.
STATEMENTS = (
    r"(?i)(ethic|reproducib|ai use|use of ai|llm use|use of (large )?language model|broader impact|"
    r"societal impact|author contribution|acknowledg|funding|impact statement|disclosure|checklist|code of conduct)"
)
BACK_MATTER = (
    r"(?i)\\(?:appendix\b|begin\{appendices\}|bibliography\s*\{|printbibliography|begin\{thebibliography\}|"
    r"section\*?\s*\{\s*Acknowledg|begin\{ack\}|section\*?\s*\{\s*(?:Supplementary|Appendix))"
)
RELATED = r"(?i)(related|prior|previous)\s+(work|research|literature|studies)|background|literature review|related\s+approaches"
EXHIBIT_ENVIRONMENTS = (
    r"(?i)^(?:verbatim|lstlisting|minted|alltt|quote|quotation|lstinputlisting)$|"
    r"(?:prompt|example|dialog|transcript|conversation|output|sample|specimen|query|response|chat|casestudy|case)"
)
BOXES = r"(?i)(tcolorbox|mdframed|framed|fbox|box)"
IO_MARKERS = r"(?i)\b(Prompt|Input|Output|Question|Answer|User|Assistant|Response|System|Query|Instruction|Model output|Generated)\s*:"
EXHIBIT_CAPTIONS = (
    r"(?i)\b(examples?|exemplars?|case stud(?:y|ies)|failure (?:cases?|modes?|examples?|analysis)|qualitative|"
    r"sample (?:outputs?|generations?|responses?)|generated (?:outputs?|samples?|texts?)|worked example|"
    r"walk-?through|illustrative|specimens?|prompt templates?|prompts? used|(?:system|user|full|exact|example) prompts?|"
    r"transcripts?|(?:model|llm|generated|sample) outputs?|(?:model|generated|example|sample) responses?|"
    r"excerpts?|generations|visuali[sz]ations? of|qualitative results?)\b"
)
ACKNOWLEDGED_GAP = (
    r"(?i)\b(no|not any)\s+(individual|concrete|specific)\s+(cases?|instances?|examples?|failure cases?)\s+"
    r"(were|was|are|is|have been|has been)\s+(retained|inspected|shown|displayed|examined|reported)|"
    r"\brests?\s+(solely\s+|only\s+)?on\s+aggregate|\b(solely|only)\s+on\s+aggregate\s+(scores|results|metrics)|"
    r"\bdoes not (display|show|include|present) (any )?(concrete |individual )+(examples?|instances?|cases?)"
)
NUMERIC_CELL = r"^[\(\[]?\s*[+\-−±~≈<>]?\s*\d[\d,]*(?:\.\d+)?\s*(?:%|×|x|k|K|M|B|s|ms|h)?\s*(?:[±]\s*\d[\d.]*)?\s*[\)\]]?\s*[*†‡]*$"
TABLE_RULES = [
    r"\\(?:toprule|midrule|bottomrule|hline|hdashline|addlinespace|endhead|endfirsthead|endfoot|endlastfoot)\b(?:\[[^\]]*\])?",
    r"\\(?:cmidrule|cline)\s*(?:\([^)]*\))?\s*\{[^}]*\}",
    r"\\(?:rowcolor|cellcolor)\s*(?:\[[^\]]*\])?\s*\{[^}]*\}",
    r"\\specialrule\s*\{[^}]*\}\s*\{[^}]*\}\s*\{[^}]*\}",
]
REFERENCE = r"\\(?:(?:eq|auto|c|C|page|name)?ref\*?\s*\{([^}]*)\}|hyperref\s*\[([^\]]*)\])"
PRINTED = {
    "section": r"(?:\bSections?|\bSecs?\.|§)\s*~?\s*(\d+)(?:\.\d+)*",
    "figure": r"\b(?:Figures?|Figs?\.)\s*~?\s*(\d+)",
    "table": r"\bTables?\s*~?\s*(\d+)",
    "appendix": r"\bAppendi(?:x|ces)\s*~?\s*([A-Z])\b",
}
#: All of them at once, which never overlap: the first letter is looked for by itself, and then what may stand before it.
SOUGHT = (
    r"[SFTA§](?:(?<=§)\s*~?\s*\d+(?:\.\d+)*|(?<=\bS)ec(?:tions?|s?\.)\s*~?\s*\d+(?:\.\d+)*|(?<=\bF)ig(?:ures?|s?\.)\s*~?\s*\d+|"
    r"(?<=\bT)ables?\s*~?\s*\d+|(?<=\bA)ppendi(?:x|ces)\s*~?\s*[A-Z]\b)"
)
SOUGHT_KINDS = {"S": "section", "§": "section", "F": "figure", "T": "table", "A": "appendix"}
#: What a text that names a section by its title holds.
NAMING = r"\s[sS](?i:ection)\b"
ENVIRONMENTS = {"figure": "figure", "table": "table", "equation": "equation", "align": "equation", "algorithm": "algorithm", "theorem": "theorem", "lemma": "theorem"}


def _holding(text: Column, literal: str, body: Callable[[Column], Column]) -> Column:
    """body of the texts that hold the literal, the others as they are: a search for bytes is cheap beside a pattern."""
    return where(text, lambda t: t.contains(literal), body)


def without_comments(tex: Column) -> Column:
    """Without comment environments, comments and \\iffalse blocks, in this order; lines that are only a comment vanish, escaped percent signs stay.

    A percent sign without a backslash before it is looked for by itself; the pattern that counts backslashes is for texts with two of them before one."""
    tex = _holding(tex, "\\begin{comment}", lambda t: F.regexp_replace(t, r"(?s)\\begin\{comment\}.*?\\end\{comment\}", ""))
    tex = _holding(tex, "%", lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)^[ \t]*%[^\n]*(?:\n|\z)", ""), r"%(?<!\\%)[^\n]*", ""))
    tex = _holding(tex, "\\\\%", lambda t: F.regexp_replace(t, r"(?m)(?<!\\)((?:\\\\)*)%[^\n]*", "$1"))
    return _holding(tex, "\\iffalse", lambda t: F.regexp_replace(t, r"(?s)\\iffalse\b.*?\\fi\b", ""))


def body(tex: Column) -> Column:
    """Between the document's begin and the first back matter or end."""
    begin = "\\begin{document}"
    inner = _holding(tex, begin, lambda t: F.substring(t, F.locate(begin, t) + len(begin), F.length(t)))
    return F.get(F.split(inner, BACK_MATTER.replace("(?:", r"(?:(?-i:end\{document\})|", 1), 2), F.lit(0))


def _cut(text: Column) -> Column:
    """The text in pieces, each but the first beginning with a section's command; a mark is set before the commands where the text does not hold it already."""
    rest = r"(?=\*?\s*(?:\[[^\]]*\])?\{)"
    marked = F.split(F.regexp_replace(text, r"\\section" + rest, "\0\\\\section"), "\0")
    return F.when(text.contains("\0"), F.split(text, r"(?=\\section\*?\s*(?:\[[^\]]*\])?\{)")).otherwise(marked)


def sections(papers: DataFrame) -> DataFrame:
    """(doc_id, sec, title, starred, kind, raw) of papers (doc_id, tex): the abstract is section 0; statements are left out before numbering."""
    return plain_sections(uncommented(papers))


def uncommented(papers: DataFrame) -> DataFrame:
    """(doc_id, tex): papers without comments, for plain_sections and plain_appendix_labels."""
    return papers.select("doc_id", without_comments(F.col("tex")).alias("tex"))


def plain_sections(papers: DataFrame) -> DataFrame:
    """sections of papers without comments.

    A paper's sections are numbered within its row, so their texts are not shuffled."""
    return _numbered(papers.select("doc_id", _parts(F.col("tex")).alias("parts")))


def _parts(tex: Column) -> Column:
    """(title, starred, kind, raw) structs of a paper without comments: the abstract and its sections."""
    head = r"(?s)^\\section(\*?)\s*(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"
    part = lambda title, starred, kind, raw: F.struct(title.alias("title"), starred.alias("starred"), F.lit(kind).alias("kind"), raw.alias("raw"))
    opened = lambda p: bound(F.regexp_extract(p, head, 0), lambda h: part(F.regexp_extract(h, head, 2), F.regexp_extract(h, head, 1) == "*", "body", F.substring(p, F.length(h) + 1, F.length(p))))

    def every(t: Column) -> Column:
        abstract = part(F.lit("Abstract"), F.lit(False), "abstract", F.regexp_extract(t, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", 1))
        found = F.transform(F.filter(_cut(t), lambda p: p.startswith("\\section")), opened)
        return F.concat(F.array(abstract), F.filter(found, lambda s: ~s["title"].rlike(STATEMENTS)))

    return bound(body(tex), every)


def _numbered(rows: DataFrame) -> DataFrame:
    """The sections of rows (parts, ...), which keep their other columns. Parts are numbered before they become rows: of a bare column Spark would first ask for its size, and read the paper again for it."""
    others = [c for c in rows.columns if c != "parts"]
    numbered = F.transform("parts", lambda s, i: F.struct(i.alias("sec"), s["title"].alias("title"), s["starred"].alias("starred"), s["kind"].alias("kind"), s["raw"].alias("raw")))
    return rows.select(*others, F.explode(F.filter(numbered, lambda s: (s["sec"] > 0) | (s["raw"] != ""))).alias("s")).select(*others, "s.*")


def numbers(found: DataFrame) -> DataFrame:
    """(doc_id, sec, number): printed numbers, which pass over starred sections and the abstract."""
    plain = F.sum(F.when((F.col("kind") == "body") & ~F.col("starred"), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("sec"))
    return found.select("doc_id", "sec", F.when((F.col("kind") == "body") & ~F.col("starred"), plain.cast("string")).alias("number"))


def roles(found: DataFrame) -> DataFrame:
    """(doc_id, sec, role): the introduction is the first section called so, else the first; related work by its title."""
    intro = found.filter("kind = 'body'").groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.lower("title").contains("intro"), F.col("sec"))), F.min("sec")).alias("sec"))
    related = found.filter("kind = 'body'").filter(F.col("title").rlike(RELATED)).join(intro, ["doc_id", "sec"], "left_anti")
    return intro.withColumn("role", F.lit("intro")).unionByName(related.select("doc_id", "sec", F.lit("related").alias("role")))


def prose(raw: Column) -> Column:
    """Running text with stand-ins for citations (which keep their keys), formulas and references."""
    t = F.regexp_replace(raw, r"(?s)\\begin\{(figure|table|equation|align|algorithm|tabular|lstlisting|verbatim)\*?\}.*?\\end\{\1\*?\}", " ")
    t = F.regexp_replace(t, r"\\[cC]ite[a-zA-Z]*\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^}]*)\}", "⟦c:$1⟧")
    t = F.regexp_replace(t, r"\\(?:eq|auto|c|C|page|name)?ref\*?\{[^}]*\}", "[ref]")
    t = where(t, lambda t: t.contains("$") | t.contains("\\[") | t.contains("\\("), lambda t: F.regexp_replace(t, r"(?s)\$\$.*?\$\$|\\\[.*?\\\]|\$[^$]*\$|\\\(.*?\\\)", "[math]"))
    t = F.regexp_replace(t, r"\\(?:label\{[^}]*\}|(?:begin|end)\{[^}]*\}|(?:vspace|hspace)\*?\{[^}]*\})", " ")
    t = F.regexp_replace(t, r"\\(?:([%&#_$])|[a-zA-Z]+\*?\s?)", "$1")
    for mark, plain in (("``", '"'), ("''", '"'), ("{", " "), ("}", " "), ("~", " ")):
        t = F.replace(t, F.lit(mark), F.lit(plain))
    return t


def sentences(found: DataFrame) -> DataFrame:
    """(doc_id, sec, sent, text, cites, words): cites holds one key group for each stand-in of a citation."""
    cut = found.select("doc_id", "sec", F.posexplode(split_sentences(prose(F.col("raw")))).alias("sent", "marked"))
    groups = F.transform(F.regexp_extract_all("marked", F.lit("⟦c:([^⟧]*)⟧"), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda k: F.trim(k)))
    groups = F.when(F.col("marked").contains("⟦"), groups).otherwise(F.array().cast("array<array<string>>"))
    text = _holding(F.col("marked"), "⟦", lambda t: F.regexp_replace(t, "⟦c:[^⟧]*⟧", "[cite]"))
    out = cut.select("doc_id", "sec", "sent", text.alias("text"), groups.alias("cites"))
    rest = F.trim(F.regexp_replace("text", r"\[(cite|math|ref)\]|[\s.,;:!?()\"]", ""))
    said = F.col("text").rlike(r"^[A-Za-z0-9]{2}|[^\[A-Za-z][A-Za-z0-9]{2}") | (F.length(rest) >= 2)  # two letters that no stand-in holds, as nearly all sentences have
    return out.filter(said).withColumn("words", tokens(F.col("text")))


def objects(found: DataFrame) -> DataFrame:
    """(doc_id, id, kind, home, alias, caption): sections, and labelled figures, tables, equations, algorithms and theorems, one row per label."""
    return placed_objects(found).drop("at")


def placed_objects(found: DataFrame) -> DataFrame:
    """objects with `at`, the character of the section's source, from 1, where the label of a figure or the like first stands; null for sections."""
    section = F.struct("sec", "title", "kind", "raw")
    return found.select("doc_id", F.explode(_things(section)).alias("o")).select("doc_id", "o.*")


def _things(section: Column) -> Column:
    """(id, kind, home, alias, caption, at) structs of a section (sec, title, kind, raw)."""
    names = "|".join(ENVIRONMENTS)
    block = rf"(?s)\\begin\{{(?:{names})\*?\}}.*?\\end\{{(?:{names})\*?\}}"
    kinds = F.create_map(*[F.lit(x) for pair in ENVIRONMENTS.items() for x in pair])
    raw = section["raw"]
    thing = lambda id, kind, alias, caption, at: F.struct(id.alias("id"), kind.alias("kind"), section["sec"].alias("home"), alias.alias("alias"), caption.alias("caption"), at.alias("at"))
    head = thing(F.concat(F.lit("sec:"), section["sec"].cast("string")), F.lit("section"), F.regexp_extract(raw, r"^\s*\\label\{([^}]*)\}", 1), section["title"], F.lit(None).cast("int"))

    def labelled(e: Column) -> Column:
        kind, caption = F.element_at(kinds, F.regexp_extract(e, r"^\\begin\{([a-z]+)", 1)), F.regexp_extract(e, r"(?s)\\caption(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", 1)
        place = lambda alias: F.instr(raw, F.concat(F.lit("\\label{"), alias, F.lit("}")))
        aliases = F.regexp_extract_all(e, F.lit(r"\\label\{([^}]*)\}"), F.lit(1))
        return bound(F.struct(kind.alias("kind"), caption.alias("caption")), lambda k: F.transform(aliases, lambda a: thing(a, k["kind"], a, k["caption"], place(a))))

    heads = F.filter(F.array(head), lambda _: section["kind"] == "body")
    return F.concat(heads, F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(block), F.lit(0)), labelled)))


def object_numbers(found: DataFrame, things: DataFrame) -> DataFrame:
    """(doc_id, kind, number, id) of sections and their placed objects: printed numbers of sections, and of figures and tables, which are counted through the paper in the order of sections and places."""
    heads = numbers(found).filter("number is not null").select("doc_id", F.lit("section").alias("kind"), "number", F.concat(F.lit("sec:"), F.col("sec").cast("string")).alias("id"))
    floats = things.filter(F.col("kind").isin("figure", "table"))
    return heads.unionByName(running_numbers(floats, "at").select("doc_id", "kind", F.col("number").cast("string").alias("number"), "id"))


def running_numbers(floats: DataFrame, at: str) -> DataFrame:
    """floats (doc_id, home, kind, ...) with their number within the paper and kind, in the order of sections and places."""
    return floats.withColumn("number", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("home", at)))


def _printed(raw: Column) -> Column:
    """(at, said, kind, number) structs of the printed references of a text."""
    kinds = F.create_map(*[F.lit(x) for pair in SOUGHT_KINDS.items() for x in pair])

    def read(s: Column) -> Column:
        kind = F.element_at(kinds, F.substring(s["match"], 1, 1))
        number = F.when(kind == "appendix", F.right(s["match"], F.lit(1))).otherwise(F.regexp_extract(s["match"], r"\d+", 0))
        return F.struct(s["at"].alias("at"), s["match"].alias("said"), kind.alias("kind"), number.alias("number"))

    return F.transform(match_spans(raw, SOUGHT), read)


def printed_references(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc_id, src, target, at, said) of texts (doc_id, src, raw): numbers that are printed after Section, Figure or Table and stand for an object of kinds (doc_id, kind, number, id), and appendix letters; `at` is the character where `said` begins."""

    each = texts.select("doc_id", "src", F.explode(_printed(F.col("raw"))).alias("s")).select("doc_id", "src", "s.*")
    target = F.when(F.col("kind") == "appendix", F.concat(F.lit("appendix:"), F.col("number"))).otherwise(F.col("id"))
    known = kinds.filter("kind <> 'appendix'").select("doc_id", "kind", "number", "id")
    return each.join(known, ["doc_id", "kind", "number"], "left").select("doc_id", "src", target.alias("target"), "at", "said").filter("target is not null")


def _key(kind: Column, number: Column) -> Column:
    return F.concat(kind, F.lit(" "), number)


def _by_key(pairs: Column) -> Column:
    """A map from each key of (key, id) structs to its ids."""
    keys = F.array_distinct(pairs["key"])
    several = F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["id"]))
    single = F.transform(pairs["id"], lambda i: F.array(i))
    return F.map_from_arrays(keys, F.when(F.size(keys) == F.size(pairs), single).otherwise(several))


def listed_targets(texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc_id, src, kind, number, target) of texts (doc_id, src, raw): printed references with lists of numbers that stand for an object of kinds (doc_id, kind, number, id), a subsection without one for its section, and lettered appendices."""
    # The objects of a document come to its texts as one map, so that texts and objects dealt by document are not shuffled by kind and number, once for each join.
    pairs = kinds.filter("kind is not null and number is not null and id is not null").groupBy("doc_id").agg(F.collect_list(F.struct(_key(F.col("kind"), F.col("number")).alias("key"), "id")).alias("pairs"))
    known = pairs.select("doc_id", _by_key(F.col("pairs")).alias("known"))
    each = texts.join(known, "doc_id", "left").select("doc_id", "src", "known", F.explode(listed_references(F.col("raw"))).alias("r"))
    kind, number = F.col("r.kind"), F.col("r.number")
    whole = F.when(kind == "section", F.element_at("known", _key(kind, F.substring_index(number, ".", 1))))
    target = F.when(kind == "appendix", F.array(F.concat(F.lit("appendix:"), number))).otherwise(F.coalesce(F.element_at("known", _key(kind, number)), whole))
    return each.select("doc_id", "src", kind.alias("kind"), number.alias("number"), F.explode(target).alias("target"))


def title_mentions(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc_id, src, target, at, said): other sections named by their title, of six characters or more, and the word section; an equality join by document, then a test of each title.

    Only titles that stand in a text, whatever the case of A to Z, are sought by their pattern, and only in texts with the word section behind white space."""
    titles = heads.groupBy("doc_id").agg(_titles(F.collect_list(F.struct("sec", "title"))).alias("titles"))
    held = texts.filter(F.col("raw").rlike(NAMING)).join(titles, "doc_id")
    return held.select("doc_id", "src", F.explode(_named(F.col("src"), F.col("raw"), F.col("titles"))).alias("s")).select("doc_id", "src", "s.*")


def _lower(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def _titles(heads: Column) -> Column:
    """(sec, title, low) structs of the sections (sec, title) with a title of six characters or more."""
    bare = F.filter(F.transform(heads, lambda h: F.struct(h["sec"].alias("sec"), F.trim(h["title"]).alias("title"))), lambda h: F.length(h["title"]) >= 6)
    return F.transform(bare, lambda h: F.struct(h["sec"].alias("sec"), h["title"].alias("title"), _lower(h["title"]).alias("low")))


def _named(src: Column, raw: Column, titles: Column) -> Column:
    """(target, at, said) structs of a text that names sections of _titles."""

    def mentions(t: Column) -> Column:
        pattern = F.concat(F.lit("(?i)\\b(?:the\\s+)?[“\"']?\\Q"), t["title"], F.lit("\\E[”\"']?\\s+section\\b"))
        target = F.concat(F.lit("sec:"), t["sec"].cast("string"))
        return F.transform(match_spans(raw, pattern), lambda s: F.struct(target.alias("target"), s["at"].alias("at"), s["match"].alias("said")))

    held = bound(_lower(raw), lambda low: F.filter(titles, lambda t: (t["sec"] != src) & F.contains(low, t["low"])))
    return F.flatten(F.transform(held, mentions))


def _labelled(raw: Column) -> Column:
    """(at, alias) structs of the references by label of a text; several labels of one reference stand at one place."""

    def read(s: Column) -> Column:
        labels = F.concat(F.regexp_extract(s["match"], REFERENCE, 1), F.regexp_extract(s["match"], REFERENCE, 2))
        return F.transform(F.split(labels, ","), lambda k: F.struct(s["at"].alias("at"), F.trim(k).alias("alias")))

    return F.filter(F.flatten(F.transform(match_spans(raw, REFERENCE), read)), lambda r: r["alias"] != "")


def appendix_labels(papers: DataFrame) -> DataFrame:
    """(doc_id, alias): labels that stand behind the beginning of the appendix."""
    return plain_appendix_labels(uncommented(papers))


def plain_appendix_labels(papers: DataFrame) -> DataFrame:
    """appendix_labels of papers without comments."""
    return papers.select("doc_id", F.explode(_appendix(F.col("tex"))).alias("alias"))


def _appendix(tex: Column) -> Column:
    """The labels behind the beginning of the appendix; only what stands behind its first mention is searched for it."""
    behind = F.substring(tex, F.locate("\\appendix", tex), F.length(tex))
    labels = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"\\label\{([^}]*)\}"), F.lit(1)))
    return F.when(F.contains(tex, F.lit("\\appendix")), F.coalesce(labels(F.get(F.split(behind, r"\\appendix\b", 2), F.lit(1))), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def pointers(papers: DataFrame, found: DataFrame, things: DataFrame) -> DataFrame:
    """(doc_id, src, target, via, at, pos) of papers, their sections and objects: references by label, by printed number and by title; what resolves nowhere is left out.

    `at` is the character of the section's source where a reference begins, and pos numbers the pointers of a section in this order; at one place, sections come last and others by their name."""
    if "at" not in things.columns:
        things = placed_objects(found)
    back = appendix_labels(papers).groupBy("doc_id").agg(F.collect_list("alias").alias("back"))
    objects = things.groupBy("doc_id").agg(F.collect_list(F.struct("id", "kind", "home", "alias", "at")).alias("objects"))
    titles = found.filter("kind = 'body'").groupBy("doc_id").agg(_titles(F.collect_list(F.struct("sec", "title"))).alias("titles"))
    secs = _referring(found.join(titles, "doc_id", "left")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec", "kind", "starred", "labelled", "printed", "named"))).alias("secs"))
    rows = secs.join(objects, "doc_id", "left").join(back, "doc_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return pointer_rows(_pointing(rows.select("doc_id", "secs", none("objects"), none("back"))))


def read_papers(papers: DataFrame) -> DataFrame:
    """(doc_id, sections, objects, pointers): the sections (sec, kind), placed_objects and pointers of each paper (doc_id, tex) as arrays.

    Papers dealt by document are not shuffled, and texts are not stored: sections are read in one pass, and what refers to each other meets in the paper's row."""
    cut = uncommented(papers).select("doc_id", _appendix(F.col("tex")).alias("back"), _parts(F.col("tex")).alias("parts"))
    heads = F.filter(F.transform("parts", lambda s, i: F.struct(i.alias("sec"), s["title"].alias("title"))), lambda s: s["sec"] > 0)
    found = _numbered(cut.select("doc_id", "back", _titles(heads).alias("titles"), "parts"))
    read = _referring(found).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec", "kind", "starred", "labelled", "printed", "named", "things"))).alias("secs"), F.first("back").alias("back"))
    rows = _pointing(read.withColumn("objects", F.flatten(F.transform("secs", lambda s: s["things"]))))
    return rows.select("doc_id", F.transform("secs", lambda s: F.struct(s["sec"].alias("sec"), s["kind"].alias("kind"))).alias("sections"), "objects", "pointers")


def pointer_rows(read: DataFrame) -> DataFrame:
    """(doc_id, src, target, via, at, pos) of read_papers. The structs are made anew, since of a bare column Spark would first ask for its size, and so find the pointers twice."""
    names = ("src", "target", "via", "at", "pos")
    return read.select("doc_id", F.inline(F.transform("pointers", lambda p: F.struct(*(p[n].alias(n) for n in names)))))


def _referring(found: DataFrame) -> DataFrame:
    """found with the references of each section in place of its text, by label, printed and by the titles of its paper's sections, and its objects."""
    raw = F.col("raw")
    named = F.when(raw.rlike(NAMING), _named(F.col("sec"), raw, F.col("titles")))
    columns = {"labelled": _labelled(raw), "printed": _printed(raw), "named": F.coalesce(named, F.array().cast("array<struct<target:string,at:int,said:string>>")), "things": _things(F.struct("sec", "title", "kind", "raw"))}
    return found.select(*(c for c in found.columns if c not in ("title", "raw", "titles")), *(column.alias(name) for name, column in columns.items()))


def _pointing(rows: DataFrame) -> DataFrame:
    """rows (doc_id, secs, objects, back) with the pointers of a paper, (src, target, via, at, pos) structs, and without `back`, the labels of the appendix; secs are in order."""
    printed = F.filter("secs", lambda s: (s["kind"] == "body") & ~s["starred"])
    entry = lambda kind, number, id: F.struct(_key(F.lit(kind), number.cast("string")).alias("key"), id.alias("id"))
    counted = [F.transform(printed, lambda s, i: entry("section", i + 1, F.concat(F.lit("sec:"), s["sec"].cast("string"))))]
    for kind in ("figure", "table"):
        floats = F.transform(F.filter("objects", lambda o: o["kind"] == kind), lambda o: F.struct(o["home"].alias("home"), o["at"].alias("at"), o["id"].alias("id")))  # noqa: B023
        counted.append(F.transform(F.array_sort(floats), lambda o, i: entry(kind, i + 1, o["id"])))  # noqa: B023
    aliases = F.array_distinct(F.transform(F.filter("objects", lambda o: o["alias"] != ""), lambda o: F.struct(o["alias"].alias("key"), o["id"].alias("id"))))
    pairs = rows.withColumns({"_numbers": F.concat(*counted), "_labels": aliases})
    known = F.struct(_by_key(F.col("_numbers")).alias("numbers"), _by_key(F.col("_labels")).alias("labels"))
    pointer = lambda at, target, via, said: F.struct(at.alias("at"), target.startswith("sec:").alias("last"), target.alias("target"), F.lit(via).alias("via"), said.alias("said"))
    none = F.array().cast("array<string>")

    def labelled(k: Column, r: Column) -> Column:
        ids = F.try_element_at(k["labels"], r["alias"])
        return F.transform(F.coalesce(ids, F.when(F.array_contains("back", r["alias"]), F.array(F.concat(F.lit("appendix:"), r["alias"]))), none), lambda i: pointer(r["at"], i, "ref", r["alias"]))

    def numbered(k: Column, r: Column) -> Column:
        ids = F.when(r["kind"] == "appendix", F.array(F.concat(F.lit("appendix:"), r["number"]))).otherwise(F.try_element_at(k["numbers"], _key(r["kind"], r["number"])))
        return F.transform(F.coalesce(ids, none), lambda i: pointer(r["at"], i, "number", r["said"]))

    def of(k: Column, s: Column) -> Column:
        every = F.concat(F.flatten(F.transform(s["labelled"], lambda r: labelled(k, r))), F.flatten(F.transform(s["printed"], lambda r: numbered(k, r))), F.transform(s["named"], lambda r: pointer(r["at"], r["target"], "name", r["said"])))
        return F.transform(F.array_sort(every), lambda p, i: F.struct(s["sec"].alias("src"), p["target"].alias("target"), p["via"].alias("via"), p["at"].alias("at"), i.alias("pos")))

    # The maps are bound: a column that stands once in a lambda would be made again for each reference.
    return pairs.withColumn("pointers", bound(known, lambda k: F.flatten(F.transform("secs", lambda s: of(k, s))))).drop("_numbers", "_labels", "back")


def numeric(cell: Column) -> Column:
    """True for a cell that holds a number, whatever its formula marks, brackets, unit or spread. A cell without a digit holds none, and one of digits, stops and blanks is read as it stands."""

    def bare(cell: Column) -> Column:
        plain = F.replace(F.regexp_replace(cell, r"\\(?:textbf|textit|mathbf|underline|emph)\b|[{}$]|\[math\]", ""), F.lit("\\pm"), F.lit("±"))
        return F.regexp_replace(F.regexp_replace(plain, r"\\([%&#_])", "$1"), r"\s+", " ")

    return bound(cell, lambda c: c.rlike("[0-9]") & F.trim(where(c, lambda t: t.rlike("[^0-9. ]|  "), bare)).rlike(NUMERIC_CELL))


def tables(found: DataFrame) -> DataFrame:
    """(doc_id, home, data_rows, numeric_cells) of each tabular: rows with a number, and numbers; of several rows the first is the header."""
    cells = found.select("doc_id", F.col("sec").alias("home"), F.posexplode(F.regexp_extract_all("raw", F.lit(r"(?s)\\begin\{tabular[x*]?\}(?:\{[^}]*\})*(.*?)\\end\{tabular"), F.lit(1))).alias("t", "b"))
    rules = r"\\(?:" + "|".join(rule.removeprefix(r"\\") for rule in TABLE_RULES) + ")"
    rows = F.split(F.regexp_replace("b", rules, " "), r"\\(?:\\(?:\s*\[[^\]]*\])?|tabularnewline)")
    data = F.when(F.size("r") > 1, F.slice("r", 2, F.size("r"))).otherwise(F.col("r"))
    counts = F.transform("d", lambda r: F.size(F.filter(F.split(r, r"&(?<!\\&)"), numeric)))
    return cells.withColumn("r", rows).withColumn("d", data).withColumn("n", counts).select("doc_id", "home", F.size(F.filter("n", lambda n: n > 0)).alias("data_rows"), F.aggregate("n", F.lit(0), lambda a, n: a + n).alias("numeric_cells"))


def exhibits(found: DataFrame) -> DataFrame:
    """(doc_id, kind): captions that announce an example, listings and boxes (those that are named for an exhibit or hold a marker of input or output), and quotations of twenty words or more outside related work."""
    captions = objects(found).filter(F.col("kind").isin("figure", "table") & F.col("caption").rlike(EXHIBIT_CAPTIONS)).select("doc_id", F.lit("caption").alias("kind"))
    env = found.select("doc_id", "raw", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\\begin\{([A-Za-z]+)\*?\}"), F.lit(1)))).alias("env"))
    boxes = env.filter(F.col("env").rlike(EXHIBIT_ENVIRONMENTS) | (F.col("env").rlike(BOXES) & F.col("raw").rlike(IO_MARKERS))).select("doc_id", F.lit("environment").alias("kind"))
    outside = found.join(roles(found).filter("role = 'related'"), ["doc_id", "sec"], "left_anti")
    marked = F.lit(False)
    for mark in "“\"`'":  # of which every quotation begins with one in the source
        marked = marked | F.col("raw").contains(mark)
    quotes = outside.filter(marked).select("doc_id", F.explode(F.regexp_extract_all(prose(F.col("raw")), F.lit(r"(?s)[“\"]([^”\"]{60,1200})[”\"]"), F.lit(1))).alias("q"))
    return captions.unionByName(boxes).unionByName(quotes.filter(F.size(F.split(F.trim("q"), r"\s+")) >= 20).select("doc_id", F.lit("quotation").alias("kind")))


def acknowledged(sents: DataFrame) -> DataFrame:
    """(doc_id, acknowledged): whether the sentences (doc_id, text) of a paper say that no single case is shown."""
    return sents.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("text").rlike(ACKNOWLEDGED_GAP), F.lit(False))).alias("acknowledged"))


def acknowledged_in(found: DataFrame) -> DataFrame:
    """acknowledged of the papers' sections, each paper with a row: only prose in which the words of a gap stand together, across sentences or not, is cut into sentences."""
    loose = ACKNOWLEDGED_GAP.replace(" ", r"\s+")
    said = lambda text: F.exists(split_sentences(text), lambda s: F.regexp_replace(s, "⟦c:[^⟧]*⟧", "[cite]").rlike(ACKNOWLEDGED_GAP))
    gaps = bound(prose(F.col("raw")), lambda t: F.when(t.rlike(loose), said(t)).otherwise(F.lit(False)))
    # Every gap has one of these words, which stands in the source as it is, unless a command inside of it is dropped.
    low = lambda word: F.lower("raw").contains(word)
    maybe = low("individual") | low("concrete") | low("specific") | low("aggregate") | F.col("raw").rlike(r"\\(?<=[A-Za-z]\\)[a-zA-Z]")
    gaps = F.when(maybe, gaps).otherwise(F.lit(False))
    return found.select("doc_id", gaps.alias("gap")).groupBy("doc_id").agg(F.bool_or(F.coalesce("gap", F.lit(False))).alias("acknowledged"))


def work_names(bib: DataFrame) -> DataFrame:
    """(doc_id, cite_key, name) of bibliographies (doc_id, bib): a title's head of one to three words with an inner capital, and the first author's name with et al."""
    entries = bib.select("doc_id", F.explode(F.split("bib", r"(?m)^(?=@)")).alias("e")).filter(F.col("e").rlike(r"^@\w+\s*\{"))
    entries = entries.select("doc_id", F.regexp_extract("e", r"^@\w+\s*\{\s*([^,\s]+)", 1).alias("cite_key"), F.regexp_extract("e", r"(?is)\btitle\s*=\s*[{\"](.*?)[}\"]\s*,?\s*\n", 1).alias("title"), F.regexp_extract("e", r"(?is)\bauthor\s*=\s*[{\"](.*?)[}\"]\s*,?\s*\n", 1).alias("author"))
    head = F.trim(F.translate(F.regexp_extract("title", r"^([^:]+):", 1), "{}", ""))
    short = F.when(F.size(F.split(head, r"\s+")).between(1, 3) & head.rlike(r"\w[A-Z]"), head)
    surname = F.regexp_extract("author", r"^\s*([^,]+?)(?:,|\s+and\b|$)", 1)
    named = F.when(surname != "", F.concat(F.regexp_extract(surname, r"(\S+)$", 1), F.lit(" et al")))
    return entries.select("doc_id", "cite_key", F.explode(F.array_compact(F.array(short, named))).alias("name"))
