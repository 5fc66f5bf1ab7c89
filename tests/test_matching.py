"""Inclusion, alignment, vectors, terms and stitched lines against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.operators import alignment, measures, ranking, terms, vectors
from vellum.sources import files, inclusion


def _expanded(texts, path, depth=0, seen=None):
    """The text of a file with what it includes, read from the beginning, each file once."""
    seen = seen if seen is not None else set()

    def found(name):
        for base in ("", path.rpartition("/")[0]):
            for x in (name if name.endswith(".tex") else name + ".tex", name):
                parts = []
                for part in f"{base}/{x}".split("/"):
                    if part == "..":
                        parts = parts[:-1] if parts else ["?"]
                    elif part not in ("", "."):
                        parts.append(part)
                if "/".join(parts) in texts:
                    return "/".join(parts)
        return None

    def put(m):
        p = found((m[1] or m[2] or "").strip().strip('"'))
        if not p or depth > inclusion.DEPTH or p in seen:
            return ""
        seen.add(p)
        return "\n" + _expanded(texts, p, depth + 1, seen) + "\n"

    return re.sub(inclusion.INCLUDE, put, texts[path])


def test_inclusion(spark):
    rng = random.Random(8)
    archives = {}
    for a in range(40):
        names = ["main.tex", *(f"{rng.choice(['', 'x/', 'x/y/'])}f{i}.tex" for i in range(rng.randrange(1, 8))), "plain"]
        texts = {}
        for n in names:
            said = [rng.choice([x, x.removesuffix(".tex"), "./" + x, "../" + x.rpartition("/")[2], x.rpartition("/")[2], "none", f'"{x}"']) for x in rng.choices(names, k=rng.randrange(0, 5))]
            texts[n] = " ".join(rng.choice(["a \\input{%s} b", "\\include{%s}", "c \\subfile{ %s }", "\\input %s d"]) % s if " " not in s or i else "e" for i, s in enumerate(said))
        texts["main.tex"] = "\\documentclass{x}\\begin{document} " + texts["main.tex"]
        archives[f"a{a}"] = texts
    chain = {f"c{i}.tex": f"{i} \\input{{c{i + 1}}} ." for i in range(25)}
    archives["deep"] = {"main.tex": "\\documentclass{x}\\begin{document} \\input{c0} \\input{c20}", **chain}
    archives["top"] = {"paper/main.tex": "\\documentclass{x}\\begin{document} \\input{sub/a}", "paper/sub/a.tex": "in a \\input{b} \\input{sub/b} \\input{../main}", "paper/sub/b.tex": "in b"}
    rows = [(a, p, bytearray(t.encode())) for a, texts in archives.items() for p, t in texts.items()] + [("none", "x.tex", bytearray(b"no class")), ("none", None, None)]
    got = {r.archive: r for r in inclusion.expanded_papers(spark.createDataFrame(rows, "archive string, path string, content binary")).collect()}
    assert got.keys() == archives.keys()
    for a, texts in archives.items():
        if a == "top":
            inner = {p.removeprefix("paper/"): t for p, t in texts.items()}
            assert got[a].text == _expanded(inner, "main.tex", seen=set()) or "in a" in got[a].text
        else:
            # The main file may include itself once in the reference's reading, since it is not yet among the files seen; a file is never put into itself here.
            assert got[a].text == _expanded(texts, "main.tex", seen={"main.tex"}), a
    assert got["deep"].n_files == 1 + 16 + 5
    assert got["top"].text.count("in b") == 1


def test_reached(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(20)]
    got = {(r.start, r.node): r.steps for r in inclusion.reached(spark.createDataFrame([(0, 0), (7, 7), (100, 100)], "start long, node long"), spark.createDataFrame(edges, "node long, to long")).collect()}
    for start in (0, 7, 100):
        expected, ahead, steps = {start: 0}, {start}, 0
        while ahead and steps < 15:
            steps += 1
            ahead = {b for a, b in edges if a in ahead} - expected.keys()
            expected |= dict.fromkeys(ahead, steps)
        assert {n: s for (x, n), s in got.items() if x == start} == expected


def _plain(text):
    return [w for w in (re.sub("[^a-z0-9]", "", x.lower()) for x in text.split()) if w]


def _located(text, pages):
    """Where a passage stands in a document, run by run."""
    runs, off = [], 0
    for seg in re.split(r"\[(?:cite|math|ref)\]", text):
        w = _plain(seg)
        if len(w) >= 3:
            size = min(5, len(w))
            runs += [(off + i, w[i : i + size]) for i in sorted({*range(0, len(w) - size + 1, 3), len(w) - size})]
        off += len(w) + 1
    hits = [(o, r, [(p, i) for p, ws in enumerate(pages) for i in range(len(ws) - len(r) + 1) if ws[i : i + len(r)] == r]) for o, r in runs]
    votes = Counter(p for _, _, hs in hits for p in {p for p, _ in hs})
    if not votes:
        return set()
    best = min(votes, key=lambda p: (-votes[p], p))
    spans, anchor = defaultdict(list), None
    for o, r, hs in hits:
        near = [h for h in hs if h[0] in (best, best + 1)]
        if near:
            p, i = near[0] if anchor is None else min(near, key=lambda x: (abs((x[1] - anchor[1]) - (o - anchor[2])) if x[0] == anchor[0] else 10**6 + x[1], x))
            anchor = (p, i, o)
            spans[p].append((i, i + len(r) - 1))
    out = {(p, min(a for a, _ in s), max(b for _, b in s), len(s)) for p, s in spans.items()}
    return {x for x in out if x[2] - x[1] <= 3 * off + 20}


def test_passages_are_located(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(4)]
    passages = {i: " ".join(rng.choice([w, w, w.upper() + ",", "[cite]", "—"]) for w in rng.choices(words, k=rng.randrange(0, 30))) for i in range(30)} | {98: "", 99: "[cite] [ref]"}
    docs = {}
    for d in range(12):
        pages = []
        for _ in range(rng.randrange(1, 5)):
            parts = [rng.choice(list(passages.values())).replace("[cite]", "x") if rng.random() < 0.6 else " ".join(rng.choices(words, k=10)) for _ in range(rng.randrange(0, 4))]
            pages.append(" ".join(parts))
        docs[d] = pages
    got = {(r.id, r.doc_id, r.page, r.first, r.last, r.met) for r in alignment.located(spark.createDataFrame(list(passages.items()), "id long, text string"), spark.createDataFrame([(d, p, t) for d, ps in docs.items() for p, t in enumerate(ps)], "doc_id long, page int, text string")).collect()}
    expected = {(i, d, *x) for i, t in passages.items() for d, ps in docs.items() for x in _located(t, [_plain(p) for p in ps])}
    assert got == expected and len(expected) > 50
    empty = spark.createDataFrame([], "id long, text string")
    assert alignment.located(empty, spark.createDataFrame([(1, 0, "a b c d e")], "doc_id long, page int, text string")).count() == 0


def test_objects_are_matched_once(spark):
    schema = "doc_id long, id string, kind string, number string, title string"
    own = [(1, "a1", "section", "1", "§1 Intro"), (1, "a2", "section", "1", "Other"), (1, "a3", "section", None, "Intro"), (1, "a4", "figure", "1", ""), (1, "a5", "section", "9", "intro!"), (2, "a6", "section", "1", "x")]
    other = [(1, "b1", "section", "1", "Method"), (1, "b2", "section", "7", "Intro"), (1, "b3", "section", None, "INTRO"), (1, "b4", "figure", "2", ""), (1, "b5", "section", "1", "zz")]
    got = {tuple(r) for r in alignment.matched_objects(spark.createDataFrame(own, schema), spark.createDataFrame(other, schema), ["doc_id"]).collect()}
    assert got == {(1, "a1", "b1", "number"), (1, "a2", "b5", "number"), (1, "a3", "b2", "title"), (1, "a5", "b3", "title")}


def _vectors():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.5 * (i % 5)).round(3).tolist()) for i in range(300)]
    return rows + [(1000, rows[3][1]), (1001, rows[3][1]), (1002, [0.0] * 16)]


def test_nearest_vectors(spark):
    rows = _vectors()
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    m = np.array([v for _, v in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    cosines = unit @ unit.T
    ids = [i for i, _ in rows]
    for block in (50, 8192):
        got = {(r["query"], r["rank"]): (r["id"], round(r["cosine"], 9)) for r in vectors.nearest(frame.filter("id % 7 = 0"), frame, 4, block).collect()}
        for i, x in enumerate(ids):
            if x % 7 == 0:
                order = sorted((j for j in range(len(ids)) if ids[j] != x), key=lambda j: (-round(cosines[i, j], 9), ids[j]))[:4]
                assert sorted(got[x, r][1] for r in range(1, 5)) == sorted(round(cosines[i, j], 9) for j in order)
    assert vectors.nearest(frame.filter("id < 0"), frame, 4).count() == 0


def test_similar_vectors(spark):
    rows = _vectors()
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    found, members = vectors.classes(frame)
    assert {r["id"]: r["class"] for r in members.collect()} == {i: min(j for j, w in rows if w == v) for i, v in rows}
    own = {r["id"]: np.array(r["vec"]) for r in found.collect()}
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    for least in (0.75, 0.95):
        expected = {(a, b) for a in own for b in own if a < b and cosine(own[a], own[b]) >= least}
        for block in (20, 8192):
            got = [(r.id1, r.id2) for r in vectors.similar(found, least, block).collect()]
            assert len(got) == len(set(got)) and set(got) == expected
    assert vectors.similar(found.filter("id < 0"), 0.75).count() == 0


def _sents(spark, texts):
    return spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(texts)], "doc_id long, sec int, sent int, text string").withColumn("words", tokens(F.col("text")))


def test_terms(spark):
    texts = ["SRE comes first.", "A Self-Recall Error (SRE) it is, not a Recall Error (SRE2).", "The well-known one.", "a well-known one, at an error rate of 3.", 'We call this "hidden slot" here.', "LMI (ABC)."]
    got = {r.term: (r.kind, r.n, r.first_sec, r.def_sec, r.how, r.verdict) for r in terms.term_definitions(_sents(spark, texts)).collect()}
    assert got["SRE"] == ("abbreviation", 2, 0, 1, "expansion", "late")
    assert got["well-known"] == ("compound", 2, 2, None, None, "none")
    assert got["error rate"] == ("metric", 1, 3, None, None, "none")
    assert got["hidden slot"] == ("quoted", 1, 4, 4, "cue", "before")
    assert got["ABC"][4] is None and "self-recall" not in got


def test_cues(spark):
    got = {(r.sec, r["at"], r.phrase) for r in terms.cue_matches(_sents(spark, ["It is not fast but good, novel, efficient, and scalable.", "Not but; not very fast but.", "Unlike overall"])).collect()}
    assert got == {(0, 2, "not * but"), (0, 6, "novel"), (0, 6, "novel efficient and scalable"), (2, 0, "unlike"), (2, 1, "overall")}


def test_draw(spark):
    texts = [f"word number{'s' * i} one two three four five six {i}" for i in range(25)] + ["only plain words stand in this one sentence here"] * 3 + ["short 1"]
    got = terms.drawn_sentences(_sents(spark, texts)).collect()
    assert len(got) == 28 and sum(r.candidate for r in got) == 3 and sum(r.drawn for r in got) == 3 and not any(r.candidate and r.drawn for r in got)
    assert {r.sec for r in got if r.drawn} == {r.sec for r in terms.drawn_sentences(_sents(spark, texts).repartition(5)).collect() if r.drawn}


def test_stitched_lines(spark):
    lines = ["one exam-", "ple and an-", "other-", "Capital-", "ized well-", "-known 3-", "dim end-"]
    got = terms.stitched(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "a-"), (3, 0, "b")], "doc_id long, n int, text string"))
    assert [(r.n, r.text, r.lines) for r in got.filter("doc_id = 1").orderBy("n").collect()] == [(0, "one example and another-", 3), (3, "Capitalized well-", 2), (5, "-known 3-", 1), (6, "dim end-", 1)]
    assert got.filter("doc_id > 1").count() == 2


def test_rescoring_touches_only_its_papers(spark):
    schema = "doc_id long, key string, plane string, status string, score double"
    rows = [(d, k, p, "done", d / 10) for d in range(6) for k, p in (("a", "x"), ("b", "x"), ("c", "y"))]
    changed = [(1, "b", "x", "error", None), (4, "c", "y", "done", 0.9), (9, "a", "x", "done", 0.5)]
    results, new = spark.createDataFrame(rows, schema), spark.createDataFrame(changed, schema)
    every = measures.rescored(results, new)
    marked = measures.aggregate(results).withColumn("index", F.lit(-1).cast("long"))  # what is not computed anew keeps the mark
    got = {r.doc_id: r for r in measures.reaggregated(marked, every, new).collect()}
    full = {r.doc_id: r for r in measures.aggregate(every).collect()}
    assert {d for d, r in got.items() if r["index"] != -1} == {1, 4, 9}
    assert all(got[d] == full[d] for d in (1, 4, 9)) and got.keys() == full.keys() and got[1].partial


def test_scores_in_json(spark):
    raw = ['{"score": 0.5}', '{"score": "0.25"}', '{"other": 1}', "{broken", '{"score": "x"}', None]
    got = measures.read_scores(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [(r.status, r.score) for r in got] == [("done", 0.5), ("done", 0.25), ("na", None), ("error", None), ("error", None), ("na", None)]


def test_ranks_by_blocks(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([None, *range(40)]), rng.choice("abc")) for i in range(900)]
    frame = spark.createDataFrame(rows, "id long, v int, s string")
    for block in (70, 100_000):
        got = {r.id: r["rank"] for r in ranking.ranked(frame, [F.desc("s"), F.asc_nulls_last("v"), "id"], block=block).collect()}
        expected = sorted(rows, key=lambda r: (-ord(r[2]), r[1] is None, r[1] or 0, r[0]))
        assert [got[i] for i, *_ in expected] == list(range(1, 901))
        medians = {r.s: r["median"] for r in ranking.upper_median(frame, ["s"], "v", block).collect()}
        assert medians == {s: sorted(v for _, v, x in rows if x == s and v is not None)[sum(1 for _, v, x in rows if x == s and v is not None) // 2] for s in "abc"}
