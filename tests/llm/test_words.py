"""Spelling variants, source divergence and license scans against brute force and SQL, on small tables with every odd row."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
import regex
from compare import DATA, rows

from vellum.llm import license_scan, registry, source_divergence, spelling_variants

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, z string"


def _docs(spark, texts, langs=("en",), sources=("a",)):
    out = [(i, t, langs[i % len(langs)], sources[i % len(sources)], "clash", 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(out, SCHEMA) if out else spark.createDataFrame([], SCHEMA)


# Spelling variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _variants_by_force(rows_, every=199, least_count=5):
    counts = Counter()
    for i, text, *_ in rows_:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    form, n_near = {}, {}
    for w, n in kept.items():
        others = [x for x in kept if _near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-kept[x], x), default=None)
        form[w] = best if best and kept[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, n_near[w], kept.get(form[w])) for w, n in kept.items()}


def _misspelt(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcé") + word[i:], word[:i] + rng.choice("abcß") + word[i + 1 :]])


@pytest.mark.parametrize("block", [5000, 3])
def test_spelling_variants(spark, block, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    rng = random.Random(3)
    base = ["".join(rng.choices("abc", k=rng.randrange(5, 10))) for _ in range(60)] + ["committee", "comittee", "commitee", "aaaaaa", "aaaaaaa", "aaaaaaaa", "façades", "facades", "×÷×÷×÷"]
    pool = base * 30 + [_misspelt(rng, w) for w in base for _ in range(3)] * 5 + [_misspelt(rng, _misspelt(rng, w)) for w in base] * 5 + ["quizzing"] * 900 + ["quizzin"] * 90 + ["quizzi"] * 9
    rng.shuffle(pool)
    texts = [rng.choice([" ", "7", "\n", "ā"]).join(pool[i : i + 40]) for i in range(0, len(pool), 40)]
    texts = [t.upper() if i % 7 == 0 else t for i, t in enumerate(texts)] + [None, "", "  ", "a", "committee " * 20]
    docs = _docs(spark, texts)
    given = [tuple(r) for r in docs.collect()]
    given += [given[0], given[-1], (None, "committee comittee " * 9, None, None, None, None, None)]
    docs = spark.createDataFrame(given, SCHEMA)
    for every in (199, 7):
        got = [tuple(r) for r in spelling_variants.variants(spelling_variants.words(docs, every=every)).collect()]
        expected = _variants_by_force(given, every)
        assert len(got) == len(set(got)) == len(expected) > 100
        assert set(got) == expected
        assert every != 199 or any(r[1] and r[2] != r[1] for r in got), "no chain of two forms"


def test_spelling_variants_of_nothing(spark):
    assert spelling_variants.variants(spelling_variants.words(_docs(spark, []))).count() == 0
    assert spelling_variants.variants(spelling_variants.words(_docs(spark, [None, "", "short words only"]))).count() == 0


def test_long_texts_are_cut_between_runs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(1, 12))) for _ in range(400)]
    text = " ".join(rng.choices(words, k=40_000)) + " " + "q" * 150_000 + "\n" + "\n" * 70_000 + "longer longer longer longer longer"
    given = [(1, text, None, None, None, None, None)]
    got = {r.word: r.n for r in spelling_variants.words(spark.createDataFrame(given, SCHEMA)).collect()}
    assert got == {w: n for w, _, _, n, _, _ in _variants_by_force(given)}


def test_automaton_numbers_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("ab", k=rng.randrange(0, 7))) for _ in range(80)})
    automaton = spelling_variants.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("bbbbbbbbb") == -1
    plain = sum(len(w) for w in words)
    assert len(automaton.states) < plain / 3
    for w in words:
        expected = [i for i, x in enumerate(words) if _near(w, x) and len(x) >= len(w)]
        assert sorted(automaton.near(w)) == expected


# Source divergence


def _divergence_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.sql(source_divergence.SQL).df()


def _frame(given):
    return pd.DataFrame(given, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({c: "string" for c in ("text", "lang", "source")})


def test_source_divergence(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 5))) for _ in range(60)]
    given = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "S2", "é", "", None])
        text = " ".join(rng.choices(words[:30] if source == "s1" else words, k=rng.randrange(0, 40)))
        given.append((i, rng.choice([text, text.upper(), text.replace(" ", "1"), None]), lang, source, "clash", 1, "clash"))
    given += [given[3], given[3], (None, "lone words", "xx", "s1", None, None, None), (None, None, "xx", "s9", None, None, None), (5, "1 2 3", "en", "empty", None, None, None), (6, " ".join(words) * 3000, "en", "long", None, None, None)]
    got = source_divergence.divergence(spark.createDataFrame(given, SCHEMA)).toPandas()
    expected = _divergence_sql(_frame(given))
    assert set(expected.part) == {"pair", "term"}
    assert (expected[expected.lang == "xx"].value == 0).all() and (expected.lang == "xx").sum() == 2
    assert rows(got) == rows(expected)


def test_source_divergence_of_nothing(spark):
    assert source_divergence.divergence(_docs(spark, [])).count() == 0
    assert source_divergence.divergence(_docs(spark, ["one group only"] * 40)).filter("part = 'pair'").count() == 0


def test_source_divergence_of_large_counts(spark):
    """Counts and totals beyond what fits a product of long integers."""
    from pyspark.sql import functions as F

    given = spark.createDataFrame([(9_300_000_000_000, 70_000_000_000_000, 1000)], "n long, total long, size long")
    got = given.select(source_divergence._rate(F.col("n"), F.col("total"), F.col("size"), 5, 10**9)).first()[0]
    assert got == 1 + 10**9 * (9_300_000_000_000 + 5) // (70_000_000_000_000 + 5 * 1000)


# License scans


def _licenses_by_force(text):
    """n_words, base places, and matches of every notice over the whole text, without seeds or windows."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    places, found = [], []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    whole = f" {' '.join(words)} " if words else " "
    for notice, label in license_scan.NOTICES.items():
        pattern = regex.compile(rf"(?e)(?<!\S)(?:{notice}){{e<={len(notice) // license_scan.EDIT_EVERY}}}(?!\S)")
        found += [(label, notice, whole[: m.start() + len(m.group()) - len(m.group().lstrip())].count(" ") - 1, sum(m.fuzzy_counts), m.group().strip()) for m in pattern.finditer(whole)]
    return len(words), sorted(places), sorted(found)


def _notices(rng):
    fill = ["this", "work", "is", "licensed", "mit", "license", "permit", "general", "public", "under", "the", "commons", "é", "v2"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts += rng.choices(fill, k=rng.randrange(0, 8))
            notice = rng.choice(list(license_scan.NOTICES))
            for _ in range(rng.randrange(0, 4)):
                notice = _misspelt(rng, notice)
            parts.append(rng.choice([notice, notice.upper(), notice.replace(" ", ", "), notice.replace(" ", "\n- ")]))
        texts.append(" ".join(parts))
    return texts


def test_license_scan(spark):
    texts = _notices(random.Random(7)) + [None, "", " . ", "mit", "MIT License mit license MIT-LICENSE", "mit license license", "permit license", "The MIT Licence.", "x" * 3000, "mit license " * 2000, "a general public license", "general public license general public license"]
    docs = _docs(spark, [*texts, texts[0]])
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == len(texts) + 1
    both = [*texts, texts[0]]
    for r in got:
        n, places, found = _licenses_by_force(both[r.doc_id])
        assert r.n_words == n
        assert sorted((p.label, p.word) for p in r.places) == places
        assert sorted((m.label, m.notice, m.first_word, m.edits, m.text) for m in r.matches) == found
    assert sum(m.edits > 0 for r in got for m in r.matches) > 100
    assert license_scan.scan_licenses(_docs(spark, [])).count() == 0


def test_license_query(spark, tmp_path):
    texts = ["Released under the MIT License. The MIT license, the Apache License.", "Under the MIT licence", "nothing", None, "All rights reserved"]
    _docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.query(spark, str(tmp_path)).collect()}
    assert got[0] == (11, 3, 3, 9, "apache,mit", "apache,mit", 1.0)
    assert got[1][1:6] == (0, None, None, "", "mit") and 0.9 < got[1][6] < 1
    assert got[2] == (1, 0, None, None, "", "", 0.0)
    assert got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4] == (3, 0, None, None, "", "proprietary", 1.0)


def test_notices_of_a_user(spark):
    got = license_scan.scan_licenses(_docs(spark, ["use it as you like", "use it as you likes"]), notices={"as you like": "beer"}, phrases={}).collect()
    assert [[(m.label, m.edits) for m in r.matches] for r in got] == [[("beer", 0)], [("beer", 1)]]
    with pytest.raises(ValueError):
        license_scan.scan_licenses(_docs(spark, ["x"]), notices={"Not Lower": "x"})


# Queries over whole tables


def test_queries(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").toPandas()
    got = {tuple(r) for r in registry.queries()["op11_spelling_variants"](spark, DATA).collect()}
    assert got == _variants_by_force(docs.itertuples(index=False))
    got = registry.queries()["op12_source_divergence"](spark, DATA).toPandas()
    assert rows(got) == rows(_divergence_sql(docs))
    for r in registry.queries()["op13_license_scan"](spark, DATA).collect():
        n, places, found = _licenses_by_force(docs.text[docs.doc_id == r.doc_id].iloc[0])
        at = [p for _, p in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places}))
        assert r.labels == ",".join(sorted({x for x, _ in places} | {m[0] for m in found}))
