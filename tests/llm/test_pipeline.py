"""The stages of the pipeline against brute force on their own input: nulls, repeated ids, ties, clashing names, empty tables."""

import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import packing, quality

RNG = random.Random(23)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randrange(2, 7))) for _ in range(300)]
ITEM = " ".join(RNG.choices(WORDS, k=14))
SCHEMA = "doc_id long, text string, lang string, row string, Score int, n_chars long"


def _prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def _rows():
    base = _prose(120)
    near = " ".join(w if i != 60 else "other" for i, w in enumerate(base.split()))
    good = [_prose(RNG.randrange(5, 90)) + "." for _ in range(160)]
    bad = [" ".join(["spam###"] * 30 + [w + "$$$" for w in _prose(30).split()]) + f" {i}" for i in range(60)]
    texts = [t for pair in zip(good, bad * 3, strict=False) for t in pair][:220] + [base, base.upper(), near, None, "", _prose(20) + " " + ITEM.upper() + " " + _prose(20), _prose(9000)]
    rows = [(i, t, "en", "r", 1, None) for i, t in enumerate(texts)]
    odd = [(None, base), (None, near), (None, ITEM), (None, bad[0]), (3, _prose(30)), (5, good[9]), (5, good[9]), (900, good[9]), (901, near + " more")]
    return rows + [(*r, None, None, None, 3) for r in odd]


ROWS = _rows()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    marks = [(i, int("###" not in (r[1] or ""))) for i, r in enumerate(ROWS[:220])] + [(4, None), (None, 1)]
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _shown(rows):
    return sorted(str((r[0], r[1])) for r in rows)


def _stage(spark, name, docs, sf_dir):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert name == "packing" or out.dtypes == docs.dtypes
    return out


def test_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, table = quality.train(docs.select(F.col("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), 2000), quality._byte_classes()
    scores = model.score(*quality._bags([r[1] for r in ROWS], table))
    got = _stage(spark, "quality", docs, sf_dir).collect()
    assert _shown(got) == _shown([r for r, s in zip(ROWS, scores, strict=True) if s >= quality.ACCEPT])
    assert not any("###" in (r.text or "") for r in got)
    # A rejected row leaves others with its id alone, and null ids are judged too.
    assert [r.text for r in got if r.doc_id == 3] == [next(t for i, t, *_ in ROWS if i == 3 and "###" not in t)]


def test_exact_copies(spark, sf_dir):
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")].append(r)
    got = _stage(spark, "exact_dedup", spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    assert len(got) == len(groups)
    for r in got:
        own = groups.pop(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        assert r.doc_id == max((x[0] for x in own if x[0] is not None), default=None)


def test_near_copies(spark, sf_dir):
    sets = []
    for r in ROWS:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    stay = defaultdict(list)
    for g, r in zip(group, ROWS, strict=True):
        stay[g].append(r)
    got = _stage(spark, "near_dedup", spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    least = lambda rows: min((r[0] for r in rows if r[0] is not None), default=None)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(least(rows)) for rows in stay.values())
    assert len(stay) < len(ROWS)


def test_benchmark(spark, sf_dir):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    item = cut(ITEM)
    windows = {tuple(item[s : s + 10]) for s in range(len(item) - 9)}
    clean = [r for r in ROWS if not any(tuple(cut(r[1])[p : p + 10]) in windows for p in range(max(0, len(cut(r[1])) - 9)))]
    got = _stage(spark, "decontamination", spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    assert _shown(got) == _shown(clean) and len(clean) == len(ROWS) - 2


def test_packing_and_run(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
    ids = {zlib.crc32(np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()): r.doc_id for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in got if r.start == 0) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(ids[r.ids_crc32] == r.doc_id for r in got if r.length == r.doc_tokens)


def test_empty(spark, tmp_path):
    path = str(tmp_path)
    for table, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{table}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
