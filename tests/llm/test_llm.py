"""Corpus operators against brute force, on small tables with every odd row."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import decontamination, exact_dedup, labelled, line_templates, minhash_dedup, packing, quality, resharding, suffix_dedup, toxicity, trie_counts
from vellum.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key long, size string"
RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefgh", k=RNG.randrange(2, 7))) for _ in range(300)]


def _prose(n):
    return " ".join(RNG.choices(WORDS, k=n))


def _texts():
    base, passage = _prose(120), _prose(45)
    texts = [None, "", " \n ", "one", "two words here", base, base.upper(), base, "é" + base, base.replace(base.split()[5], "changed"), base + " " + _prose(20), _prose(60) + " " + passage + " " + _prose(10), passage + _prose(30), "x" * 450, "Zeile ß. " * 60, _prose(9000)]
    texts += [_prose(RNG.randrange(1, 80)) for _ in range(40)]
    rows = [(i, t, "en", 1, "clash") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[30], (None, base, None, None, None), (None, None, None, None, None)]


ROWS = _texts()


def _corpus():
    return ROWS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for i, t, *_ in _corpus():
        groups[lower(t)].append(i)
    expected = []
    for i, t, *_ in _corpus():
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        expected.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, digest=True).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_near_dedup(docs, empty):
    sets, parent = defaultdict(set), {}
    for i, t, *_ in _corpus():
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] |= {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_dedup(docs).collect()}
    assert got.pop(None)[1:] == (None, True)
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}
    assert minhash_dedup.near_dedup(docs).count() == docs.count()
    assert minhash_dedup.near_dedup(empty).count() == 0


def _components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in range(n)}


def _all_links(texts, percent=75):
    """Every pair that is similar enough, each document against all before it."""
    hashes = minhash_dedup._WordHashes()
    sets = [minhash_dedup.shingle_set(t, hashes) for t in texts]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum([0, *map(len, sets)])
    n, marked = np.diff(starts), np.zeros(codes.max() + 1, bool)
    for i in range(1, len(sets)):
        marked[:] = False
        marked[codes[starts[i] : starts[i + 1]]] = True
        same = np.add.reduceat(marked[codes[: starts[i]]], starts[:i], dtype=np.int64)
        yield from ((i, int(j)) for j in np.flatnonzero(100 * same >= percent * (n[:i] + n[i] - same)))


@pytest.mark.parametrize(("size", "block"), [(700, minhash_dedup.BLOCK), (1400, minhash_dedup.BLOCK), (300, 40)])
def test_near_dedup_in_a_large_group(spark, monkeypatch, size, block):
    """Near copies of a text that is not there, about as many above the similarity asked for as below: hubs miss many links; candidates stay below the members' number times the bands."""
    rng = random.Random(size)
    base = _prose(100).split()
    texts = [" ".join(rng.choice(WORDS) if rng.random() < rng.choice([0.01, 0.03, 0.05]) else w for w in base) for _ in range(size)]
    counted = {}
    for name in ("_stars", "_screened", "_joining"):

        def counting(*args, name=name, own=getattr(minhash_dedup, name)):
            out = minhash_dedup.kept(own(*args), name)
            counted[name] = out.count()
            return out

        monkeypatch.setattr(minhash_dedup, name, counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_dedup(df, block=block).collect()}
    want = _components(size, _all_links(texts))
    assert got == want
    assert 1 < len(set(want.values())) < size
    blocks = -(-size // block)
    assert counted["_stars"] <= size * minhash_dedup.BANDS
    assert counted["_screened"] <= 2 * blocks * size * minhash_dedup.BANDS
    assert counted["_joining"] <= blocks**2 * size * minhash_dedup.BANDS


def test_sketches_pass_pairs_at_the_similarity_asked_for():
    """The screen of the sketches lets every pair at 0.75 through, for small and large sets."""
    rng, orders = np.random.default_rng(5), minhash_dedup.search_orders(minhash_dedup.BANDS * minhash_dedup.BINS_PER_BAND)
    bins = len(orders)
    least = bins * 0.75 - minhash_dedup.DEVIATIONS * (bins * 0.75 * 0.25) ** 0.5
    for n in (7, 35, 140, 700):
        for _ in range(200):
            s = rng.integers(0, 2**64, n, dtype=np.uint64)
            a, b = s[: n * 6 // 7], s[n // 7 :]  # 5/7 in both: scaled below to three quarters at least
            b = np.concatenate([b, a[: n // 28 + 1]])
            a, b = np.unique(a), np.unique(b)
            if 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b)):
                x, y = (minhash_dedup.signature(v, orders).astype(np.uint8) for v in (a, b))
                assert (x == y).sum() >= least


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    rows = [r.asDict() for r in packing.pack(docs, with_ids=True).collect()]
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    whole = sorted(str((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in _corpus())
    # Pieces of a document follow each other; rows that repeat an id have the same pieces as often.
    own = defaultdict(list)
    for r in rows:
        own[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    got = []
    for (i, n), pieces in own.items():
        copies = sum(start == 0 for start, _ in pieces)
        ids = [None] * n
        for start, part in pieces:
            ids[start : start + len(part)] = part
        assert None not in ids and sum(len(p) for _, p in pieces) == copies * n
        got += [str((i, ids))] * copies
    assert sorted(got) == whole
    assert any(len(p) > 1 for p in own.values())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty).count() == 0


def test_chunks_of_random_texts():
    """Letters of many scripts beside stops, commas and blanks, at random."""
    from tokenizers import Tokenizer

    encoder, tokenizer = packing.ChunkEncoder(packing.tokenizer_file(), 2), Tokenizer.from_file(packing.tokenizer_file())
    rng = random.Random(4)
    letters = "abXY.,. ,12'éÉßİıΣςσÅ\u0301ñǅﬁ日जि️’”\u00a0\u2028\u1e9e_-"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(20_000)]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [2], ascii(t)


def test_cut_covers_every_token():
    for n in [*range(1, 300), 1000, 4095, 4096, 4097, 20_001]:
        pieces = packing.cut(n, 4096)
        assert [p[0] for p in pieces] == list(np.cumsum([0, *(p[1] for p in pieces[:-1])])) and sum(p[1] for p in pieces) == n
        assert all(k * length <= 4096 for _, length, k in pieces)


def test_chunks_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    odd = ["Hello, World.", "don't. it's, <|endoftext|> x<|startoftext|>,", "á. é, ﬁ. Σας. ΣΑΣ. İstanbul. 5. ...x., ,,a. 's. ½. ²,", "x.  y, z​. ", "日本語。 12,3. _a. WE'LL,", "\x1c a\x1db. \x85c, <|EndOfText|>", "a,b.c", "é,é. ñ", "ﬀ ǅ ʰ ª", "”a.” (b).", ""]
    encoder, tokenizer = packing.ChunkEncoder(packing.tokenizer_file(), 2), Tokenizer.from_file(packing.tokenizer_file())
    for t, ids in zip(odd, encoder.encode(odd), strict=True):
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [2]


def test_flow_is_cheapest():
    flow = resharding.min_cost_flow([5, 3], [2, 4, 2], [[0, 1, 1], [1, 0, 1]])
    assert sum(n for (i, j), n in flow.items() if i != j) == 3
    assert [sum(n for (i, _), n in flow.items() if i == k) for k in (0, 1)] == [5, 3]
    flow = resharding.min_cost_flow([2, 2], [2, 2], [[1, 5], [2, 9]])  # the greedy choice is dearer
    assert sum([[1, 5], [2, 9]][i][j] * n for (i, j), n in flow.items()) == 14
    with pytest.raises(ValueError):
        resharding.min_cost_flow([3], [2], [[0]])


def _cheapest(supply, capacity, cost):
    """The least cost over all ways to ship, tried one by one."""
    if not supply:
        return 0
    best = 10**9

    def split(j, left, spent, room):
        nonlocal best
        if j == len(capacity):
            if not left:
                best = min(best, spent + _cheapest(supply[1:], room, cost[1:]))
            return
        for n in range(min(left, room[j]) + 1):
            split(j + 1, left - n, spent + n * cost[0][j], [*room[:j], room[j] - n, *room[j + 1 :]])

    split(0, supply[0], 0, list(capacity))
    return best


def test_flow_equals_exhaustive_search():
    rng = random.Random(3)
    for trial in range(120):
        supply, capacity = [rng.randrange(4) for _ in range(3)], [rng.randrange(5) for _ in range(3)]
        cost = [[rng.randrange(6) if trial % 2 else int(i != j) for j in range(3)] for i in range(3)]
        if sum(supply) <= sum(capacity):
            flow = resharding.min_cost_flow(supply, capacity, cost)
            assert sum(cost[i][j] * n for (i, j), n in flow.items()) == _cheapest(supply, capacity, cost)
            assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(3)] == supply


def test_resharding(docs, empty, tmp_path):
    old = F.pmod("doc_id", F.lit(3))  # null ids lie in no shard so far
    placed = resharding.reshard(docs, old, 4, whole=True).cache()
    rows = placed.collect()
    expected = sorted(len((t or "").encode()) + 8 for _, t, *_ in _corpus())
    assert sorted(r["size"] for r in rows) == expected
    assert all(r["text_crc32"] == zlib.crc32((r["record"]["text"] or "").encode()) for r in rows)
    assert {r["old_shard"] for r in rows if r["doc_id"] is None} == {-1}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(4)]
    assert max(abs(x - sum(load) / 4) for x in load) <= max(expected)
    changed = resharding.rewrite(placed, str(tmp_path / "shards"))
    back = placed.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == sum(r["shard"] in changed for r in rows)
    assert set(back.columns) == {"doc_id", "text", "lang", "key", "size", "shard"}
    assert resharding.reshard(empty, F.lit(0), 4).count() == 0


def test_rewrite_leaves_other_shards_alone(spark, tmp_path):
    path = tmp_path / "shards"
    rows = [(i, "x" * 10, shard) for shard, n in ((0, 4), (1, 2), (2, 3), (3, 3)) for i in range(10 * shard, 10 * shard + n)]
    spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(1).write.partitionBy("shard").parquet(str(path))
    files = lambda k: {f.name: f.read_bytes() for f in (path / f"shard={k}").iterdir()}
    before = {k: files(k) for k in range(4)}
    docs = spark.read.parquet(str(path))
    assert resharding.rewrite(resharding.reshard(docs, F.col("shard"), 4, whole=True), str(path)) == [0, 1]
    assert all(files(k) == before[k] for k in (2, 3)) and all(files(k) != before[k] for k in (0, 1))
    back = spark.read.parquet(str(path))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(r[:2] for r in rows)
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 3}
    # A shard that goes out of use loses its folder.
    spark.catalog.refreshByPath(str(path))
    resharding.rewrite(resharding.reshard(spark.read.parquet(str(path)), F.col("shard"), 4, weights=[1, 1, 1, 0], whole=True), str(path))
    assert not (path / "shard=3").exists()
    assert spark.read.parquet(str(path)).count() == len(rows)


def test_line_templates(spark, docs, empty):
    rows = [(i, f"Job {i} took {i * 7} ms on node{i} today\n{_prose(12)}\n\nshort") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_templates(df, short=False).collect()}
    assert all(got[i].n_dropped == 1 and got[i].text == t.split("\n", 1)[1] and got[i].n_lines == 4 for i, t in rows)
    got = {r.doc_id: r for r in line_templates.drop_templates(df).collect()}
    assert all(got[i].n_dropped == 2 and got[i].text == t.split("\n", 1)[1].removesuffix("\nshort") for i, t in rows)
    same = spark.createDataFrame([(i, "All of this text is copied many times over") for i in range(9)], "doc_id long, text string")
    assert line_templates.drop_templates(same).filter("n_dropped > 0").count() == 0
    kept = line_templates.drop_templates(docs).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str((i, t)) for i, t, *_ in _corpus())
    assert line_templates.drop_templates(empty).count() == 0


def test_short_lines_are_dropped_too(spark):
    rows = [(i, f"{_prose(12)}\n\nAll rights reserved.\nPage {i}\n7\nonly {WORDS[i]} here" + "\nrare line" * (i < 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_templates(df).collect()}
    assert all(got[i].text == t.replace("All rights reserved.\n", "") and got[i].n_dropped == 1 for i, t in rows)
    assert line_templates.drop_templates(df, short=False).filter("n_dropped > 0").count() == 0


def test_a_copy_counts_once_for_a_token(spark):
    """Many lines of few documents that share a template recur in too few documents."""
    rows = [(i, "\n".join(f"alpha beta gamma delta {w} {i}" for w in WORDS[:6])) for i in range(4)]
    assert line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_dropped > 0").count() == 0
    rows.append((9, "alpha beta gamma delta once 9"))
    assert line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 25


def test_repeats(docs, empty):
    rows = [(i, (t or "").encode()) for i, t, *_ in _corpus()]
    seen = defaultdict(int)
    for _, b in rows:
        for j in range(len(b) - 199):
            seen[b[j : j + 200]] += 1
    expected = []
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        left = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        expected.append((i, len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 1000
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_token_counts(docs, empty):
    scores = trie_counts.piece_scores(trie_counts.vocabulary_file())
    trie = trie_counts.Trie(scores)

    def best(word):
        w, path = trie_counts.MARK + word, [(0.0, 0)]
        for end in range(1, len(w) + 1):
            n = len(w[end - 1].encode())
            options = [(path[end - 1][0] + n * trie.byte, path[end - 1][1] - n)]
            options += [(path[s][0] + scores[w[s:end]], path[s][1] - 1) for s in range(end) if w[s:end] in scores]
            path.append(max(options))
        return -path[-1][1]

    expected = [(i, len((t or "").encode().split()), sum(best(w.decode()) for w in (t or "").encode().split())) for i, t, *_ in _corpus()]
    assert sorted(map(tuple, trie_counts.count_tokens(docs).collect()), key=str) == sorted(expected, key=str)
    assert trie_counts.count_tokens(empty).count() == 0


def test_decontamination(spark, docs, empty):
    texts = [t for _, t, *_ in _corpus()]
    items = [(1, " ".join(texts[11].split()[58:100]).upper()), (2, "two, words"), (3, None), (4, "..."), (5, _prose(30)), (6, texts[5][:90]), (6, texts[5][:90])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    expected = []
    for i, t, *_ in _corpus():
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            v = cut(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        expected.append((i, len(w), len(hit), sorted(found)))
    got = decontamination.decontaminate(docs, bench).select("doc_id", "n_words", decontamination.hit_words(F.col("spans")), F.array_sort("items"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert any(e[3] for e in expected)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_proximity(spark):
    texts = ["alpha and then some more words before beta comes", "alpha beta", "beta alpha", "alpha x beta gamma", "gamma", None, "alpha beta gamma alpha beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, "alpha beta"), (2, "alpha beta gamma"), (3, "missing words"), (4, "..."), (None, "gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall("[a-z]+", t or "")
    common = defaultdict(int)
    for w in (w for t in texts for w in cut(t)):
        common[w] += 1
    for slop in (0, 1, 8):
        expected = {}
        for i, t in enumerate(texts):
            w, near = cut(t), set()
            for item, v in ((k, cut(x)) for k, x in items if k is not None and cut(x)):
                rare = min(range(len(v)), key=lambda j: (common[v[j]], j))
                for p in (p for p, x in enumerate(w) if x == v[rare]):
                    if all(any(x == v[j] and abs(q - (p - rare + j)) <= slop for q, x in enumerate(w)) for j in range(len(v))):
                        near.add(item)
            expected[i] = sorted(near)
        got = {r.doc_id: sorted(r.near) for r in decontamination.decontaminate(docs, bench, slop=slop).collect()}
        assert got == expected
    assert decontamination.decontaminate(docs, bench, slop=None).filter(F.size("near") > 0).count() == 0


def _labels(spark, label, n=400):
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        if label == "quality":
            text = " ".join(["spam###"] * 30 + [w + "$$$" for w in _prose(40).split()]) if bad else _prose(80) + "."
            marks.append((i, int(not bad), 0))
        else:
            text = _prose(40) + (f". you are a grubling{RNG.choice('abc')} {_prose(3)}." if bad else ".") + _prose(20)
            marks.append((i, 1, int(bad)))
        rows.append((i, text))
    rows += [(None, None), (n, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, empty, module, label):
    docs, labels = _labels(spark, label)
    scored = module.score(docs, labels).join(labels.dropna(), "doc_id").filter("held_out").collect()
    assert len(scored) > 40
    assert sum((r["score"] >= 0.5) == bool(r[label]) for r in scored) / len(scored) >= 0.97
    assert module.score(docs, labels).count() == docs.count()
    assert module.score(docs, labels.limit(0)).filter("score is null or score > 0.5").count() == 0
    assert module.score(empty.select("doc_id", "text"), labels).count() == 0


@pytest.mark.parametrize("most", [90, 1000])
def test_classifiers_keep_the_classes_shares(spark, most):
    """Where the label sample is cut, scores stay near the share of the label among like documents."""
    n = 1200
    labels = spark.createDataFrame([(i, int(i % 6 > 0), int(i % 10 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(i, "the same words in every document") for i in range(n)], "doc_id long, text string")
    assert abs(quality.score(same, labels, most=most).agg(F.avg("score")).first()[0] - 5 / 6) < 0.08
    # 'grubling' stands in every toxic document and in a ninth of the others: half of those that hold it are toxic.
    holds = lambda i: i % 10 == 0 or i % 90 in range(1, 90, 9)
    rows = [(i, "a grubling here" if holds(i) else "plain words here") for i in range(n)]
    share = sum(i % 10 == 0 for i in range(n)) / sum(map(holds, range(n)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, labels, most=most).filter("n_matches > 0").agg(F.avg("score"), F.count("*")).first()
    assert got[1] == sum(map(holds, range(n))) and abs(got[0] - share) < 0.2  # 90 rows alone leave a deviation of 0.08


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers_take_odd_rows(spark, module, label, cut):
    docs, labels = _labels(spark, label)
    odd = [(1, "x " * 200_000), (2, "y"), (2, "z"), (2, None), (None, "w"), (900, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).select("*", F.lit("clash").alias("score"), F.lit(7).alias("weight"), F.lit(None).cast("int").alias("y"))
    # Ids 8 and 12 contradict themselves, in either order of rows; that must not depend on which row comes first.
    more = spark.createDataFrame([(8, 0, 1), (8, 1, 0), (12, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    one = {(r.doc_id, r.score) for r in module.score(docs, labels.unionByName(more)).collect()}
    other = {(r.doc_id, r.score) for r in module.score(docs.repartition(3), more.unionByName(labels).repartition(2)).collect()}
    assert len(one) >= 400 and {(i, round(s, 4)) for i, s in one} == {(i, round(s, 4)) for i, s in other}
    assert all(0 <= s <= 1 for _, s in one)
    assert labelled.sample(docs, labels.unionByName(more), label, 1000).filter("doc_id in (8, 12)").count() == 0
    assert labelled.sample(docs, labels, label, 1000).groupBy("doc_id").count().filter("count > 1").count() == 0
    assert labelled.sample(docs, labels, label, 1000).filter(F.length("text") > labelled.LONGEST).count() == 0


@pytest.mark.parametrize(("module", "label", "cut"), [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers_on_the_labels_table(spark, module, label, cut):
    """Held-out rows of sf0.01: ranking, and recall of the class sought at the contract's cut."""
    data = "/root/testdata/sf0.01"
    got = module.query(spark, data).cache()
    assert got.filter((F.col("score") >= cut).cast("int") != F.col("predicted")).count() == 0
    held = got.filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    ranks, y = held["score"].rank().to_numpy(), held[label].to_numpy()
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    sought = y == (0 if label == "quality" else 1)
    right = held["predicted"].to_numpy() == y
    assert auc >= 0.8 and right[sought].mean() >= 0.6 and right[~sought].mean() >= 0.98, (auc, right[sought].mean(), right[~sought].mean())


def test_grammar_reads_scopes():
    tagger, machine = toxicity.Tagger({"grub": 2.0}), toxicity.grammar()
    kinds = lambda t: {toxicity.KINDS[k] for k in np.flatnonzero(toxicity.clause_features(t, tagger, machine)[: len(toxicity.KINDS)])}
    assert kinds("a grubling") == {"I"} and kinds("you grub") == {"Ay"} and kinds("you are not a grub") == {"Any"} and kinds("he said you grub") == {"Ary"}
    assert kinds("he said. a grub") == {"I"} and kinds("not one two three grub") == {"I"} and kinds("I kill") == {"T"} and kinds("nothing") == set()
    # A target counts after the match as well, but not in another clause, and not from too far as an address.
    assert kinds("a grub like you") == {"Iy"} and kinds("a grub. you") == {"I"} and kinds("you one two three four grub") == {"Iy"}
    assert kinds("he will kill you") == {"Vy"} and kinds("they kill you") == {"Ty"} and kinds("he will never kill") == {"Vn"} and kinds("a grub will kill you") == {"I", "Vy"}
    assert toxicity.clause_features("a grub will kill you", tagger, machine)[len(toxicity.KINDS) + toxicity.KINDS.index("I")] == np.log1p(2.0)


def test_held_out(spark):
    got = spark.range(50).withColumn("h", labelled.held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


COLUMNS = {
    "op1_minhash_near_dedup": "doc_id long, n_shingles long, component_id long, kept boolean",
    "op2_harmonic_packing": "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    "op3_min_cost_resharding": "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int",
    "op4_line_templates": "doc_id long, n_lines long, n_dropped long, text string",
    "op5_suffix_dedup": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "op6_trie_token_counts": "doc_id long, n_pretokens long, n_tokens long",
    "op7_decontamination": "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    "op8_quality": "doc_id long, held_out boolean, score double, predicted int",
    "op9_toxicity": "doc_id long, held_out boolean, score double, predicted int",
    "op10_exact_dedup": "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_return_what_is_asked(spark, name):
    """Columns and types of each query, rows, and its SQL where there is any."""
    from compare import DATA, connection
    from compare import rows as plain

    from vellum.llm import registry

    got = registry.queries()[name](spark, DATA).cache()
    kinds = dict(got.dtypes)
    assert all(kinds.get(c) == kind.replace("long", "bigint") for c, kind in (part.split() for part in COLUMNS[name].split(", ")))
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got.select("doc_id").distinct().count() == documents.count()
    assert name == "op2_harmonic_packing" or got.count() == documents.count()
    if sql := registry.oracle_sql().get(name):
        assert plain(got.toPandas()) == plain(connection().sql(sql).df())
    if name == "op3_min_cost_resharding":
        rows = got.collect()
        load = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(24)]
        assert {r["law"] for r in rows} == {"bytes"} and max(load) - min(load) <= 2 * max(r["size"] for r in rows)


def test_results_without_broadcasts(spark, docs, monkeypatch):
    """Sides too large to be broadcast are shuffled; the rows are the same."""
    from vellum import storage

    bench = spark.createDataFrame([(1, " ".join(ROWS[11][1].split()[58:100])), (2, "two words")], "item_id long, text string")
    lines = spark.createDataFrame([(i, f"Job {i} took {i * 7} ms on node{i} today\n{WORDS[i]}\nAll rights reserved") for i in range(8)], "doc_id long, text string")

    def results():
        runs = [exact_dedup.exact_dedup(docs, digest=True), minhash_dedup.near_dedup(docs), suffix_dedup.remove_repeats(docs).drop("kept"), line_templates.drop_templates(lines)]
        found = decontamination.decontaminate(docs, bench)
        runs.append(found.select("doc_id", "n_words", "spans", F.array_sort("items"), F.array_sort("near")))
        return [sorted(map(tuple, df.collect()), key=str) for df in runs]

    before = results()
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST", 0)
    assert results() == before
