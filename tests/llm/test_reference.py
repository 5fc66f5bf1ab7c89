"""The classifiers' scores against plain Python, and very long texts."""

import math
import random
import time

import numpy as np
import pytest

from vellum.llm import line_templates, quality, spelling_variants, toxicity, trie_counts  # noqa: F401

SYMBOLS = {"o": "plain", "I": "blorful", "T": "kill", "Y": "you", "B": "are", "M": "will", "N": "not", "R": "said"}


def _kinds(symbols, weights):
    """Kinds of matches of one clause with their weights, read off the rules without any machine."""
    out = []
    for i, s in enumerate(symbols):
        if s not in "IT":
            continue
        opens, extends = ("Y", "B") if s == "I" else ("M", "M")
        reach = 0
        for x in symbols[:i]:
            reach = toxicity.REACH if x == opens or (x == extends and reach) else max(0, reach - 1)
        kind = ({"I": "A", "T": "V"}[s] if reach else s) + ("n" if "N" in symbols[max(0, i - toxicity.SCOPE) : i] else "") + ("r" if "R" in symbols[:i] else "")
        following = next((j for j in range(i + 1, len(symbols)) if symbols[j] in "IT"), len(symbols))
        out.append((kind + ("y" if "Y" in symbols[:i] or "Y" in symbols[i:following] else ""), weights[i]))
    return out


def test_grammar_equals_its_rules():
    rng = random.Random(13)
    machine = toxicity.grammar()
    tagger = toxicity.Tagger({"blor": 2.0, "zikk$": 0.5})
    for _ in range(3000):
        words, clauses = [], [[]]
        for _ in range(rng.randrange(0, 25)):
            s = rng.choice("ooIITYBMNR")
            word = "zikk" if s == "I" and rng.random() < 0.3 else SYMBOLS[s]
            clauses[-1].append((s, {"zikk": 0.5, "blorful": 2.0}.get(word, 0.0)))
            if rng.random() < 0.15:
                word += rng.choice([".", ",", '!"'])
                clauses.append([])
            words.append(rng.choice([word, word.upper(), f"«{word}" if word[-1].isalpha() else word]))
        counts, weights = dict.fromkeys(toxicity.KINDS, 0), dict.fromkeys(toxicity.KINDS, 0.0)
        for clause in clauses:
            for kind, weight in _kinds([s for s, _ in clause], [w for _, w in clause]):
                counts[kind] += 1
                weights[kind] += weight
        expected = [math.log1p(counts[k]) for k in toxicity.KINDS] + [math.log1p(weights[k]) for k in toxicity.KINDS] + [1.0]
        assert np.allclose(toxicity.clause_features(" ".join(words), tagger, machine), expected), words


def _passages(text):
    """Features of each passage, byte by byte."""
    raw, table = text.encode(), quality._byte_classes()
    cuts = [0]
    while len(raw) - cuts[-1] > quality.PASSAGE:
        at = cuts[-1] + quality.PASSAGE
        stop = min(at + quality.PASSAGE, len(raw))
        cuts.append(next((i + 1 for i in range(at, stop) if raw[i : i + 1] in (b" ", b"\n")), stop))
    if len(cuts) > 1 and cuts[-1] == len(raw):
        cuts.pop()
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True):
        pairs = [0.0] * quality.CLASSES**2
        for i in range(max(a, 1), b):
            pairs[table[raw[i - 1]] * quality.CLASSES + table[raw[i]]] += 1
        total = max(1.0, sum(pairs))
        words, rest = raw[a:b].split(), [0.0] * 5
        if words:
            rest = [len(set(words)) / len(words), sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / len(words), min(4.0, (b - a) / len(words) / 8), math.log(1 + len(words)) / 5, len({len(w) for w in words}) / 12]
        out.append([math.sqrt(p / total) for p in pairs] + rest)
    return out


def _attended(model, bag):
    """The score of one bag, neuron by neuron."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    layer = lambda x, w, offset: [sum(x[i] * w[i][j] for i in range(len(x))) + (offset[j] if offset is not None else 0.0) for j in range(len(w[0]))]
    hidden = [[math.tanh(v) for v in layer(x, model.w[:-1].tolist(), model.w[-1].tolist())] for x in bag]
    energies = [sum(math.tanh(t) * sigmoid(g) * a for t, g, a in zip(layer(h, model.v.tolist(), None), layer(h, model.u.tolist(), None), model.a.tolist(), strict=True)) for h in hidden]
    top = max(energies)
    shares = [math.exp(e - top) for e in energies]
    pooled = [sum(s * h[j] for s, h in zip(shares, hidden, strict=True)) / sum(shares) for j in range(len(hidden[0]))]
    return sigmoid(sum(p * o for p, o in zip(pooled, model.o[:-1].tolist(), strict=True)) + float(model.o[-1]))


def test_attention_equals_plain_loops():
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdeXYZé0.,!|#", k=rng.randrange(1, 9))) for _ in range(60)]
    texts = ["", "a", "é", "x" * 2000, "ab " * 700, *(rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randrange(1, 600))) for _ in range(25))]
    table = quality._byte_classes()
    for t in texts:
        assert np.allclose(quality.passages(t, table), _passages(t), atol=1e-6)
    bags = [quality.passages(t, table).astype(np.float32) for t in texts]
    model = quality.fit(bags, np.array([i % 2 for i in range(len(texts))], np.float32), epochs=3)
    got = model.score(*quality._bags(texts, table))
    assert np.allclose(got, [_attended(model, b) for b in bags], atol=1e-4)


@pytest.mark.parametrize("lines", [100_000])
def test_many_dropped_lines_in_one_text(spark, lines):
    """A text's dropped lines cost time in proportion to their number."""
    log = "\n".join(f"job {i} ended with code {i % 7} on host" if i % 3 else f"kept {i} {'ab'[i % 2]} line{i} no{i} two{i}x" for i in range(lines))
    rows = [(0, log)] + [(i, "\n".join(f"job {i * 1000 + j} ended with code {j} on host" for j in range(3))) for i in range(1, 8)]
    began = time.time()
    got = {r.doc_id: r for r in line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    assert got[0].n_lines == lines and got[0].n_dropped >= sum(1 for i in range(lines) if i % 3)
    assert not any(x.startswith("job") for x in got[0].text.split("\n"))
