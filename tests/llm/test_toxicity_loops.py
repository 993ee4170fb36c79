"""Toxicity by plain loops: sentences, features, noisy-or and training steps, one number at a time."""

import math
import re

import numpy as np
import pytest

from ledgermark.llm import _text as tx
from ledgermark.llm import toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile("[a-z0-9À-῿⁰-\U0010ffff]+")


def hashed(word):
    cp, _ = tx.codes([word])
    return int(tx.SpanHasher(cp)(np.array([0]), np.array([len(word)]))[0])


def loop_score(weights, text, seen):
    """1 minus the product of the chances that no sentence is toxic."""
    low, none = "".join(c.lower()[0] for c in text), 1.0
    for sentence in re.split("[.!?\n]", low):
        known = set()
        for word in WORD.findall(sentence):
            if word not in seen:
                own = [hashed(word)] + [(hashed(word[:n]) + n) % 2**64 for n in toxicity.PREFIXES if len(word) > n]
                seen[word] = [f for f in own if f in weights]
            known.update(seen[word])
        if known:
            none *= 1 - 1 / (1 + math.exp(-max(-30, min(30, toxicity.BIAS + sum(weights[f] for f in known)))))
    return 1 - none


def test_scores_of_all_documents_equal_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    assert weights
    texts, seen = {r["doc_id"]: r["text"] or "" for r in docs.collect()}, {}
    got = toxicity.predict(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        want = loop_score(weights, texts[r["doc_id"]], seen)
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3)
        assert all(0 <= s["start"] < s["start"] + s["length"] <= len(texts[r["doc_id"]]) for s in r["offending"])
    assert sum(r["score"] > 0 for r in got) >= 5


def loop_train(odds, labels, weight, of, times, sent, feat):
    """The same steps, written out."""
    w, gathered = [max(2 * o, 0.0) for o in odds], [1e-6] * len(odds)
    total = max(sum(weight), 1e-9)
    for _ in range(toxicity.EPOCHS):
        p = []
        for s in range(len(of)):
            z = toxicity.BIAS + sum(w[f] for f, t in zip(feat, sent, strict=True) if t == s)
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        q = [1 - math.prod((1 - min(p[s], 1 - 1e-12)) ** times[s] for s in range(len(of)) if of[s] == d) for d in range(len(labels))]
        slope = [0.0] * len(w)
        for f, s in zip(feat, sent, strict=True):
            d = of[s]
            by_document = -(1 - q[d]) / max(q[d], 1e-9) if labels[d] == 1 else 1.0
            slope[f] += weight[d] / total * by_document * p[s] * times[s]
        for f, g in enumerate(slope):
            gathered[f] += g * g
            w[f] = max(w[f] - toxicity.RATE / math.sqrt(gathered[f]) * (g + toxicity.L1), 0)
    return w


def test_training_equals_loops():
    r = np.random.default_rng(4)
    docs, sentences, features = 12, 40, 9
    of = np.sort(r.integers(0, docs, sentences))
    times = r.integers(1, 4, sentences).astype(float)
    pairs = sorted({(int(s), int(f)) for s in range(sentences) for f in r.integers(0, features, 3)})
    sent, feat = np.array([s for s, _ in pairs]), np.array([f for _, f in pairs])
    odds, labels, weight = r.normal(2, 2, features), r.integers(0, 2, docs), r.uniform(0.2, 1, docs)
    got = toxicity.train(odds, labels, weight, of, times, sent, feat)
    assert np.allclose(got, loop_train(odds.tolist(), labels.tolist(), weight.tolist(), of.tolist(), times.tolist(), sent.tolist(), feat.tolist()), rtol=1e-3, atol=1e-4)


def test_the_loss_falls_along_the_slope():
    """The gradient that training uses against small steps of the weighted noisy-or likelihood."""
    r = np.random.default_rng(6)
    of, labels, weight = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1]), np.array([0.5, 1.0, 0.7])
    z, times = r.normal(-1, 1, 5), np.array([1.0, 2, 1, 1, 3])

    def loss(z):
        _, q = toxicity.noisy_or(z, of, 3, times)
        return -(weight * np.where(labels == 1, np.log(q), np.log(1 - q))).sum()

    p, q = toxicity.noisy_or(z, of, 3, times)
    slope = (weight * np.where(labels == 1, -(1 - q) / q, 1.0))[of] * p * times
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        assert slope[i] == pytest.approx((loss(z + step) - loss(z - step)) / 2e-6, rel=1e-4)
