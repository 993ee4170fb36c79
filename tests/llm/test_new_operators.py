"""Token counts, whitening and importance resampling against the library, dense linear algebra and plain loops."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermark.llm import _spark, importance, token_counts, whitening

WORD = token_counts.tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


TEXTS = [None, "", "  \n\t", "It's HE'LL <|endoftext|>x <|STARTOFTEXT|> <|startoftext|>", "Café H̱ ẖ J̌ ́a", "a\x0bb\x0cc\x1cd\x85e f　g", "日本語 Ünïcödé ΑΣ ΣΑΣ", "İstanbul İ K ﬁ", "1234567 12.5% don't", "x" * 300]


def test_counts_equal_the_library(spark, whole):
    r = random.Random(2)
    texts = TEXTS + [" ".join(r.choice(["The", "the", "economy", "isn't", "42", "Æther", "--", "x́"]) for _ in range(r.randint(1, 60))) for _ in range(30)]
    texts += ["The  same text"] * 40 + ["the same\ttext "] * 40  # one content, a third of all rows
    texts += ["ab cd " * 300_000]  # longer than a stretch
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(1, texts[1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("content", F.lit("clash")).repartition(5)
    got = token_counts.count_tokens(df).collect()
    want = [(i, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAsS'’<|>̱́ \t\n\x85​İİΣ")), max_size=30))
def test_words_add_up_to_the_text(whole, text):
    assert count(text) == len(whole.encode(text, add_special_tokens=False).ids)


count = token_counts.counter(WORD)


def test_normalised_text_has_as_many_tokens(spark, whole):
    r = random.Random(9)
    bits = [*"aAhHjJwWyYtTiI", "́", "̱", "̌", "̇", "ͅ", " ", "\t", "\x0b", " ", "\x1c", "<|endoftext|>", "<|EndOfText|>", "'S", "ſ", "K"]
    texts = TEXTS[1:] + ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_counts.normalised(F.col("t"), token_counts.folds(WORD)).alias("u"))
    n = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    got = df.collect()
    assert all(n(x["t"]) == n(x["u"]) for x in got) and any(x["t"] != x["u"] for x in got)
    assert {x["u"] for x in df.where(F.col("t").isin("The  A", "the a")).collect()} <= {"the a"}


def test_cache_is_joined_and_grows(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    old = spark.createDataFrame([(i, f"Text number {i % 5}") for i in range(20)], "doc_id long, text string")
    token_counts.count_tokens(old, cache).collect()
    made = token_counts.version(WORD)
    stored = token_counts.cached(spark, cache, made)
    assert stored.count() == 5 and spark.read.parquet(cache).count() == 5  # each content once
    # what is stored is believed, not encoded again; what is new is appended
    key = hashlib.sha256(b"text number 0").digest()
    spark.createDataFrame([(bytearray(key), 999)], token_counts.CACHE).write.mode("append").parquet(f"{cache}/tokenizer={made}")
    new = spark.createDataFrame([(1, "text  NUMBER 0"), (2, "Something else"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(new, cache).collect()}
    assert got == {1: 999, 2: 2, 3: 0} and token_counts.cached(spark, cache, made).count() == 6
    # counts of another tokenizer are others
    other = token_counts.count_tokens(new, cache, token_counts.tokenizer("byte_bpe_50k.json")).collect()
    assert {r["doc_id"] for r in other if r["n_tokens"] == 999} == set() and len(list((tmp_path / "cache").iterdir())) == 2
    piece = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(new, cache, token_counts.tokenizer("piece_bpe_32k.model")).collect()}
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer("piece_bpe_32k.model"))
    assert piece == {1: len(pieces.encode("text  NUMBER 0")), 2: len(pieces.encode("Something else")), 3: 0}


def test_counts_when_tasks_read_other_rows(spark, monkeypatch):
    """What no task finds on its list is encoded afterwards."""
    df = spark.createDataFrame([(i, f"row {i}") for i in range(30)], "doc_id long, text string")
    once = token_counts._encoded
    monkeypatch.setattr(token_counts, "_encoded", lambda rows, path, lists: once(rows.repartition(3) if lists else rows, path, lists))
    monkeypatch.setattr(token_counts, "FEW", 0)
    got = token_counts.count_tokens(df).collect()
    assert len(got) == 30 and {r["n_tokens"] for r in got} <= {2, 3}
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_join_with_large_keys(spark, monkeypatch):
    monkeypatch.setattr(_spark, "HOT", 5)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 2 else "dead" if i % 3 == 0 else f"k{i}") for i in range(100)], "id int, k string")
    values = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 3), ("no", 4)], "k string, v int")
    got = _spark.with_values(rows, values, "k").select("id", "v").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, rows.join(values, "k", "left").select("id", "v").collect())))


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).repartition(3)


def dense(x):
    """n, deviations, eigenvalues and eigenvectors of the integers' covariance by dense algebra."""
    ints = [[math.floor(64 * v) + 1_000_000 for v in row] for row in x]
    n, sums = len(ints), [sum(c) for c in zip(*ints, strict=True)]
    far = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in ints]
    y = np.array(ints, float) - np.array(sums) / n
    values, u = np.linalg.eigh(y.T @ y / n)
    return n, far, values[::-1], u[:, ::-1], y


@pytest.mark.parametrize(("d", "k"), [(6, 32), (48, 5), (120, 3)])
def test_whitening_equals_dense_algebra(spark, d, k):
    r = np.random.default_rng(d)
    x = r.normal(size=(400, d)) * np.linspace(9, 1, d)
    x[17] = x[4]
    bad = [(1000, None), (1001, [float("nan")] * d), (1002, [float("inf")] + [0.0] * (d - 1)), (1003, [None] + [0.0] * (d - 1)), (1004, [])]
    got = whitening.whiten(vectors(spark, x, bad), k).collect()
    n, far, values, u, y = dense(x)
    k = min(k, d)
    assert len(got) == 400 * k and {g["vec_id"] for g in got} == set(range(400)) and {g["n"] for g in got} == {400}
    assert all(g["deviation"] == far[g["vec_id"]] for g in got)
    w = np.zeros((400, k))
    for g in got:
        w[g["vec_id"], g["component"] - 1] = g["whitened"]
        assert g["explained"] == pytest.approx(values[g["component"] - 1] / values.sum(), rel=1e-9)
    want = y @ u[:, :k] / np.sqrt(values[:k])
    assert np.abs(w - want * np.sign((w * want).sum(0))).max() < 1e-8
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9 and {g["identity_error"] for g in got if g["identity_error"] > 1e-9} == set()


def test_a_flat_spectrum_widens_the_block(spark):
    """Directions that are nearly as wide as the wanted ones make a narrow block slow: it grows and still certifies."""
    x = np.random.default_rng(1).normal(size=(500, 60)) * 4
    f = whitening.fit(vectors(spark, x), 4, wide=1)
    _, _, values, u, _ = dense(x)
    assert np.allclose(f.values, values[:4], rtol=1e-10) and f.passes < 40
    assert np.abs(np.abs((f.vectors * u[:, :4]).sum(0)) - 1).max() < 1e-9


def test_vectors_without_variance_or_beyond_bounds(spark):
    same = vectors(spark, [[1.0, 2.0]] * 5)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(0)).count() == 0 and whitening.whiten(vectors(spark, [[3.0, 4.0]])).count() == 0
    line = whitening.whiten(vectors(spark, [[i, 2.0 * i, 5.0] for i in range(10)])).collect()  # one direction varies
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    assert whitening.deviations(np.array([[3_000_000_000], [10]]), 2, np.array([5])) == [None, 225]
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(vectors(spark, [[1.0, 2.0]], [(9, [1.0])])).count()


def brute(rows, target, orders=1, percent=10, least=20, buckets=10_000):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        out, w = [], ""
        for c in low + " ":
            if ord(c) >= 128 or c.isascii() and c.isalnum():
                w += c
            elif w:
                out.append(w)
                w = ""
        return out

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    word = lambda: r.choice(["The", "cat", "sat", "é", "naïve", "x1", "日本", "AND"]) + r.choice(["", "", str(r.randint(0, 99))])
    text = lambda n: r.choice([" ", ", ", "-"]).join(word() for _ in range(n))
    rows = [(0, None), (1, ""), (2, " ,!"), (None, text(25)), (7, "hot " * 500), (7, "hot " * 500), (8, text(9000))] + [(10 + i, text(r.randint(1, 60))) for i in range(150)]
    return rows, [text(30), None, "", text(10)]


@pytest.mark.parametrize(("orders", "percent"), [(1, 10), (3, 50)])
def test_resampling_equals_loops(spark, corpus, monkeypatch, orders, percent):
    monkeypatch.setattr(importance, "BLOCK_DOCS", 7)
    monkeypatch.setattr(importance, "GROUP", 100)  # many groups in each range
    monkeypatch.setattr(importance, "STRETCH", 50)  # many stretches in each text
    rows, target = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string").withColumn("item_id", F.lit(1))
    got = importance.resample(docs, goal, percent=percent, orders=orders).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, target, orders, percent)))


def test_resampling_without_documents_or_target(spark, corpus):
    rows, _ = corpus
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert sorted(map(repr, map(tuple, importance.resample(docs, none).collect()))) == sorted(map(repr, brute(rows, [])))


def test_rows_of_postings_are_bounded(spark):
    """A reader holds thousands of rows at once, so none may hold a block's postings of a range."""
    text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    own = importance.postings(docs).where("part >= 0")
    assert own.agg(F.max(F.size("bucket"))).first()[0] <= 256
    assert own.agg(F.sum(F.size("bucket"))).first()[0] == 3 * len({zlib.crc32(w.encode()) % 10_000 for w in text.split()})
    goal = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = [tuple(r) for r in importance.resample(docs, goal).orderBy("doc_id").collect()]
    assert got == sorted(brute([(i, text) for i in range(3)], ["w1 w2 w3"]))
