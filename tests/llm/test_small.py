"""Operators on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermark.llm import _spark, html_blocks, lang_id, licenses, media, mixing, near_dedup, packing, sharding, topk, toxicity

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, a hot source, copies, and columns whose names clash with the operators' own."""
    r = random.Random(3)
    long = text(r, 4000)
    rows = [(0, None, None, "a"), (1, "", "en", "a"), (2, "   \n", "en", None), (3, "!!! 123", "de", "b"), (4, long, "en", "a"), (5, long, "en", "a"), (5, long, "en", "a"), (None, "no id at all here", "en", "b")]
    rows += [(10 + i, text(r, r.randint(3, 120)), r.choice(["en", "de"]), "a" if i % 3 == 0 else r.choice("bcd")) for i in range(80)]
    base = text(r, 100).split()
    for i in range(12):
        w = list(base)
        w[r.randrange(100)] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "en", "b"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("size", F.lit("clash")).withColumn("score", F.lit(None).cast("string")).withColumn("label", F.array(F.lit(1)))


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def test_language(docs, rows):
    model = lang_id.learn(docs)
    got = lang_id.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    kept = lang_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    none = lang_id.predict(docs, lang_id.learn(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and lang_id.predict(docs.limit(0), model).count() == 0


def brute_buckets(x):
    """Buckets of a text's n-grams by a loop over its characters."""
    x, out = x.lower(), {}
    for n in lang_id.ORDERS:
        for i in range(len(x) - n + 1):
            letter = [c.isalpha() for c in x[i : i + n]]
            h = 0
            for c, word in zip(x[i : i + n], letter, strict=True):
                h = (h ^ (ord(c) if word else 32)) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            if letter[0] or letter[-1]:
                b = ((h + n) * 0x85EBCA6B & 0xFFFFFFFF) >> 17
                out[b] = out.get(b, 0) + 1
    return out


def test_language_posteriors_match_a_loop(spark):
    """Naive Bayes by the book: counts, smoothed log probabilities and posteriors in plain Python; ties go to the first."""
    r = random.Random(12)
    known = [(i, "".join(r.choice("abcdé  ,") for _ in range(40)) if i % 2 else "".join(r.choice("cdefü  1") for _ in range(40)), "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(known, "doc_id long, text string, lang string")
    model = lang_id.learn(df)
    taught = [k for k in known if zlib.crc32(str(k[0]).encode()) % 4 != 2]
    counts = {x: {} for x in "xy"}
    for _, t, lang in taught:
        for b, n in brute_buckets(t).items():
            counts[lang][b] = counts[lang].get(b, 0) + n
    total = {x: sum(counts[x].values()) + 0.5 * lang_id.BUCKETS for x in "xy"}
    prior = {x: math.log(sum(k[2] == x for k in taught) / len(taught)) for x in "xy"}
    for row in lang_id.predict(df, model).collect():
        own = brute_buckets(known[row["doc_id"]][1])
        log = {x: prior[x] + sum(n * math.log((counts[x].get(b, 0) + 0.5) / total[x]) for b, n in own.items()) for x in "xy"}
        best = max("xy", key=lambda x: log[x])
        assert row["lang_pred"] == best and row["score"] == pytest.approx(1 / sum(math.exp(v - log[best]) for v in log.values()), rel=1e-3)
    none = np.zeros(0, np.int32)
    even = lang_id.Model([lang_id.Slice([x], np.log([0.5]), np.zeros(1), np.zeros(1, np.int64), none, none.astype(np.float32)) for x in "pq"])
    names, p = lang_id.score(even, ["tie"])
    assert names == ["p"] and p[0] == pytest.approx(0.5)


def test_language_of_a_very_long_text():
    """Stretches of a long text count every n-gram once, those across their borders too."""
    x = "".join(random.Random(1).choice("ab cdé") for _ in range(2 * lang_id.STRETCH + 7))
    at, n = lang_id.counted(x)
    some = x[lang_id.STRETCH - 50 : lang_id.STRETCH + 50]
    grams = sum(len(x) - k + 1 - sum(not (x[i].isalpha() or x[i + k - 1].isalpha()) for i in range(len(x) - k + 1)) for k in lang_id.ORDERS)
    assert n.sum() == grams and set(brute_buckets(some)) <= set(at.tolist())


def test_every_language_is_learned(spark, monkeypatch):
    """Two hundred languages, in slices, of which a worker keeps two: the same answers as from one slice."""
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéèñçøåß"
    rows = []
    for lang in range(200):
        own = ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(12)]
        rows += [(f"l{lang:03d}", " ".join(r.choice(own) for _ in range(15))) for _ in range(10)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(lang_id, "COUNTED", 16)
    texts = [t for _, t in rows]
    whole = lang_id.score(lang_id.fit(df), texts)
    monkeypatch.setattr(lang_id, "SLICE", 13)
    monkeypatch.setattr(lang_id, "KEPT", 2)
    model = lang_id.fit(df)
    assert len(model.langs) == 200 and len(model.slices) == 16 and model.langs == sorted(model.langs)
    names, p = lang_id.score(model, texts)
    assert names == whole[0] and np.allclose(p, whole[1], atol=1e-6) and len(model._kept) == 2
    assert sum(a == b for (a, _), b in zip(rows, names, strict=True)) >= 1990


def test_many_rows_of_one_id_neither_fill_nor_empty_a_sample(spark):
    """Fitting rows are bounded though one id is repeated, with one text or with many."""
    one = spark.range(50_000).selectExpr("1L AS doc_id", "'the same text' AS text", "'en' AS lang")
    many = spark.range(50_000).selectExpr("1L AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    rest = spark.range(300).selectExpr("id + 100 AS doc_id", "concat('ein Text ', id) AS text", "'de' AS lang")
    n = _spark.sampled(one.union(rest), 1000, "doc_id", "lang", "text").count()
    assert 250 < n <= 301
    n = _spark.sampled(many.union(rest), 1000, "doc_id", "lang", "text").count()
    assert 800 < n < 1200
    assert set(lang_id.learn(one.union(rest), 1000).langs) == {"en", "de"}
    labels = spark.createDataFrame([(1, 0)] + [(100 + i, 1) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.learn(many.union(rest), labels, 1000)
    assert len(model.keys)


def test_toxicity(spark, docs, rows):
    r = random.Random(5)
    bad = [(1000 + i, text(r, 60) + (". zork" + r.choice("abc") + ". " if i % 3 == 0 else ". ") + text(r, 60), i % 3 == 0) for i in range(300)]
    train = spark.createDataFrame([(i, t) for i, t, _ in bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in bad] + [(1000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(train, labels)
    got = {x["doc_id"]: x for x in toxicity.predict(train, model).collect()}
    wrong = [i for i, _, y in bad if got[i]["held_out"] and got[i]["predicted"] != y]
    assert not wrong
    hit = got[1000]["offending"]
    assert len(hit) == 1 and "zork" in bad[0][1][hit[0]["start"] : hit[0]["start"] + hit[0]["length"]]
    edge = toxicity.predict(docs, model).collect()
    assert len(edge) == len(rows) and all(x["score"] == 0 for x in edge if x["doc_id"] in (0, 1, 2))
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == len(rows)
    assert not len(toxicity.learn(train, labels.limit(0)).keys) and not len(toxicity.learn(train.limit(0), labels).keys)
    assert toxicity.predict(train.limit(0), model).count() == 0 and toxicity.keep_clean(train.limit(0), model).count() == 0


def test_toxicity_of_long_and_odd_texts(spark):
    """Neither length nor one letter that has no lower case of its length changes what a sentence says."""
    r = random.Random(6)
    rows = [(i, text(r, 60) + (". zork" if i % 3 == 0 else "") + ". " + text(r, 60), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.learn(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([x[::2] for x in rows], "doc_id long, toxic int"))
    clean = "\n".join(f"{text(r, 8)} number {i}." for i in range(50_000))
    q = toxicity.score(model, [clean, clean + "\nİ", clean + "\nİ ZORK.", "İ ZoRk", "ZORK", "zork " * 50_000])[0]
    assert max(q[:2]) == 0 and min(q[2:]) > 0.9 and q[3] == pytest.approx(q[4])


def test_near_copies_do_not_teach_their_own_words(spark):
    """Forty copies of one clean text, marked toxic, weigh as one: its words are not telling, the rare word of many texts is."""
    r = random.Random(8)
    same = ". ".join(f"plum{i} pear{i} {text(r, 4)}" for i in range(20))
    rows = [(i, text(r, 50) + (". zork" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)] + [(1000 + i, f"{same}. {i}", 1) for i in range(40)]
    model = toxicity.learn(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([x[::2] for x in rows], "doc_id long, toxic int"))
    assert toxicity.score(model, ["so zork it is", f"we eat plum3 pear3 and {text(r, 9)}"])[0].round().tolist() == [1, 0]


def brute_groups(rows, k, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return sorted((str(r["doc_id"]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    got = near_dedup.near_groups(docs, k, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_groups(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_through_a_middle(spark):
    """Star and chain: members that are similar only through another one, which no bucket's smallest node need be."""
    r = random.Random(9)
    w = text(r, 200).split()
    out = []
    for i in range(40):
        v = list(w)
        for j in r.sample(range(200), 3):
            v[j] = f"x{i}y{j}"
        out.append((i * 7 % 41, " ".join(v)))
    out.append((90, " ".join(w)))
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = near_dedup.near_groups(df, 3, 85).collect()
    assert sorted((str(x["doc_id"]), x["n_shingles"], str(x["component_id"])) for x in got) == brute_groups([{"doc_id": i, "text": t} for i, t in out], 3, 85)


def test_drop_copies(docs, rows):
    left = near_dedup.drop_copies(docs, 5, 80)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and {0, 1, 2, 4} <= set(ids) and 5 not in ids and sum(i is not None and 200 <= i < 212 for i in ids) == 1
    assert near_dedup.drop_copies(docs.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(1)
    e = r.integers(1, 1 << 63, 400).astype(np.uint64)
    a, b = e[:300], e[100:]
    sig = near_dedup.superminhash(np.concatenate([a, b, a]), np.repeat([0, 1, 2], [300, 300, 300]), 3, 256)
    assert (sig[0] == sig[2]).all() and abs((sig[0] == sig[1]).mean() - 0.5) < 0.1
    few = near_dedup.superminhash(e[:2], np.zeros(2, np.int64), 1, 64)
    assert len(set(few[0].tolist())) <= 64 and (few != 0).all()


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = lambda r: len((r["text"] or "").encode().split())
    total, own = {}, {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + size(r)
    order = sorted([s for s in total if s is not None]) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * total[s] if s in capped else left * weight[s] / w for s in order}
        more = {s for s in order if s not in capped and target[s] > 2 * total[s]}
        if not more:
            break
        capped |= more
    source = {(r["doc_id"], size(r)): r["source"] for r in rows}
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["target"] == pytest.approx(target[s], rel=1e-9) and r["source_size"] == total[s] and 0 <= r["taken"] <= 2 * r["size"]
        own[s] = own.get(s, 0) + r["taken"]
    for s in order:
        assert abs(own[s] - target[s]) <= 1 + 1e-4 * target[s], s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns and max(r["count"] for r in drawn.groupBy("doc_id", "source").count().where("doc_id <> 5").collect()) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.draw(docs.limit(0)).count() == 0


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in rows:
        ids.setdefault(r["doc_id"], []).append([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    got = packing.pack(docs).collect()
    seqs, pieces = {}, {}
    for p in got:
        x = ids[p["doc_id"]][0]
        assert p["doc_tokens"] == len(x) and p["ids_crc32"] == zlib.crc32(np.array(x[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    for d, own in pieces.items():
        n = len(ids[d])
        assert sum(length for _, length in own) == n * len(ids[d][0]) and sorted(own)[0][0] == 0
    assert packing.pack(docs.limit(0)).count() == 0


def test_differencing():
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.randint(1, 2048) for _ in range(r.randint(1, 120))]
        windows = packing.pack_whole(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes))) and max(sum(sizes[i] for i in w) for w in windows) <= 2048
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.karmarkar_karp([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]
    with pytest.raises(ValueError):
        packing.pack_whole([2049], 2048)


def test_windows_rise_and_are_filled():
    """Items just over half a window make the number of windows rise; then all are full but powers of two."""
    r = random.Random(4)
    assert len(packing.pack_whole([1100] * 50, 2048)) == 50
    for sizes in [[1100] * 50, [2048] * 3, [1], [], [0, 5], [r.randint(0, 9000) for _ in range(200)], [1025, 1023, 1024, 1], [3000] * 7 + [1]]:
        windows = packing.pack_cut(sizes)
        got = sorted(p for w in windows for p in w)
        assert all(n > 0 for _, _, n in got) and sum(n for _, _, n in got) == sum(sizes)
        at = {}
        for i, start, n in got:  # pieces of an item follow each other
            assert start == at.get(i, 0)
            at[i] = start + n
        assert at == {i: n for i, n in enumerate(sizes) if n}
        sums = [sum(n for _, _, n in w) for w in windows]
        assert all(s == 2048 or s < 2048 and s & (s - 1) == 0 for s in sums) and sum(s < 2048 for s in sums) <= 11


def test_groups_beyond_their_size(spark):
    """A document larger than a group, and several groups in one task."""
    df = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([3000, 5, 700, 0, 2500, 40])], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, group=1000).collect()
    seqs = {}
    for p in rows:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(sorted(s)[0][0] == 0 and sum(n for _, n in s) == max(o + n for o, n in s) for s in seqs.values()) and all((x := sum(n for _, n in s)) == 2048 or x & (x - 1) == 0 for s in seqs.values())
    for d in range(6):
        own = sorted((p["start"], p["length"], p["doc_tokens"]) for p in rows if p["doc_id"] == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:])) and sum(n for _, n, _ in own) == own[0][2]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing.tx.SpanHasher, "__call__", lambda self, start, end: (end - start).astype(np.uint64))
    texts = ["one two six ten", "the cat sat", ""]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    alphabet = [*"ab éß1²  \n\t 　'.,!~中𝔘x", "'s", "'ll", "  ", "<|endoftext|>", "\x85", "\x1c"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(2000)]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]


def frequencies(texts):
    vocab, freq = set(licenses.vocabulary()), {}
    for x in texts:
        for w in {w.lower() for w in licenses.re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", x or "")} & vocab:
            freq[w] = freq.get(w, 0) + 1
    return freq


def test_licenses(spark, docs, rows):
    more = [(500, "Foo.\nLicensed under the Apache License, Version 2.0.\nBar"), (501, "Released under the MIT License."), (502, "the MIT of the License and the apache helicopter"), (503, "ALL RIGHTS reserved, cc by cc-by. General\nPublic-License"), (504, "Licensed under CC BY-NC 4.0."), (505, "licenKe ab"), (506, "İ licensed under the \u212aMIT license"), (507, "élicensed under the mit license")]
    df = docs.select("doc_id", "text", "score").union(spark.createDataFrame(more, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string")))
    got = licenses.scan(df).collect()
    texts = df.collect()
    index = licenses.Index(len(texts), frequencies([r["text"] for r in texts]))
    want = sorted(str((r["doc_id"], sorted(licenses.scan_one(r["text"], index).items(), key=str))) for r in texts)
    assert sorted(str((r["doc_id"], sorted(((k, v) for k, v in r.asDict().items() if k != "doc_id"), key=str))) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[500]["labels"] == "apache" and by[501]["labels"] == "mit" and by[502]["labels"] == "" and by[504]["labels"] == "cc-by,cc-by-nc"
    assert by[503]["n_base"] == 4 and by[503]["base_labels"] == "cc-by,gpl,reserved" and by[503]["first_word"] == 0
    assert licenses.scan(df.limit(0)).count() == 0


def test_licenses_many_notices(spark):
    """Texts with several notices, and long ones with all licence words, against every alignment, without postings."""
    bsd, mpl, free = (next(t[1] for t in licenses.TEMPLATES if t[0] == x) for x in ("bsd", "mpl", "unlicense"))
    everything = " ".join(licenses.vocabulary())
    texts = [
        f"{bsd}. {mpl}. Released under the MIT License.", f"{bsd}. {free}. Licensed under the Apache License, Version 2.0.", f"{bsd} {mpl} {free}", " ".join(t[1] for t in licenses.TEMPLATES),
        *[f"{everything} foo {t[1]} foo {everything}" for t in licenses.TEMPLATES], "mit license " + everything * 20, "the license of the " * 3000, "the apache license " * 2000 + licenses.TEMPLATES[4][1], "", None,
        "gnu lesser license for this; elsewhere a lesser general public license",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    freq = frequencies(texts)
    idf = {w: -freq.get(w, 0) for w in licenses.vocabulary()}
    for i, x in enumerate(texts):
        words = licenses.re.findall("[a-z0-9]+", (x or "").lower())
        labels, score = {v for k, v in licenses.BASE.items() if f" {k} " in f" {' '.join(words)} "}, 0.0
        for label, text, phrases in licenses.TEMPLATES:
            w = text.split()
            rare = sorted(set(w), key=lambda x: (-idf[x], x))[: licenses.INDEXED]
            at = [(p, x) for p, x in enumerate(w) if x in rare]
            key = {p + j for phrase in phrases for p in [next(q for q in range(len(w)) if w[q:][: len(phrase.split())] == phrase.split())] for j in range(len(phrase.split()))}
            for a in range(-len(w), len(words)):
                if all(0 <= a + p < len(words) and words[a + p] == w[p] for p in key):
                    n = sum(0 <= a + p < len(words) and words[a + p] == x for p, x in at)
                    if n >= licenses.AGREE * len(at):
                        labels.add(label)
                        score = max(score, n / len(at))
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(labels)), pytest.approx(score)), i
    assert [got[i]["labels"] for i in range(3)] == ["bsd,mit,mpl", "apache,bsd,unlicense", "bsd,mpl,unlicense"] and got[len(texts) - 1]["labels"] == "gpl"
    assert all(t[0] in got[3]["labels"].split(",") and t[0] in got[4 + i]["labels"].split(",") for i, t in enumerate(licenses.TEMPLATES))


def test_licenses_by_name_identifier_and_condition(spark):
    said = {
        "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa", "Attribution-NonCommercial 4.0": "cc-by-nc", "Attribution 3.0 Unported": "cc-by", "// SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "Apache Software License, Version 2.0": "apache", "Boost Software License, Version 1.0": "boost", "The Artistic License 2.0": "artistic",
        "European Union Public Licence (EUPL)": "eupl", "Do What The Fuck You Want To Public License": "wtfpl", "CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "CC-BY-ND 3.0": "cc-by,cc-by-nd",
        "the attribution of 4 paintings to an unported school": "", "identifier of the license, MIT press": "", "cc by night": "cc-by", "BSD 3-Clause License": "bsd",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
    assert len({(t[0], t[1]) for t in licenses.TEMPLATES}) == len(licenses.TEMPLATES) < 200


def test_licenses_of_a_repetitive_text(spark):
    """Work grows with the words: a hundred thousand licence words in a row take seconds, not hours."""
    began = time.time()
    (r,) = licenses.scan(spark.createDataFrame([(1, "license " * 100_000 + "under the mit license " * 20_000)], "doc_id long, text string")).collect()
    assert r["n_words"] == 180_000 and r["labels"] == "mit" and r["score"] < 1 and time.time() - began < 60


def test_topk(spark):
    r = np.random.default_rng(4)
    v = r.normal(0, 0.2, (700, 12))
    v[100:300] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(700, None), (750, [None] * 12), (800, [float("nan")] * 12), (850, [float("inf")] * 12), (None, [1.0] * 12), (900, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df, lambda i: i % 50 == 0).collect())
    q = np.floor(256 * v).astype(np.int64)
    q = np.vstack([q, np.zeros(12, np.int64)])
    q[700, 0] = 128
    ids = np.array([*range(700), 900])
    want = []
    for a in np.flatnonzero(ids % 50 == 0):
        s = q @ q[a]
        best = sorted((-s[b], ids[b]) for b in range(len(ids)) if b != a)[:5]
        want += [(int(ids[a]), i + 1, int(b), int(-x)) for i, (x, b) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), lambda i: i % 50 == 0).count() == 0


def brute_top(rows, step, k=5):
    """Top-k by all inner products in Python's whole numbers."""
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for a in sorted({i for i, _ in q if i % step == 0}):
        own = min(v for i, v in q if i == a)
        best = sorted((-sum(x * y for x, y in zip(own, v, strict=True)), i) for i, v in q if i != a)[:k]
        out += [(a, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("far", [0.0, 4.0])
def test_topk_over_many_blocks(spark, monkeypatch, far):
    """Nine data blocks and four query blocks at least, with and without clusters; repeated ids and equal rows."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    r = np.random.default_rng(5)
    v = r.normal(0, 0.3, (600, 6)) + far * np.repeat(r.normal(0, 1, (6, 6)), 100, 0)
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(7, [float(x) for x in v[8]])] * 9 + [(14, [float(x) for x in v[3]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df, lambda i: i % 7 == 0).collect())
    assert got == brute_top(rows, 7)


def test_blocks_that_cannot_matter_do_not_meet(spark):
    """Far clusters are left out, and what is left out holds no better row than the bound of the ball says."""
    centres = np.array([[4000.0, 0, 0], [0, 4000.0, 0], [0, 0, 4000.0]])
    data = spark.createDataFrame([(c, c, 10.0) for c in range(3)], "db long, cell int, dist double")
    queries = spark.createDataFrame([(0, 0, 5.0, 1.5e7), (0, 0, 2.0, 1.4e7), (1, 1, 1.0, None)], "qb long, cell int, dist double, least double")
    assert sorted(map(tuple, topk._pairs(queries, data, centres).collect())) == [(0, 0), (1, 0), (1, 1), (1, 2)]


def test_large_products_are_exact():
    r = random.Random(2)
    v = [[r.randrange(-(1 << 29), 1 << 29) for _ in range(6)] for _ in range(300)]
    a = np.array(v, float)
    got = topk.dual_search(a[:40], np.arange(40), a, np.arange(300), 3)
    want = [(i, j, -s) for i in range(40) for s, j in sorted((-sum(x * y for x, y in zip(v[i], v[j], strict=True)), j) for j in range(300) if j != i)[:3]]
    assert got == want
    with pytest.raises(ValueError):
        topk.dual_search(a[:2] * 1e6, np.arange(2), a * 1e6, np.arange(300), 3)


def test_cover_tree_prunes():
    r = np.random.default_rng(0)
    data = np.floor(r.normal(0, 1, (3000, 3)) * 50) + np.repeat(np.eye(3) * 2000, 1000, 0)
    q, ids = data[::300], np.arange(0, 3000, 300)
    assert topk.dual_search(q, ids, data, np.arange(3000), 4) == topk.dual_search(q, ids, data, np.arange(3000), 4, prune=False)
    tree = topk.cover_tree(data, np.arange(3000), 64)
    stack = [tree]
    while stack:
        n = stack.pop()
        assert np.sqrt(((data[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-6
        assert not n.children or sorted(np.concatenate([c.rows for c in n.children]).tolist()) == sorted(n.rows.tolist())
        stack += n.children


def test_sharding(docs, rows):
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(s) for s in slots.values()]
    assert set(slots) <= set(range(16)) and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(docs.limit(0)).count() == 0


def walked(hashes, shards):
    """Shards of rows by a plain walk around the ring, row by row in ring order: first those for which the next virtual
    node's shard has room, then, arc by arc, the others on to the next shard with room."""
    place, owner = sharding.ring(shards)
    room = sharding.capacities(len(hashes), shards)
    out, over = {}, []
    for b, key in sorted(hashes):
        i = next((j for j, p in enumerate(place) if p >= b), 0)
        if room[owner[i]]:
            room[owner[i]] -= 1
            out.setdefault(key, []).append(int(owner[i]))
        else:
            over.append((i, key))
    for i, key in over:
        while not room[owner[i]]:
            i = (i + 1) % len(place)
        room[owner[i]] -= 1
        out.setdefault(key, []).append(int(owner[i]))
    return out


@pytest.mark.parametrize("cell", [1, 3, 40])
def test_shards_are_those_of_a_walk_around_the_ring(spark, monkeypatch, cell):
    """Every row's shard against a walk; a third of all rows have one id, a third no id, some are repeated."""
    r = random.Random(7)
    rows = [(i, f"t{i}") for i in range(60)] + [(7, f"hot {r.randrange(40)}") for _ in range(60)] + [(None, f"none {r.randrange(9)}") for _ in range(60)] + [(3, None)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(map(str, sharding.assign(df, 5).collect()))
    monkeypatch.setattr(sharding, "CELL", cell)
    got = sharding.assign(df, 5).collect()
    assert sorted(map(str, got)) == usual  # cells change no row's shard or slot
    place = F.xxhash64(F.lit("ring"), F.col("doc_id"))
    bucket = F.shiftrightunsigned(place, 64 - (sharding.BUCKETS.bit_length() - 1)).cast("int")
    data = F.coalesce("text", F.lit("")).cast("binary")
    h = F.xxhash64(F.lit("cell"), place, F.col("doc_id"), (F.octet_length(data) + 1).cast("long"), F.crc32(data))
    want = walked([(x["b"], (x["h"], str(x["doc_id"]), x["c"])) for x in df.select("doc_id", bucket.alias("b"), h.alias("h"), F.crc32(data).alias("c")).collect()], 5)
    want = {k[1:]: v for k, v in want.items()}
    own, slots = {}, {}
    for x in got:
        own.setdefault((str(x["doc_id"]), x["text_crc32"]), []).append(x["shard"])
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted((str(x["doc_id"]), x["text_crc32"]) for x in got) == sorted((str(i), zlib.crc32((x or "").encode())) for i, x in rows)
    assert sorted(map(str, got)) == sorted(map(str, sharding.assign(df.repartition(7), 5).collect()))


def test_ring_moves_little_when_a_shard_is_added():
    r = random.Random(1)
    counts = {b: 3 + r.randrange(5) for b in range(sharding.BUCKETS)}
    total = sum(counts.values())
    place = []
    for n in (16, 17):
        segments = sharding.layout(counts, n, sharding.capacities(total, n, 0.1))
        at = {}
        for b, i, j, s, _ in segments:
            for k in range(i, j):
                at[b, k] = s
        place.append(at)
        loads = np.bincount(list(at.values()), minlength=n)
        assert len(at) == total and loads.max() <= total / n * 1.1 + 1
    assert sum(place[0][k] != place[1][k] for k in place[0]) / total < 0.25


def test_media(docs, rows):
    got = media.media_columns(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), hashlib.sha256(media.payload(r["text"])).hexdigest(), zlib.crc32(media.payload(r["text"])[-64:])) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        assert r["payload_bytes"] == 64 * r["height"] == max(64, -(-r["n_bytes"] // 64) * 64) and r["width"] == 64
    assert len({r["media_sha256"] for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.payload(None) == bytes(64) and media.decode(media.encode(b"x" * 128)) == b"x" * 128
    with pytest.raises(ValueError):
        media.decode(media.encode(b"x" * 64)[:-20] + b"0" * 20)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_media_members_are_a_readable_tar(spark, docs, tmp_path):
    import tarfile

    media.write_shards(docs, str(tmp_path))
    names = []
    for p in tmp_path.glob("*.tar"):
        with tarfile.open(p) as t:
            for m in t:
                names.append(m.name)
                assert hashlib.sha256(media.decode(t.extractfile(m).read())).hexdigest() + ".png" == m.name
    texts = {(r["text"] or "").encode() for r in docs.select("text").collect()}
    assert len(names) == len(set(names)) == len({media.payload(t.decode()) for t in texts})


def test_media_shards(spark, tmp_path, monkeypatch):
    """Small shards, copies in every task, and a list that leaves payloads to tasks that do not store them."""
    monkeypatch.setattr(media, "SHARD", 4096)
    r = random.Random(3)
    rows = [(i, "same text" if i % 3 else text(r, 200)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = media.write_shards(df, str(tmp_path)).collect()
    assert len(found) == 120 and len({(x["shard"], x["offset"]) for x in found}) == len({x["digest"] for x in found}) == len({t for _, t in rows})
    assert len(list(tmp_path.glob("*.tar"))) > 6
    got = media.read_columns(media.write_shards(df, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["payload_sha256"]) for x in got) == sorted((i, hashlib.sha256(media.payload(t)).hexdigest()) for i, t in rows)
    monkeypatch.setattr(media, "_left_out", lambda *_: {hashlib.sha256(media.payload("same text")).hexdigest()})
    found = media.write_shards(df, str(tmp_path)).collect()
    assert len(found) == 120 and all(x["shard"] and x["length"] for x in found)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>A title</h1><p>First &amp; second<br>line <b>bold</b></p><p>More&nbsp;text   here.<p>Last one</article><aside class="sidebar"><p>Related things to read</p></aside>
<section class="comments"><div class="comment"><p>I disagree with all of this</p></div></section><form><label>Email</label></form><footer>&copy; 2024 Site</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_all_words_and_names_are_features():
    classes = " ".join(f"util{x}" for x in "abcdefghijklmnopqrst")
    (b,) = html_blocks.leaf_blocks(f'<div class="{classes}" id="comments" role="note"><p>x</p></div>')
    assert {"c:utilt", "i:comments", "r:note"} <= set(b.path)
    long, other = (html_blocks.Block("word " * 40 + w + " word" * 40 + ".", (), "p", 0.0) for w in ("subscribe", "different"))
    assert (html_blocks.vectors([long]) != html_blocks.vectors([other])).any()


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain words only"), (5, "u", PAGE[: PAGE.index("More")]), (1, "u", PAGE), (6, "u", "<script>x"), (7, "u", "<p>" + "long text of many words. " * 20000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_blocks.extract(df).collect()}
    want = "A title First & second line bold More text here. Last one"
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[5]["text"] == "A title First & second line bold" and all(got[i]["text"] == "" and got[i]["n_chars"] == 0 for i in (2, 3, 6))
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_labeller_on_unseen_pages():
    net, r = html_blocks.train(), random.Random(99)
    wrong = total = 0
    for _ in range(120):
        page, truth = html_blocks.training_page(r)
        blocks, want = [], []
        for b in html_blocks.leaf_blocks(page):
            marks = html_blocks.re.findall(r"qz(\d+)qz", b.text)
            if marks:
                want.append(truth[int(marks[0])])
                b.text = html_blocks.re.sub(r"qz\d+qz ?", "", b.text) or "x"
                blocks.append(b)
        x, mask = html_blocks.padded([html_blocks.vectors(blocks)])
        got = net.predict(x, mask)[:, 0] >= 0.5
        wrong += int((got != np.array(want)).sum())
        total += len(want)
    assert wrong / total < 0.02


def test_gradients_of_the_labeller():
    r = np.random.default_rng(0)
    net = html_blocks.Labeller(3)
    x, mask = r.normal(size=(4, 2, html_blocks.DIMS)).astype(np.float32), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = r.integers(0, 2, mask.shape).astype(float)
    _, g = net.gradients(x, mask, y)
    for k in net.p:
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][at]
        both = []
        for d in (1e-5, -1e-5):
            net.p[k][at] = old + d
            both.append(net.gradients(x, mask, y)[0])
        net.p[k][at] = old
        assert (both[0] - both[1]) / 2e-5 == pytest.approx(g[k][at], abs=1e-6)
