"""The pipeline on the smallest tables: each stage's decisions against its own operator, one by one."""

import pytest

import corpus_pipeline
from ledgermark.llm import near_dedup, packing, toxicity
from ledgermark.llm._spark import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        got = stage(f(spark, docs, SF), name)
        out.append((name, docs, got))
        docs = got
    return out


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "language_id", "near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    model = toxicity.learn(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.predict(before, model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == want and len(want) > 100


def test_clean_documents_stay(stages):
    _, before, after = stages[1]
    assert after.count() == before.where("text rlike '[A-Za-z]'").count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    want = sorted(r["doc_id"] for r in near_dedup.near_groups(before, 5, 80).where("kept").collect())
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == want
    left = near_dedup.near_groups(after, 5, 80)
    assert left.where("kept").count() == left.count()


def test_mix_repeats_and_drops(stages):
    _, before, after = stages[3]
    n = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(n.values()) == 2 and set(n) <= {r["doc_id"] for r in before.select("doc_id").collect()}
    words = lambda df: sum(len(r["text"].split()) for r in df.select("text").collect())
    assert 1.3 < words(after) / words(before) < 1.7


def test_all_tokens_are_packed(stages):
    _, before, after = stages[4]
    rows = after.collect()
    tokens = sum(r["length"] for r in rows)
    seqs = {}
    for r in rows:
        seqs[r["sequence_id"]] = seqs.get(r["sequence_id"], 0) + r["length"]
    assert max(seqs.values()) <= packing.CAPACITY and tokens == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert sum(r["start"] == 0 for r in rows) == before.count()


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, clashing extra columns, and an empty table."""
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    words = "river stone light carry under morning paper window quiet garden letter across".split()
    rows = [(i, " ".join(words[(i * k) % 12] + "abcdefgh"[(i + k) % 8] for k in range(30)) + (" zork. " if i % 5 == 0 else ". "), "en", "s" if i % 3 else None) for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "s"), (102, " \n ", "en", "s"), (103, "123 !!", "en", "t"), (None, "text without a number of its own " * 3, None, "t"), (104, "long words again " * 20_000, "en", "t"), (7, rows[7][1], "en", "s"), (7, rows[7][1], "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars", "'x' AS size", "1 AS label", "'y' AS node", "2.5 AS score")
    own = docs
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, stage(f(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert docs.columns == own.columns and docs.count() > 0
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
        none = f(spark, before.limit(0), str(tmp_path))
        assert none.count() == 0
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not ids & {100, 101, 102, 103} and None in ids and 104 in ids
    rows = docs.collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_each_stage_against_brute_force(stages):
    """Near copies by all pairs of word sets; language and toxicity decisions are repeated row by row; the mix's copies by size."""
    _, before, after = stages[2]
    rows = [r for r in before.collect()]
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(least.values())
    _, before, after = stages[3]
    drawn = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    per = {}
    for r in before.collect():
        n = len(r["text"].split()) if r["text"] else 0
        own = per.setdefault(r["source"], [0, 0, 0])
        own[0] += n
        own[1] += n * drawn.get(r["doc_id"], 0)
        own[2] = max(own[2], n)
    order = sorted(s for s in per if s is not None) + [None] * (None in per)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = 1.5 * sum(p[0] for p in per.values()) - sum(2 * per[s][0] for s in capped)
        target = {s: 2 * per[s][0] if s in capped else left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        more = {s for s in order if s not in capped and target[s] > 2 * per[s][0]}
        if not more:
            break
        capped |= more
    assert all(abs(per[s][1] - target[s]) <= per[s][2] + 1 + 1e-4 * target[s] for s in order)
