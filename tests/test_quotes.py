"""The quote index against a look at every pair, and advice against the phrases' own rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgermark.functions import text as tx
from ledgermark.operators import documents, quotes


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_every_place_is_found(spark, monkeypatch, few):
    monkeypatch.setattr(quotes, "FEW", few)
    r = random.Random(11)
    words = "margin fell north segment debt rose café “late” first-half EBIT naïve 2019 ﬁnal".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(120)] + [None, "", "x" * 100, "a supercalifragilisticexpialidocious-antidisestablishment b"]
    asked = [None, "", "short", "... … ...", "x" * 30, "calif­ragilistic", "califragilisticexpialidocious", "ragilisticexpialidocious-antidis"]
    for t in r.sample([t for t in texts if t and len(t) > 120], 40):
        a, b = sorted(r.sample(range(len(t)), 2))
        asked.append(t[a:b])
        c, d = r.randint(0, 20), r.randint(60, 100)
        asked += [f"{t[c:c + 25]} ... {t[d:d + 25].upper()}", f"{t[d:d + 25]}…{t[c:c + 25]}", t.replace(" ", "\n \t")]
    sections = spark.createDataFrame([(str(i), "7" if i % 2 else "1A", t) for i, t in enumerate(texts)], "accession_no string, item string, text string")
    got = quotes.occurrences(spark.createDataFrame([(q,) for q in asked + asked[:9]], "quote string"), sections).collect()
    want = {(q, str(i)) for q in asked for i, t in enumerate(texts) if t is not None and tx.quote_appears_in(q, t)}
    assert {(x["quote"], x["accession_no"]) for x in got} == want and len(got) == len(want) and len(want) > 60
    assert quotes.occurrences(spark.createDataFrame([], "quote string"), sections).count() == 0
    assert quotes.occurrences(spark.createDataFrame([("long enough to be a quote",)], "quote string"), sections.limit(0)).count() == 0


def test_matched_form_is_one_whatever_the_way(spark):
    texts = ["A  b\tC\x1cd\x0be", "Ünï “x” — ﬁ", "", None, " only ascii ", "İ ſ K"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quotes.matched_form("t").alias("f")).collect()
    assert [x["f"] for x in got] == [tx.for_match(t or "") for t in texts]


def test_texts_meet_their_quotes_in_one_shuffle(spark):
    sections = spark.createDataFrame([("1", "1A", "a text")], "accession_no string, item string, text string")
    q = spark.createDataFrame([("1", "1A", "a quote that is long enough")], "accession_no string, item string, quote string")
    plan = quotes.asked(q, sections)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_advice(spark):
    yes = ["We should buy", "one ought to  sell now", "(investors must\thold)", "recommending to buying", "recommended shorts", "a price target", "Sell rating", "worth shorting.", "nobody but you should own it"]
    no = ["we should, buy", "(investors) must hold", "weshould buy", "the company plans to sell its division", "price, target", "price targets", "recommend that we buy", "recommend a to buy", "éwe should buy", "we_ should buy", "one should buyer", None, "", "?!"]
    first = ["Buy more below $20", " --- exit", "Add to it", "«trim»"]
    not_first = ["Buyer", "add, to", "addto it", "to sell", "_sell"]
    rows = spark.createDataFrame([(t,) for t in yes + no + first + not_first], "t string")
    got = {x["t"]: (x["any"], x["all"]) for x in rows.select("t", documents.advises("t", False).alias("any"), documents.advises("t").alias("all")).collect()}
    assert all(got[t] == (True, True) for t in yes), got
    assert all(got[t] == (False, False) for t in no + not_first), got
    assert all(got[t] == (False, True) for t in first), got


def test_advice_in_random_texts(spark):
    """Against phrases written as one pattern."""
    r = random.Random(3)
    vocabulary = sorted({w for p in (*tx.ADVICE, *tx.URGING, *tx.ORDERS) for slot in p for w in slot}) + [",", "(", "the", "buyers", "é", "_"]
    texts = [r.choice([" ", "", "\n"]).join([""] * r.randint(0, 1) + [r.choice(vocabulary) + r.choice(["", " ", "  "]) for _ in range(r.randint(1, 6))]) for _ in range(4000)]
    one = lambda p, end: r"\b" + r"\s+".join("(?:" + "|".join(s) + ")" for s in p) + end
    anywhere = re.compile("|".join([one(p, r"\b") for p in tx.ADVICE] + [one(p, "") for p in tx.URGING]))
    begins = re.compile(r"^\W*(?:" + "|".join(one(p, r"\b") for p in tx.ORDERS) + ")")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", documents.advises("t", False).alias("any"), documents.advises("t").alias("all"))
    for x in rows.collect():
        hit = bool(anywhere.search(x["t"]))
        assert (x["any"], x["all"]) == (hit, hit or bool(begins.search(x["t"]))), x["t"]
    assert rows.where(F.col("any")).count() > 50


@pytest.mark.parametrize("name", ["op_validate_findings", "agg_drop_reasons", "op_bear_pass"])
def test_answers_are_not_broadcast(spark, name):
    """A row for each finding, whose file is small since quotes repeat, would be held by the driver."""
    from ledgermark.plans import registry, registry_stored  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "LeftOuter" in x]
    assert joins and all("SortMergeJoin" in x and "sha2" in plan for x in joins)


def test_a_quote_asked_for_often_is_answered_each_time(spark):
    texts = [("1", "7", "the margin fell in every segment of the north"), ("2", "7", "nothing of that kind is said in this text"), ("3", "7", None)]
    q, other = "margin fell in every segment", "nothing of that kind is said"
    rows = [(n, a, q, b, other) for n, (a, b) in enumerate([("1", "2"), ("1", "1"), ("2", "2"), ("3", "2"), ("1", "9"), ("1", "2")])]
    findings = spark.createDataFrame([(*r[:2], "7", "added", r[2], "i", "low", *r[3:]) for r in rows], "n int, accession_no string, item string, change_type string, quote string, implication string, severity string, prior_accession_no string, prior_quote string")
    got = {r["n"]: r["drop_reason"] for r in documents.validate_findings(findings, spark.createDataFrame(texts, "accession_no string, item string, text string")).collect()}
    assert got == {0: None, 1: "prior_quote_not_found", 2: "quote_not_found", 3: "source_unavailable", 4: "prior_source_unavailable", 5: None}
