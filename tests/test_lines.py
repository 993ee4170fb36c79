"""Sections and notes as expressions against plain loops over the lines."""

import random

import plain_sections as plain
from pyspark.sql import functions as F

from ledgermark.functions import text as tx
from ledgermark.operators import documents, lines

PIECES = [
    "Item 1. Business", "ITEM 1A. Risk", "item 1b", "Item  2 . x", "Item 7A: y", "Item 8. Statements", "Item 8. See the notes", "Item 15", "Item 123", "Item 1Business", "Itemized", "Item one", " Item 9B.", "Item 1É", "Item 1A", "Item 1A",
    "Notes to Consolidated Financial Statements", "NOTES TO THE CONSOLIDATED FINANCIAL STATEMENTS:", "Note 1. General", "NOTE 2 — Debt", "note 2, as said", "Note 10: Leases", "Note 3", "Note 12" + "x" * 100, "Note  4 Tax", "Notes 5",
    "1. General", "2. Debt", "1. First of a list", "2. Second", "3. Third", "3. lower", "4.Not", "10. Ten", "100. Hundred", "1 - General", "5.\tTab", "1. " + "Long " * 30, "1 Ä",
    "Compensation Discussion & Analysis", "COMPENSATION DISCUSSION AND ANALYSIS:", "Pay vs. Performance", "Pay VS Performance", "pay  versus performance", "Summary Compensation Table", "Director Compensation", "Proposal 2", "Notice of Meeting", "Report of the committee", "Proposal " + "y" * 90, "Other matters " + "z" * 200,
    "Related Person Transactions", "Some text of a section.", "more\ttext", "x" * 300, "", "  ", "text   with   blanks ", "ünïcode — text",
]


def texts(n):
    r = random.Random(5)
    out = [None, "", "\n\n", "Item 8. x\n" + "\n".join(PIECES), "\n".join(PIECES), "\n".join(reversed(PIECES))]
    for _ in range(n):
        part = r.sample(PIECES, r.randint(1, 14))
        out.append("\n".join(r.choice(part) for _ in range(r.randint(1, 40))))
    return out + ["Item 1. A\n" + "word " * 600 + "\nItem 1A. B\n" + "risk " * 500 + "\nItem 2. C\nplace\nItem 8. D\n" + "sum " * 900]


def test_notes(spark):
    some = texts(700)
    rows = spark.createDataFrame(list(enumerate(some)), "k long, text string")
    got = {}
    for r in documents.notes(rows).collect():
        got.setdefault(r["k"], []).append((r["number"], r["heading"], r["text"], r["char_count"]))
    for k, t in enumerate(some):
        assert got[k] == [(n["number"], n["heading"], n["text"], n["char_count"]) for n in plain.split_notes(t)], t
    plan = documents.notes(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sections(spark, monkeypatch):
    some = [t for t in texts(700) if t is not None]
    monkeypatch.setattr(plain, "filing_text", lambda t: t)  # the lines as they are
    rows = spark.createDataFrame(list(enumerate(some)), "k long, text string").select("k", lines.lines("text").alias("x"))
    key = lambda s: tuple(s[c] for c in ("item", "text", "ended_at", "heading"))
    for named, way in ((lines.item_sections, plain.item_sections), (lines.proxy_sections, plain.proxy_sections)):
        found = 0
        for r in rows.select("k", named(F.col("x")).alias("s")).collect():
            want = way(some[r["k"]])
            assert sorted(map(repr, map(key, r["s"]))) == sorted(map(repr, map(key, want))), some[r["k"]]
            sure = {s["item"]: s["confidence"] for s in want}
            assert all(abs(s["confidence"] - sure[s["item"]]) < 0.0011 for s in r["s"])  # a tie in the third digit may go either way
            found += len(want)
        assert found > 400


def test_one_item_only(spark, monkeypatch):
    monkeypatch.setattr(plain, "filing_text", lambda t: t)
    some = [t for t in texts(100) if t]
    rows = spark.createDataFrame(list(enumerate(some)), "k long, text string").select("k", lines.item_sections(lines.lines("text"), ("1a", "2")).alias("s"))
    for r in rows.collect():
        assert sorted(s["item"] for s in r["s"]) == sorted(s["item"] for s in plain.item_sections(some[r["k"]], ("1a", "2")))
    assert tx.ITEMS[0] == "1"


def test_confidence_is_not_rounded(spark):
    """A section of 1,199 characters, where 2,000 are plausible, is just below the usable bound."""
    page = "\n".join(["Item 1. Business", "x" * 1199, "Item 1A. Risk Factors", "y", "Item 2. Properties", "z"])
    s = spark.createDataFrame([(page,)], "text string").select(F.inline(lines.item_sections(lines.lines("text")))).where("item = '1'").first()
    assert s["confidence"] == 1199 / 2000
