"""Queries over whole documents and labels, against brute force on a small fixture."""

from datetime import datetime

import duckdb
import pytest

from ledgermark.functions import text as tx
from ledgermark.plans import registry, registry_stored  # noqa: F401

PASSAGES = {i: f"Item {i} tells of margins which fell in the {i} segments of the north, and only later, at the very end, of the {i} debts." for i in range(12)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("whole"))
    filler = "plain words without figures and without any quotes of other texts "
    docs = {i: filler for i in range(400)}
    docs |= {390: f"{filler}({PASSAGES[0].upper()}) x", 391: filler + PASSAGES[1][:70] + " and then it goes on", 395: PASSAGES[5].replace(" ", "\n\t"), 396: f"“{PASSAGES[6]}”", 397: PASSAGES[7] + PASSAGES[8], 398: None}
    docs |= {380: filler * 3 + "7", 381: filler + "none"}
    items = PASSAGES | {12: "too short", 13: None, 14: "margins which fell in the ... of the north, and only later"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i * 37, i % 2, i // 2 % 2) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, docs, items


def test_findings_cite_every_document_and_quote_whole_items(spark, tables):
    sf, docs, items = tables
    rows = registry.QUERIES["op_validate_findings"](spark, sf).collect()
    got = {(r["item_id"], int(r["accession_no"])): r["drop_reason"] for r in rows}
    assert len(got) == len(rows) and {a for _, a in got} == set(docs)
    for (i, a), why in got.items():
        quote = "" if i % 11 == 3 else items[i]
        want = "malformed" if i % 7 == 2 else "quote_missing" if not quote else "source_unavailable" if docs[a] is None else None if tx.quote_appears_in(quote, docs[a]) else "quote_not_found"
        assert why == want, (i, a)
    quoting = {(i, a) for i, q in items.items() for a, t in docs.items() if tx.quote_appears_in(q, t)}
    assert {(0, 390), (5, 395), (6, 396), (7, 397), (8, 397)} <= quoting <= set(got)
    assert got[0, 390] is None and got[1, 391] == "quote_not_found"
    counts = {r["drop_reason"]: r["n"] for r in registry.QUERIES["agg_drop_reasons"](spark, sf).collect()}
    assert counts == {w: list(got.values()).count(w) for w in set(got.values()) - {None}}


def test_findings_cite_sums_short_items_and_beginnings(spark, tables):
    sf, docs, items = tables
    got = {(r["item_id"], int(r["accession_no"])) for r in registry.QUERIES["op_validate_findings"](spark, sf).collect()}
    words = {i: tx.for_match(q or "").split(" ") for i, q in items.items()}
    begun = lambda i, a: f" {' '.join(words[i][1:6])} " in f" {tx.for_match(docs[a] or '')} "
    quoting = {(i, a) for i, q in items.items() for a, t in docs.items() if tx.quote_appears_in(q, t)}
    want = {(i, a) for i in items for a in docs if (i + a) % 40 == 0 or len(words[i]) <= 6 or a % 15 == i or begun(i, a)} | quoting
    assert got == want and {(12, a) for a in docs} <= got


def test_all_labels_have_a_place(spark, tables):
    got = [(r["place"], r["severity"], r["doc_id"]) for r in registry.QUERIES["srt_severity"](spark, tables[0]).collect()]
    level = lambda i: 2 - i % 2 - i // 2 % 2
    want = sorted(range(400), key=lambda i: (level(i), i))
    assert got == [(k, ("high", "medium", "low")[level(i)], i * 37) for k, i in enumerate(want, 1)]


def test_figures_late_in_a_justification_count(spark, tables):
    got = {r["doc_id"]: r["problem"] for r in registry.QUERIES["op_assumption_checks"](spark, tables[0]).collect()}
    assert got[380] is None and got[381] == "justification cites nothing"


def test_prior_sections_hand_over_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["jn_prior_section"](spark, sf).collect()
    chars = {f"{r['doc_id']:010}": len(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and all(r[f"{w}_chars"] == chars[r[w]] for r in rows for w in ("current", "prior") if r[w])
    assert all(r["refused"] == any(int(r[w]) % 5 == 0 for w in ("current", "prior") if r[w]) for r in rows) and {r["refused"] for r in rows} == {True, False}


def test_sections_of_every_document_of_either_form(spark, tmp_path):
    sf = str(tmp_path)
    docs = [(0, "alpha beta"), (1, "gamma"), (2, None), (3, "Delta 7"), (900, "one more text"), (901, "and another")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 5, datetime(1999, 1, 4)) for i in range(4)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{sf}/orders.parquet")
    got = {}
    for r in registry.QUERIES["op_extract_filing"](spark, sf).collect():
        got.setdefault(int(r["accession_no"]), set()).add(r["item"])
    items, names = {"1", "1A", "1B", "2", "7", "8"}, {"CDA", "SUMMARY_COMP", "PAY_VS_PERFORMANCE", "DIRECTOR_COMP"}
    assert got == {0: items, 1: names, 2: items - {"1", "2"}, 3: names, 900: items, 901: names}
    c = duckdb.connect()
    for t in ("documents", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    want = c.sql(registry.ORACLE_SQL["op_extract_filing"]).fetchall()
    assert sorted((r["accession_no"], r["item"], r["digest"]) for r in registry.QUERIES["op_extract_filing"](spark, sf).collect()) == sorted((a, i, d) for a, i, _, d, _, _ in want)
