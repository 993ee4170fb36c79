import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain_sections as plain
from ledgermark.functions import text as tx
from ledgermark.operators import documents as d

SOURCE = "The Company’s revenue declined in every segment during the year, and management\nexpects   the decline to continue into 2025 across all regions."


@pytest.mark.parametrize(
    ("quote", "ok"),
    [
        ("The Company's revenue declined in every segment", True),
        ("THE COMPANY'S REVENUE DECLINED IN EVERY SEGMENT", True),
        ("revenue declined", False),
        ("revenue declined in every segment ... decline to continue into 2025", True),
        ("decline to continue into 2025 ... revenue declined in every segment", False),
        ("revenue increased in every segment during the year", False),
        ("short … revenue declined in every segment", False),
        ("", False),
        ("...", False),
    ],
)
def test_quotes(quote, ok):
    assert tx.quote_appears_in(quote, SOURCE) is ok


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=40, max_size=200), st.integers(0, 10), st.integers(30, 40))
def test_a_verbatim_passage_is_found(text, at, n):
    q = text[at : at + n]
    if len(tx.for_match(q)) >= 24 and not tx.ELLIPSIS.search(q) and tx.for_match(q) in tx.for_match(text):
        assert tx.quote_appears_in(q, text)


def page(*blocks):
    return "<html><body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body></html>"


def test_filing_text():
    assert tx.filing_text("<p>Item 1<font>A</font>.&nbsp;Risk</p><script>x</script><div>B &amp; C</div>") == "Item 1A. Risk\nB & C"
    assert tx.filing_text(page("the quick brown", "17", "fox jumps")) == "the quick brown fox jumps"
    assert tx.filing_text(page("It ends.", "17", "Next one")) == "It ends.\nNext one"
    assert tx.filing_text(page("$ 1,200", "340", "Total")) == "$ 1,200\n340\nTotal"
    assert tx.filing_text(page("Acme | 2024 Form 10-K | 7", "Table of Contents", "Text")) == "Text"
    assert tx.filing_text(None) == ""


def test_sections_prefer_the_body_over_the_contents():
    body = "We make things. " * 200
    risk = "Risks abound here. " * 200
    p = page("Item 1. Business", "Item 1A. Risk Factors", "Item 1B. Unresolved", "Item 1. Business", body, "Item 1A. Risk Factors", risk, "Item 1B. Unresolved", "None.", "Item 2. Properties", "x" * 200, "Item 3. Legal")
    got = {s["item"]: s for s in plain.item_sections(p)}
    assert got["1"]["text"] == body.strip() and got["1"]["confidence"] == 1.0 and got["1A"]["ended_at"] == "1B"
    assert got["1B"]["text"] == "None." and got["1B"]["confidence"] == 1.0 and got["2"]["confidence"] == 1.0 and "7" not in got


def test_item_8_that_points_to_the_notes():
    notes = "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS"
    p = page("Item 8. Financial Statements", "See Part IV.", "Item 9. Changes", "None", notes, "Note 1. General", "We consolidate." * 300)
    (s,) = plain.item_sections(p, ("8",))
    assert s["confidence"] == 0.8 and s["text"].startswith(notes)


def test_proxy():
    p = page("Compensation Discussion and Analysis", "Summary Compensation Table", "Compensation Discussion and Analysis", "We pay for sales. " * 30, "AUDIT COMMITTEE REPORT", "y", "Director Compensation", "Directors are paid.")
    got = {s["item"]: s for s in plain.proxy_sections(p)}
    assert got["CDA"]["ended_at"] == "OTHER" and got["CDA"]["confidence"] == 0.9 and got["DIRECTOR_COMP"]["confidence"] == 0.6 and "SUMMARY_COMP" not in got


def test_notes():
    text = "Intro\nNOTE 1. General\nabc\nNote 1 (Continued)\nmore\nNote 2 — Debt\nNote 1, above, says\nend"
    assert [n["number"] for n in plain.split_notes(text)] == ["1", "2"]
    text = "1. Organization\nabc\n2. Revenue\nsteps\n1. Identify the contract\n2. Identify duties\n3. Leases\nend"
    assert [n["number"] for n in plain.split_notes(text)] == ["1", "2"]
    assert plain.split_notes("nothing here")[0]["number"] is None and plain.split_notes(None)[0]["char_count"] == 0


def test_document_operators(spark):
    rows = spark.createDataFrame([("a", "10-K", page("Item 1. Business", "x" * 3000, "Item 1A. Risk", "y" * 2000)), ("b", "DEF 14A", page("Director Compensation", "paid")), ("c", "10-K", None)], "accession_no string, form_type string, html string")
    got = {(r["accession_no"], r["item"]) for r in d.sections(rows).collect()}
    assert got == {("a", "1"), ("a", "1A"), ("b", "DIRECTOR_COMP")}
    n = spark.createDataFrame([("a", "NOTE 1. A\nx\nNOTE 2. B\ny")], "accession_no string, text string")
    assert [r["number"] for r in d.notes(n).collect()] == ["1", "2"]


def test_findings(spark):
    src = spark.createDataFrame([("a", "1A", SOURCE)], "accession_no string, item string, text string")
    f = lambda n, a, q, p=None, s="low", imp="margins fell": (n, a, "1A", "added", q, imp, s, "zz" if p else None, p)
    good = "revenue declined in every segment"
    rows = [f(1, "a", good), f(2, "a", ""), f(3, "b", good), f(4, "a", good + " today"), f(5, "a", good, good), f(6, "a", good, s="grave"), f(7, "a", good, imp="investors should sell the shares")]
    df = spark.createDataFrame(rows, "n int, accession_no string, item string, change_type string, quote string, implication string, severity string, prior_accession_no string, prior_quote string")
    got = {r["n"]: r["drop_reason"] for r in d.validate_findings(df, src).collect()}
    assert got == {1: None, 2: "quote_missing", 3: "source_unavailable", 4: "quote_not_found", 5: "prior_source_unavailable", 6: "malformed", 7: "malformed"}
    rate = d.drop_rate(d.validate_findings(df, src)).first()
    assert (rate["kept"], rate["dropped"]) == (1, 6)


def test_references_without_a_semicolon_stay():
    assert tx.filing_text("<p>a &amp;&amp;&amp</p><p>&copyx; &#233;&quot;&nosuch; &amp;quot;</p>") == 'a &&&amp\n&copyx; é"&nosuch; &quot;'


def test_a_sharp_s_is_one_letter():
    q = "Die Straße ist sehr lan"  # 23 letters
    assert len(tx.for_match(q)) == 23 and tx.fragments(q) == [] and tx.fragments(q + "g") == [(q + "g").lower()]
    assert not tx.quote_appears_in(q + "g und breit", (q + "g und breit").upper())
