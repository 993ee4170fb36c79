import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from builder import Builder
from ledgermark import manifest
from ledgermark.functions import columns as cx
from ledgermark.plans import recheck, valuation
from ledgermark.sources import landing, sinks
from ledgermark.streaming import arrivals

INDEX = """Form Type   Company Name                  CIK         Date Filed  File Name
---------------------------------------------------------------------------------
10-K        ACME CORP                     0000000012  2020-02-03  edgar/data/12/a.txt
10-K        ACME CORP                     0000000012  2020-01-03  edgar/data/12/b.txt
15-12G      GONE INC                      0000000013  2020-03-01  edgar/data/13/c.txt
25-NSE      LISTED CO                     0000000014  2020-03-02  edgar/data/14/d.txt
DEF 14A     SPACED CO                     0000000015  2020-03-02  edgar/data/15/e.txt
"""


def test_form_index(spark, tmp_path):
    p = tmp_path / landing.index_url(2020, 1)
    p.parent.mkdir(parents=True)
    p.write_text(INDEX)
    rows, report = landing.read_quarters(spark, str(tmp_path), 2020, 2020)
    assert rows.count() == 4 and {(r["year"], r["quarter"]): r["rows"] for r in report.collect()} == {(2020, 1): 4, (2020, 2): None, (2020, 3): None, (2020, 4): None}
    empty, report = landing.read_quarters(spark, str(tmp_path / "none"), 2020, 2020)
    assert empty.count() == 0 and report.count() == 4
    first = landing.annual_filers(rows).collect()
    assert [(r["cik"], r["filed_date"]) for r in first] == [(12, date(2020, 1, 3))]
    assert {(r["cik"], r["status"]) for r in landing.terminal_filings(rows).collect()} == {(13, "deregistered"), (14, None)}
    with pytest.raises(ValueError):
        landing.index_url(2020, 5)


def test_submissions(spark, tmp_path):
    doc = {"cik": "320", "name": "Acme", "sic": "", "tickers": ["ACM"], "exchanges": [], "filings": {"recent": {"accessionNumber": ["1-2", "3-4"], "filingDate": ["2024-01-02", "2023-01-02"], "reportDate": ["", "2022-12-31"], "form": ["10-K", "10-Q"], "primaryDocument": ["a.htm"]}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    filers, filings = landing.submissions(landing.read_documents(spark, str(tmp_path), landing.SUBMISSIONS))
    f = filers.first()
    assert (f["cik"], f["ticker"], f["exchange"], f["sic"], f["first_seen"]) == (320, "ACM", None, None, date(2023, 1, 2))
    rows = {r["accession_no"]: r for r in filings.collect()}
    assert rows["1-2"]["period_end"] is None and rows["1-2"]["primary_doc_url"].endswith("320/12/a.htm") and rows["3-4"]["primary_doc_url"] is None


def test_company_facts(spark, tmp_path):
    point = {"end": "2023-12-31", "val": 5, "accn": "x", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}
    doc = {"cik": 1, "facts": {"us-gaap": {"Assets": {"units": {"USD": [point, {**point, "filed": None}, {**point, "accn": None}]}}, "Unlisted": {"units": {"USD": [point]}}, "Revenues": {"units": {"USD": [{**point, "start": "2023-01-01"}]}}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    docs = landing.read_documents(spark, str(tmp_path), landing.COMPANY_FACTS)
    got = {(r["tag"], r["period_start"]) for r in landing.company_facts(docs).collect()}
    assert got == {("Assets", None), ("Revenues", date(2023, 1, 1))}
    with pytest.raises(Exception, match="another filer"):
        landing.company_facts(docs, expected_cik=F.lit(2)).collect()


def test_chart_undoes_splits(spark, tmp_path):
    doc = {"chart": {"result": [{"meta": {"gmtoffset": -14400}, "timestamp": [1000000, 2000000, 3000000], "events": {"splits": {"s": {"date": 2500000, "numerator": 4, "denominator": 1}}}, "indicators": {"quote": [{"close": [124.8075, None, 129.04]}]}}], "error": None}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = landing.chart_closes(landing.read_documents(spark, str(tmp_path), landing.CHART)).orderBy("price_date").collect()
    assert [r["close"] for r in got] == [499.23, 129.04]


def test_ingest_twice_is_ingest_once(spark):
    b = Builder(spark).filer(1, first_seen=date(2010, 1, 1)).annual(1, date(2023, 12, 31), date(2024, 2, 1), Assets=5, Revenues=7)
    s = b.store()
    empty = [x.limit(0) for x in (s.filer, s.filing, s.fact)]
    filer, filing, fact = sinks.ingest(*empty, s.filer, s.filing, s.fact)
    assert (filer.count(), filing.count(), fact.count()) == (1, 1, 2)
    assert sinks.ingest(s.filer, s.filing, s.fact, s.filer, s.filing, s.fact)[2].count() == 0
    lost = s.fact.withColumn("accession_no", F.lit("lost"))
    assert sinks.stub_filings(lost, s.filing).first()["form_type"] == "10-K"


def test_facts_alone_need_their_filer(spark):
    b = Builder(spark).filer(1, first_seen=date(2015, 1, 1)).annual(1, date(2011, 12, 31), date(2012, 2, 1), Assets=5)
    s = b.store()
    filer, filing, fact = sinks.ingest_facts(s.filer, s.filing.limit(0), s.fact.limit(0), s.fact)
    assert filer.first()["first_seen"] == date(2012, 2, 1) and filing.count() == 1 and fact.count() == 1
    with pytest.raises(Exception, match="not held"):
        sinks.ingest_facts(s.filer.limit(0), s.filing, s.fact, s.fact)[2].collect()


def test_stored_results_are_superseded(spark):
    held = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (2, 5, "c")], "k int, j int, v string")
    new = spark.createDataFrame([(1, None, "z")], "k int, j int, v string")
    assert sorted(r["v"] for r in sinks.replaced(held, new, ["k", "j"]).collect()) == ["c", "z"]
    assert sinks.first_of(held, ["k", "j"]).where("k = 1").first()["v"] == "a"
    back = sinks.from_payload(sinks.to_payload(held, "k").select("payload").union(spark.createDataFrame([("no json",)], "payload string")), "k int, j int, v string")
    assert sorted(str(r["v"]) for r in back.collect()) == ["None", "a", "b", "c"]
    theses = spark.createDataFrame([(1, date(2024, 1, 1), 2, 1)], "cik long, as_of date, version int, written_at long")
    more = spark.createDataFrame([(1, date(2024, 1, 1), 9, 5), (1, date(2024, 1, 1), 9, 4), (2, date(2024, 1, 1), 9, 1)], theses.schema)
    assert {(r["cik"], r["written_at"]): r["version"] for r in sinks.append_versions(theses, more).collect()} == {(1, 4): 3, (1, 5): 4, (2, 1): 1}


def test_bulk_archive_is_inflated_by_tasks(spark, tmp_path, monkeypatch):
    import zipfile

    from ledgermark.sources import archives

    def doc(cik):
        return json.dumps({"cik": cik, "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-12-31", "val": cik, "accn": "x", "filed": "2024-02-01"}]}}}}})

    for part in (0, 1):
        with zipfile.ZipFile(tmp_path / f"facts{part}.zip", "w") as z:
            z.writestr("folder/", "")
            for cik in range(1 + part, 60, 2):
                info = zipfile.ZipInfo(f"CIK{cik:010}.json", (2024, 3, 1 + cik % 20, 6, 0, 0))
                info.compress_type, info.extra = (zipfile.ZIP_DEFLATED if cik % 3 else zipfile.ZIP_STORED), b"\x99\x99\x02\x00ab"
                z.writestr(info, doc(cik))
            z.writestr(zipfile.ZipInfo("README.txt", (2024, 1, 1, 0, 0, 0)), "no filer")
    monkeypatch.setattr(archives, "READ", 500)  # many tasks
    found = archives.entries(spark, archives.listed(spark, str(tmp_path / "*.zip")))
    assert found.count() == 61 and landing.bulk_version(found).first()[0] == "2024-03-20T06:00:00"
    wanted = spark.createDataFrame([(c,) for c in (*range(0, 60, 4), 2, 2, 99)], "cik long")
    rows = landing.bulk_company_facts(found, wanted)
    assert sorted((r["wanted"], r["cik"]) for r in rows.collect()) == [(c, c) for c in sorted({2, *range(4, 60, 4)})]
    assert landing.company_facts(rows, expected_cik=F.col("wanted")).count() == 15
    assert landing.bulk_company_facts(found, wanted.limit(0)).count() == 0 and archives.entries(spark, []).count() == 0
    every = spark.createDataFrame([(f"CIK{c:010}.json", doc(c)) for c in range(9)], "name string, content string")
    made = [r["archive"] for r in archives.write(every.repartition(2), str(tmp_path / "own"), (2024, 1, 1, 0, 0, 0)).collect()]
    assert sorted(r["content"] for r in archives.members(archives.entries(spark, made)).collect()) == sorted(doc(c) for c in range(9))
    raw = bytearray((tmp_path / "facts0.zip").read_bytes())
    raw[raw.index(b'"val": 3') + 7] = ord("4")
    (tmp_path / "facts0.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        archives.members(archives.entries(spark, [str(tmp_path / "facts0.zip")])).count()


def test_quarters_are_written_in_parts(spark, tmp_path):
    lines = [(2020, 1 + i % 2, f"10-K        CO {i}                          {i:010}  2020-01-{1 + i % 28:02}  edgar/data/{i}/x.txt") for i in range(1, 200)]
    parts = landing.write_quarters(spark.createDataFrame(lines, "year int, quarter int, value string").repartition(4), str(tmp_path)).collect()
    rows, report = landing.read_quarters(spark, str(tmp_path), 2020, 2020, spark.createDataFrame(parts))
    assert {(r["quarter"], r["rows"]) for r in report.collect()} == {(1, 99), (2, 100), (3, None), (4, None)}
    (tmp_path / "edgar/full-index/2020/QTR1/form-lost.idx").write_text(lines[0][2] + "\n")  # an attempt that does not count
    assert landing.read_quarters(spark, str(tmp_path), 2020, 2020, spark.createDataFrame(parts))[0].count() == 199


def test_splits_from_a_table_of_their_own(spark):
    closes = spark.createDataFrame([("a", 5, 10.0, 1), ("a", 10, 10.0, 2), ("a", 11, 10.0, 3), ("a", 20, 10.0, 4), ("b", 5, 7.0, 5), (None, 5, 1.0, 6), ("a", 5, 10.0, 1)], "k string, stamp int, close double, n int")
    splits = spark.createDataFrame([("a", 10, 4.0), ("a", 15, 2.0), ("a", 15, 3.0), ("a", None, 9.0), ("a", 16, None), ("c", 9, 5.0)], "k string, at long, ratio double")
    got = sorted((r["n"], r["close"]) for r in landing.as_traded(closes, splits, "k").collect())
    assert got == [(1, 240.0), (1, 240.0), (2, 60.0), (3, 60.0), (4, 10.0), (5, 7.0), (6, 1.0)]
    assert landing.as_traded(closes, splits.limit(0), "k").count() == 7 and landing.as_traded(closes.limit(0), splits, "k").count() == 0


def test_terminal_marks(spark):
    b = Builder(spark).filer(1).filer(2).filer(3, status="acquired", status_date=date(2020, 1, 1))
    b.annual(2, date(2023, 12, 31), date(2024, 2, 1), Assets=1)
    s = b.store()
    rec = spark.createDataFrame([(1, date(2023, 5, 1), "deregistered"), (1, date(2023, 3, 1), "deregistered"), (2, date(2023, 5, 1), "deregistered"), (3, date(2019, 1, 1), "deregistered"), (1, date(2020, 1, 1), None)], "cik long, filed_date date, status string")
    got = {r["cik"]: (r["status"], r["status_date"]) for r in sinks.mark_terminal(s.filer, s.filing, rec).collect()}
    assert got == {1: ("deregistered", date(2023, 3, 1)), 2: ("active", None), 3: ("acquired", date(2020, 1, 1))}


def test_stream_appends_each_fact_once(spark, tmp_path):
    s = Builder(spark).filer(1).annual(1, date(2023, 12, 31), date(2024, 2, 1), Assets=5, Revenues=7).store()
    for _ in range(2):
        s.fact.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = arrivals.append_facts(arrivals.fact_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_keeps_the_latest_version(spark, tmp_path):
    """Restatements in any order, years late, over a restart and a fold; equal to the view of the same facts."""
    from ledgermark.plans.asof import AsOfView
    from ledgermark.sources.adapter import star_store

    s = star_store(spark, "/root/testdata/sf0.001")
    day = date(2000, 6, 30)
    want = AsOfView(s, day).fact_asof.select(*arrivals.FACT_KEY, *arrivals.VERSION)
    paths = [str(tmp_path / x) for x in ("in", "out", "state", "folded")]
    for n, rest in enumerate((2, 0, 1)):
        s.fact.where(f"pmod(crc32(cast(accession_no AS binary)), 3) = {rest}").coalesce(1).write.mode("append").parquet(paths[0])
        arrivals.keep_latest(arrivals.latest_versions(arrivals.arrived(spark, paths[0], 1), day), paths[1], paths[2]).awaitTermination()
        assert spark.read.parquet(paths[1]).select("batch").distinct().count() == n + 1
    rows = arrivals.current(spark, paths[1])
    assert rows.count() == want.count() and rows.exceptAll(want).count() == 0
    arrivals.folded(spark, paths[1], paths[3])
    folded = arrivals.current(spark, paths[3])
    assert folded.count() == want.count() and folded.exceptAll(want).count() == 0


def test_tickers_and_dates(spark):
    cases = {"ABC": "common", "BF-B": "common", "BF.B": "common", "SCE-PG": "preferred", "X-WS": "warrant", "X-WI": "when_issued", "X-U": "unit", "X-R": "right", "A-B-C": "unknown", "-B": "unknown", "X-77": "unknown", None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", cx.ticker_class("t").alias("got")).collect())
    day = spark.sql("SELECT DATE '2025-05-31' AS d").select(cx.months_back(F.col("d"), 15).alias("a"), cx.months_before(F.col("d"), 15).alias("b"), cx.leading_int(F.lit("6021X")).alias("c"), cx.leading_int(F.lit("abc")).alias("e")).first()
    assert (day["a"], day["b"], day["c"], day["e"]) == (date(2024, 3, 2), date(2024, 2, 29), 6021, 0)


def dcf(revenue, growth, margin, t=0.025):
    total, r = 0.0, revenue
    for y in range(1, 11):
        r *= 1 + growth
        total += r * margin / 1.1**y
    return total + r * margin * (1 + t) / (0.1 - t) / 1.1**10


def test_valuation_recovers_growth(spark):
    df = spark.createDataFrame([(1e9, g, 0.1, dcf(1e9, g, 0.1)) for g in (-0.2, 0.0, 0.07)], "r double, g double, m double, v double")
    for row in df.select("*", valuation.scenario_value("r", "g", "m").alias("x"), valuation.implied_growth("v", "r", "m").alias("i")).collect():
        assert row["x"] == pytest.approx(row["v"], rel=1e-12) and row["i"] == pytest.approx(row["g"], abs=1e-9)


def test_newton_reaches_growth_in_the_whole_range(spark):
    some = [(10.0**e, g / 100, m, dcf(10.0**e, g / 100, m)) for e in (2, 9) for m in (0.01, 0.9) for g in range(-49, 50)]
    some += [(1e9, None, 0.1, v) for v in (dcf(1e9, -0.51, 0.1), dcf(1e9, 0.51, 0.1), 0.0, -1.0, None)] + [(0.0, None, 0.1, 5.0), (1e9, None, -0.1, 5.0), (None, None, 0.1, 5.0)]
    df = spark.createDataFrame(some, "r double, g double, m double, v double").select("*", valuation.implied_growth("v", "r", "m").alias("i"))
    for row in df.collect():
        assert row["i"] is None if row["g"] is None else row["i"] == pytest.approx(row["g"], abs=1e-12)
    bad = spark.createDataFrame([("revenue_growth", 0.1, 0.2, 0.3, "grew 7% in 2024"), ("revenue_growth", 0.3, 0.2, 0.1, "7%"), ("discount_rate", 0.1, 0.1, 0.1, "7%"), ("terminal_growth", 0.1, 0.1, 0.1, "a conservative estimate")], "name string, bear double, base double, bull double, justification string")
    assert [r["p"] for r in bad.select(valuation.assumption_problem().alias("p")).collect()] == [None, "cases out of order", "the discount rate is fixed", "justification cites nothing"]


def test_metric_phrases(spark):
    cases = [("Consolidated operating margin", "operating_margin"), ("the total revenue, year over year", "revenue_growth"), ("written same-store sales", None), ("sales", "revenue"), ("EBIT margin before", "operating_margin"), ("gross_margin", "gross_margin")]
    df = spark.createDataFrame(cases, "m string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", recheck.resolve_metric(F.col("m")).alias("got")).collect())
    windows = [("two consecutive fiscal years", 2), ("24 months", 24), ("", 1), ("a year", 1), ("0 years", 1), ("three-year", 3)]
    df = spark.createDataFrame(windows, "w string, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", recheck.window_years(F.col("w")).alias("got")).collect())


def test_conditions(spark):
    series = spark.createDataFrame([(1, date(2022, 12, 31), 0.08), (1, date(2023, 12, 31), 0.03), (1, date(2024, 12, 31), 0.02)], "cik long, fy_end date, operating_margin double")
    series = series.select("*", *[F.lit(None).cast("double").alias(k) for k in recheck.METRICS if k != "operating_margin"])
    rows = [(1, "operating margin", "below", 0.05, "two years", "breached"), (1, "operating margin", "below", 0.05, "three years", "holding"), (1, "operating margin", "near", 0.05, "one", "needs_a_human"), (1, "operating margin", "above", 0.01, "five", "needs_a_human"), (2, "operating margin", "below", 0.05, "one", "needs_a_human")]
    df = spark.createDataFrame(rows, "cik long, metric string, direction string, threshold double, window string, want string")
    got = recheck.evaluate(df, series)
    assert all(r["status"] == r["want"] for r in got.collect())
    assert {(r["cik"], r["status"]) for r in recheck.roll_up(got, "cik").collect()} == {(1, "breached"), (2, "needs_a_human")}


def test_manifest(tmp_path):
    m, calls = manifest.Manifest(tmp_path), []
    assert m.run("screen", {"b": 1, "a": 2}, lambda: calls.append(1) or 5)["output"] == 5
    assert m.run("screen", {"a": 2, "b": 1}, lambda: calls.append(1))["cached"] and len(calls) == 1
    for _ in range(4):
        failed = m.run("bad", {}, lambda: 1 / 0)
    assert failed["status"] == "failed" and failed["attempts"] == 3 and m.counts() == {"done": 1, "failed": 1} and m.resumable() == []
    with pytest.raises(ValueError):
        manifest.pass_over(tmp_path, 1, " ")
    assert manifest.append_entry(tmp_path / "j", {"a": 1}, "x") != manifest.append_entry(tmp_path / "j", {"a": 1}, "x")
    total = manifest.Cost.total([manifest.Cost.estimate("m", 3, 15, 1_000_000), manifest.Cost.estimate("n", 3, 15, 0, 1000)])
    assert total.model == "mixed" and total.usd == pytest.approx(3.015) and manifest.Cost("m", 0.005).human() == "$0.0050"


def test_thesis_problems(spark):
    from ledgermark.plans import thesis

    cond = ("operating margin", "below", 0.05, "two years")
    why = ("forced selling", "An index fund had to sell its whole holding within one week of March.")
    good = (1, date(2024, 1, 1), 1, "Makes pumps", why, ["a"], [cond, cond], 3.0, "the margin falls", "we were wrong on price")
    bad = (2, date(2024, 1, 1), 1, "", ("Undervalued", "the market is wrong"), [], [("x", "", None, "y")], None, "sell the shares now", None)
    df = spark.createDataFrame([good, bad], thesis.THESIS)
    got = {r["cik"]: r["p"] for r in df.select("cik", thesis.problems().alias("p")).collect()}
    assert got[1] == []
    assert {x.split(":")[0] for x in got[2]} == set(thesis.SECTIONS)
    again = spark.createDataFrame([good, (*good[:2], 2, *good[3:])], thesis.THESIS)
    assert [r["version"] for r in thesis.latest(again).collect()] == [2]
    assert sinks.next_version(again).first()["next_version"] == 3


def test_replacing_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = lambda d, n: spark.createDataFrame([(d, i) for i in range(n)], "as_of date, cik int")
    sinks.write(rows(date(2024, 1, 1), 3), p, "replace", ["as_of"])
    sinks.write(rows(date(2024, 2, 1), 2), p, "replace", ["as_of"])
    sinks.write(rows(date(2024, 1, 1), 1), p, "replace", ["as_of"])
    assert spark.read.parquet(p).count() == 3


@pytest.mark.parametrize("name", ["sink_insert_facts", "sink_ingest", "op_inputs"])
def test_facts_are_not_broadcast(spark, name):
    """The estimate of exploded facts is that of the few rows they come from."""
    from ledgermark.plans import registry, registry_stored  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    if name == "op_inputs":
        assert any("ShuffledHashJoin" in x and "period_end" in x for x in joins) and not any("BroadcastHashJoin" in x and "period_end" in x for x in joins)
    else:
        assert any("SortMergeJoin" in x and "LeftAnti" in x for x in joins) and not any("BroadcastHashJoin" in x and "LeftAnti" in x for x in joins)
