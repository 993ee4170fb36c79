import json
from datetime import date

import pytest

from builder import AS_OF, healthy
from ledgermark import schemas
from ledgermark.__main__ import main
from ledgermark.sources import store


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("catalog") / "store")
    assert store.create(spark, path).fact.count() == 0
    s = healthy(spark).store()
    for name in store.RELATIONS:
        store.append(spark, path, name, getattr(s, name))
    return path


def test_catalog_and_its_version(spark, catalog, monkeypatch):
    s = store.open_store(spark, catalog)
    assert s.filer.count() == 1 and s.fact.count() > 50 and store.migrate(spark, catalog) == []
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.create(spark, catalog)
    monkeypatch.setattr(store, "SCHEMA_VERSION", schemas.SCHEMA_VERSION + 1)
    assert store.migrate(spark, catalog) == [schemas.SCHEMA_VERSION + 1] and store.open_store(spark, catalog).filer.count() == 1
    monkeypatch.setattr(store, "SCHEMA_VERSION", schemas.SCHEMA_VERSION)
    with pytest.raises(ValueError, match="schema version"):
        store.open_store(spark, catalog)
    monkeypatch.setattr(store, "version_of", lambda *_: schemas.SCHEMA_VERSION)


def test_rows_of_all_versions_are_read_with_defaults(spark, tmp_path):
    path = str(tmp_path / "old")
    store.create(spark, path)
    s = healthy(spark).store()
    s.filing.limit(1).write.mode("append").parquet(f"{path}/filing")  # laid down before versions had folders
    store.append(spark, path, "filing", s.filing.limit(2))
    steps = (store.Step(2, "filing", "amends", "boolean", False), store.Step(3, "filing", "pages", "int", 7))
    assert store.migrate(spark, path, steps[:1]) == [2] and store.migrate(spark, path, steps[:1]) == []
    store.append(spark, path, "filing", s.filing.limit(3).selectExpr("*", "CAST(NULL AS boolean) AS amends"), steps)
    with pytest.raises(ValueError, match="schema version 2"):
        store.open_store(spark, path)
    assert store.migrate(spark, path, steps) == [3]
    store.append(spark, path, "filing", s.filing.limit(1).selectExpr("*", "true AS amends"), steps)
    for _ in range(2):  # twice the same
        got = sorted(str((r["amends"], r["pages"])) for r in store.open_store(spark, path, steps).filing.collect())
        assert got == sorted(map(str, [(False, 7)] * 3 + [(None, 7)] * 3 + [(True, 7)]))
    assert store.open_store(spark, path, steps).fact.count() == 0


def test_settled_facts_are_not_shuffled(spark, tmp_path):
    from ledgermark.plans.asof import AsOfView
    from ledgermark.sources.adapter import star_store

    s = star_store(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "facts")
    store.settle(spark, s, path, 8)
    view = AsOfView(store.settled(spark, s, path, 8), date(2000, 6, 30))
    rows = view.fact_asof
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "filed_date" in plan.split("PushedFilters")[1]
    want = AsOfView(s, date(2000, 6, 30)).fact_asof
    assert rows.count() == want.count() and rows.exceptAll(want).count() == 0


def test_command_line(spark, catalog, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(store, "version_of", lambda *_: schemas.SCHEMA_VERSION)

    def run(*argv):
        assert main([*argv, "--as-of", str(AS_OF)], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    (u,) = run("universe", catalog)
    assert u["cik"] == 1 and "excluded_because" not in u and u["market_cap"] == 2e9
    assert len(run("figures", catalog, "--cik", "1")) == 6 and run("figures", catalog, "--cik", "2") == []
    assert run("screen", catalog, "--screen", "net_net")[0]["rank"] == 1
    assert {r["relation"] for r in run("counts", catalog)} == {"fact", "price", "filing", "filer"}
    (c,) = run("candidates", catalog, "--compare", "12")
    assert c["trend"] in ("new", "persistent", "recent", "returning")
    assert main(["filings", catalog, "--as-of", "2024-01-01", "--out", str(tmp_path / "f")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "f")).where(f"filed_date > DATE '{date(2024, 1, 1)}'").count() == 0
    with pytest.raises(SystemExit) as e:
        main(["recheck", catalog], spark)
    assert e.value.code == 2
    (v,) = run("value", catalog, "--growth", "0", "0.02", "0.05")
    assert v["per_share_bear"] < v["per_share_base"] < v["per_share_bull"]
    assert main(["value", catalog, "--as-of", str(AS_OF), "--cik", "9"], spark) == 1
    assert main(["universe", str(tmp_path / "nothing")], spark) == 1 and "universe:" in capsys.readouterr().err


def test_recheck_and_extract_verbs(spark, catalog, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(store, "version_of", lambda *_: schemas.SCHEMA_VERSION)
    told = [{"cik": 1, "metric": "operating margin", "direction": "below", "threshold": t, "window": "1 year"} for t in (0.01, 0.99)]
    for name, rows, code in (("fine", told[:1], 0), ("bad", told, 2)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
        assert main(["recheck", catalog, "--as-of", str(AS_OF), "--input", str(tmp_path / f"{name}.jsonl")], spark) == code
        assert json.loads(capsys.readouterr().out)["status"] == ("breached" if code else "holding")
    known = store.open_store(spark, catalog).filing.first()["accession_no"]
    pages = [(known, "10-K", "<p>Item 1. Business</p><p>We make pumps.</p><p>Item 2. Properties</p><p>One.</p>"), ("later", "10-K", "<p>Item 1. Business</p><p>No.</p>")]
    spark.createDataFrame(pages, "accession_no string, form_type string, html string").write.parquet(str(tmp_path / "pages"))
    assert main(["extract", catalog, "--as-of", str(AS_OF), "--input", str(tmp_path / "pages")], spark) == 0
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {(g["accession_no"], g["item"], g["text"]) for g in got} == {(known, "1", "We make pumps."), (known, "2", "One.")}


def test_ingest_twice_leaves_the_same_catalog(spark, capsys, tmp_path):
    import zipfile

    path, root = str(tmp_path / "store"), tmp_path / "landing"
    store.create(spark, path)

    def facts(cik, val):
        return json.dumps({"cik": cik, "entityName": "x", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-12-31", "val": val, "accn": f"a{cik}", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}]}}}}})

    for name in ("submissions", "companyfacts", "bulk"):
        (root / name).mkdir(parents=True)
    for cik in (1, 2, 3):
        recent = {"accessionNumber": [f"a{cik}"] if cik < 3 else [], "filingDate": ["2024-02-01"], "reportDate": ["2023-12-31"], "form": ["10-K"], "primaryDocument": ["d.htm"]}
        (root / "submissions" / f"{cik}.json").write_text(json.dumps({"cik": str(cik), "name": f"Filer {cik}", "tickers": [f"T{cik}"], "exchanges": ["X"], "filings": {"recent": recent}}))
    (root / "companyfacts" / "1.json").write_text(facts(1, 5.0))
    with zipfile.ZipFile(root / "bulk" / "facts.zip", "w") as z:
        for cik in (2, 3, 4):
            z.writestr(f"CIK{cik:010}.json", facts(cik, 7.0))
    seen = []
    for _ in range(2):
        assert main(["ingest", path, "--input", str(root)], spark) == 0
        counts = json.loads(capsys.readouterr().out)
        s = store.open_store(spark, path)
        seen.append(sorted(str(tuple(r)) for name in store.RELATIONS for r in getattr(s, name).collect()))
        assert (counts["filer"], counts["filing"], counts["fact"]) == (3, 3, 3)
    assert seen[0] == seen[1] and counts["new_facts"] == 0
    (root / "companyfacts" / "1.json").write_text(facts(1, 6.0).replace('"a1"', '"b1"'))  # a restatement by a filing that no list has
    assert main(["ingest", path, "--input", str(root)], spark) == 0 and json.loads(capsys.readouterr().out)["filing"] == 4
    # a rewrite that broke off after the old folder went
    (tmp_path / "store" / "filer").rename(tmp_path / "store" / "filer.next")
    assert store.recover(spark, path) == ["filer"] and store.open_store(spark, path).filer.count() == 3 and store.recover(spark, path) == []
    assert main(["ingest", path, "--input", str(tmp_path / "none")], spark) == 1


def test_a_cluster_needs_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from ledgermark import tables

    def session(master, path=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: path), sparkContext=SimpleNamespace(master=master))

    assert tables.shared_root(session("local")) == tables.shared_root(session("local[4]")) == tables.LOCAL_WORK
    assert tables.shared_root(session("yarn", "hdfs://shared/")) == "hdfs://shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="shared folder"):
            tables.shared_root(session(master))


def test_facts_of_the_test_tables_are_dealt_out_as_filings(spark):
    """A row for each filing is shuffled; by filer and period nothing is shuffled again, and settling puts a bucket in a file."""
    from ledgermark.sources.adapter import star_store

    s = star_store(spark, "/root/testdata/sf0.001")
    plan = s.fact.groupBy("cik", "tag", "period_end").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate explode") < plan.index("Exchange ")


def test_batches_without_state_give_the_latest_versions(spark, tmp_path):
    from datetime import date

    from ledgermark.schemas import FACT
    from ledgermark.streaming import arrivals

    row = lambda a, v, filed, start=None: (a, 1, "Assets", "USD", start, date(2020, 12, 31), v, 2020, "FY", "10-K", filed)
    parts = [[row("3", 3.0, date(2023, 1, 1)), row("2", 2.0, date(2022, 1, 1))], [row("1", 1.0, date(2021, 1, 1)), row("9", 9.0, date(2024, 1, 1))], [row("4", 4.0, date(2023, 1, 1)), row("5", 5.0, date(2021, 5, 1), date(2020, 1, 1))]]
    for part in parts:
        spark.createDataFrame(part, FACT).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals.keep_batches(arrivals.arrived(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", date(2023, 6, 30)).awaitTermination()
    got = {(r["period_start"], r["value"], r["accession_no"]) for r in arrivals.newest(spark, f"{tmp_path}/out").collect()}
    assert got == {(None, 4.0, "4"), (date(2020, 1, 1), 5.0, "5")}
    assert not (tmp_path / "check" / "state").exists() and len(list((tmp_path / "out").glob("batch=*"))) == 3
