from datetime import date

import pytest

from ledgermark.plans.asof import AsOfView
from ledgermark.plans.candidates import candidates
from ledgermark.plans.figures import Figures
from ledgermark.plans.screens import Screens

from builder import AS_OF, HEALTHY, Builder, healthy


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_restatement_is_seen_only_after_it_was_filed(spark):
    b = Builder(spark).filer(1)
    b.fact(1, "Assets", 100, date(2023, 12, 31), date(2024, 2, 15)).fact(1, "Assets", 90, date(2023, 12, 31), date(2025, 2, 15))
    s = b.store()
    assert one(AsOfView(s, date(2024, 12, 31)).latest_fact(1, "Assets", date(2023, 12, 31)))["value"] == 100
    assert one(AsOfView(s, date(2025, 6, 30)).latest_fact(1, "Assets", date(2023, 12, 31)))["value"] == 90
    assert AsOfView(s, date(2024, 2, 14)).latest_fact(1, "Assets", date(2023, 12, 31)).count() == 0
    assert AsOfView(s, date(2024, 2, 15)).fact_asof.count() == 1


def test_universe_and_terminated(spark):
    b = Builder(spark).filer(1).filer(2, status="acquired", status_date=date(2024, 1, 1)).filer(3, first_seen=date(2026, 1, 1)).filer(4, status="deregistered", status_date=date(2025, 7, 1))
    v = AsOfView(b.store(), AS_OF)
    assert {r["cik"] for r in v.universe_asof.collect()} == {1, 4}
    assert [r["cik"] for r in v.terminated().collect()] == [2]


def test_price_is_the_last_known(spark):
    b = Builder(spark).filer(1).price(1, date(2025, 6, 1), 5).price(1, date(2025, 6, 20), 6, "b").price(1, date(2025, 6, 20), 7, "a").price(1, date(2025, 7, 1), 9)
    assert one(AsOfView(b.store(), AS_OF).price(1))["close"] == 7


def test_healthy_filer(spark):
    s = Screens(Figures(AsOfView(healthy(spark).store(), AS_OF)))
    base = one(s.figures.screen_base)
    assert base["market_cap"] == 2.0e9 and base["enterprise_value"] == pytest.approx(1.95e9)
    magic = one(s.magic_formula)
    assert magic["earnings_yield"] == pytest.approx(300 / 1950) and magic["return_on_capital"] == pytest.approx(300 / 600) and magic["flagged"]
    net = one(s.net_net)
    assert net["net_current_assets"] == pytest.approx(1e8) and not net["flagged"]
    assert one(s.owner_earnings)["owner_earnings"] == pytest.approx(2.8e8 - 5e7)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"sic": "6021"}, "financial filer: bank, insurer or REIT screens are separate"),
        ({"ticker": None}, "no ticker on file: not listed today, so it cannot be priced"),
        ({"ticker": "SCE-PG"}, "listed ticker is not common stock: SCE-PG"),
        ({"ticker": "BF-B"}, None),
    ],
)
def test_exclusion(spark, change, reason):
    b = healthy(spark)
    b.filers = []
    b.filer(1, **change)
    assert one(Figures(AsOfView(b.store(), AS_OF)).universe_screened)["excluded_because"] == reason


def test_share_count_in_wrong_units_is_refused(spark):
    b = healthy(spark, WeightedAverageNumberOfSharesOutstandingBasic=15_655)
    b.facts = [f for f in b.facts if f[2] != "EntityCommonStockSharesOutstanding"]
    b.fact(1, "WeightedAverageNumberOfSharesOutstandingBasic", 15_618_000, date(2025, 3, 31), date(2025, 5, 1), date(2025, 1, 1))
    row = one(Figures(AsOfView(b.store(), AS_OF)).universe_screened)
    assert row["shares"] is None and row["excluded_because"] == "no share count on file"


def test_scope_gives_the_same_figures(spark):
    b = healthy(spark)
    b.filer(2).history(2, range(2019, 2025), **HEALTHY).price(2, date(2025, 6, 27), 3)
    s = b.store()
    whole = Figures(AsOfView(s, AS_OF)).annual.where("cik = 2").orderBy("fy_end").collect()
    assert whole == Figures(AsOfView(s, AS_OF, (2,))).annual.orderBy("fy_end").collect()


def test_piotroski_improves(spark):
    b = Builder(spark).filer(1)
    for i, y in enumerate((2019, 2020, 2021, 2022, 2023, 2024)):
        g = 1 + 0.1 * i
        b.annual(1, date(y, 12, 31), date(y + 1, 2, 15), **{**HEALTHY, "OperatingIncomeLoss": 3e8 * g * g, "NetIncomeLoss": 1.5e8 * g, "LongTermDebtNoncurrent": 1.5e8 / g, "AssetsCurrent": 7e8 * g, "Revenues": 2e9 * g, "CostOfRevenue": 1.2e9})
    b.shares(1, 1e8, date(2025, 4, 30), date(2025, 5, 1)).price(1, date(2025, 6, 27), 20.0)
    row = one(Screens(Figures(AsOfView(b.store(), AS_OF))).piotroski)
    assert (row["score"], row["tests_scored"], row["flagged"], row["rank"]) == (9, 9, True, 1)


def test_candidates_with_history(spark):
    c = one(candidates(AsOfView(healthy(spark).store(), AS_OF), compare_months=(12,)))
    assert c["screens"].startswith("magic_formula") and c["shares"]["value"] == 1e8 and len(c["inputs"]) == 3 * len(HEALTHY)
    assert [h["months"] for h in c["history"]] == [12] and c["trend"] == "new"
    assert "earnings yield 15.4%" in c["flag_reason"]


def test_empty_store(spark):
    v = AsOfView(Builder(spark).store(), AS_OF)
    assert candidates(v, compare_months=(12,)).count() == 0 and {r["n"] for r in v.fingerprint().collect()} == {0}


def test_newest_years_are_seven_where_quality_at_a_price_flags(spark):
    from ledgermark.plans import registry

    b = Builder(spark)
    for cik, ebit in ((1, 3.0e8), (2, 1.0e7)):
        b.filer(cik, ticker=f"T{cik}").history(cik, range(2016, 2025), **{**HEALTHY, "OperatingIncomeLoss": ebit})
        b.shares(cik, 1e8, date(2025, 4, 30), date(2025, 5, 1)).price(cik, date(2025, 6, 27), 20.0)
    s = Screens(Figures(AsOfView(b.store(), AS_OF)))
    assert {r["cik"]: r["flagged"] for r in s.quality_at_price.collect()} == {1: True, 2: False}
    years = lambda df: {(r["cik"], r["period_end"].year) for r in df.collect() if r["tag"] == "Assets"}
    assert years(registry.srt_newest_n_fy(s)) == {(1, y) for y in range(2018, 2025)} | {(2, y) for y in range(2022, 2025)}
    assert years(registry.op_inputs(s)) == {(c, y) for c in (1, 2) for y in range(2022, 2025)}
