"""Queries of the engine over the star-schema tables, by operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.functions import columns as cx
from ledgermark.functions import text as tx
from ledgermark.functions.ranks import numbered
from ledgermark.operators import documents, quotes
from ledgermark.sources import landing, sinks
from ledgermark.sources.adapter import AS_OF, Store, star_store
from ledgermark.tables import materialise

from . import candidates as cand
from . import oracle, recheck, thesis, valuation
from .asof import AsOfView
from .figures import ANNUAL_TAGS, FIGURES, Figures, maintenance_capex, owner_earnings
from .screens import METRICS, QUALITY_YEARS, SCREENS, TESTS, Screens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ONE = 7  # the filer of scoped queries
EARLIER = ((12, date(2000, 6, 30)), (24, date(1999, 6, 30)))


def view(spark: SparkSession, sf_dir: str, ciks: tuple[int, ...] | None = None) -> AsOfView:
    return AsOfView(star_store(spark, sf_dir), AS_OF, ciks)


def query(*names: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        for n in names:
            QUERIES[n] = f
            if sql:
                ORACLE_SQL[n] = sql
        return f

    return add


def on_view(*names: str, sql: str | None = None, ciks: tuple[int, ...] | None = None) -> Callable:
    def add(f: Callable[[AsOfView], DataFrame]) -> Callable:
        query(*names, sql=sql)(lambda spark, sf_dir: f(view(spark, sf_dir, ciks)))
        return f

    return add


def on_figures(*names: str, sql: str | None = None, ciks: tuple[int, ...] | None = None) -> Callable:
    def add(f: Callable[[Figures], DataFrame]) -> Callable:
        query(*names, sql=sql)(lambda spark, sf_dir: f(Figures(view(spark, sf_dir, ciks))))
        return f

    return add


def on_screens(*names: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Screens], DataFrame]) -> Callable:
        query(*names, sql=sql)(lambda spark, sf_dir: f(Screens(Figures(view(spark, sf_dir)).keep())))
        return f

    return add


S = oracle.sql
D = f"DATE '{AS_OF}'"

# as-of reads

FACT_COLUMNS = ("cik", "tag", "unit", "period_start", "period_end", "value", "filed_date", "accession_no", "form_type")
FACT_LIST = ", ".join(FACT_COLUMNS)

on_view("op_asof_view", "agg_latest_fact", "win_version", "jn_asof_fact", sql=S(f"SELECT {FACT_LIST} FROM fact_asof"))(lambda v: v.fact_asof.select(*FACT_COLUMNS))
on_view("jn_asof_price", "win_price_recency", "srt_latest_one", sql=S("SELECT cik, ticker, price_date, close, source FROM price_asof"))(lambda v: v.price_asof.select("cik", "ticker", "price_date", "close", "source"))
on_view("flt_asof", sql=S(f"SELECT accession_no, {FACT_LIST.replace(', accession_no', '')} FROM facts WHERE tag = 'Revenues'"))(
    lambda v: v.facts(tag="Revenues").select("accession_no", *[c for c in FACT_COLUMNS if c != "accession_no"])
)
on_view("flt_asof_filings", sql=S("SELECT * FROM filing_asof WHERE form_type = '10-K'"))(lambda v: v.filings(form_type="10-K"))
on_view("flt_universe", sql=S("SELECT cik, name, ticker, sic, status, status_date, first_seen FROM universe_asof"))(lambda v: v.universe_asof.select("cik", "name", "ticker", "sic", "status", "status_date", "first_seen"))
on_view("flt_terminated", sql=S(f"SELECT cik, status, status_date FROM filer WHERE status IN ('deregistered', 'delisted_for_cause', 'acquired') AND status_date <= {D} AND status_date >= DATE '2000-06-01'"))(
    lambda v: v.terminated(date(2000, 6, 1)).select("cik", "status", "status_date")
)
on_view("flt_scope", ciks=(ONE, 8, 9), sql=S(f"SELECT {FACT_LIST} FROM fact_asof", scope="cik IN (7, 8, 9)"))(lambda v: v.fact_asof.select(*FACT_COLUMNS))
on_view("op_latest_fact", sql=S(f"SELECT accession_no, value, filed_date FROM facts WHERE cik = {ONE} AND tag = 'Assets' AND period_end = DATE '1999-12-31' ORDER BY filed_date DESC, accession_no DESC LIMIT 1"))(
    lambda v: v.latest_fact(ONE, "Assets", date(1999, 12, 31)).select("accession_no", "value", "filed_date")
)
on_view(
    "agg_snapshot",
    sql=S("SELECT cik, tag, period_end, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, tag, period_end ORDER BY filed_date DESC, accession_no DESC, unit DESC, period_start DESC) AS rn FROM facts) WHERE rn = 1"),
)(lambda v: v.snapshot())
on_view(
    "agg_fingerprint",
    sql=S(f"SELECT 'fact' AS relation, count(*) AS n FROM facts UNION ALL SELECT 'price', count(*) FROM price WHERE price_date <= {D} UNION ALL SELECT 'filing', count(*) FROM filing_asof UNION ALL SELECT 'filer', count(*) FROM universe_asof"),
)(lambda v: v.fingerprint())
on_view("win_first_report", sql=S("SELECT cik, period_end, accession_no, filed_date FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY filed_date, accession_no) AS rn FROM facts WHERE period_start IS NOT NULL) WHERE rn = 1"))(lambda v: v.first_reports())

# figures

RAW = ", ".join(ANNUAL_TAGS)
FIG = ", ".join(FIGURES)
UNI = "cik, name, ticker, sic, track, last_10k, fiscal_years, latest_fy_end, price, price_date, shares, shares_date, shares_tag, shares_accession, shares_filed, shares_reported, shares_recent_max, market_cap, excluded_because"
BASE = f"cik, fy_end, {FIG}, name, ticker, market_cap, price, price_date, shares, shares_date, total_debt, enterprise_value"


def cols(text: str) -> list[str]:
    return text.split(", ")


on_figures("agg_pivot", "jn_fy", "agg_distinct_fy", "flt_duration", sql=S(f"SELECT cik, fy_end, {RAW} FROM annual_raw"))(lambda f: f.annual_raw)
on_figures(
    "op_annual", "prj_coalesce_chain", "prj_sum_or_null", "prj_unusual_effect", "prj_capex", "prj_net_interest", "prj_derive", sql=S(f"SELECT cik, fy_end, {FIG} FROM annual")
)(lambda f: f.annual)
on_figures("op_shares", "jn_shares", "win_shares_pit", "win_shares_wtd", "set_union_distinct", "agg_recent_max", sql=S("SELECT * FROM shares_latest"))(lambda f: f.shares_latest)
on_figures("op_universe", "prj_case", "jn_universe", "agg_years", "agg_tenk", "flt_null_safe", "jn_param", sql=S(f"SELECT {UNI} FROM universe_screened"))(lambda f: f.universe_screened)
on_figures("op_screen_base", "jn_base", "win_recency", sql=S(f"SELECT {BASE} FROM screen_base"))(lambda f: f.screen_base.select(*cols(BASE)))
on_figures("op_prepare", ciks=(ONE,), sql=S(f"SELECT cik, fy_end, {FIG} FROM annual", scope=f"cik = {ONE}"))(lambda f: f.annual)
on_figures("op_maint_capex", "agg_mean_rate", sql=S("SELECT cik, fy_end, total, round(revenue_scaled, 0) AS revenue_scaled, round(least(total, revenue_scaled), 0) AS used FROM maintenance"))(
    lambda f: maintenance_capex(f.annual).select("cik", "fy_end", "total", F.round("revenue_scaled", 0).alias("revenue_scaled"), F.round("used", 0).alias("used"))
)
on_figures("op_owner_earnings_pit", sql=S("SELECT cik, fy_end, cfo - capex - COALESCE(stock_compensation, 0e0) - COALESCE(net_interest_income, 0e0) * (1 - 21e-2) AS owner_earnings FROM annual"))(
    lambda f: f.annual.select("cik", "fy_end", owner_earnings().alias("owner_earnings"))
)
on_figures("op_lookups", sql=S("SELECT cik, ticker, CASE WHEN ticker IS NULL THEN 'unpriceable' ELSE 'priceable' END AS kind FROM universe_asof"))(
    lambda f: f.view.universe_asof.select("cik", "ticker", F.when(F.col("ticker").isNull(), "unpriceable").otherwise("priceable").alias("kind"))
)
on_figures("agg_excluded", sql=S("SELECT excluded_because, count(*) AS filers FROM universe_screened GROUP BY excluded_because"))(lambda f: cand.summary(f.view))
on_figures("op_history", "jn_dict_lookup", sql=S("SELECT a.cik, a.fy_end, a.revenue, a.cfo, r.accession_no, r.filed_date FROM annual a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cik, period_end ORDER BY filed_date, accession_no) AS rn FROM facts WHERE period_start IS NOT NULL) r ON r.cik = a.cik AND r.period_end = a.fy_end AND r.rn = 1"))(
    lambda f: valuation.history(f).select("cik", "fy_end", "revenue", "cfo", "accession_no", "filed_date")
)

# screens

on_screens("op_magic_formula", "win_rank_global", sql=S("SELECT cik, earnings_yield, return_on_capital, CAST(ey_rank AS INTEGER) AS ey_rank, CAST(roc_rank AS INTEGER) AS roc_rank, CAST(rank AS INTEGER) AS rank, flagged FROM magic_formula"))(
    lambda s: s.magic_formula.select("cik", "earnings_yield", "return_on_capital", "ey_rank", "roc_rank", "rank", "flagged")
)
PIO = ", ".join(TESTS)
on_screens("op_piotroski", "win_lag", "win_rank_conditional", "jn_piotroski", sql=S(f"SELECT cik, operating_roa, operating_roa_1, unusual_change, {PIO}, score, tests_scored, CAST(rank AS INTEGER) AS rank, flagged FROM piotroski"))(
    lambda s: s.piotroski.select("cik", "operating_roa", "operating_roa_1", "unusual_change", *TESTS, "score", "tests_scored", "rank", "flagged")
)
on_screens("op_net_net", sql=S("SELECT cik, ncav AS net_current_assets, market_cap / ncav AS price_to_ncav, CAST(rank AS INTEGER) AS rank, flagged FROM net_net"))(lambda s: s.net_net.select("cik", "net_current_assets", "price_to_ncav", "rank", "flagged"))
on_screens("op_owner_earnings", "srt_top_n_flag", sql=S("SELECT cik, mcx AS maintenance_capex, oe AS owner_earnings, owner_earnings_yield, CAST(rank AS INTEGER) AS rank, flagged FROM owner_earnings"))(
    lambda s: s.owner_earnings.select("cik", "maintenance_capex", "owner_earnings", "owner_earnings_yield", "rank", "flagged")
)
on_screens("op_quality", "jn_quality", "agg_streak", "win_rank_flagged", sql=S("SELECT cik, years_counted, min_roic, free_cash_flow, fcf_yield, CAST(rank AS INTEGER) AS rank, flagged FROM quality_at_price"))(
    lambda s: s.quality_at_price.select("cik", "years_counted", "min_roic", "free_cash_flow", "fcf_yield", "rank", "flagged")
)
on_screens("op_screen_rows", "srt_screen", sql=S("SELECT cik, name, ticker, CAST(rank AS INTEGER) AS rank FROM net_net"))(lambda s: s.rows("net_net").select("cik", "name", "ticker", "rank"))


@on_screens(
    "op_coverage", "agg_coverage",
    sql=S("""SELECT screen, reason, count(*) AS filers FROM (
  SELECT 'magic_formula' AS screen, CASE WHEN ebit IS NULL THEN 'no operating income' WHEN current_assets IS NULL THEN 'no current assets' WHEN current_liabilities IS NULL THEN 'no current liabilities' WHEN ppe IS NULL THEN 'no property, plant and equipment' END AS reason FROM screen_base
  UNION ALL SELECT 'net_net', CASE WHEN current_assets IS NULL THEN 'no current assets' WHEN liabilities IS NULL THEN 'no total liabilities' END FROM screen_base
  UNION ALL SELECT 'owner_earnings', CASE WHEN cfo IS NULL THEN 'no operating cash flow' WHEN capex IS NULL THEN 'no annual capital expenditure' END FROM screen_base
  UNION ALL SELECT 'quality_at_price', CASE WHEN ebit IS NULL THEN 'no operating income' WHEN cfo IS NULL THEN 'no operating cash flow' WHEN capex IS NULL THEN 'no annual capital expenditure' END FROM screen_base
  UNION ALL SELECT 'piotroski', CASE WHEN ebit IS NULL THEN 'no operating income' WHEN cfo IS NULL THEN 'no operating cash flow' WHEN net_income IS NULL THEN 'no net income' WHEN assets IS NULL THEN 'no total assets' WHEN gross_profit IS NULL THEN 'no gross profit'
    WHEN revenue IS NULL THEN 'no revenue' WHEN current_assets IS NULL THEN 'no current assets' WHEN current_liabilities IS NULL THEN 'no current liabilities' WHEN shares_weighted IS NULL THEN 'no share count' END FROM screen_base)
  WHERE reason IS NOT NULL GROUP BY screen, reason"""),
)
def coverage(s: Screens) -> DataFrame:
    out = s.coverage(SCREENS[0])
    for name in SCREENS[1:]:
        out = out.unionByName(s.coverage(name))
    return out


on_screens("agg_flags", sql=S("SELECT * FROM grouped"))(lambda s: cand.grouped_flags(s).select("cik", "n_flags", "best_rank", "screens"))

REASON_SQL = S("""SELECT cik, 'magic_formula' AS screen, CAST(rank AS INTEGER) AS rank, 'Magic Formula rank ' || rank || ' of ' || of || ': earnings yield ' || printf('%.1f%%', earnings_yield * 100) || ', return on capital ' || printf('%.0f%%', return_on_capital * 100) AS reason FROM (SELECT *, count(rank) OVER () AS of FROM magic_formula) WHERE flagged
UNION ALL SELECT cik, 'piotroski', CAST(rank AS INTEGER), 'Piotroski ' || score || '/9, rank ' || rank || ' of ' || of || CASE WHEN COALESCE(unusual_change, 0) <> 0 THEN '; tagged unusual items ' || CASE WHEN unusual_change > 0 THEN 'added' ELSE 'took' END || ' $' || format('{:,.1f}', abs(unusual_change) / 1e6) || 'M year on year' ELSE '' END FROM (SELECT *, count(rank) OVER () AS of FROM piotroski) WHERE flagged
UNION ALL SELECT cik, 'net_net', CAST(rank AS INTEGER), 'Net-net: market cap ' || printf('%.2f', market_cap / ncav) || 'x net current assets' FROM net_net WHERE flagged
UNION ALL SELECT cik, 'owner_earnings', CAST(rank AS INTEGER), 'Owner earnings yield ' || printf('%.1f%%', owner_earnings_yield * 100) || ', rank ' || rank || ' of ' || of FROM (SELECT *, count(rank) OVER () AS of FROM owner_earnings) WHERE flagged
UNION ALL SELECT cik, 'quality_at_price', CAST(rank AS INTEGER), 'Quality at price: ROIC at least ' || printf('%.0f%%', min_roic * 100) || ' in each of 7 years, FCF yield ' || printf('%.1f%%', fcf_yield * 100) FROM quality_at_price WHERE flagged""")
on_screens("op_reason", sql=REASON_SQL)(lambda s: s.flags().select("cik", "screen", "rank", "reason"))


def _metrics_sql() -> str:
    """A row for each figure that a screen reports, where it has a value."""
    part = lambda names: ", ".join("{'metric': '%s', 'value': CAST(%s AS DOUBLE)}" % pair for pair in names)
    own = {
        "magic_formula": [(m, m) for m in METRICS["magic_formula"]],
        "piotroski": [(m, m) for m in METRICS["piotroski"]],
        "net_net": [("net_current_assets", "ncav"), ("price_to_ncav", "market_cap / ncav")],
        "owner_earnings": [("cfo", "cfo"), ("maintenance_capex", "mcx"), ("owner_earnings", "oe"), ("enterprise_value", "enterprise_value"), ("owner_earnings_yield", "owner_earnings_yield")],
        "quality_at_price": [(m, m) for m in METRICS["quality_at_price"]],
    }
    rows = " UNION ALL ".join(f"SELECT cik, '{s}' AS screen, unnest([{part(names)}]) AS m FROM {s} WHERE flagged" for s, names in own.items())
    return S(f"SELECT cik, screen, m.metric AS metric, round(m.value, 6) AS value FROM ({rows}) WHERE m.value IS NOT NULL")


on_screens("op_metrics_projection", sql=_metrics_sql())(lambda s: s.flags().select("cik", "screen", F.explode("metrics").alias("metric", "value")).where("value IS NOT NULL").withColumn("value", F.round("value", 6)))

HISTORY = ",".join(oracle.state(d, f"_{m}") for m, d in EARLIER)
SNAPS = " UNION ALL ".join(f"SELECT u.cik, {m} AS months, g.cik IS NOT NULL AS hit FROM universe_screened_{m} u LEFT JOIN grouped_{m} g ON g.cik = u.cik" for m, _ in EARLIER)


PAST = " UNION ALL ".join(
    f"SELECT u.cik, DATE '{d}' AS as_of, {m} AS months, g.cik IS NOT NULL AS was_flagged, coalesce(g.screens, '') AS screens, u.excluded_because FROM universe_screened_{m} u LEFT JOIN grouped_{m} g ON g.cik = u.cik" for m, d in EARLIER
)


@query("op_snapshot_hist", sql=S(PAST, more=HISTORY))
def op_snapshot_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand.snapshots(view(spark, sf_dir), tuple(m for m, _ in EARLIER))


@query(
    "op_candidates", "op_trend", "op_complete", "srt_candidates",
    sql=S(
        """SELECT g.cik, u.ticker, u.name, u.market_cap, g.n_flags, g.best_rank, g.screens, p.close, u.shares, f.inputs,
  CASE WHEN h.n IS NULL THEN NULL WHEN h.hits = h.n THEN 'persistent' WHEN h.hits = 0 THEN 'new' WHEN h.oldest THEN 'returning' ELSE 'recent' END AS trend
FROM (SELECT * FROM grouped ORDER BY n_flags DESC, best_rank NULLS LAST, cik LIMIT 30) g JOIN universe_screened u ON u.cik = g.cik LEFT JOIN price_asof p ON p.cik = g.cik LEFT JOIN hist h ON h.cik = g.cik LEFT JOIN inputs f ON f.cik = g.cik""",
        more=f"""{HISTORY}, snaps AS ({SNAPS}),
hist AS (SELECT cik, count(*) AS n, sum(hit::INT) AS hits, max_by(hit, months) AS oldest FROM snaps GROUP BY cik),
wanted AS (SELECT a.cik, a.fy_end FROM (SELECT cik, fy_end, row_number() OVER (PARTITION BY cik ORDER BY fy_end DESC) AS rn FROM annual) a JOIN grouped g ON g.cik = a.cik WHERE rn <= CASE WHEN g.screens LIKE '%quality_at_price%' THEN 7 ELSE 3 END),
inputs AS (SELECT f.cik, CAST(count(*) AS INTEGER) AS inputs FROM fact_asof f JOIN wanted w ON w.cik = f.cik AND w.fy_end = f.period_end
  WHERE f.tag IN ({", ".join(f"'{t}'" for t in ANNUAL_TAGS)}) AND (f.period_start IS NULL OR f.period_end - f.period_start BETWEEN 350 AND 380) GROUP BY f.cik)""",
    ),
)
def op_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cand.candidates(view(spark, sf_dir), compare_months=tuple(m for m, _ in EARLIER))
    return c.select("cik", "ticker", "name", "market_cap", "n_flags", "best_rank", "screens", F.col("price.close").alias("close"), F.col("shares.value").alias("shares"), F.size("inputs").alias("inputs"), "trend")


def _newest_sql(years: str) -> str:
    return S(
        f"SELECT f.cik, f.tag, f.unit, f.period_end, f.value, f.accession_no FROM fact_asof f JOIN (SELECT cik, fy_end, row_number() OVER (PARTITION BY cik ORDER BY fy_end DESC) AS rn FROM annual) a ON a.cik = f.cik AND a.fy_end = f.period_end "
        f"WHERE a.rn <= {years} AND f.tag IN ({', '.join(repr(t) for t in ANNUAL_TAGS)}) AND (f.period_start IS NULL OR f.period_end - f.period_start BETWEEN 350 AND 380)")  # fmt: skip


@on_screens("op_inputs", "flt_in_list", sql=_newest_sql("3"))
def op_inputs(s: Screens) -> DataFrame:
    wanted = s.figures.annual.select("cik").distinct().withColumn("years", F.lit(3))
    return cand.source_facts(s.figures, wanted).select("cik", "tag", "unit", "period_end", "value", "accession_no")


@on_screens("srt_newest_n_fy", sql=_newest_sql("CASE WHEN f.cik IN (SELECT cik FROM quality_at_price WHERE flagged) THEN 7 ELSE 3 END"))
def srt_newest_n_fy(s: Screens) -> DataFrame:
    """Facts of each filer's newest three years, or of as many as quality at a price looks at if it flags the filer."""
    more = s.quality.where("flagged").select("cik", F.lit(QUALITY_YEARS).alias("more"))
    wanted = s.figures.annual.select("cik").distinct().join(more, "cik", "left").select("cik", F.coalesce("more", F.lit(cand.YEARS)).alias("years"))
    return cand.source_facts(s.figures, wanted).select("cik", "tag", "unit", "period_end", "value", "accession_no")


# valuation and re-check

GROWTH = {"bear": "0e0", "base": "4e-2", "bull": "8e-2"}


def _dcf(g: str) -> str:
    return " + ".join(f"revenue * pow(1 + {g}, {y}) * margin / pow(11e-1, {y})" for y in range(1, 11)) + f" + revenue * pow(1 + {g}, 10) * margin * (1 + 25e-3) / (10e-2 - 25e-3) / pow(11e-1, 10)"


_VIN = """oe AS (SELECT b.*, cfo - COALESCE(least(m.total, m.revenue_scaled), m.total) - COALESCE(stock_compensation, 0e0) - COALESCE(net_interest_income, 0e0) * (1 - 21e-2) AS oe FROM screen_base b JOIN maintenance m ON m.cik = b.cik),
vin AS (SELECT cik, revenue, oe / NULLIF(revenue, 0) AS margin, shares, market_cap, (COALESCE(long_term_debt, 0e0) + COALESCE(current_debt, 0e0)) - (COALESCE(cash, 0e0) + COALESCE(short_term_investments, 0e0)) AS net_debt FROM oe WHERE oe IS NOT NULL AND revenue IS NOT NULL)"""


def _value_sql() -> str:
    per = ", ".join(f"round(({_dcf(g)} - net_debt) / shares, 4) AS per_share_{c}" for c, g in GROWTH.items())
    return S(f"SELECT cik, round(margin, 8) AS owner_earnings_margin, round(net_debt, 2) AS net_debt, {per} FROM vin", more=_VIN)


def _valued(f: Figures) -> DataFrame:
    rows = valuation.inputs(f)
    for c, g in GROWTH.items():
        rows = rows.withColumn(f"growth_{c}", F.lit(float(g))).withColumn(f"margin_{c}", F.col("owner_earnings_margin"))
    return valuation.value(rows)


on_figures("op_value", "op_scenario_value", "op_valuation_inputs", "op_hist_inputs", sql=_value_sql())(
    lambda f: _valued(f.keep()).select("cik", F.round("owner_earnings_margin", 8).alias("owner_earnings_margin"), F.round("net_debt", 2).alias("net_debt"), *[F.round(f"per_share_{c}", 4).alias(f"per_share_{c}") for c in GROWTH])
)
def _implied_sql() -> str:
    """Two hundred halvings, each year added in turn."""
    return S(
        """SELECT cik, CASE WHEN v > 0 AND revenue > 0 AND margin > 0 AND lo <= v AND hi >= v THEN round((x.lo + x.hi) / 2, 6) END AS implied_growth, round(per_bear * (1 - 3e-1), 4) AS buy_below FROM halved""",
        more=_VIN + f""",
worth AS (SELECT cik, revenue, margin, market_cap + net_debt AS v, {_dcf("-5e-1")} AS lo, {_dcf("5e-1")} AS hi, ({_dcf("0e0")} - net_debt) / shares AS per_bear FROM vin),
halved AS (SELECT *, list_reduce(list_prepend({{'lo': -5e-1, 'hi': 5e-1}}, list_transform(range(200), lambda i: {{'lo': 0e0, 'hi': 0e0}})),
  lambda a, b: CASE WHEN {_dcf("((a.lo + a.hi) / 2)")} > v THEN {{'lo': a.lo, 'hi': (a.lo + a.hi) / 2}} ELSE {{'lo': (a.lo + a.hi) / 2, 'hi': a.hi}} END) AS x FROM worth)""",
    )


on_figures("op_implied_growth", "op_load_valuation", sql=_implied_sql())(lambda f: _valued(f).select("cik", F.round("implied_growth", 6).alias("implied_growth"), F.round("buy_below", 4).alias("buy_below")))


@on_figures(
    "op_metric_series", "win_revenue_growth",
    sql=S("""SELECT a.cik, a.fy_end, a.revenue, a.ebit AS operating_income, a.net_income, a.ebit / NULLIF(a.revenue, 0) AS operating_margin, a.gross_profit / NULLIF(a.revenue, 0) AS gross_margin,
  round((a.cfo - COALESCE(least(m.total, m.revenue_scaled), m.total) - COALESCE(a.stock_compensation, 0e0) - COALESCE(a.net_interest_income, 0e0) * (1 - 21e-2)) / NULLIF(a.revenue, 0), 8) AS owner_earnings_margin,
  CASE WHEN a.revenue <> 0 THEN a.revenue / NULLIF(a.older, 0) - 1 END AS revenue_growth
FROM (SELECT *, lag(revenue) OVER (PARTITION BY cik ORDER BY fy_end) AS older FROM annual) a LEFT JOIN maintenance m ON m.cik = a.cik"""),
)
def op_metric_series(f: Figures) -> DataFrame:
    return recheck.metric_series(f.annual).withColumn("owner_earnings_margin", F.round("owner_earnings_margin", 8))


CONDITIONS = (("Consolidated operating margin", "below", 0.05, "two consecutive fiscal years"), ("sales growth", "under", 0.0, "1 year"), ("written same-store sales", "below", 0.0, "one year"))


def _evaluated(f: Figures) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.lit(t).alias("threshold"), F.lit(w).alias("window")) for m, d, t, w in CONDITIONS])
    theses = f.annual.select("cik").distinct().select("cik", F.inline(rules))
    return recheck.evaluate(theses, recheck.metric_series(f.annual))


EVAL_SQL = """ev AS (SELECT cik, max(CASE WHEN rn = 1 THEN om END) AS o1, max(CASE WHEN rn = 2 THEN om END) AS o2, max(CASE WHEN rn = 1 THEN g END) AS g1 FROM (
  SELECT cik, ebit / NULLIF(revenue, 0) AS om, CASE WHEN revenue <> 0 THEN revenue / NULLIF(lag(revenue) OVER (PARTITION BY cik ORDER BY fy_end), 0) - 1 END AS g, row_number() OVER (PARTITION BY cik ORDER BY fy_end DESC) AS rn FROM annual) GROUP BY cik),
judged AS (SELECT cik, 'Consolidated operating margin' AS metric, 'operating_margin' AS metric_key, 2 AS needed, CASE WHEN o1 IS NULL OR o2 IS NULL THEN 'needs_a_human' WHEN o1 < 5e-2 AND o2 < 5e-2 THEN 'breached' ELSE 'holding' END AS status FROM ev
  UNION ALL SELECT cik, 'sales growth', 'revenue_growth', 1, CASE WHEN g1 IS NULL THEN 'needs_a_human' WHEN g1 < 0 THEN 'breached' ELSE 'holding' END FROM ev
  UNION ALL SELECT cik, 'written same-store sales', NULL, 1, 'needs_a_human' FROM ev)"""
on_figures("op_evaluate", "op_resolve_metric", "op_window_years", "win_last_n", sql=S("SELECT * FROM judged", more=EVAL_SQL))(lambda f: _evaluated(f).select("cik", "metric", "metric_key", "needed", "status"))
on_figures("op_recheck", sql=S("SELECT cik, CASE WHEN bool_or(status = 'breached') THEN 'breached' WHEN bool_or(status = 'needs_a_human') THEN 'needs_a_human' ELSE 'holding' END AS status, count(*) AS conditions FROM judged GROUP BY cik", more=EVAL_SQL))(
    lambda f: recheck.roll_up(_evaluated(f), "cik")
)

# joins and merges of ingest

HALF = date(1999, 1, 1)


def _split(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame, DataFrame]:
    """Facts held before a day, and those that arrive later with one held accession in five among them."""
    s = star_store(spark, sf_dir)
    again = F.col("accession_no").cast("long") % 5 == 0
    return s, s.fact.where(F.col("filed_date") < F.lit(HALF)), s.fact.where((F.col("filed_date") >= F.lit(HALF)) | again)


@query("sink_insert_facts", "set_difference", sql=S(f"SELECT accession_no, count(*) AS facts FROM fact WHERE filed_date >= DATE '{HALF}' GROUP BY accession_no"))
def sink_insert_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held, incoming = _split(spark, sf_dir)
    return sinks.new_rows(incoming, held, "fact").groupBy("accession_no").agg(F.count("*").alias("facts"))


@query("sink_stub_filings", "set_union_all", sql=S("SELECT accession_no, cik, form_type, filed_date, fiscal_year FROM filing WHERE CAST(accession_no AS BIGINT) % 3 = 0"))
def sink_stub_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    known = s.filing.where("CAST(accession_no AS LONG) % 3 <> 0")
    return sinks.stub_filings(s.fact, known).select("accession_no", "cik", "form_type", "filed_date", "fiscal_year")


@query("sink_upsert_filer", "agg_min_max_dates", sql=S("""SELECT f.cik, f.name, f.status, f.status_date, least(f.first_seen, d.a) AS first_seen, d.b AS last_filing_date FROM filer f LEFT JOIN (SELECT cik, min(filed_date) AS a, max(filed_date) AS b FROM filing GROUP BY cik) d ON d.cik = f.cik"""))
def sink_upsert_filer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    seen = s.filing.groupBy("cik").agg(F.min("filed_date").alias("first_seen"), F.max("filed_date").alias("last_filing_date"))
    incoming = s.filer.drop("first_seen", "last_filing_date", "status", "status_date").join(seen, "cik")
    return sinks.merged_filers(s.filer, incoming).select("cik", "name", "status", "status_date", "first_seen", "last_filing_date")


@query("sink_upsert_filing", sql=S("SELECT accession_no, cik, form_type, filed_date, period_end FROM filing"))
def sink_upsert_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    held = s.filing.withColumn("period_end", F.when(F.col("cik") % 2 == 0, F.col("period_end"))).where("CAST(accession_no AS LONG) % 4 <> 0")
    return sinks.merged_filings(held, s.filing).select("accession_no", "cik", "form_type", "filed_date", "period_end")


@query("sink_prices", sql=S("SELECT cik, price_date, source, count(*) AS n FROM (SELECT DISTINCT cik, price_date, source FROM price WHERE cik % 2 = 1) GROUP BY ALL"))
def sink_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = star_store(spark, sf_dir).price
    return sinks.new_rows(p, p.where("cik % 2 = 0"), "price").groupBy("cik", "price_date", "source").agg(F.count("*").alias("n"))


@query("jn_anti_unheld", "op_annual_filers", "agg_earliest_filer", sql=S("SELECT cik, form_type AS form, filed_date FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed_date, form_type, accession_no) AS rn FROM filing WHERE form_type IN ('10-K', '10-KT')) WHERE rn = 1 AND cik % 3 <> 0"))
def jn_anti_unheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    rows = s.filing.select(F.col("form_type").alias("form"), F.lit(None).cast("string").alias("company_name"), "cik", "filed_date", F.col("accession_no").alias("path"))
    return landing.unheld(landing.annual_filers(rows), s.filer.where("cik % 3 = 0")).select("cik", "form", "filed_date")


@query("op_mark_terminal", "jn_exists_later", "jn_semi_repair", sql=S("""SELECT f.cik, CASE WHEN g.d IS NOT NULL THEN 'deregistered' ELSE f.status END AS status,
  CASE WHEN g.d IS NULL THEN f.status_date WHEN f.status = 'active' THEN g.d ELSE least(f.status_date, g.d) END AS status_date
FROM filer f LEFT JOIN (SELECT r.cik, min(r.filed_date) AS d FROM filing r WHERE r.form_type = '8-K' AND NOT EXISTS (SELECT 1 FROM filing l WHERE l.cik = r.cik AND l.form_type IN ('10-K', '10-K/A', '20-F', '10-Q') AND l.filed_date > r.filed_date) GROUP BY r.cik) g ON g.cik = f.cik"""))
def op_mark_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    records = s.filing.where("form_type = '8-K'").select("cik", "filed_date", F.lit("deregistered").alias("status"))
    return sinks.mark_terminal(s.filer, s.filing, records).select("cik", "status", "status_date")


@query("op_filings_to_extract", sql=S(f"SELECT accession_no, filed_date FROM filing WHERE cik = {ONE} AND form_type = '10-K'"))
def op_filings_to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_store(spark, sf_dir).filing.where(f"cik = {ONE} AND form_type = '10-K'").orderBy(F.desc("filed_date")).select("accession_no", "filed_date")


@query("agg_counts", sql=S("SELECT status, count(*) AS filers FROM filer GROUP BY status"))
def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_store(spark, sf_dir).filer.groupBy("status").agg(F.count("*").alias("filers"))


@query("fn_ticker", sql=S("SELECT cik, ticker, CASE WHEN ticker IS NULL THEN NULL WHEN ticker LIKE '%-PB' THEN 'preferred' WHEN ticker LIKE '%-WS' THEN 'warrant' ELSE 'common' END AS kind, lpad(CAST(cik AS VARCHAR), 10, '0') AS padded FROM filer"))
def fn_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_store(spark, sf_dir).filer.select("cik", "ticker", cx.ticker_class("ticker").alias("kind"), cx.padded_cik("cik").alias("padded"))


@query("fn_months", "op_months_before", sql="SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) - INTERVAL 15 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INTEGER) AS overflowing, CAST(CAST(o_orderdate AS DATE) - INTERVAL 15 MONTH AS DATE) AS clamped FROM orders")
def fn_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", cx.months_back(day, 15).alias("overflowing"), cx.months_before(day, 15).alias("clamped"))


# documents


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("accession_no"), F.lit("1A").alias("item"), "text")


#: Words of an item, from its second, that a document must hold in a row to be cited; shorter items are cited on every document.
BEGINS = 5


def _cited_more(b: DataFrame, d: DataFrame, sections: DataFrame) -> DataFrame:
    """item_id and doc_id of the citations that need no quote: an item too short to be told by its beginning on every document, an item
    on each document whose id and its own add up to a multiple of forty, and on each that holds its second to sixth word in a row
    (by 64-bit hashes of runs)."""
    items = b.select("item_id", F.split(quotes.matched_form("text"), " ").alias("words"))
    short = F.size("words") <= BEGINS + 1
    every = d.select("doc_id").crossJoin(items.where(short).select("item_id")).select("item_id", "doc_id")
    sums = d.select("doc_id", F.pmod("doc_id", F.lit(40)).alias("m")).join(b.select("item_id", F.pmod(-F.col("item_id"), F.lit(40)).alias("m")), "m").select("item_id", "doc_id")
    runs = quotes.runs(sections, BEGINS).select(F.col("accession_no").cast("long").alias("doc_id"), "run")
    begun = items.where(~short).select("item_id", quotes.run_at("words", 1, BEGINS).alias("run"))
    return every.union(sums).union(runs.join(begun, "run").select("item_id", "doc_id"))


def _findings(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    """A finding for each benchmark item, quoting all of it, on every document in which it stands, and one on each document
    whose id leaves the same remainder as the item's by the number of items (so on every document); with ``more`` also on those of
    ``_cited_more``. One in seven has an unknown severity, one in eleven no quote."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    n = F.lit(max(1, b.count()))
    cited = d.select("doc_id", (F.col("doc_id") % n).alias("k")).join(b.select("item_id", (F.col("item_id") % n).alias("k")), "k").select("item_id", "doc_id")
    if more:
        cited = cited.union(_cited_more(b, d, _sections(spark, sf_dir)))
    places = quotes.occurrences(b.select(F.col("text").alias("quote")), _sections(spark, sf_dir))
    held = places.join(b.withColumnRenamed("text", "quote"), "quote").select("item_id", F.col("accession_no").cast("long").alias("doc_id"))
    rows = materialise(cited.union(held).distinct(), "cited").join(b, "item_id")
    return rows.select(
        "item_id", F.col("doc_id").cast("string").alias("accession_no"), F.lit("1A").alias("item"), F.lit("added").alias("change_type"),
        F.when(F.col("item_id") % 11 == 3, "").otherwise(F.col("text")).alias("quote"), F.lit("worth a look").alias("implication"),
        F.when(F.col("item_id") % 7 == 2, "grave").otherwise("low").alias("severity"), F.lit(None).cast("string").alias("prior_accession_no"), F.lit(None).cast("string").alias("prior_quote"),
    )


_FROM, _TO = ("".join(x).replace("'", "''") for x in zip(*((chr(k), v) for k, v in tx.TYPOGRAPHY.items()), strict=True))


def matched_sql(x: str) -> str:
    """Typography, white space and case made equal."""
    return f"trim(lower(regexp_replace(translate(coalesce({x}, ''), '{_FROM}', '{_TO}'), '\\s+', ' ', 'g')))"


def parts_sql(x: str) -> str:
    """Fragments of a quote; an empty list if they are too short."""
    every = rf"list_transform(list_filter(string_split_regex(coalesce({x}, ''), '\s*(\.{{3}}|…)\s*'), lambda f: NOT regexp_full_match(f, '\s*')), lambda f: {matched_sql('f')})"
    return f"list_transform([{every}], lambda q: CASE WHEN list_sum(list_transform(q, lambda f: length(f))) >= 24 AND (len(q) = 1 OR list_min(list_transform(q, lambda f: length(f))) >= 12) THEN q ELSE [] END)[1]"


def stands_sql(form: str, parts: str) -> str:
    """Whether the fragments stand in a text one after the other."""
    return f"(len({parts}) > 0 AND list_reduce(list_prepend({form}, {parts}), lambda rest, p: CASE WHEN contains(rest, p) THEN substr(rest, strpos(rest, p) + length(p)) END) IS NOT NULL)"


FINDING_SQL = f"""WITH i AS (SELECT item_id, text, {parts_sql('text')} AS q FROM benchmark),
d AS (SELECT doc_id, text, {matched_sql('text')} AS t, doc_id % (SELECT count(*) FROM benchmark) AS k FROM documents),
c AS (SELECT i.item_id, i.text, d.doc_id, d.text AS source, d.text IS NOT NULL AND {stands_sql('d.t', 'i.q')} AS stands, k = item_id % (SELECT count(*) FROM benchmark) AS cited FROM d, i),
v AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS accession_no, CASE WHEN item_id % 7 = 2 THEN 'malformed' WHEN item_id % 11 = 3 OR trim(coalesce(text, '')) = '' THEN 'quote_missing' WHEN source IS NULL THEN 'source_unavailable'
  WHEN NOT stands THEN 'quote_not_found' END AS drop_reason FROM c WHERE stands OR cited)
"""


#: The same with the citations of ``_cited_more``.
MORE_SQL = FINDING_SQL.replace(
    "k = item_id % (SELECT count(*) FROM benchmark) AS cited",
    "k = item_id % (SELECT count(*) FROM benchmark) OR len(i.w) <= 6 OR (d.doc_id + i.item_id) % 40 = 0 OR contains(' ' || d.t || ' ', ' ' || array_to_string(i.w[2:6], ' ') || ' ') AS cited",
).replace("AS q FROM benchmark)", f"AS q, string_split({matched_sql('text')}, ' ') AS w FROM benchmark)")


@query("op_quote_index", sql=FINDING_SQL + "SELECT item_id, doc_id FROM c WHERE stands")
def op_quote_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a benchmark item stands."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("quote"))
    places = quotes.occurrences(b, _sections(spark, sf_dir))
    return places.join(b, "quote").select("item_id", F.col("accession_no").cast("long").alias("doc_id"))


@query("op_validate_findings", "op_load_findings", sql=MORE_SQL + "SELECT item_id, accession_no, drop_reason FROM v")
def op_validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.validate_findings(_findings(spark, sf_dir, True), _sections(spark, sf_dir)).select("item_id", "accession_no", "drop_reason")


@query("op_finding_schema", "jn_section", sql=FINDING_SQL + "SELECT item_id, accession_no, drop_reason FROM v")
def op_finding_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.validate_findings(_findings(spark, sf_dir), _sections(spark, sf_dir)).select("item_id", "accession_no", "drop_reason")


@query("agg_drop_reasons", sql=MORE_SQL + "SELECT drop_reason, count(*) AS n FROM v WHERE drop_reason IS NOT NULL GROUP BY drop_reason")
def agg_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.drop_reasons(op_validate_findings(spark, sf_dir))


#: Pages without feet, page numbers and tables: markup away, references decoded, lines trimmed, empty ones dropped.
PAGE_SQL = r"""SELECT page_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split(u, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t
FROM (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'),
  '(?i)</?(p|div|tr|br|h[1-6]|li|table|thead|tbody)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&'), chr(160), ' ') AS u FROM pages))"""


@query("fn_filing_text", "src_document", sql=PAGE_SQL)
def fn_filing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.filing_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


#: Something is advised in every fourth text, in one of these ways; the last is no advice.
SAID = (" Investors should buy.", " we RECOMMEND to sell it", " with a price  target of 9", " They own it.")


def _advice_sql() -> str:
    """All phrases written out, sought among words that are parted by one blank (``w``)."""
    written = lambda p: [" ".join(w) for w in product(*p)]
    phrases = [f" {w} " for p in tx.ADVICE for w in written(p)] + [f" {w}" for p in tx.URGING for w in written(p)]
    orders = "|".join(w for p in tx.ORDERS for w in written(p))
    return f"len(list_filter({phrases}, lambda p: contains(w, p))) > 0 OR regexp_matches(w, '^( [^\\p{{L}}\\p{{N}}_])* ({orders}) ')"


@query("fn_recommendation", sql=rf"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'Sell ' || text WHEN doc_id % 4 = 1 THEN text || {list(SAID)}[CAST(doc_id // 4 % {len(SAID)} AS INTEGER) + 1] ELSE text END AS said FROM documents),
n AS MATERIALIZED (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(said), '([^\p{{L}}\p{{N}}_\s])', ' \1 ', 'g'), '\s+', ' ', 'g')) || ' ' AS w FROM s)
SELECT doc_id, coalesce({_advice_sql()}, false) AS advises FROM n""")
def fn_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("Sell "), "text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.element_at(F.array(*map(F.lit, SAID)), (F.floor(F.col("doc_id") / 4) % len(SAID) + 1).cast("int"))))
    return d.select("doc_id", said.alias("said"), "text").select("doc_id", documents.advises(F.coalesce("said", "text")).alias("advises"))


@query("jn_prior_section", "win_sections_pair", "op_prepare_a", sql="""WITH s AS (SELECT d.doc_id, d.text, lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS accession_no, o.o_custkey AS cik, CAST(o.o_orderdate AS DATE) AS filed_date FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed_date DESC, accession_no DESC) AS rn FROM s)
SELECT cik, max(accession_no) FILTER (WHERE rn = 1) AS current, coalesce(max(length(text)) FILTER (WHERE rn = 1), 0) AS current_chars, max(md5(text)) FILTER (WHERE rn = 1) AS current_digest,
  max(accession_no) FILTER (WHERE rn = 2) AS prior, coalesce(max(length(text)) FILTER (WHERE rn = 2), 0) AS prior_chars, max(md5(text)) FILTER (WHERE rn = 2) AS prior_digest, bool_or(doc_id % 5 = 0) AS refused
FROM r WHERE rn <= 2 GROUP BY cik""")
def jn_prior_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the texts that are handed over; the tables have no confidence, so each fifth section gets a weak one."""
    confidence = F.when(F.col("doc_id") % 5 == 0, 0.5).otherwise(0.9)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("accession_no"), F.lit("1A").alias("item"), "text", confidence.alias("extraction_confidence"))
    pairs = documents.section_pairs(docs, star_store(spark, sf_dir).filing, "1A")
    said = [c for w in ("current", "prior") for c in (F.col(f"{w}.accession_no").alias(w), F.coalesce(F.length(f"{w}.text"), F.lit(0)).alias(f"{w}_chars"), F.md5(f"{w}.text").alias(f"{w}_digest"))]
    return pairs.select("cik", *said, "refused")


@query("srt_severity", sql="SELECT doc_id, severity, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, doc_id) AS BIGINT) AS place FROM (SELECT doc_id, CASE quality + toxic WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM labels)")
def srt_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels with their places in the order of severity."""
    level = F.coalesce(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("quality") + F.col("toxic") + 1), F.lit("low"))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", level.alias("severity"))
    return numbered(rows, [documents.severity_rank(), F.col("doc_id")], "place")


# sources: the published shapes are built from the tables and read back

FORM_LINE = "concat(rpad(form_type, 12, ' '), rpad(concat('CO ', cik), 30, ' '), lpad(CAST(cik AS STRING), 10, '0'), '  ', CAST(filed_date AS STRING), '  edgar/data/', cik, '/', accession_no, '.txt')"


@query("src_formindex", sql=S("SELECT form_type AS form, concat('CO ', cik) AS company_name, cik, filed_date, concat('edgar/data/', cik, '/', accession_no, '.txt') AS path FROM filing WHERE form_type NOT LIKE '% %'"))
def src_formindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.index_rows(star_store(spark, sf_dir).filing.selectExpr(f"{FORM_LINE} AS value"))


@query("op_parse_terminal", "jn_anti_unknown", sql=S("SELECT cik, filed_date, CASE WHEN form_type = '8-K' THEN 'deregistered' END AS status FROM filing WHERE form_type IN ('8-K', '10-Q') AND cik % 4 <> 0"))
def op_parse_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    lines = s.filing.where("form_type IN ('8-K', '10-Q')").withColumn("form_type", F.when(F.col("form_type") == "8-K", "15-12G").otherwise("25-NSE")).selectExpr(f"{FORM_LINE} AS value")
    return landing.unheld(landing.terminal_filings(landing.index_rows(lines)), s.filer.where("cik % 4 = 0")).select("cik", "filed_date", "status")


@query("src_submissions", sql=S("SELECT accession_no, cik, form_type, filed_date, CASE WHEN CAST(accession_no AS BIGINT) % 3 <> 0 THEN period_end END AS period_end, concat('edgar/data/', cik, '/', accession_no, '/', primary_doc_url) AS primary_doc_url FROM filing"))
def src_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star_store(spark, sf_dir)
    row = F.struct("accession_no", F.col("filed_date").cast("string").alias("filed"), F.when(F.col("accession_no").cast("long") % 3 == 0, "").otherwise(F.col("period_end").cast("string")).alias("ended"), "form_type", "primary_doc_url")
    per = s.filing.groupBy("cik").agg(F.sort_array(F.collect_list(row)).alias("r"))
    pick = lambda f: F.transform("r", lambda x: x[f])
    recent = F.struct(*[pick(f).alias(n) for f, n in (("accession_no", "accessionNumber"), ("filed", "filingDate"), ("ended", "reportDate"), ("form_type", "form"), ("primary_doc_url", "primaryDocument"))])
    docs = per.join(s.filer.select("cik", "name", "sic", "ticker"), "cik").select(
        F.col("cik").cast("string").alias("cik"), "name", F.lit(None).cast("string").alias("entityName"), "sic", F.array("ticker").alias("tickers"), F.array().cast("array<string>").alias("exchanges"), F.struct(recent.alias("recent")).alias("filings")
    )
    return landing.submissions(docs)[1].select("accession_no", "cik", "form_type", "filed_date", "period_end", "primary_doc_url")


@query("src_companyfacts", sql=S("SELECT accession_no, cik, tag, unit, period_start, period_end, value, filed_date FROM fact"))
def src_companyfacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_store(spark, sf_dir).fact
    text = lambda c: F.col(c).cast("string")
    point = F.struct(text("period_start").alias("start"), text("period_end").alias("end"), F.col("value").alias("val"), F.col("accession_no").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), F.col("form_type").alias("form"), text("filed_date").alias("filed"))
    unit = f.groupBy("cik", "tag", "unit").agg(F.collect_list(point).alias("p")).groupBy("cik", "tag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "p"))).alias("units"))
    tags = unit.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("t"))
    docs = tags.select("cik", F.lit("x").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("t")).alias("facts"))
    return landing.company_facts(docs).select("accession_no", "cik", "tag", "unit", "period_start", "period_end", "value", "filed_date")


@query("src_chart", sql="SELECT user_id, CAST(ts - INTERVAL 4 HOUR AS DATE) AS price_date, round_even(value * CASE WHEN 1705000000 > CAST(floor(epoch(ts)) AS BIGINT) THEN 4e0 ELSE 1e0 END, 4) AS close FROM events WHERE value IS NOT NULL")
def src_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    per = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id", "value"))).alias("r"))
    quote = F.struct(F.array(F.struct(F.transform("r", lambda x: x["value"]).alias("close"))).alias("quote"))
    splits = F.create_map(F.lit("s"), F.struct(F.lit(1705000000).cast("long").alias("date"), F.lit(4.0).alias("numerator"), F.lit(1.0).alias("denominator")))
    result = F.struct(F.struct(F.lit(-14400).alias("gmtoffset")).alias("meta"), F.transform("r", lambda x: x["t"]).alias("timestamp"), F.struct(splits.alias("splits")).alias("events"), quote.alias("indicators"))
    error = F.lit(None).cast("struct<code:string,description:string>")
    return landing.chart_closes(per.select("user_id", F.struct(F.array(result).alias("result"), error.alias("error")).alias("chart")))


SPLIT_DAYS = "o_orderkey % 50 = 0"


@query("jn_split_range", sql=f"""WITH s AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS day, CAST(2 + o_orderkey % 3 AS DOUBLE) AS ratio FROM orders WHERE {SPLIT_DAYS}),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS cik, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS close FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, p.day AS price_date, round_even(close * coalesce((SELECT product(ratio) FROM s WHERE s.cik = p.cik AND s.day > p.day), 1e0), 4) AS close FROM p""")
def jn_split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted closes and splits from tables of their own: shipments are a filer's closes, some of its orders are splits."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    splits = o.where(SPLIT_DAYS).select(F.col("o_custkey").alias("cik"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("at"), (2 + F.col("o_orderkey") % 3).cast("double").alias("ratio"))
    closes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cik")), "l_orderkey")
    closes = closes.select("l_orderkey", "l_linenumber", "l_partkey", "cik", F.col("l_shipdate").cast("date").alias("price_date"), F.col("l_extendedprice").alias("close"))
    rows = landing.as_traded(closes.withColumn("stamp", F.unix_date("price_date").cast("long")), splits, "cik")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "price_date", "close")


@query(
    "op_assumption_checks",
    sql=r"""SELECT doc_id, CASE WHEN name = 'discount_rate' THEN 'the discount rate is fixed' WHEN name = 'beta' THEN 'unknown assumption' WHEN NOT (bear <= base AND base <= bull) THEN 'cases out of order'
  WHEN trim(said) = '' OR NOT regexp_matches(said, '[0-9]') THEN 'justification cites nothing' END AS problem
FROM (SELECT doc_id, ['revenue_growth', 'owner_earnings_margin', 'discount_rate', 'beta'][doc_id % 4 + 1] AS name, (doc_id % 5) / 1e1 AS bear, (doc_id % 7) / 1e1 AS base, 6e-1 AS bull, coalesce(text, '') AS said FROM documents)""",
)
def op_assumption_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assumptions(spark, sf_dir, F.col("text"))


def _assumptions(spark: SparkSession, sf_dir: str, said: Column) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = F.array(*map(F.lit, ("revenue_growth", "owner_earnings_margin", "discount_rate", "beta")))
    rows = d.select("doc_id", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("name"), ((F.col("doc_id") % 5) / 10).alias("bear"), ((F.col("doc_id") % 7) / 10).alias("base"), F.lit(0.6).alias("bull"), said.alias("justification"))
    return rows.select("doc_id", valuation.assumption_problem().alias("problem"))


@query(
    "op_stored_thesis", "agg_max_version",
    sql="SELECT o_custkey AS cik, as_of, version, points, next_version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, as_of ORDER BY version DESC) AS rn, max(version) OVER (PARTITION BY o_custkey, as_of) + 1 AS next_version FROM (SELECT o_custkey, make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) AS as_of, CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS INTEGER) AS version, CAST(o_orderkey % 3 AS INTEGER) AS points FROM orders)) WHERE rn = 1",
)
def op_stored_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("as_of", F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)))
    w = Window.partitionBy("o_custkey", "as_of").orderBy("o_orderkey")
    t = o.select(F.col("o_custkey").alias("cik"), "as_of", F.row_number().over(w).alias("version"), (F.col("o_orderkey") % 3).cast("int").alias("n"))
    raised = t.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select("cik", "as_of", F.col("version").alias("thesis_version"), F.lit("x").alias("attacks"), F.col("k").cast("string").alias("claim"), F.lit(None).cast("string").alias("accession_no"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("quote"))
    full = thesis.with_points(t, raised).join(sinks.next_version(t), ["cik", "as_of"])
    return full.select("cik", "as_of", "version", F.coalesce(F.size("points"), F.lit(0)).alias("points"), "next_version")
