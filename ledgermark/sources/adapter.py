"""The engine's base relations from the star-schema tables, for tests, benchmarks and trials.

Every customer is a filer, every order a filing with facts of the fiscal year before it, every event a close. Later orders of
a customer in one year restate that year. The same specification gives the SQL of the oracle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 6, 30)
SHIFT = (date(2024, 1, 31) - AS_OF).days

#: tag, unit, kind (D: the fiscal year, I: its end, C: the filing day), value and condition, in SQL of both engines.
FACTS = (
    ("Revenues", "USD", "D", "o_totalprice * 2e3", "o_orderkey % 6 <> 0"),
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "D", "o_totalprice * 2.1e3", "o_orderkey % 12 = 6"),
    ("SalesRevenueNet", "USD", "D", "o_totalprice * 1.9e3", "o_orderkey % 12 = 0"),
    ("CostOfRevenue", "USD", "D", "o_totalprice * (1e3 + (o_orderkey % 9) * 5e1)", "o_orderkey % 5 <> 1"),
    ("CostOfGoodsSold", "USD", "D", "o_totalprice * (1.1e3 + (o_orderkey % 4) * 5e1)", "o_orderkey % 5 = 1"),
    ("GrossProfit", "USD", "D", "o_totalprice * (8e2 + (o_orderkey % 8) * 2e1)", "o_orderkey % 7 = 0"),
    ("OperatingIncomeLoss", "USD", "D", "o_totalprice * ((o_orderkey % 13) - 1) * 4e1", "o_orderkey % 11 <> 3"),
    ("NetIncomeLoss", "USD", "D", "o_totalprice * ((o_orderkey % 10) - 2) * 2.5e1", "o_orderkey % 31 <> 8"),
    ("NetCashProvidedByUsedInOperatingActivities", "USD", "D", "o_totalprice * ((o_orderkey % 12) - 1) * 3e1", "o_orderkey % 17 <> 5"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "USD", "D", "o_totalprice * ((o_orderkey % 7) + 1) * 1e1", "o_orderkey % 9 <> 4"),
    ("PaymentsToAcquireProductiveAssets", "USD", "D", "o_totalprice * ((o_orderkey % 7) + 2) * 1e1", "o_orderkey % 9 = 4"),
    ("PaymentsToDevelopSoftware", "USD", "D", "o_totalprice * 2e0", "o_orderkey % 4 = 0"),
    ("DepreciationDepletionAndAmortization", "USD", "D", "o_totalprice * ((o_orderkey % 6) + 2) * 8e0", "o_orderkey % 8 <> 1"),
    ("ShareBasedCompensation", "USD", "D", "o_totalprice * (o_orderkey % 5) * 2e0", "o_orderkey % 3 <> 1"),
    ("InterestExpense", "USD", "D", "o_totalprice * ((o_orderkey % 4) + 1) * 3e0", "o_orderkey % 2 = 0"),
    ("InvestmentIncomeInterest", "USD", "D", "o_totalprice * 5e0", "o_orderkey % 3 = 2"),
    ("RestructuringCharges", "USD", "D", "o_totalprice * 7e0", "o_orderkey % 7 = 3"),
    ("GoodwillImpairmentLoss", "USD", "D", "o_totalprice * 9e0", "o_orderkey % 16 = 4"),
    ("GainLossOnSaleOfBusiness", "USD", "D", "o_totalprice * 6e0", "o_orderkey % 18 = 1"),
    ("WeightedAverageNumberOfSharesOutstandingBasic", "shares", "D", "(o_custkey % 97 + 20) * (1e5 + (o_orderkey % 5) * 1e3)", "o_orderkey % 23 <> 7"),
    ("Assets", "USD", "I", "o_totalprice * (3e3 + (o_orderkey % 11) * 1e2)", "o_orderkey % 29 <> 3"),
    ("AssetsCurrent", "USD", "I", "o_totalprice * (1.5e3 + (o_orderkey % 5) * 2e2)", "o_orderkey % 19 <> 2"),
    ("Liabilities", "USD", "I", "o_totalprice * (5e2 + (o_orderkey % 15) * 1.2e2)", "o_orderkey % 10 <> 7"),
    ("LiabilitiesCurrent", "USD", "I", "o_totalprice * (4e2 + (o_orderkey % 9) * 1e2)", "o_orderkey % 37 <> 1"),
    ("LiabilitiesAndStockholdersEquity", "USD", "I", "o_totalprice * (3e3 + (o_orderkey % 11) * 1e2)", "o_orderkey % 2 = 1"),
    ("StockholdersEquity", "USD", "I", "o_totalprice * (1.2e3 + (o_orderkey % 6) * 1e2)", "o_orderkey % 13 <> 9"),
    ("CashAndCashEquivalentsAtCarryingValue", "USD", "I", "o_totalprice * (o_orderkey % 7) * 4e1", "o_orderkey % 6 <> 5"),
    ("ShortTermInvestments", "USD", "I", "o_totalprice * 3e1", "o_orderkey % 13 = 1"),
    ("LongTermDebtNoncurrent", "USD", "I", "o_totalprice * (o_orderkey % 8) * 6e1", "o_orderkey % 3 = 0"),
    ("LongTermDebt", "USD", "I", "o_totalprice * ((o_orderkey % 8) + 1) * 6e1", "o_orderkey % 3 = 1"),
    ("LongTermDebtCurrent", "USD", "I", "o_totalprice * 2e1", "o_orderkey % 3 = 1"),
    ("DebtCurrent", "USD", "I", "o_totalprice * 4e1", "o_orderkey % 5 = 2"),
    ("PropertyPlantAndEquipmentNet", "USD", "I", "o_totalprice * (6e2 + (o_orderkey % 10) * 5e1)", "o_orderkey % 14 <> 6"),
    ("CommonStockSharesOutstanding", "shares", "I", "(o_custkey % 97 + 20) * (1e5 + (o_orderkey % 3) * 1e3)", "o_orderkey % 4 = 3"),
    ("EntityCommonStockSharesOutstanding", "shares", "C", "(o_custkey % 97 + 20) * (1e5 + (o_orderkey % 7) * 1e3)", "o_orderkey % 4 <> 3"),
)

FORMS = {"1": "10-K", "2": "10-K/A", "3": "10-Q", "4": "8-K", "5": "DEF 14A"}


_VALUE = re.compile(
    r"(?P<base>o_totalprice|\(o_custkey % 97 \+ 20\))"
    r"(?: \* (?:\((?P<c>\d\S*) \+ \(o_orderkey % (?P<m>\d+)\) \* (?P<d>\S+)\)|\(\(o_orderkey % (?P<m2>\d+)\) (?P<c2>[+-] \d+)\)|\(o_orderkey % (?P<m3>\d+)\)))?"
    r"(?: \* (?P<y>\d\S*))?"
)
_CONDITION = re.compile(r"o_orderkey % (\d+) (=|<>) (\d+)")


def fact_rows() -> list[tuple]:
    """``FACTS`` as rows (tag, unit, kind, priced, m, c, d, y, n, equal, r): the value is base * (c + (o_orderkey % m) * d) * y, in this
    order, with the price as its base if ``priced``; the condition is whether o_orderkey % n equals r."""
    out = []
    for tag, unit, kind, value, condition in FACTS:
        v, w = _VALUE.fullmatch(value), _CONDITION.fullmatch(condition)
        if not v or not w:
            raise ValueError(f"a value or condition of another form: {value}, {condition}")
        m = int(v["m"] or v["m2"] or v["m3"] or 1)
        c, d = (v["c"], v["d"]) if v["c"] else ((v["c2"] or "0").replace(" ", ""), 1) if m > 1 else (1, 0)
        out.append((tag, unit, kind, v["base"] == "o_totalprice", m, float(c), float(d), float(v["y"] or 1), int(w[1]), w[2] == "=", int(w[3])))
    return out


@dataclass(frozen=True)
class Store:
    """The base relations. ``by_filer`` says that facts are stored in buckets of filers, or dealt out by them, so that what is grouped
    by filer needs no shuffle."""

    filer: DataFrame
    filing: DataFrame
    fact: DataFrame
    price: DataFrame
    by_filer: bool = False


def star_store(spark: SparkSession, sf_dir: str, parts: int | None = None) -> Store:
    """The base relations. Filings are dealt out by filer (into ``parts``, if given) before they meet the table of facts, so that what is
    grouped by filer shuffles a row for each filing and none for each fact."""
    customer, orders, events = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "events"))
    filer = customer.selectExpr(
        "c_custkey AS cik", "c_name AS name",
        "CASE c_custkey % 20 WHEN 0 THEN NULL WHEN 1 THEN concat('T', c_custkey, '-PB') WHEN 2 THEN concat('T', c_custkey, '-A') WHEN 3 THEN concat('T', c_custkey, '-WS') ELSE concat('T', c_custkey) END AS ticker",
        "'X' AS exchange", "CAST(c_nationkey * 280 AS STRING) AS sic",
        "CASE WHEN c_custkey % 25 = 0 THEN 'deregistered' ELSE 'active' END AS status",
        "CASE WHEN c_custkey % 25 = 0 THEN date_add(DATE '2000-01-01', CAST(c_custkey % 900 AS INT)) END AS status_date",
        "CASE WHEN c_custkey % 7 <> 0 THEN date_add(DATE '1996-01-01', CAST(c_custkey % 2500 AS INT)) END AS first_seen", "CAST(NULL AS DATE) AS last_filing_date",
    )
    form = "CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMS.items()) + " END"
    made = lambda rows: rows.selectExpr("*", "lpad(CAST(o_orderkey AS STRING), 10, '0') AS accession_no", "CAST(o_orderdate AS DATE) AS filed_date", "year(o_orderdate) - 1 AS fy", f"{form} AS form_type")
    filing = made(orders).selectExpr(
        "accession_no", "o_custkey AS cik", "form_type", "filed_date", "make_date(fy, 12, 31) AS period_end", "concat('doc', o_orderkey, '.htm') AS primary_doc_url", "fy AS fiscal_year", "'FY' AS fiscal_period"
    )
    # a table to join with, not an array of all facts to explode: its code is short, and a filter on tags or units shortens the table
    said = ", ".join(f"('{t}', '{u}', '{k}', {priced}, {m}L, {c!r}D, {d!r}D, {y!r}D, {n}L, {equal}, {x}L)" for t, u, k, priced, m, c, d, y, n, equal, x in sorted(fact_rows(), key=lambda x: (x[2] == "C", x[0])))
    f = F.broadcast(spark.sql(f"SELECT * FROM VALUES {said} AS f(tag, unit, kind, priced, m, c, d, y, n, equal, r)")).alias("f")
    dealt = orders.repartition(parts, "o_custkey") if parts else orders.repartition("o_custkey")
    dealt = dealt.sortWithinPartitions("o_custkey", "o_orderdate")  # facts then come nearly in the order that settling them sorts by
    value = F.expr("(CASE WHEN f.priced THEN o_totalprice ELSE CAST(o_custkey % 97 + 20 AS DOUBLE) END) * (f.c + (o_orderkey % f.m) * f.d) * f.y")
    exploded = made(dealt).join(f, F.expr("(o_orderkey % f.n = f.r) = f.equal")).withColumn("value", value).where("value IS NOT NULL")
    fact = exploded.selectExpr(
        "accession_no", "o_custkey AS cik", "f.tag AS tag", "f.unit AS unit", "CASE WHEN f.kind = 'D' THEN make_date(fy, 1, 1) END AS period_start",
        "CASE WHEN f.kind = 'C' THEN filed_date ELSE make_date(fy, 12, 31) END AS period_end", "value", "fy AS fiscal_year", "'FY' AS fiscal_period", "form_type", "filed_date",
    )
    price = events.selectExpr(
        "user_id + 150 * (event_id % 10) AS cik", "CAST(NULL AS STRING) AS ticker", f"date_sub(CAST(ts AS DATE), {SHIFT}) AS price_date", "value AS close", "event_type AS source", "ts AS fetched_at"
    )
    return Store(filer, filing, fact, price.where("cik % 25 <> 0 AND close IS NOT NULL"), by_filer=True)


def store_sql() -> str:
    """The same relations as common table expressions of the oracle's SQL."""
    form = "CASE substr(o_orderpriority, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMS.items()) + " END"
    items = ", ".join(f"{{'tag': '{t}', 'unit': '{u}', 'kind': '{k}', 'value': CASE WHEN {cond} THEN CAST({value} AS DOUBLE) END}}" for t, u, k, value, cond in FACTS)
    return f"""
filer AS (SELECT c_custkey AS cik, c_name AS name,
  CASE c_custkey % 20 WHEN 0 THEN NULL WHEN 1 THEN concat('T', c_custkey, '-PB') WHEN 2 THEN concat('T', c_custkey, '-A') WHEN 3 THEN concat('T', c_custkey, '-WS') ELSE concat('T', c_custkey) END AS ticker,
  'X' AS exchange, CAST(c_nationkey * 280 AS VARCHAR) AS sic, CASE WHEN c_custkey % 25 = 0 THEN 'deregistered' ELSE 'active' END AS status,
  CASE WHEN c_custkey % 25 = 0 THEN DATE '2000-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS status_date,
  CASE WHEN c_custkey % 7 <> 0 THEN DATE '1996-01-01' + CAST(c_custkey % 2500 AS INTEGER) END AS first_seen, CAST(NULL AS DATE) AS last_filing_date FROM customer),
filed AS (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS accession_no, CAST(o_orderdate AS DATE) AS filed_date, CAST(year(o_orderdate) - 1 AS INTEGER) AS fy, {form} AS form_type FROM orders),
filing AS (SELECT accession_no, o_custkey AS cik, form_type, filed_date, make_date(fy, 12, 31) AS period_end, concat('doc', o_orderkey, '.htm') AS primary_doc_url, fy AS fiscal_year, 'FY' AS fiscal_period FROM filed),
exploded AS (SELECT *, unnest([{items}]) AS f FROM filed),
fact AS (SELECT accession_no, o_custkey AS cik, f.tag AS tag, f.unit AS unit, CASE WHEN f.kind = 'D' THEN make_date(fy, 1, 1) END AS period_start,
  CASE WHEN f.kind = 'C' THEN filed_date ELSE make_date(fy, 12, 31) END AS period_end, f.value AS value, fy AS fiscal_year, 'FY' AS fiscal_period, form_type, filed_date FROM exploded WHERE f.value IS NOT NULL),
price AS (SELECT user_id + 150 * (event_id % 10) AS cik, CAST(NULL AS VARCHAR) AS ticker, CAST(ts AS DATE) - {SHIFT} AS price_date, value AS close, event_type AS source, ts AS fetched_at
  FROM events WHERE (user_id + 150 * (event_id % 10)) % 25 <> 0 AND value IS NOT NULL)"""
