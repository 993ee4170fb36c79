"""Queries of extraction, ingest and stored results over the test tables, with their SQL.

Documents stand in for filings' texts: each is filed by the order of its number, under one of 97 filers, as an annual
report or (odd numbers) a proxy statement. Their words, lower-case a-z, fill pages of known structure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.functions import columns as cx
from ledgermark.operators import documents
from ledgermark.sources import archives, landing, sinks, store
from ledgermark.sources.adapter import AS_OF, star_store
from ledgermark.streaming import arrivals
from ledgermark.tables import folder, materialise

from . import prepare, thesis, valuation
from .asof import AsOfView
from .figures import Figures, maintenance_capex
from .registry import FACT_COLUMNS, FACT_LIST, FORM_LINE, S, matched_sql, parts_sql, query, stands_sql, view

FILERS = 97
CLEAN = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' '))"
FILED = f"""fd AS (SELECT d.doc_id, lpad(CAST(d.doc_id AS VARCHAR), 10, '0') AS accession_no, o.o_custkey % {FILERS} AS cik, CASE WHEN d.doc_id % 2 = 1 THEN 'DEF 14A' ELSE '10-K' END AS form_type, CAST(o.o_orderdate AS DATE) AS filed_date,
  trim(regexp_replace(lower(coalesce(d.text, '')), '[^a-z]+', ' ', 'g')) AS t, d.text FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id)"""


def _as_filings(d: DataFrame) -> DataFrame:
    return d.withColumn("accession_no", F.lpad(F.col("doc_id").cast("string"), 10, "0")).withColumn("form_type", F.when(F.col("doc_id") % 2 == 1, "DEF 14A").otherwise("10-K"))


def every_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession_no, form_type, text and its words (t) of every document, whether an order stands for it or not."""
    return _as_filings(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", f"{CLEAN} AS t"))


def filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession_no, cik, form_type, filed_date, text and its words (t) of every document that an order stands for."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS doc_id", f"o_custkey % {FILERS} AS cik", "CAST(o_orderdate AS DATE) AS filed_date")
    return _as_filings(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", f"{CLEAN} AS t").join(o, "doc_id"))


# extraction

TEN_K = ("Item 1. Business", "t", "Item 1A. Risk Factors", "risk t", "Item 1B. Unresolved Staff Comments", "None.", "12", "Item 2. Properties", "t", "Acme Pumps | 2001 Form 10-K | 13", "Table of Contents", "Item 7. Discussion", "we t", "Item 8. Financial Statements", "See the notes.", "Item 9. Changes", "x", "$ 1,200", "340", "(7)", "14", "Table of Contents", "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS", "Note 1. General", "t", "Note 2. Debt", "owed t")
PROXY = ("Notice of Meeting", "t", "Compensation Discussion & Analysis", "pay t", "Summary Compensation Table", "t", "Pay vs. Performance", "so t", "Director Compensation", "dir t")


def _page(parts: tuple[str, ...]) -> Column:
    return F.concat(*[F.concat(F.lit("<p>"), *([F.lit(p[:-1]), F.col("t")] if p == "t" or p.endswith(" t") else [F.lit(p)]), F.lit("</p>")) for p in parts])


def extracted(spark: SparkSession, sf_dir: str, filings: Callable[[SparkSession, str], DataFrame] = filed) -> DataFrame:
    rows = filings(spark, sf_dir).withColumn("html", F.when(F.col("form_type") == "10-K", _page(TEN_K)).otherwise(_page(PROXY)))
    return documents.sections(rows.select("accession_no", "form_type", "html"))


_SECTIONS = f"""{FILED},
notes AS (SELECT *, 'NOTES TO CONSOLIDATED FINANCIAL STATEMENTS' || chr(10) || 'Note 1. General' || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END || chr(10) || 'Note 2. Debt' || chr(10) || trim('owed ' || t) AS n FROM fd),
sec AS (SELECT doc_id, accession_no, cik, filed_date, form_type, s.item AS item, s.x AS text, s.ended AS ended_at, length(s.x) AS char_count, CASE WHEN s.item IN ('8') THEN 8e-1 WHEN s.item IN ('CDA', 'SUMMARY_COMP', 'PAY_VS_PERFORMANCE') THEN 9e-1 WHEN s.item = 'DIRECTOR_COMP' THEN 6e-1
    ELSE CASE WHEN length(s.x) < s.plausible THEN greatest(15e-2, length(s.x) / s.plausible) ELSE 1e0 END * s.trust END AS confidence
  FROM (SELECT *, unnest(CASE WHEN form_type = '10-K' THEN [{{'item': '1', 'x': t, 'ended': '1A', 'plausible': 2000e0, 'trust': 1e0}}, {{'item': '1A', 'x': trim('risk ' || t), 'ended': '1B', 'plausible': 1500e0, 'trust': 1e0}}, {{'item': '1B', 'x': 'None.', 'ended': '2', 'plausible': 0e0, 'trust': 1e0}},
    {{'item': '2', 'x': t, 'ended': '7', 'plausible': 100e0, 'trust': 8e-1}}, {{'item': '7', 'x': trim('we ' || t), 'ended': '8', 'plausible': 1500e0, 'trust': 8e-1}}, {{'item': '8', 'x': n, 'ended': NULL, 'plausible': 1e0, 'trust': 1e0}}]
    ELSE [{{'item': 'CDA', 'x': trim('pay ' || t), 'ended': 'SUMMARY_COMP', 'plausible': 1e0, 'trust': 1e0}}, {{'item': 'SUMMARY_COMP', 'x': t, 'ended': 'PAY_VS_PERFORMANCE', 'plausible': 1e0, 'trust': 1e0}}, {{'item': 'PAY_VS_PERFORMANCE', 'x': trim('so ' || t), 'ended': 'DIRECTOR_COMP', 'plausible': 1e0, 'trust': 1e0}},
      {{'item': 'DIRECTOR_COMP', 'x': trim('dir ' || t), 'ended': NULL, 'plausible': 1e0, 'trust': 1e0}}] END) AS s FROM notes) WHERE s.x <> '')"""
_SECTION_COLUMNS = "accession_no, item, CAST(char_count AS INTEGER) AS char_count, md5(text) AS digest, ended_at, confidence >= 6e-1 AS usable"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("accession_no", "item", "char_count", F.md5("text").alias("digest"), "ended_at", (F.col("extraction_confidence") >= documents.USABLE).alias("usable"))


#: The same sections of every document, whether an order stands for it or not.
_EVERY = _SECTIONS.replace(f"o.o_custkey % {FILERS} AS cik", "NULL AS cik").replace("CAST(o.o_orderdate AS DATE) AS filed_date", "NULL AS filed_date").replace(" JOIN orders o ON o.o_orderkey = d.doc_id", "")


@query("op_extract_filing", sql=f"WITH {_EVERY} SELECT {_SECTION_COLUMNS} FROM sec")
def op_extract_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document, by its form: of annual reports by item number, of proxy statements by name."""
    return _shown(extracted(spark, sf_dir, every_document))


@query("fn_item_sections", sql=f"WITH {_SECTIONS} SELECT {_SECTION_COLUMNS} FROM sec WHERE form_type = '10-K'")
def fn_item_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(extracted(spark, sf_dir).where("form_type = '10-K'"))


@query("fn_proxy_sections", sql=f"WITH {_SECTIONS} SELECT {_SECTION_COLUMNS} FROM sec WHERE form_type = 'DEF 14A'")
def fn_proxy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(extracted(spark, sf_dir).where("form_type = 'DEF 14A'"))


@query("sink_sections", sql=f"WITH {_SECTIONS} SELECT accession_no, item, CAST(CASE WHEN doc_id % 3 = 0 AND item = '1' THEN 1 ELSE char_count END AS INTEGER) AS char_count FROM sec WHERE doc_id % 3 = 0 OR item <> '1B'")
def sink_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extraction leaves out item 1B of two thirds of the filings, and says nothing of the rest but a shorter item 1."""
    rows = extracted(spark, sf_dir).select("accession_no", "item", "char_count")
    third = F.col("accession_no").cast("long") % 3 == 0
    incoming = rows.where(third & (F.col("item") == "1")).withColumn("char_count", F.lit(1))
    return sinks.replaced(rows.where(third | (F.col("item") != "1B")), incoming, ["accession_no", "item"])


@query("fn_split_notes", sql=f"WITH {_SECTIONS} SELECT accession_no, s.number AS number, CAST(length(s.x) AS INTEGER) AS char_count, md5(s.x) AS digest FROM (SELECT accession_no, unnest([{{'number': '1', 'x': trim('Note 1. General' || chr(10) || t, ' ' || chr(10))}}, {{'number': '2', 'x': 'Note 2. Debt' || chr(10) || trim('owed ' || t)}}]) AS s FROM notes WHERE form_type = '10-K')")
def fn_split_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extracted(spark, sf_dir).where("item = '8'").select("accession_no", "text")
    return documents.notes(rows).select("accession_no", "number", "char_count", F.md5("text").alias("digest"))


# what is handed over

CANDIDATES = f"cand AS (SELECT o_custkey % {FILERS} AS cik, CAST(o_orderdate AS DATE) AS as_of, max('flagged by ' || o_orderpriority) AS flag_reason FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % {FILERS} % 5 <> 2 GROUP BY 1, 2), screen AS (SELECT cik, max(as_of) AS as_of, max_by(flag_reason, as_of) AS flag_reason FROM cand GROUP BY cik)"
FINDINGS = "fi AS (SELECT cik, accession_no, CAST(doc_id % 4 AS VARCHAR) AS item, ['high', 'medium', 'low'][doc_id % 3 + 1] AS severity FROM fd)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where(f"o_orderkey % 3 = 0 AND o_custkey % {FILERS} % 5 <> 2")
    return rows.groupBy((F.col("o_custkey") % FILERS).alias("cik"), F.col("o_orderdate").cast("date").alias("as_of")).agg(F.max(F.concat(F.lit("flagged by "), "o_orderpriority")).alias("flag_reason"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filed(spark, sf_dir)
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select("cik", "accession_no", (F.col("doc_id") % 4).cast("string").alias("item"), level.alias("severity"), F.lit("added").alias("change_type"), F.lit("q").alias("quote"), F.lit("i").alias("implication"))


@query("op_screen_reason", sql=f"WITH {CANDIDATES} SELECT * FROM screen")
def op_screen_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.latest_screen(candidates(spark, sf_dir)).select("cik", "screen.as_of", "screen.flag_reason")


@query("sink_candidates", sql=f"WITH {CANDIDATES} SELECT cik, as_of, CASE WHEN as_of >= DATE '1999-01-01' THEN 'again' ELSE flag_reason END AS flag_reason FROM cand WHERE as_of < DATE '1999-01-01' OR cik % 2 = 0")
def sink_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of later days are done again and find half of the filers: all rows of those days are superseded."""
    held = candidates(spark, sf_dir)
    later = held.where("as_of >= DATE '1999-01-01'")
    kept = held.join(later.select("as_of").distinct(), "as_of", "left_anti").select(*held.columns)
    return kept.unionByName(sinks.replaced(held.limit(0), later.where("cik % 2 = 0").withColumn("flag_reason", F.lit("again")), ["as_of"]))


_TWO = "two AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed_date DESC, accession_no DESC) AS rn FROM "


@query("op_prepare_b", sql=f"""WITH {_SECTIONS}, {CANDIDATES}, {_TWO} sec WHERE item = '8')
SELECT a.cik, a.accession_no AS current, CAST(a.char_count AS INTEGER) AS chars, 2 AS notes, b.accession_no AS prior, CASE WHEN b.cik IS NULL THEN 0 ELSE 2 END AS prior_notes, s.flag_reason FROM two a LEFT JOIN two b ON b.cik = a.cik AND b.rn = 2 LEFT JOIN screen s ON s.cik = a.cik WHERE a.rn = 1""")  # fmt: skip
def op_prepare_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.notes_pass(extracted(spark, sf_dir), filed(spark, sf_dir), candidates(spark, sf_dir))
    count = lambda c, has: F.when(F.col(has).isNull(), 0).otherwise(F.size(c))
    return rows.select("cik", F.col("current.accession_no").alias("current"), F.length("current.text").alias("chars"), F.size("notes").alias("notes"), F.col("prior.accession_no").alias("prior"), count("prior_notes", "prior").alias("prior_notes"), "screen.flag_reason")


@query("op_prepare_d", sql=f"""WITH {_SECTIONS}, {CANDIDATES}, px AS (SELECT cik, accession_no, filed_date, count(*) AS n, sum(char_count) AS chars FROM sec WHERE form_type = 'DEF 14A' GROUP BY ALL), {_TWO} px)
SELECT a.cik, a.accession_no AS current, CAST(a.n AS INTEGER) AS sections, CAST(a.chars AS BIGINT) AS chars, b.accession_no AS prior, CAST(coalesce(b.n, 0) AS INTEGER) AS prior_sections, s.flag_reason FROM two a LEFT JOIN two b ON b.cik = a.cik AND b.rn = 2 LEFT JOIN screen s ON s.cik = a.cik WHERE a.rn = 1""")  # fmt: skip
def op_prepare_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.pay_pass(extracted(spark, sf_dir), filed(spark, sf_dir), candidates(spark, sf_dir))
    chars = F.aggregate(F.map_values("current.sections"), F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(f"{c}.sections")), F.lit(0))
    return rows.select("cik", F.col("current.accession_no").alias("current"), size("current").alias("sections"), chars.alias("chars"), F.col("prior.accession_no").alias("prior"), size("prior").alias("prior_sections"), "screen.flag_reason")


_ORDERED = "string_agg(accession_no, ',' ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, item, accession_no) AS findings"
def _listed() -> Column:
    return F.array_join(F.transform("findings", lambda x: x["accession_no"]), ",")


@query("op_prepare_valuation", sql=S(f"SELECT v.cik, v.used, v.net_debt, f.findings, 1e-1 AS discount_rate FROM (SELECT b.cik, round(coalesce(least(m.total, m.revenue_scaled), m.total), 0) AS used, round((coalesce(long_term_debt, 0e0) + coalesce(current_debt, 0e0)) - (coalesce(cash, 0e0) + coalesce(short_term_investments, 0e0)), 2) AS net_debt FROM screen_base b JOIN maintenance m ON m.cik = b.cik WHERE revenue IS NOT NULL AND cfo IS NOT NULL AND coalesce(least(m.total, m.revenue_scaled), m.total) IS NOT NULL) v LEFT JOIN (SELECT cik, {_ORDERED} FROM fi GROUP BY cik) f ON f.cik = v.cik", more=f"{FILED}, {FINDINGS}"))
def op_prepare_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Figures(view(spark, sf_dir))
    rows = prepare.valuation_input(valuation.inputs(f), maintenance_capex(f.annual), findings(spark, sf_dir))
    return rows.select("cik", F.round("maintenance_capex.used", 0).alias("used"), F.round("net_debt", 2).alias("net_debt"), _listed().alias("findings"), "fixed.discount_rate")


# theses

THESES = f"th AS (SELECT o_custkey % {FILERS} AS cik, make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) AS as_of, CAST(row_number() OVER (PARTITION BY o_custkey % {FILERS}, year(o_orderdate) ORDER BY o_orderkey) AS INTEGER) AS version, o_orderkey AS written_at FROM orders)"


def theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % FILERS).alias("cik"), F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("as_of"), F.col("o_orderkey").alias("written_at"))
    return o.withColumn("version", F.row_number().over(Window.partitionBy("cik", "as_of").orderBy("written_at")))


@query("agg_open_theses", "agg_latest_as_of", sql=f"WITH {THESES} SELECT cik, max(as_of) AS as_of FROM th GROUP BY cik")
def agg_open_theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thesis.open_theses(theses(spark, sf_dir))


@query("sink_thesis", sql=f"WITH {THESES} SELECT cik, as_of, written_at, CAST(coalesce(max(CASE WHEN written_at % 3 <> 0 THEN n END) OVER (PARTITION BY cik, as_of), 0) + row_number() OVER (PARTITION BY cik, as_of, written_at % 3 = 0 ORDER BY written_at) AS INTEGER) AS version FROM (SELECT *, row_number() OVER (PARTITION BY cik, as_of, written_at % 3 = 0 ORDER BY written_at) AS n FROM th) QUALIFY written_at % 3 = 0")
def sink_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the theses are held; the others are appended with the versions that come next."""
    t = theses(spark, sf_dir)
    held = t.where("written_at % 3 <> 0").withColumn("version", F.row_number().over(Window.partitionBy("cik", "as_of").orderBy("written_at")))
    return sinks.append_versions(held, t.where("written_at % 3 = 0")).select("cik", "as_of", "written_at", "version")


_WRONG = """CASE WHEN k % 2 = 0 THEN NULL ELSE 'business: missing' END, CASE WHEN k % 3 = 0 THEN 'mispricing: missing' WHEN k % 3 = 1 THEN 'mispricing: names the conclusion' END, CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'mispricing: explanation too short' END, CASE WHEN k % 7 = 0 THEN 'must_go_right: missing' END,
  CASE WHEN k % 4 < 2 THEN 'falsification: fewer than two conditions' END, CASE WHEN k % 4 = 3 THEN 'falsification: condition incomplete' END, CASE WHEN k % 11 = 0 THEN 'holding_period_years: missing' END, CASE WHEN k % 13 = 0 THEN 'pre_mortem: missing' END, CASE WHEN k % 9 = 0 THEN 'sell_early_if: reads as a recommendation' END"""


@query("op_thesis_checks", sql=f"SELECT o_orderkey, array_to_string(list_filter([{_WRONG}], lambda x: x IS NOT NULL), ';') AS problems FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)")
def op_thesis_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    condition = lambda metric: F.struct(metric.alias("metric"), F.lit("below").alias("direction"), F.lit(0.05).alias("threshold"), F.lit("two years").alias("window"))
    good, bad = condition(F.lit("operating margin")), condition(F.lit(" "))
    reason = F.when(k % 3 == 1, "Undervalued").otherwise("forced selling")
    said = F.when(k % 5 == 0, "too short").otherwise("An index fund had to sell its whole holding within one week of March.")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k, F.when(k % 2 == 0, "Makes pumps").alias("business"), F.when(k % 3 != 0, F.struct(reason.alias("reason_type"), said.alias("explanation"))).alias("mispricing"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("must_go_right"), F.when(k % 4 < 2, F.array(good)).when(k % 4 == 3, F.array(good, bad)).otherwise(F.array(good, good)).alias("falsification"),
        F.when(k % 11 != 0, 3.0).alias("holding_period_years"), F.when(k % 9 == 0, "Sell the shares at once").otherwise("the margin falls").alias("sell_early_if"), F.when(k % 13 != 0, "we were wrong on price").alias("pre_mortem"),
    )
    return rows.select("o_orderkey", F.array_join(thesis.problems(), ";").alias("problems"))


POINTS = f"""{FILED},
pt AS (SELECT doc_id, cik, CASE WHEN doc_id % 8 = 7 THEN ' ' WHEN doc_id % 8 = 6 THEN 'investors should sell' ELSE 'margins will fall' END AS claim, CASE WHEN doc_id % 5 = 4 THEN lpad(CAST(doc_id + 5000000 AS VARCHAR), 10, '0') ELSE accession_no END AS accession_no, t,
  CASE WHEN doc_id % 3 = 0 THEN t ELSE t || ' and more' END AS quote FROM fd),
ck AS (SELECT *, CASE WHEN trim(claim) = '' OR quote = '' THEN 'malformed' WHEN claim = 'investors should sell' THEN 'recommendation' WHEN doc_id % 5 = 4 THEN 'source_unavailable' WHEN doc_id % 3 <> 0 OR length(t) < 24 THEN 'quote_not_found' END AS drop_reason FROM pt)"""


def checked_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = materialise(filed(spark, sf_dir), "filed")
    claim = F.when(F.col("doc_id") % 8 == 7, " ").when(F.col("doc_id") % 8 == 6, "investors should sell").otherwise("margins will fall")
    elsewhere = F.lpad((F.col("doc_id") + 5000000).cast("string"), 10, "0")
    points = d.select(
        "doc_id", "cik", claim.alias("claim"), F.when(F.col("doc_id") % 5 == 4, elsewhere).otherwise(F.col("accession_no")).alias("accession_no"), F.lit("1A").alias("item"),
        F.when(F.col("doc_id") % 3 == 0, F.col("t")).otherwise(F.concat("t", F.lit(" and more"))).alias("quote"),
    )
    return thesis.checked_points(points, d.select("accession_no", F.lit("1A").alias("item"), F.col("t").alias("text")))


@query("op_bear_pass", sql=f"WITH {POINTS} SELECT doc_id, drop_reason FROM ck")
def op_bear_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_points(spark, sf_dir).select("doc_id", "drop_reason")


@query("sink_bear", sql=f"WITH {POINTS} SELECT cik, CAST(count(*) FILTER (WHERE drop_reason IS NULL) AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE drop_reason IS NOT NULL) AS BIGINT) AS dropped, count(*) FILTER (WHERE drop_reason IS NOT NULL) / count(*) AS fabrication_rate FROM ck GROUP BY cik")
def sink_bear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thesis.pass_summary(checked_points(spark, sf_dir), "cik")


@query("op_prepare_thesis", sql=f"WITH filer AS (SELECT c_custkey AS cik, c_name AS name FROM customer), {FILED}, {FINDINGS}, {THESES}, va AS (SELECT cik, as_of FROM th WHERE version = 1) SELECT va.cik, va.as_of, n.name, f.findings FROM va LEFT JOIN filer n ON n.cik = va.cik LEFT JOIN (SELECT cik, {_ORDERED} FROM fi GROUP BY cik) f ON f.cik = va.cik")
def op_prepare_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    valued = theses(spark, sf_dir).where("version = 1").select("cik", "as_of", F.lit("{}").alias("payload"))
    rows = prepare.thesis_input(valued, findings(spark, sf_dir), star_store(spark, sf_dir).filer)
    return rows.select("cik", "as_of", "name", _listed().alias("findings"))


@query("op_prepare_bear", sql=f"WITH {FILED}, {FINDINGS}, {THESES}, la AS (SELECT cik, as_of, max(version) AS version FROM th GROUP BY ALL) SELECT la.cik, la.as_of, la.version, f.findings, s.newest, CAST(coalesce(s.n, 0) AS INTEGER) AS sections FROM la LEFT JOIN (SELECT cik, {_ORDERED} FROM fi GROUP BY cik) f ON f.cik = la.cik LEFT JOIN (SELECT cik, max_by(accession_no, (filed_date, -doc_id)) AS newest, count(*) AS n FROM fd GROUP BY cik) s ON s.cik = la.cik")
def op_prepare_bear(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filed(spark, sf_dir)
    sections = d.select("accession_no", F.lit("1A").alias("item"), F.length("t").alias("char_count"))
    valued = theses(spark, sf_dir).where("version = 1").select("cik", "as_of", F.lit("{}").alias("payload"))
    rows = prepare.attack_input(thesis.latest(theses(spark, sf_dir)), valued, findings(spark, sf_dir), sections, d)
    first = F.get("available_sections", F.lit(0))["accession_no"]
    return rows.select("cik", "as_of", "version", _listed().alias("findings"), first.alias("newest"), F.coalesce(F.size("available_sections"), F.lit(0)).alias("sections"))


# stored results

HELD = "SELECT o_custkey AS cik, make_date(CAST(year(o_orderdate) AS INTEGER), 1, 1) AS as_of, sum(o_totalprice) AS total FROM orders GROUP BY ALL"


@query("sink_valuation", "sink_json", "src_payload", sql=f"SELECT cik, as_of, round(CASE WHEN cik % 2 = 0 THEN total * 2 ELSE total END, 2) AS total FROM ({HELD})")
def sink_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valuations as JSON payloads; those of every second filer are stored again, and all are read back."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("cik"), F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("as_of")).agg(F.sum("o_totalprice").alias("total"))
    again = rows.where("cik % 2 = 0").withColumn("total", F.col("total") * 2)
    held = sinks.replaced(sinks.to_payload(rows, "cik", "as_of"), sinks.to_payload(again, "cik", "as_of"), ["cik", "as_of"])
    return sinks.from_payload(held.select("payload"), "cik long, as_of date, total double").withColumn("total", F.round("total", 2))


@query("sink_recheck", sql="SELECT cik, run_date, status, count(*) AS n FROM (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS run_date, CASE WHEN year(o_orderdate) = 1999 THEN 'breached' ELSE 'holding' END AS status FROM orders GROUP BY ALL) GROUP BY ALL")
def sink_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one year are stored again with another status."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("run_date"), F.lit("holding").alias("status")).distinct()
    again = rows.where("year(run_date) = 1999").withColumn("status", F.lit("breached"))
    return sinks.replaced(rows, again, ["cik", "run_date"]).groupBy("cik", "run_date", "status").agg(F.count("*").alias("n"))


@query("sink_findings", "agg_run_statistics", sql=f"""WITH d AS (SELECT doc_id, text, {matched_sql('text')} AS t, {parts_sql('text')} AS q FROM documents),
v AS (SELECT doc_id % 50 AS run_key, CASE WHEN doc_id % 7 = 2 THEN 'malformed' WHEN doc_id % 11 = 3 OR trim(coalesce(text, '')) = '' THEN 'quote_missing' WHEN NOT {stands_sql('t', 'q')} THEN 'quote_not_found' END AS why FROM d),
p AS (SELECT run_key, why, count(*) AS n FROM v GROUP BY ALL)
SELECT run_key, CAST(sum(CASE WHEN why IS NULL THEN n ELSE 0 END) AS BIGINT) AS findings_kept, CAST(sum(CASE WHEN why IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS findings_dropped,
  '{{' || coalesce(string_agg('"' || why || '":' || n, ',' ORDER BY why) FILTER (WHERE why IS NOT NULL), '') || '}}' AS drop_reasons FROM p GROUP BY run_key""")  # fmt: skip
def sink_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text quoted from itself, in fifty runs; kept and dropped findings of each run. A text with
    ellipses is a quote of several fragments."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    f = d.select(
        (F.col("doc_id") % 50).alias("run_key"), F.col("doc_id").cast("string").alias("accession_no"), F.lit("1A").alias("item"), F.lit("added").alias("change_type"), F.when(F.col("doc_id") % 11 == 3, "").otherwise(F.col("text")).alias("quote"),
        F.lit("worth a look").alias("implication"), F.when(F.col("doc_id") % 7 == 2, "grave").otherwise("low").alias("severity"), F.lit(None).cast("string").alias("prior_accession_no"), F.lit(None).cast("string").alias("prior_quote"),
    )
    sources = d.select(F.col("doc_id").cast("string").alias("accession_no"), F.lit("1A").alias("item"), "text")
    return documents.run_statistics(documents.validate_findings(f, sources), "run_key")


# ingest

_HALF = "DATE '1999-01-01'"


@query("sink_ingest", sql=S(f"SELECT 'filer' AS relation, CAST(cik AS VARCHAR) AS key, least(first_seen, a) AS first_day FROM filer LEFT JOIN (SELECT cik, min(filed_date) AS a FROM filing GROUP BY cik) d USING (cik) UNION ALL SELECT 'filing', accession_no, filed_date FROM filing WHERE accession_no IN (SELECT accession_no FROM fact) OR CAST(accession_no AS BIGINT) % 5 <> 0 UNION ALL SELECT 'fact', accession_no, max(filed_date) FROM fact WHERE filed_date >= {_HALF} GROUP BY accession_no"))
def sink_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filers, filings and facts of half the time are held; an ingest brings all filers and facts, and a list that lacks
    every fifth filing, for which stubs stand in."""
    s = star_store(spark, sf_dir)
    listed = s.filing.where("CAST(accession_no AS LONG) % 5 <> 0")
    filer, filing, fact = sinks.ingest(s.filer.where("cik % 3 = 0"), listed.where(f"filed_date < {_HALF}"), s.fact.where(f"filed_date < {_HALF}"), s.filer, listed, s.fact)
    seen = s.filer.select("cik", F.col("first_seen").alias("own"))
    filer = filer.join(seen, "cik").select(F.lit("filer").alias("relation"), F.col("cik").cast("string").alias("key"), F.least("first_seen", "own").alias("first_day"))
    facts = fact.groupBy("accession_no").agg(F.max("filed_date").alias("first_day")).select(F.lit("fact").alias("relation"), F.col("accession_no").alias("key"), "first_day")
    return filer.unionByName(filing.select(F.lit("filing").alias("relation"), F.col("accession_no").alias("key"), F.col("filed_date").alias("first_day"))).unionByName(facts)


@query("sink_ingest_facts", sql=S(f"SELECT f.cik, least(f.first_seen, d.a) AS first_seen, CAST(coalesce(d.stubs, 0) AS BIGINT) AS stubs FROM filer f LEFT JOIN (SELECT cik, min(filed_date) AS a, count(DISTINCT accession_no) FILTER (WHERE CAST(accession_no AS BIGINT) % 4 = 0) AS stubs FROM fact GROUP BY cik) d ON d.cik = f.cik"))
def sink_ingest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts alone come in for filers that are held, a quarter of them from filings that no list has."""
    s = star_store(spark, sf_dir)
    listed = s.filing.where("CAST(accession_no AS LONG) % 4 <> 0")
    filer, filing, _ = sinks.ingest_facts(s.filer, listed, s.fact.limit(0), s.fact)
    stubs = filing.join(listed.select("accession_no"), "accession_no", "left_anti").groupBy("cik").agg(F.count("*").alias("stubs"))
    return filer.join(stubs, "cik", "left").select("cik", "first_seen", F.coalesce("stubs", F.lit(0)).alias("stubs"))


@query("src_quarters", "src_index_url", sql=S("SELECT CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, coalesce(n.n, 0) AS rows FROM (SELECT unnest(range(1994, 2003)) AS y), (SELECT unnest(range(1, 5)) AS q) LEFT JOIN (SELECT year(filed_date) AS y1, quarter(filed_date) AS q1, count(*) AS n FROM filing WHERE form_type NOT LIKE '% %' GROUP BY ALL) n ON n.y1 = y AND n.q1 = q"))
def src_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filings' index, laid down quarter by quarter and read back; quarters without a file have no rows."""
    root = folder(spark, "index")
    f = star_store(spark, sf_dir).filing
    parts = materialise(landing.write_quarters(f.selectExpr("year(filed_date) AS year", "quarter(filed_date) AS quarter", f"{FORM_LINE} AS value"), root), "parts")
    return landing.read_quarters(spark, root, 1994, 2002, parts)[1].fillna(0, ["rows"])


@query("src_bulk_zip", "src_bulk_version", sql="SELECT o_custkey AS cik, count(*) AS facts, '2024-03-01T06:00:00' AS version FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey")
def src_bulk_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk archives of all filers' fact documents (one fact an order), of which every second filer's is wanted."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    point = F.struct(F.lit("2023-12-31").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), F.lit("2024-02-01").alias("filed"))
    per = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(point).alias("points"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Assets"), F.struct(F.create_map(F.lit("USD"), F.col("points")).alias("units"))))
    docs = per.select(F.concat(F.lit("CIK"), cx.padded_cik("cik"), F.lit(".json")).alias("name"), F.to_json(F.struct("cik", facts.alias("facts"))).alias("content"))
    made = materialise(archives.write(docs, folder(spark, "bulk"), (2024, 3, 1, 6, 0, 0)), "archives")
    held = materialise(archives.entries(spark, [r["archive"] for r in made.where("members > 0").collect()]), "entries")  # a row for each archive
    wanted = o.select(F.col("o_custkey").alias("cik")).where("cik % 2 = 0")
    rows = landing.company_facts(landing.bulk_company_facts(held, wanted), expected_cik=F.col("wanted"))
    return rows.groupBy("cik").agg(F.count("*").alias("facts")).crossJoin(F.broadcast(landing.bulk_version(held)))  # one row


@query("op_price_class", sql=S("SELECT cik, upper(trim(replace(ticker, '.', '-'))) AS symbol, CASE WHEN ticker IS NULL THEN 'unpriceable' WHEN ticker LIKE '%-PB' OR ticker LIKE '%-WS' THEN 'not common stock' ELSE 'priceable' END AS class FROM filer"))
def op_price_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = star_store(spark, sf_dir).filer
    kind = F.when(F.col("ticker").isNull(), "unpriceable").when(cx.is_common_stock("ticker"), "priceable").otherwise("not common stock")
    return f.select("cik", cx.price_symbol("ticker").alias("symbol"), kind.alias("class"))


# the catalog's layout, its versions, and facts that arrive


@query("op_asof_settled", "src_sqlite", sql=S(f"SELECT {FACT_LIST} FROM fact_asof"))
def op_asof_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest versions from facts that are stored in buckets of filers."""
    path = folder(spark, "settled")
    s = star_store(spark, sf_dir, 16)
    store.settle(spark, s, path, 16)
    return AsOfView(store.settled(spark, s, path, 16), AS_OF).fact_asof.select(*FACT_COLUMNS)


#: Versions that the catalog's filings might go through.
LATER = (store.Step(2, "filing", "amends", "boolean", False), store.Step(3, "filing", "pages", "int", 1))


@query("src_migrate", sql=S("""SELECT accession_no, CASE k % 3 WHEN 0 THEN false WHEN 1 THEN k % 2 = 0 ELSE CASE WHEN k % 4 <> 0 THEN form_type LIKE '%/A' END END AS amends, CAST(CASE WHEN k % 3 = 2 THEN k % 7 ELSE 1 END AS INTEGER) AS pages
FROM (SELECT *, CAST(accession_no AS BIGINT) AS k FROM filing)"""))  # fmt: skip
def src_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that three versions of the catalog wrote, a third each, read with the last one's columns."""
    path = folder(spark, "catalog")
    store.create(spark, path)
    k = F.col("accession_no").cast("long")
    f = star_store(spark, sf_dir).filing
    store.append(spark, path, "filing", f.where(k % 3 == 0))
    store.migrate(spark, path, LATER[:1])
    store.append(spark, path, "filing", f.where(k % 3 == 1).withColumn("amends", k % 2 == 0), LATER)
    store.migrate(spark, path, LATER)
    store.append(spark, path, "filing", f.where(k % 3 == 2).withColumn("amends", F.when(k % 4 != 0, F.endswith("form_type", F.lit("/A")))).withColumn("pages", k % 7), LATER)
    return store.open_store(spark, path, LATER).filing.select("accession_no", "amends", "pages")


@query("stream_latest_facts", sql=S(f"SELECT {FACT_LIST} FROM fact_asof"))
def stream_latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that arrive in three parts, the last filed first, through a stream that is started twice. Each part is as many files as
    tasks wrote it."""
    root = folder(spark, "arrivals")
    facts = star_store(spark, sf_dir).fact
    for n, day in enumerate(("filed_date >= DATE '1999-01-01'", "filed_date < DATE '1997-01-01'", "filed_date >= DATE '1997-01-01' AND filed_date < DATE '1999-01-01'")):
        facts.where(day).write.mode("append").parquet(f"{root}/in")
        if n:  # the second start finds the last part
            arrivals.keep_batches(arrivals.arrived(spark, f"{root}/in"), f"{root}/out", f"{root}/state", AS_OF).awaitTermination()
    return arrivals.newest(spark, f"{root}/out").select(*FACT_COLUMNS)
