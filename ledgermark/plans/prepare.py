"""What is handed over for a reading, a valuation, a thesis or an attack on one: a row for each filer, for all filers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.operators.documents import USABLE, note_index

from .valuation import DISCOUNT, SAFETY, TERMINAL_CAP, YEARS

#: Sections of a proxy statement that tell what management is paid.
PAY_SECTIONS = ("CDA", "SUMMARY_COMP", "PAY_VS_PERFORMANCE", "DIRECTOR_COMP", "RELATED_PERSON")


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "high", 0).when(F.col(c) == "medium", 1).otherwise(2)


def latest_screen(candidates: DataFrame) -> DataFrame:
    """Of each filer the newest screen run that made it a candidate (cik, as_of, flag_reason, ...), as ``screen``."""
    rest = [c for c in candidates.columns if c != "cik"]
    return candidates.groupBy("cik").agg(F.max_by(F.struct(*rest), "as_of").alias("screen"))


def findings_of(findings: DataFrame) -> DataFrame:
    """Of each filer its findings, worst first, then by item."""
    body = F.struct(severity_rank().alias("o"), "item", "accession_no", "change_type", "quote", "implication", "severity")
    return findings.groupBy("cik").agg(F.array_sort(F.collect_list(body)).alias("f")).select("cik", F.transform("f", lambda x: x.dropFields("o")).alias("findings"))


def _newest_two(rows: DataFrame, *body: str) -> DataFrame:
    """Of each filer the newest row and the one before, as structs ``current`` and ``prior``."""
    w = Window.partitionBy("cik").orderBy(F.desc("filed_date"), F.desc("accession_no"))
    r = rows.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    one = F.struct("accession_no", "filed_date", *body)
    return r.groupBy("cik").agg(F.max(F.when(F.col("__rn") == 1, one)).alias("current"), F.max(F.when(F.col("__rn") == 2, one)).alias("prior"))


def notes_pass(sections: DataFrame, filing: DataFrame, candidates: DataFrame, item: str = "8") -> DataFrame:
    """The footnotes of the newest annual report and of the one before, with indexes of their notes (numbers, headings,
    lengths), whether one of them is too weak to be used, and the screen that brought the filer up."""
    own = sections.where(F.col("item") == item).join(filing.where("form_type = '10-K'").select("accession_no", "cik", "filed_date"), "accession_no")
    rows = _newest_two(own, "text", "extraction_confidence")
    rows = rows.withColumn("notes", note_index("current.text")).withColumn("prior_notes", note_index("prior.text"))
    weak = lambda c: F.coalesce(F.col(f"{c}.extraction_confidence") < USABLE, F.lit(False))
    return rows.withColumn("refused", weak("current") | weak("prior")).join(latest_screen(candidates), "cik", "left")


def pay_pass(sections: DataFrame, filing: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pay sections of the newest proxy statement and of the one before, as maps by section, and the screen."""
    own = sections.where(F.col("item").isin(*PAY_SECTIONS)).join(filing.where("form_type = 'DEF 14A'").select("accession_no", "cik", "filed_date"), "accession_no")
    body = F.struct("text", "extraction_confidence")
    per = own.groupBy("cik", "accession_no", "filed_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("item", body.alias("s"))))).alias("sections"))
    w = Window.partitionBy("cik").orderBy(F.desc("filed_date"), F.desc("accession_no"))
    per = per.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    one = F.struct("accession_no", "filed_date", "sections")
    # maps have no order, so the one row of each rank is picked by first
    two = per.groupBy("cik").agg(F.first(F.when(F.col("__rn") == 1, one), True).alias("current"), F.first(F.when(F.col("__rn") == 2, one), True).alias("prior"))
    return two.join(latest_screen(candidates), "cik", "left")


def valuation_input(inputs: DataFrame, maintenance: DataFrame, findings: DataFrame) -> DataFrame:
    """The figures a valuation starts from, maintenance capex, findings, and the rules that nobody may change."""
    mc = maintenance.select("cik", F.struct("fy_end", "total", "revenue_scaled", "used", "spread").alias("maintenance_capex"))
    fixed = F.struct(F.lit(DISCOUNT).alias("discount_rate"), F.lit(TERMINAL_CAP).alias("terminal_growth_cap"), F.lit(SAFETY).alias("margin_of_safety"), F.lit(YEARS).alias("projection_years"))
    return inputs.join(mc, "cik", "left").join(findings_of(findings), "cik", "left").withColumn("fixed", fixed)


def thesis_input(valuations: DataFrame, findings: DataFrame, filer: DataFrame) -> DataFrame:
    """Stored valuations (cik, as_of, payload) with names and findings; a filer without a valuation has no row."""
    named = valuations.join(filer.select("cik", "name", "ticker"), "cik", "left")
    return named.join(findings_of(findings), "cik", "left")


def attack_input(theses: DataFrame, valuations: DataFrame, findings: DataFrame, sections: DataFrame, filing: DataFrame) -> DataFrame:
    """The latest version of each thesis with its valuation, its findings, and the sections that may be quoted, newest first."""
    newest = F.struct((-F.datediff("filed_date", F.lit("1900-01-01").cast("date"))).alias("o"), "accession_no", "item", "filed_date", "char_count")
    own = sections.join(filing.select("accession_no", "cik", "filed_date"), "accession_no").groupBy("cik").agg(F.array_sort(F.collect_list(newest)).alias("s"))
    own = own.select("cik", F.transform("s", lambda x: x.dropFields("o")).alias("available_sections"))
    return theses.join(valuations, ["cik", "as_of"], "left").join(findings_of(findings), "cik", "left").join(own, "cik", "left")
