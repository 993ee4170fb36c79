"""Checks on a written thesis, its versions, and the points raised against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermark.operators.documents import advises, drop_rate, with_sources

# Sections of a thesis, conclusions that are no reasons, and least lengths.
SECTIONS = ("business", "mispricing", "must_go_right", "falsification", "holding_period_years", "sell_early_if", "pre_mortem")
NO_REASON = ("mispriced", "undervalued", "overlooked", "cheap", "the market is wrong", "market inefficiency", "value", "unknown")
LEAST_CONDITIONS, LEAST_EXPLANATION = 2, 40

#: Shape of a thesis.
THESIS = (
    "cik long, as_of date, version int, business string, mispricing struct<reason_type: string, explanation: string>, must_go_right array<string>, "
    "falsification array<struct<metric: string, direction: string, threshold: double, window: string>>, holding_period_years double, sell_early_if string, pre_mortem string"
)


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def problems() -> Column:
    """What is wrong with a thesis, as an array of sections and reasons; empty if nothing is."""
    reason, said = F.lower(F.trim("mispricing.reason_type")), F.trim(F.coalesce("mispricing.explanation", F.lit("")))
    bad_condition = F.exists("falsification", lambda c: _blank(c["metric"]) | _blank(c["direction"]) | _blank(c["window"]) | c["threshold"].isNull())
    found = [
        F.when(_blank("business"), "business: missing"),
        F.when(F.col("mispricing").isNull(), "mispricing: missing"),
        F.when(F.col("mispricing").isNotNull() & (_blank("mispricing.reason_type") | reason.isin(*NO_REASON)), "mispricing: names the conclusion"),
        F.when(F.col("mispricing").isNotNull() & (F.length(said) < LEAST_EXPLANATION), "mispricing: explanation too short"),
        F.when(F.lower(said).contains("market is wrong"), "mispricing: restates the position"),
        F.when(F.coalesce(F.size("must_go_right"), F.lit(0)) < 1, "must_go_right: missing"),
        F.when(F.coalesce(F.size("falsification"), F.lit(0)) < LEAST_CONDITIONS, "falsification: fewer than two conditions"),
        F.when(F.coalesce(bad_condition, F.lit(False)), "falsification: condition incomplete"),
        F.when(F.col("holding_period_years").isNull(), "holding_period_years: missing"),
        F.when(_blank("sell_early_if"), "sell_early_if: missing"),
        F.when(_blank("pre_mortem"), "pre_mortem: missing"),
        *[F.when(advises(s), f"{s}: reads as a recommendation") for s in ("business", "sell_early_if", "pre_mortem")],
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def latest(theses: DataFrame, version: int | None = None) -> DataFrame:
    """Latest version of each thesis, or the named one."""
    if version is not None:
        return theses.where(F.col("version") == version)
    rest = [c for c in theses.columns if c not in ("cik", "as_of")]
    return theses.groupBy("cik", "as_of").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("cik", "as_of", "x.*")


def with_points(theses: DataFrame, points: DataFrame) -> DataFrame:
    """Latest theses with the points raised against that version."""
    own = points.groupBy("cik", "as_of", F.col("thesis_version").alias("version")).agg(F.array_sort(F.collect_list(F.struct("attacks", "claim", "accession_no", "item", "quote"))).alias("points"))
    return latest(theses).join(own, ["cik", "as_of", "version"], "left")


def open_theses(theses: DataFrame) -> DataFrame:
    """Every filer with a thesis, and the day of its latest one."""
    return theses.groupBy("cik").agg(F.max("as_of").alias("as_of"))


def checked_points(points: DataFrame, sections: DataFrame) -> DataFrame:
    """Points raised against theses (claim, quote, accession_no, item, ...) with the reason each is dropped for (null:
    kept), the first that applies. Each section's text is read once, with all the quotes from it."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    before = F.when(blank("claim") | blank("quote") | blank("accession_no"), "malformed").when(advises("claim"), "recommendation")
    rows = with_sources(points.withColumn("__why", before), sections, F.col("__why").isNull(), ("__", "quote", "accession_no", "item"))
    return rows.select(*points.columns, F.coalesce("__why", F.when(~F.col("__sourced"), "source_unavailable").when(~F.col("__found"), "quote_not_found")).alias("drop_reason"))


def pass_summary(checked: DataFrame, *by: str) -> DataFrame:
    """Of each pass: points kept and dropped, and the dropped share (null for none)."""
    return drop_rate(checked, *by)
