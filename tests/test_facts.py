"""Facts of the star tables against their SQL, and how often the figures read them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermark.plans import registry
from ledgermark.plans.figures import Figures
from ledgermark.sources.adapter import FACTS, star_store

SF = "/root/testdata/sf0.001"


def scans(df, table):
    return df._jdf.queryExecution().optimizedPlan().toString().count(table)


def test_facts_are_what_their_sql_says(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    want = None
    for tag, unit, _, value, condition in FACTS:
        one = orders.where(condition).select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("accession_no"), F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), F.expr(f"CAST({value} AS DOUBLE)").alias("value"))
        one = one.where("value IS NOT NULL")
        want = one if want is None else want.unionByName(one)
    got = star_store(spark, SF).fact.select("accession_no", "tag", "unit", "value")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0  # to the last bit


def test_facts_are_no_arrays_to_explode_and_share_counts_read_them_once(spark):
    view = registry.view(spark, SF)
    assert scans(view.fact_asof, "Generate explode") == 0
    assert scans(Figures(view).shares_latest, "o_totalprice") <= scans(view.fact_asof, "o_totalprice")


def test_a_valuation_reads_written_figures(spark):
    assert scans(registry.QUERIES["op_value"](spark, SF), "o_orderkey") == 0
