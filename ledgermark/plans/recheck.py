"""Re-check of stated conditions against the figures filed since: all theses in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.columns import ratio

from .figures import maintenance_capex, owner_earnings

# Metrics that figures can give, the phrases they are written as, words without weight, number words.
METRICS = {
    "owner_earnings_margin": ("owner earnings margin", "owner earnings"),
    "operating_margin": ("operating margin", "consolidated operating margin", "ebit margin"),
    "gross_margin": ("gross margin",),
    "revenue_growth": ("revenue growth", "sales growth", "revenue, year over year"),
    "revenue": ("revenue", "sales"),
    "operating_income": ("operating income", "ebit"),
    "net_income": ("net income", "earnings"),
}
PREFIXES = ("consolidated", "total", "the", "company", "reported")
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "a": 1, "an": 1, "single": 1}


def resolve_metric(phrase: Column) -> Column:
    """The metric that a phrase begins with (its longest name wins); null for any other phrase."""
    plain = F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))
    plain = F.regexp_replace(plain, f"^(?:(?:{'|'.join(PREFIXES)}) )+", "")
    names = sorted({(a, k) for k, own in METRICS.items() for a in (k, k.replace("_", " "), *own)}, key=lambda x: (-len(x[0]), list(METRICS).index(x[1])))
    out = None
    for alias, key in names:
        hit = (plain == alias) if "_" in alias else (plain == alias) | F.startswith(plain, F.lit(alias + " ")) | F.startswith(plain, F.lit(alias + ","))
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def window_years(phrase: Column) -> Column:
    """Years that a condition must hold for: the first number or number word of its window, 1 at least."""
    tokens = F.split(F.replace(F.lower(phrase), F.lit("-"), F.lit(" ")), r"\s+")
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    n = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.greatest(F.lit(1), t.try_cast("int"))).otherwise(words[t]))
    return F.coalesce(F.get(F.filter(n, lambda x: x.isNotNull()), F.lit(0)), F.lit(1))


def metric_series(annual: DataFrame) -> DataFrame:
    """Every metric of every filer and year. The maintenance capex of the newest years holds for all years."""
    mc = maintenance_capex(annual).select("cik", "used")
    rows = annual.join(mc, "cik", "left").withColumn("older", F.lag("revenue").over(Window.partitionBy("cik").orderBy("fy_end")))
    some = lambda c: F.when(F.col("revenue") != 0, c)
    return rows.select(
        "cik", "fy_end", "revenue", F.col("ebit").alias("operating_income"), "net_income",
        some(ratio("ebit", "revenue")).alias("operating_margin"), some(ratio("gross_profit", "revenue")).alias("gross_margin"),
        some(ratio(owner_earnings("used"), "revenue")).alias("owner_earnings_margin"), some(ratio("revenue", "older") - 1).alias("revenue_growth"),
    )


def evaluate(conditions: DataFrame, series: DataFrame) -> DataFrame:
    """``conditions`` (cik, metric, direction, threshold, window) with the metric's key, what was observed (newest
    first) and a status: breached only if all years of the window are beyond the threshold, needs_a_human if that
    cannot be told."""
    point = F.struct((-F.datediff("fy_end", F.lit("1900-01-01").cast("date"))).alias("o"), "fy_end", *METRICS)
    per = series.groupBy("cik").agg(F.array_sort(F.collect_list(point)).alias("points"))
    rows = conditions.withColumn("metric_key", resolve_metric(F.col("metric"))).withColumn("needed", window_years(F.coalesce("window", F.lit(""))))
    rows = rows.join(per, "cik", "left")
    values = None
    for key in METRICS:
        own = F.col("metric_key") == key
        values = F.when(own, _series_of(key)) if values is None else values.when(own, _series_of(key))
    rows = rows.withColumn("observed", F.slice(F.coalesce(values, F.array().cast("array<struct<fy_end:date,value:double>>")), F.lit(1), F.col("needed"))).drop("points")
    whole = (F.size("observed") == F.col("needed")) & F.forall("observed", lambda p: p["value"].isNotNull())
    d = F.lower(F.coalesce("direction", F.lit("")))
    below, above = F.startswith(d, F.lit("below")) | F.startswith(d, F.lit("under")), F.startswith(d, F.lit("above")) | F.startswith(d, F.lit("over"))
    beyond = F.when(below, F.forall("observed", lambda p: p["value"] < F.col("threshold"))).when(above, F.forall("observed", lambda p: p["value"] > F.col("threshold")))
    status = F.when(F.col("metric_key").isNull() | ~whole | beyond.isNull(), "needs_a_human").when(beyond, "breached").otherwise("holding")
    return rows.withColumn("status", status)


def _series_of(key: str) -> Column:
    return F.transform("points", lambda p: F.struct(p["fy_end"].alias("fy_end"), p[key].alias("value")))


def roll_up(evaluated: DataFrame, *by: str) -> DataFrame:
    """Status of each thesis: breached if a condition is, else needs_a_human if one does, else holding."""
    rank = F.when(F.col("status") == "breached", 0).when(F.col("status") == "needs_a_human", 1).otherwise(2)
    names = F.array(F.lit("breached"), F.lit("needs_a_human"), F.lit("holding"))
    return evaluated.groupBy(*by).agg(F.min(rank).alias("r"), F.count("*").alias("conditions")).select(*by, F.element_at(names, F.col("r") + 1).alias("status"), "conditions")
