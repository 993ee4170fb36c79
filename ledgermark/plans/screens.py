"""Five ranked screens over one base, their coverage, and what they say about a filer they flag."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.columns import fiscal_length, money_millions, or_zero, percent, ratio
from ledgermark.functions.ranks import ranked

from .figures import Figures

# The screens in order, their labels, and their limits.
SCREENS = ("magic_formula", "piotroski", "net_net", "owner_earnings", "quality_at_price")
LABELS = {"magic_formula": "Magic Formula", "piotroski": "Piotroski", "net_net": "Net-net", "owner_earnings": "Owner earnings yield", "quality_at_price": "Quality at price"}
TOP = 10
STRONG_SCORE = 8
QUALITY_YEARS, LEAST_ROIC, LEAST_FCF_YIELD, AFTER_TAX = 7, 0.12, 0.05, 0.79
TESTS = ("f_roa", "f_cfo", "f_delta_roa", "f_accrual", "f_leverage", "f_liquidity", "f_no_dilution", "f_margin", "f_turnover")
#: Figures a screen reports of a filer it flags.
METRICS = {
    "magic_formula": ("ebit", "enterprise_value", "earnings_yield", "return_on_capital"),
    "piotroski": ("score", "tests_scored", "operating_roa", "operating_roa_1", "roa", "roa_1", "unusual_effect", "unusual_effect_1", "unusual_change", *TESTS),
    "net_net": ("net_current_assets", "price_to_ncav"),
    "owner_earnings": ("cfo", "maintenance_capex", "owner_earnings", "enterprise_value", "owner_earnings_yield"),
    "quality_at_price": ("years_counted", "min_roic", "free_cash_flow", "fcf_yield"),
}
#: Figures of the latest year without which a screen cannot rank a filer, and what their absence is called.
NAMES = {
    "ebit": "no operating income", "cfo": "no operating cash flow", "net_income": "no net income", "assets": "no total assets", "gross_profit": "no gross profit", "revenue": "no revenue",
    "current_assets": "no current assets", "current_liabilities": "no current liabilities", "liabilities": "no total liabilities", "ppe": "no property, plant and equipment",
    "capex": "no annual capital expenditure", "shares_weighted": "no share count",
}
REQUIRED = {
    "magic_formula": ("ebit", "current_assets", "current_liabilities", "ppe"),
    "net_net": ("current_assets", "liabilities"),
    "owner_earnings": ("cfo", "capex"),
    "quality_at_price": ("ebit", "cfo", "capex"),
    "piotroski": ("ebit", "cfo", "net_income", "assets", "gross_profit", "revenue", "current_assets", "current_liabilities", "shares_weighted"),
}


def _test(passed: Column) -> Column:
    """1 or 0, and null where the comparison cannot be made."""
    return passed.cast("int")


@dataclass(frozen=True)
class Screens:
    """The five screens of one set of figures, for each of its dates. Ranks are found by ranges of the ranked values."""

    figures: Figures

    @property
    def key(self) -> list[str]:
        return list(self.figures.key)

    @property
    def dates(self) -> list[str]:
        """What ranks are within, besides the whole."""
        return self.key[:-1]

    def _ranked(self, df: DataFrame, name: str, *by: tuple[str | Column, bool], among: Column | None = None) -> DataFrame:
        return ranked(df, name, *by, among=among, within=self.dates)

    @cached_property
    def magic_formula(self) -> DataFrame:
        base = self.figures.screen_base.where("ebit IS NOT NULL AND current_assets IS NOT NULL AND current_liabilities IS NOT NULL AND ppe IS NOT NULL AND enterprise_value > 0")
        capital = (F.col("current_assets") - or_zero("cash")) - (F.col("current_liabilities") - or_zero("current_debt")) + F.col("ppe")
        base = base.withColumn("tangible_capital", capital).where("tangible_capital > 0")
        base = base.withColumn("earnings_yield", ratio("ebit", "enterprise_value")).withColumn("return_on_capital", ratio("ebit", "tangible_capital"))
        base = self._ranked(self._ranked(base, "ey_rank", ("earnings_yield", True)), "roc_rank", ("return_on_capital", True))
        base = self._ranked(base, "rank", (F.col("ey_rank") + F.col("roc_rank"), False), ("earnings_yield", True))
        return base.withColumn("flagged", (F.col("rank") <= TOP) & (F.col("ebit") > 0))

    @cached_property
    def piotroski(self) -> DataFrame:
        w = Window.partitionBy(*self.key).orderBy("fy_end")
        a = self.figures.annual
        back = [("fy_end", 1), ("fy_end", 2), ("assets", 1), ("assets", 2)]
        back += [(c, 1) for c in ("ebit", "net_income", "long_term_debt", "current_assets", "current_liabilities", "shares_weighted", "gross_profit", "revenue", "unusual_effect")]
        a = a.select("*", *[F.lag(c, n).over(w).alias(f"{c}_{n}") for c, n in back], F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc("fy_end"))).alias("recency"))
        a = a.where((F.col("recency") == 1) & fiscal_length("fy_end_1", "fy_end") & fiscal_length("fy_end_2", "fy_end_1"))
        a = a.withColumn("operating_roa", ratio("ebit", "assets_1")).withColumn("operating_roa_1", ratio("ebit_1", "assets_2"))
        a = a.withColumn("roa", ratio("net_income", "assets_1")).withColumn("roa_1", ratio("net_income_1", "assets_2"))
        change = or_zero("unusual_effect") - or_zero("unusual_effect_1")
        a = a.withColumn("unusual_change", F.when(F.coalesce("unusual_effect", "unusual_effect_1").isNotNull(), change))
        debt, debt_1 = or_zero("long_term_debt"), or_zero("long_term_debt_1")
        leverage = F.when((debt == 0) & (debt_1 == 0), 1).otherwise(_test(debt / F.col("assets") < debt_1 / F.col("assets_1")))
        tests = {
            "f_roa": _test(F.col("operating_roa") > 0),
            "f_cfo": _test(F.col("cfo") > 0),
            "f_delta_roa": _test(F.col("operating_roa") > F.col("operating_roa_1")),
            "f_accrual": _test(F.col("cfo") > F.col("net_income")),
            "f_leverage": F.when((F.col("assets") != 0) & (F.col("assets_1") != 0), leverage),
            "f_liquidity": _test(ratio("current_assets", "current_liabilities") > ratio("current_assets_1", "current_liabilities_1")),
            "f_no_dilution": _test(F.col("shares_weighted") <= F.col("shares_weighted_1")),
            "f_margin": _test(ratio("gross_profit", "revenue") > ratio("gross_profit_1", "revenue_1")),
            "f_turnover": _test(ratio("revenue", "assets_1") > ratio("revenue_1", "assets_2")),
        }
        a = a.select("*", *[c.alias(n) for n, c in tests.items()])
        a = a.withColumn("score", reduce(Column.__add__, [F.coalesce(t, F.lit(0)) for t in TESTS])).withColumn("tests_scored", reduce(Column.__add__, [F.col(t).isNotNull().cast("int") for t in TESTS]))
        u = self.figures.universe_screened.where("excluded_because IS NULL").select(*self.key, "name", "ticker", "market_cap")
        whole = F.col("tests_scored") == len(TESTS)
        a = self._ranked(a.join(u, self.key), "rank", ("score", True), ("operating_roa", True), among=whole)
        return a.withColumn("flagged", whole & (F.col("score") >= STRONG_SCORE))

    @cached_property
    def net_net(self) -> DataFrame:
        base = self.figures.screen_base.where("current_assets IS NOT NULL AND liabilities IS NOT NULL").withColumn("net_current_assets", F.col("current_assets") - F.col("liabilities"))
        base = base.where("net_current_assets > 0").withColumn("price_to_ncav", ratio("market_cap", "net_current_assets"))
        return self._ranked(base, "rank", ("price_to_ncav", False)).withColumn("flagged", F.col("market_cap") < F.col("net_current_assets"))

    @cached_property
    def owner_earnings(self) -> DataFrame:
        base = self.figures.screen_base.where("cfo IS NOT NULL AND capex IS NOT NULL AND enterprise_value > 0")
        base = base.withColumn("maintenance_capex", F.least("capex", "depreciation")).withColumn("owner_earnings", F.col("cfo") - F.col("maintenance_capex"))
        base = base.withColumn("owner_earnings_yield", ratio("owner_earnings", "enterprise_value"))
        return self._ranked(base, "rank", ("owner_earnings_yield", True)).withColumn("flagged", (F.col("rank") <= TOP) & (F.col("owner_earnings") > 0))

    @cached_property
    def quality(self) -> DataFrame:
        """Filers with what quality at a price asks of them and whether they are flagged, not yet ranked."""
        invested = or_zero("equity") + or_zero("long_term_debt") + or_zero("current_debt") - or_zero("cash")
        years = self.figures.annual.withColumn("roic", ratio(F.col("ebit") * AFTER_TAX, invested))
        years = years.withColumn("rn", F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc("fy_end")))).where(F.col("rn") <= QUALITY_YEARS)
        streak = years.groupBy(*self.key).agg(
            F.count("*").alias("years_counted"), F.count("roic").alias("roics"), F.min("roic").alias("min_roic"), F.datediff(F.max("fy_end"), F.min("fy_end")).alias("span")
        )
        base = self.figures.screen_base.where("cfo IS NOT NULL AND capex IS NOT NULL").withColumn("free_cash_flow", F.col("cfo") - F.col("capex"))
        base = base.withColumn("fcf_yield", ratio("free_cash_flow", "market_cap")).join(streak, self.key)
        n = QUALITY_YEARS
        good = (F.col("years_counted") == n) & (F.col("roics") == n) & F.col("span").between(350 * (n - 1), 380 * (n - 1)) & (F.col("min_roic") > LEAST_ROIC) & (F.col("fcf_yield") > LEAST_FCF_YIELD)
        return base.withColumn("flagged", F.coalesce(good, F.lit(False)))

    @cached_property
    def quality_at_price(self) -> DataFrame:
        return self._ranked(self.quality, "rank", ("fcf_yield", True), among=F.col("flagged"))

    def table(self, screen: str) -> DataFrame:
        if screen not in SCREENS:
            raise ValueError(f"no screen {screen!r}; one of {', '.join(SCREENS)}")
        return getattr(self, screen)

    def rows(self, screen: str) -> DataFrame:
        """A screen's rows by rank, unranked ones last."""
        return self.table(screen).orderBy(F.col("rank").asc_nulls_last(), "cik")

    def register_views(self) -> None:
        """The screens as temporary views under their names."""
        for s in SCREENS:
            self.table(s).createOrReplaceTempView(s)

    def coverage(self, screen: str) -> DataFrame:
        """Eligible filers that a screen cannot rank, counted by the first figure they lack."""
        missing = F.coalesce(*[F.when(F.col(c).isNull(), NAMES[c]) for c in REQUIRED[screen]])
        return self.figures.screen_base.select(missing.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("filers")).withColumn("screen", F.lit(screen))

    def flags(self) -> DataFrame:
        """A row for each filer (and date) and screen that flags it: rank, a sentence, and the figures behind it."""
        out = []
        for i, s in enumerate(SCREENS):
            t = self.table(s)
            n = t.groupBy(*self.dates).agg(F.count("rank").alias("ranked"))  # a row for each date
            t = t.join(F.broadcast(n), self.dates) if self.dates else t.crossJoin(F.broadcast(n))
            metrics = F.map_from_arrays(F.array(*[F.lit(m) for m in METRICS[s]]), F.array(*[F.col(m).cast("double") for m in METRICS[s]]))
            out.append(t.where("flagged").select(*self.key, F.lit(i).alias("ord"), F.lit(s).alias("screen"), F.col("rank").cast("int").alias("rank"), reason(s).alias("reason"), metrics.alias("metrics")))
        return reduce(DataFrame.unionByName, out)


def reason(screen: str) -> Column:
    """One sentence on why a screen flags a row (with ``ranked``, the number of ranked filers)."""
    label = LABELS[screen]
    place = F.concat(F.lit("rank "), F.col("rank").cast("string"), F.lit(" of "), F.col("ranked").cast("string"))
    if screen == "magic_formula":
        return F.concat(F.lit(f"{label} "), place, F.lit(": earnings yield "), percent("earnings_yield"), F.lit(", return on capital "), percent("return_on_capital", 0))
    if screen == "piotroski":
        way = F.when(F.col("unusual_change") > 0, "added").otherwise("took")
        more = F.when(F.coalesce(F.col("unusual_change"), F.lit(0.0)) != 0, F.concat(F.lit("; tagged unusual items "), way, F.lit(" "), money_millions("unusual_change"), F.lit(" year on year")))
        return F.concat(F.lit(f"{label} "), F.col("score").cast("string"), F.lit("/9, "), place, F.coalesce(more, F.lit("")))
    if screen == "net_net":
        return F.concat(F.lit(f"{label}: market cap "), F.format_string("%.2f", "price_to_ncav"), F.lit("x net current assets"))
    if screen == "owner_earnings":
        return F.concat(F.lit(f"{label} "), percent("owner_earnings_yield"), F.lit(", "), place)
    return F.concat(F.lit(f"{label}: ROIC at least "), percent("min_roic", 0), F.lit(f" in each of {QUALITY_YEARS} years, FCF yield "), percent("fcf_yield"))
