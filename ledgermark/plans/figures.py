"""Annual figures, share counts, the screened universe and the screens' common base, from one as-of view."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.columns import fiscal_length, is_common_stock, leading_int, months_back, or_zero, ratio, sum_or_null
from ledgermark.tables import materialise

from .asof import AsOfView, ManyDates, newest

# The reporting tags behind each figure, in order of preference.
REVENUE = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet")
COST = ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold", "CostOfServices", "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization")
PROPERTY_PAYMENTS = (
    "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets", "PaymentsForCapitalImprovements",
    "PaymentsToAcquireOtherPropertyPlantAndEquipment", "PaymentsToAcquireMachineryAndEquipment",
)
SOFTWARE = ("PaymentsToDevelopSoftware", "PaymentsForSoftware")
DEPRECIATION = ("DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet")
EQUITY = ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "StockholdersEquity")
PROPERTY = ("PropertyPlantAndEquipmentNet", "PropertyPlantAndEquipmentAndFinanceLeaseRightOfUseAssetAfterAccumulatedDepreciationAndAmortization")
NET_INTEREST = ("InterestIncomeExpenseNonoperatingNet", "InterestIncomeExpenseNet")
INTEREST_EXPENSE = ("InterestExpenseNonoperating", "InterestExpense", "InterestAndDebtExpense", "InterestExpenseDebt")
INTANGIBLES = ("ImpairmentOfIntangibleAssetsExcludingGoodwill", "ImpairmentOfIntangibleAssetsIndefinitelivedExcludingGoodwill")
RESTRUCTURING = ("RestructuringCharges", "RestructuringCosts")
DISPOSALS = ("GainLossOnDispositionOfAssets1", "GainLossOnDispositionOfAssets", "GainLossOnSaleOfPropertyPlantEquipment", "GainLossOnSaleOfProperties")
BUSINESS_SALES = ("GainLossOnSaleOfBusiness", "DisposalGroupNotDiscontinuedOperationGainLossOnDisposal")
DISCONTINUED = ("IncomeLossFromDiscontinuedOperationsNetOfTaxAttributableToReportingEntity", "IncomeLossFromDiscontinuedOperationsNetOfTax")
WEIGHTED_SHARES = ("WeightedAverageNumberOfSharesOutstandingBasic", "WeightedAverageNumberOfDilutedSharesOutstanding")
POINT_SHARES = ("EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding")
SINGLE = (
    "GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss", "NetCashProvidedByUsedInOperatingActivities", "ShareBasedCompensation", "Assets", "AssetsCurrent",
    "Liabilities", "LiabilitiesCurrent", "LiabilitiesAndStockholdersEquity", "CashAndCashEquivalentsAtCarryingValue", "LongTermDebtNoncurrent", "LongTermDebt",
    "LongTermDebtCurrent", "DebtCurrent", "ShortTermInvestments", "InvestmentIncomeInterest", "AssetImpairmentCharges", "GoodwillAndIntangibleAssetImpairment",
    "GoodwillImpairmentLoss", "ImpairmentOfLongLivedAssetsHeldForUse", "ImpairmentOfLongLivedAssetsToBeDisposedOf", "OperatingLeaseImpairmentLoss",
    "GainsLossesOnExtinguishmentOfDebt", "GainLossRelatedToLitigationSettlement",
)
USD_TAGS = (
    *REVENUE, *COST, *PROPERTY_PAYMENTS, *SOFTWARE, *DEPRECIATION, *EQUITY, *PROPERTY, *NET_INTEREST, *INTEREST_EXPENSE, *INTANGIBLES, *RESTRUCTURING, *DISPOSALS,
    *BUSINESS_SALES, *DISCONTINUED, *SINGLE,
)
ANNUAL_TAGS = {**dict.fromkeys(USD_TAGS, "USD"), **dict.fromkeys(WEIGHTED_SHARES, "shares")}
FIGURES = (
    "revenue", "cost_of_revenue", "gross_profit", "ebit", "net_income", "unusual_effect", "cfo", "stock_compensation", "capex", "capitalized_software", "depreciation", "assets",
    "current_assets", "current_liabilities", "liabilities", "equity", "cash", "short_term_investments", "net_interest_income", "long_term_debt", "current_debt", "ppe", "shares_weighted",
)

# Limits of the universe.
ANNUAL_FORMS = ("10-K", "10-K/A", "10-KT")
FILING_MONTHS, SHARE_MONTHS, SHARE_HISTORY_MONTHS = 15, 15, 48
PRICE_DAYS, LEAST_YEARS, LEAST_MARKET_CAP = 10, 5, 300_000_000
FINANCIAL = (6000, 6799)
WEIGHTED_FLOOR, UNITS_ERROR = 0.8, 100
TAX = 0.21


def first(*tags: str) -> Column:
    return F.coalesce(*[F.col(t) for t in tags])


def unusual_effect() -> Column:
    """Effect of tagged unusual items on income: charges negative, gains positive; null if none is tagged."""
    goodwill = F.coalesce("GoodwillAndIntangibleAssetImpairment", sum_or_null("GoodwillImpairmentLoss", first(*INTANGIBLES)))
    held = ("ImpairmentOfLongLivedAssetsHeldForUse", "ImpairmentOfLongLivedAssetsToBeDisposedOf", "OperatingLeaseImpairmentLoss")
    impairment = F.coalesce("AssetImpairmentCharges", sum_or_null(goodwill, *held))
    gains = (first(*DISPOSALS), first(*BUSINESS_SALES), F.col("GainsLossesOnExtinguishmentOfDebt"), F.col("GainLossRelatedToLitigationSettlement"), first(*DISCONTINUED))
    return sum_or_null(-impairment, -first(*RESTRUCTURING), *gains)


def figure_columns() -> list[Column]:
    """The figures of one filer and fiscal year from its pivoted tags."""
    revenue, cost, equity = first(*REVENUE), first(*COST), first(*EQUITY)
    software = F.coalesce(*[F.col(t) for t in SOFTWARE], F.lit(0.0))
    only_productive = F.col(PROPERTY_PAYMENTS[0]).isNull() & F.col(PROPERTY_PAYMENTS[1]).isNotNull()
    capex = first(*PROPERTY_PAYMENTS) + F.when(only_productive, 0.0).otherwise(software)
    expense = first(*INTEREST_EXPENSE)
    interest = F.coalesce(*[F.col(t) for t in NET_INTEREST], sum_or_null("InvestmentIncomeInterest", -expense))
    return [
        revenue.alias("revenue"),
        cost.alias("cost_of_revenue"),
        F.coalesce("GrossProfit", revenue - cost).alias("gross_profit"),
        F.col("OperatingIncomeLoss").alias("ebit"),
        F.col("NetIncomeLoss").alias("net_income"),
        unusual_effect().alias("unusual_effect"),
        F.col("NetCashProvidedByUsedInOperatingActivities").alias("cfo"),
        F.col("ShareBasedCompensation").alias("stock_compensation"),
        capex.alias("capex"),
        first(*SOFTWARE).alias("capitalized_software"),
        first(*DEPRECIATION).alias("depreciation"),
        F.col("Assets").alias("assets"),
        F.col("AssetsCurrent").alias("current_assets"),
        F.col("LiabilitiesCurrent").alias("current_liabilities"),
        F.coalesce("Liabilities", F.col("LiabilitiesAndStockholdersEquity") - equity).alias("liabilities"),
        equity.alias("equity"),
        F.col("CashAndCashEquivalentsAtCarryingValue").alias("cash"),
        F.col("ShortTermInvestments").alias("short_term_investments"),
        interest.alias("net_interest_income"),
        F.coalesce("LongTermDebtNoncurrent", F.col("LongTermDebt") - or_zero("LongTermDebtCurrent")).alias("long_term_debt"),
        F.coalesce("DebtCurrent", "LongTermDebtCurrent").alias("current_debt"),
        first(*PROPERTY).alias("ppe"),
        first(*WEIGHTED_SHARES).alias("shares_weighted"),
    ]


#: Stands for the tags and units that no figure is made of.
OTHER = "other"


@dataclass(frozen=True)
class Figures:
    """All derived relations of one view; each is lazy and built once. A view of few filers stays small from the scan
    on, since the filer is a key of every grouping below; so is the date, if the view has several."""

    view: AsOfView | ManyDates

    @property
    def key(self) -> tuple[str, ...]:
        return self.view.key

    @cached_property
    def annual_raw(self) -> DataFrame:
        """A row for each filer and fiscal year end, a column for each tag; of several fiscal-length values the largest.

        A year end is the end of some fiscal-length duration, whatever its tag: the pivot carries that beside the values."""
        f = self.view.fact_asof
        whole_year = F.coalesce(fiscal_length("period_start", "period_end"), F.lit(False))
        f = f.where(F.col("period_start").isNull() | whole_year)
        wanted = [(F.col("unit") == u) & F.col("tag").isin([t for t, x in ANNUAL_TAGS.items() if x == u]) for u in ("USD", "shares")]
        tag = F.when(wanted[0] | wanted[1], F.col("tag")).otherwise(OTHER)
        rows = f.select(*self.key, F.col("period_end").alias("fy_end"), tag.alias("tag"), "value", F.col("period_start").isNotNull().alias("year"))
        wide = rows.groupBy(*self.key, "fy_end").pivot("tag", [*ANNUAL_TAGS, OTHER]).agg(F.max("value").alias("value"), F.max("year").alias("year"))
        is_end = F.greatest(*[F.coalesce(F.col(f"{t}_year"), F.lit(False)) for t in (*ANNUAL_TAGS, OTHER)])
        return wide.where(is_end).select(*self.key, "fy_end", *[F.col(f"{t}_value").alias(t) for t in ANNUAL_TAGS])

    @cached_property
    def annual(self) -> DataFrame:
        return self.annual_raw.select(*self.key, "fy_end", *figure_columns())

    @cached_property
    def shares_latest(self) -> DataFrame:
        """Share count of each filer: the count at a point in time if it is recent and not far below the weighted one."""
        day, key = self.view.day, list(self.key)
        shares = self.view.fact_asof.where("unit = 'shares'")
        point = F.col("period_start").isNull() & F.col("tag").isin(*POINT_SHARES) & (F.col("period_end") >= months_back(day, SHARE_MONTHS))
        weighted = fiscal_length("period_start", "period_end") & F.col("tag").isin(*WEIGHTED_SHARES)
        body = F.struct("value", "period_end", "tag", "accession_no", "filed_date")

        def best(among: Column, preferred: str) -> Column:
            order = F.struct("period_end", (F.col("tag") == preferred).cast("int"), F.coalesce("period_start", "period_end"))
            return F.max_by(F.when(among, body), F.when(among, order))  # rows without an order do not count

        recent = F.max(F.when((F.col("period_end") >= months_back(day, SHARE_HISTORY_MONTHS)) & (F.col("value") > 0), F.col("value")))
        both = shares.groupBy(*key).agg(best(point, POINT_SHARES[0]).alias("p"), best(weighted, WEIGHTED_SHARES[0]).alias("w"), recent.alias("shares_recent_max"))
        both = both.where("p IS NOT NULL OR w IS NOT NULL")
        use_point = F.col("p.value").isNotNull() & (F.col("w.value").isNull() | (F.col("p.value") >= WEIGHTED_FLOOR * F.col("w.value")))
        both = both.withColumn("x", F.when(use_point, F.col("p")).otherwise(F.col("w")))
        bad = F.col("x.value").isNull() | (F.col("x.value") <= 0) | F.coalesce(F.col("x.value") * UNITS_ERROR < F.col("shares_recent_max"), F.lit(False))
        return both.select(
            *key, F.when(~bad, F.col("x.value")).alias("shares"), F.col("x.period_end").alias("shares_date"), F.col("x.tag").alias("shares_tag"),
            F.col("x.accession_no").alias("shares_accession"), F.col("x.filed_date").alias("shares_filed"), F.col("x.value").alias("shares_reported"), "shares_recent_max",
        )

    @cached_property
    def universe_screened(self) -> DataFrame:
        """Every filer of the universe with its figures and the first reason it is excluded for (null: eligible)."""
        day, key = self.view.day, list(self.key)
        years = self.annual.groupBy(*key).agg(F.count("*").alias("fiscal_years"), F.max("fy_end").alias("latest_fy_end"))
        tenk = self.view.filing_asof.where(F.col("form_type").isin(*ANNUAL_FORMS)).groupBy(*key).agg(F.max("filed_date").alias("last_10k"))
        u = self.view.universe_asof.join(tenk, key, "left").join(years, key, "left")
        u = u.join(self.view.price_asof.select(*key, "price_date", F.col("close").alias("last_close")), key, "left").join(self.shares_latest, key, "left")
        sic = leading_int("sic")
        u = u.withColumn("price", F.when(F.col("price_date") >= F.date_sub(day, PRICE_DAYS), F.col("last_close"))).withColumn("market_cap", F.col("price") * F.col("shares"))
        u = u.withColumn("track", F.when(sic.between(*FINANCIAL), "financial").otherwise("general"))
        recent = F.coalesce(F.col("last_10k") >= months_back(day, FILING_MONTHS), F.lit(False))
        terminal = F.col("status").isin("deregistered", "delisted_for_cause", "acquired")
        # fixed values: the reasons, which results carry
        why = (
            F.when(~recent, "no 10-K filed in the 15 months to the as-of date")
            .when(F.col("track") == "financial", "financial filer: bank, insurer or REIT screens are separate")
            .when(F.coalesce("fiscal_years", F.lit(0)) < LEAST_YEARS, "fewer than 5 years of XBRL history")
            .when(F.col("price").isNull() & terminal, "no price for a filer that later stopped filing: the survivorship gap")
            .when(F.col("ticker").isNull(), "no ticker on file: not listed today, so it cannot be priced")
            .when(~is_common_stock("ticker"), F.concat(F.lit("listed ticker is not common stock: "), F.col("ticker")))
            .when(F.col("price").isNull(), "no price within 10 days of the as-of date")
            .when(F.col("shares").isNull(), "no share count on file")
            .when(F.col("market_cap") < LEAST_MARKET_CAP, "market cap below $300M")
        )
        return u.select(
            *key, "name", "ticker", "sic", "track", "last_10k", F.coalesce("fiscal_years", F.lit(0)).alias("fiscal_years"), "latest_fy_end", "price", "price_date", "shares", "shares_date",
            "shares_tag", "shares_accession", "shares_filed", "shares_reported", "shares_recent_max", "market_cap", why.alias("excluded_because"),
        )

    @cached_property
    def screen_base(self) -> DataFrame:
        """Latest fiscal year of every eligible filer with its debt and enterprise value."""
        eligible = self.universe_screened.where("excluded_because IS NULL").select(*self.key, "name", "ticker", "market_cap", "price", "price_date", "shares", "shares_date")
        debt = or_zero("long_term_debt") + or_zero("current_debt")
        base = newest(self.annual, "fy_end", 1, key=self.key).join(eligible, list(self.key)).withColumn("total_debt", debt)
        return base.withColumn("enterprise_value", F.col("market_cap") + F.col("total_debt") - or_zero("cash"))

    def keep(self) -> Figures:
        """Write what several screens share as tables, each built on the one before."""
        for name in ("annual", "universe_screened", "screen_base"):
            self.__dict__[name] = materialise(getattr(self, name), name)
        return self

    def on(self, view: AsOfView) -> Figures:
        """Figures of one of the dates that were kept together."""
        one = Figures(view)
        for name in ("annual", "universe_screened", "screen_base"):
            one.__dict__[name] = getattr(self, name).where(F.col("as_of") == view.day).drop("as_of")
        return one


def owner_earnings(capex_used: str | Column = "capex") -> Column:
    """Cash from operations less capital spending, stock compensation and net interest after tax; missing deductions are none."""
    used = F.col(capex_used) if isinstance(capex_used, str) else capex_used
    return F.col("cfo") - used - or_zero("stock_compensation") - or_zero("net_interest_income") * (1 - TAX)


MAINTENANCE_YEARS = 7


def maintenance_capex(annual: DataFrame) -> DataFrame:
    """Of each filer: total capex of its newest year with capex, its revenue times the mean capex rate of up to
    seven years, the lower of both as ``used``, and their spread."""
    rows = newest(annual.where("capex IS NOT NULL"), "fy_end", MAINTENANCE_YEARS)
    per = rows.groupBy("cik").agg(
        F.max_by(F.struct("capex", "revenue", "fy_end"), "fy_end").alias("x"),
        F.expr("aggregate(array_sort(collect_list(struct(-datediff(fy_end, DATE '1900-01-01') AS o, CASE WHEN revenue <> 0 THEN capex / revenue END AS r))), "
               "named_struct('s', 0D, 'n', 0), (a, x) -> named_struct('s', a.s + coalesce(x.r, 0D), 'n', a.n + CASE WHEN x.r IS NULL THEN 0 ELSE 1 END))").alias("m"),
    )
    scaled = F.nullif(F.col("x.revenue"), F.lit(0.0)) * ratio("m.s", F.col("m.n").cast("double"))
    used = F.least(F.col("x.capex"), scaled)
    return per.select("cik", F.col("x.fy_end").alias("fy_end"), F.col("x.capex").alias("total"), scaled.alias("revenue_scaled"), used.alias("used"), F.abs(F.col("x.capex") - scaled).alias("spread"))
