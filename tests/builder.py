"""A small store with rows as an ingest would write them."""

from __future__ import annotations

from datetime import date, timedelta

from ledgermark.schemas import FACT, FILER, FILING, PRICE
from ledgermark.sources.adapter import Store

INSTANTS = {
    "Assets", "AssetsCurrent", "Liabilities", "LiabilitiesCurrent", "StockholdersEquity", "CashAndCashEquivalentsAtCarryingValue", "LongTermDebtNoncurrent", "LongTermDebt", "DebtCurrent",
    "LongTermDebtCurrent", "PropertyPlantAndEquipmentNet", "EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding",
}
SHARES = {"WeightedAverageNumberOfSharesOutstandingBasic", "EntityCommonStockSharesOutstanding", "CommonStockSharesOutstanding"}


class Builder:
    def __init__(self, spark):
        self.spark = spark
        self.filers, self.filings, self.facts, self.prices = [], [], [], []

    def filer(self, cik, ticker="ABC", sic="3500", status="active", status_date=None, first_seen=date(2000, 1, 1)):
        self.filers.append((cik, f"Filer {cik}", ticker, "X", sic, status, status_date, first_seen, None))
        return self

    def fact(self, cik, tag, value, end, filed, start=None, unit=None, accession=None, form="10-K"):
        unit = unit or ("shares" if tag in SHARES else "USD")
        self.facts.append((accession or f"{cik}-{filed}", cik, tag, unit, start, end, float(value), end.year, "FY", form, filed))
        return self

    def annual(self, cik, end, filed, form="10-K", **tags):
        accession = f"{cik}-{filed}-{end}"
        self.filings.append((accession, cik, form, filed, end, None, end.year, "FY"))
        for tag, value in tags.items():
            if value is not None:
                self.fact(cik, tag, value, end, filed, None if tag in INSTANTS else end - timedelta(364), accession=accession, form=form)
        return self

    def history(self, cik, years, **tags):
        for y in years:
            self.annual(cik, date(y, 12, 31), date(y + 1, 2, 15), **tags)
        return self

    def shares(self, cik, count, day, filed):
        return self.fact(cik, "EntityCommonStockSharesOutstanding", count, day, filed, form="10-Q")

    def price(self, cik, day, close, source="a"):
        self.prices.append((cik, None, day, float(close), source, None))
        return self

    def store(self) -> Store:
        make = self.spark.createDataFrame
        return Store(make(self.filers, FILER), make(self.filings, FILING), make(self.facts, FACT), make(self.prices, PRICE))


HEALTHY = {
    "Revenues": 2.0e9, "CostOfRevenue": 1.2e9, "OperatingIncomeLoss": 3.0e8, "NetIncomeLoss": 2.0e8, "NetCashProvidedByUsedInOperatingActivities": 2.8e8,
    "PaymentsToAcquirePropertyPlantAndEquipment": 6e7, "DepreciationDepletionAndAmortization": 5e7, "Assets": 1.5e9, "AssetsCurrent": 7e8, "LiabilitiesCurrent": 3e8, "Liabilities": 6e8,
    "StockholdersEquity": 9e8, "CashAndCashEquivalentsAtCarryingValue": 2e8, "LongTermDebtNoncurrent": 1.5e8, "PropertyPlantAndEquipmentNet": 4e8, "WeightedAverageNumberOfSharesOutstandingBasic": 1e8,
}
AS_OF = date(2025, 6, 30)


def healthy(spark, **changes) -> Builder:
    b = Builder(spark).filer(1).history(1, range(2019, 2025), **{**HEALTHY, **changes})
    return b.shares(1, 1e8, date(2025, 4, 30), date(2025, 5, 1)).price(1, date(2025, 6, 27), 20.0)
