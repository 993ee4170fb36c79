"""What was knowable on a date: the one gateway to facts and prices.

No other plan reads ``store.fact`` or ``store.price``; a test holds to that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.schemas import TERMINAL
from ledgermark.sources.adapter import Store

FACT_KEY = ["cik", "tag", "unit", "period_start", "period_end"]
#: The same in the order that facts are sorted by, which is near the one that filings come in.
BY_PERIOD = ["cik", "period_end", "tag", "unit", "period_start"]


def intervals(versions: DataFrame, key: list[str], since: str, *ties: str) -> DataFrame:
    """``versions`` with ``valid_from`` and ``valid_to``: each holds from the day in ``since`` until the next version of its
    ``key`` comes (null: until now). Of several versions of one day the last by ``ties`` holds; the others' time is empty."""
    following = F.lead(since).over(Window.partitionBy(*key).orderBy(since, *ties))
    return versions.withColumn("valid_from", F.col(since)).withColumn("valid_to", following)


@dataclass(frozen=True)
class AsOfView:
    """Base relations as they stood on ``as_of`` (inclusive), for all filers or for ``ciks``."""

    store: Store
    as_of: date
    ciks: tuple[int, ...] | None = None
    key = ("cik",)  # what tells the rows of one filer's state apart

    def __post_init__(self) -> None:
        if isinstance(self.as_of, str):
            object.__setattr__(self, "as_of", date.fromisoformat(self.as_of))

    @property
    def day(self):
        return F.lit(self.as_of)

    def _scoped(self, df: DataFrame) -> DataFrame:
        return df if self.ciks is None else df.where(F.col("cik").isin(list(self.ciks)))

    @cached_property
    def _facts(self) -> DataFrame:
        return self._scoped(self.store.fact).where(F.col("filed_date") <= self.day)

    @cached_property
    def _prices(self) -> DataFrame:
        return self._scoped(self.store.price).where(F.col("price_date") <= self.day)

    def facts(self, cik: int | None = None, tag: str | None = None, period_end: date | None = None) -> DataFrame:
        """All versions of facts known by then, in no order (``in_order`` sorts them for show)."""
        df = self._facts
        for name, wanted in (("cik", cik), ("tag", tag), ("period_end", period_end)):
            if wanted is not None:
                df = df.where(F.col(name) == F.lit(wanted))
        return df

    @staticmethod
    def in_order(facts: DataFrame) -> DataFrame:
        """Oldest first within a period."""
        return facts.orderBy("period_end", "filed_date", "accession_no")

    @cached_property
    def _dealt(self) -> DataFrame:
        """Facts as they are dealt out for all that follows: stored by filer, or else shuffled once, raw, by filer and period end.
        (A period has few versions, so adding them up before the shuffle would save little.)"""
        return self._facts if self.store.by_filer else self._facts.repartition("cik", "period_end")

    @cached_property
    def fact_asof(self) -> DataFrame:
        """Latest version of each fact. What is grouped by filer and period end later on needs no other shuffle."""
        latest = F.max_by(F.struct("value", "filed_date", "accession_no", "form_type"), F.struct("filed_date", "accession_no"))
        return self._dealt.groupBy(*BY_PERIOD).agg(latest.alias("x")).select(*FACT_KEY, "x.*")

    def latest_fact(self, cik: int, tag: str, period_end: date) -> DataFrame:
        """The version of one period's fact that was the latest by then (no row if there is none)."""
        return self.facts(cik, tag, period_end).orderBy(F.desc("filed_date"), F.desc("accession_no")).limit(1)

    def snapshot(self, tags: list[str] | None = None) -> DataFrame:
        """Latest value of each tag and period end, whatever its unit and start."""
        df = self._facts if tags is None else self._facts.where(F.col("tag").isin(tags))
        key = F.struct("filed_date", "accession_no", "unit", F.coalesce("period_start", F.lit("1800-01-01").cast("date")))
        return df.groupBy("cik", "tag", "period_end").agg(F.max_by("value", key).alias("value"))

    @cached_property
    def price_asof(self) -> DataFrame:
        """Latest close of each filer; of several sources on a day the one that sorts first, and of its rows the lowest close."""
        order = F.struct(F.col("price_date"))
        newest = self._prices.groupBy("cik").agg(F.max_by(F.col("price_date"), order).alias("price_date"))
        rows = self._prices.join(newest, ["cik", "price_date"])
        return rows.groupBy("cik", "price_date").agg(F.min_by(F.struct("ticker", "close", "source"), F.struct("source", "close")).alias("x")).select("cik", "x.ticker", "price_date", "x.close", "x.source")

    def price(self, cik: int) -> DataFrame:
        return self.price_asof.where(F.col("cik") == cik)

    @cached_property
    def filing_asof(self) -> DataFrame:
        return self._scoped(self.store.filing).where(F.col("filed_date") <= self.day)

    def filings(self, cik: int | None = None, form_type: str | None = None) -> DataFrame:
        """Filings by then."""
        df = self.filing_asof
        for name, wanted in (("cik", cik), ("form_type", form_type)):
            if wanted is not None:
                df = df.where(F.col(name) == wanted)
        return df

    @cached_property
    def universe_asof(self) -> DataFrame:
        """Filers seen by then that had not ended by then. (Names, tickers and statuses are the current ones.)"""
        seen = F.col("first_seen").isNull() | (F.col("first_seen") <= self.day)
        alive = ~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)) | F.col("status_date").isNull() | (F.col("status_date") > self.day)
        return self._scoped(self.store.filer).where(seen & alive)

    def terminated(self, since: date | None = None) -> DataFrame:
        df = self._scoped(self.store.filer).where(F.col("status").isin(*TERMINAL) & (F.col("status_date") <= self.day))
        if since is not None:
            df = df.where(F.col("status_date") >= F.lit(since))
        return df

    def fingerprint(self) -> DataFrame:
        """Visible rows of each relation: one row a relation."""
        parts = {"fact": self._facts, "price": self._prices, "filing": self.filing_asof, "filer": self.universe_asof}
        out = None
        for name, df in parts.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def first_reports(self) -> DataFrame:
        """Of each filer and fiscal year end the filing that reported it first."""
        df = self._facts.where(F.col("period_start").isNotNull())
        return df.groupBy("cik", "period_end").agg(F.min_by(F.struct("accession_no", "filed_date"), F.struct("filed_date", "accession_no")).alias("x")).select("cik", "period_end", "x.*")


@dataclass(frozen=True)
class ManyDates:
    """Base relations as they stood on each of some ``dates``, with the date in ``as_of``: a row for each date on which it
    held. Facts and prices are read once, whatever the number of dates: their versions' intervals are laid out and meet
    the dates, which are few and stand in the plan."""

    store: Store
    dates: tuple[date, ...]
    ciks: tuple[int, ...] | None = None
    key = ("as_of", "cik")

    @property
    def day(self):
        return F.col("as_of")

    @cached_property
    def _last(self) -> AsOfView:
        return AsOfView(self.store, max(self.dates), self.ciks)

    def _held(self, df: DataFrame, when: Callable[[Column], Column]) -> DataFrame:
        """A row for each date that ``when`` is true of."""
        days = F.array(*[F.lit(d) for d in sorted(set(self.dates))])
        return df.withColumn("as_of", F.explode(F.filter(days, when)))

    def _within(self, df: DataFrame) -> DataFrame:
        return self._held(df, lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to")))).drop("valid_from", "valid_to")

    @cached_property
    def fact_intervals(self) -> DataFrame:
        """Every version of a fact with the time in which it was the latest. Dealt out by filer and period end, as all that
        follows needs it."""
        facts = self._last._dealt.select(*FACT_KEY, "value", "filed_date", "accession_no", "form_type")
        return intervals(facts, BY_PERIOD, "filed_date", "accession_no")

    @cached_property
    def fact_asof(self) -> DataFrame:
        """Latest version of each fact on each date."""
        return self._within(self.fact_intervals)

    @cached_property
    def price_asof(self) -> DataFrame:
        """Latest close of each filer on each date; of several sources on a day as for one date."""
        best = F.min_by(F.struct("ticker", "close", "source"), F.struct("source", "close"))
        days = self._last._prices.groupBy("cik", "price_date").agg(best.alias("x")).select("cik", "x.ticker", "price_date", "x.close", "x.source")
        return self._within(intervals(days, ["cik"], "price_date"))

    @cached_property
    def filing_asof(self) -> DataFrame:
        return self._held(self._last.filing_asof, lambda d: d >= F.col("filed_date"))

    @cached_property
    def universe_asof(self) -> DataFrame:
        seen = lambda d: F.col("first_seen").isNull() | (F.col("first_seen") <= d)
        ended = F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)) & F.col("status_date").isNotNull()
        return self._held(self._last._scoped(self.store.filer), lambda d: seen(d) & ~F.coalesce(ended & (F.col("status_date") <= d), F.lit(False)))


def newest(df: DataFrame, by: str, n: int, *, key: tuple[str, ...] = ("cik",)) -> DataFrame:
    """The n newest rows of each key (Spark limits the rows before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.desc(by))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)
