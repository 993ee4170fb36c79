"""Candidates: filers that screens flag, with their history, sources and the run's summary."""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.functions.columns import fiscal_length
from ledgermark.tables import materialise

from .asof import AsOfView, ManyDates
from .figures import ANNUAL_TAGS, Figures
from .screens import QUALITY_YEARS, Screens

LIMIT = 30
YEARS = 3


def grouped_flags(screens: Screens) -> DataFrame:
    """A row for each flagged filer (and date)."""
    key = screens.key
    flag = F.struct("ord", "screen", "rank", "reason", "metrics")
    rows = screens.flags().select(*key, flag.alias("f"), "rank")
    # maps cannot be sorted: order by position, then look the flags up
    got = rows.groupBy(*key).agg(F.collect_list("f").alias("fs"), F.count("*").alias("n_flags"), F.min("rank").alias("best_rank"))
    order = F.array_sort(F.transform("fs", lambda x: x["ord"]))
    flags = F.transform(order, lambda o: F.element_at(F.filter("fs", lambda x: x["ord"] == o), 1))
    return got.select(*key, "n_flags", "best_rank", flags.alias("flagged_by"), F.array_join(F.transform(flags, lambda x: x["screen"]), ",").alias("screens"), F.array_join(F.transform(flags, lambda x: x["reason"]), "; ").alias("flag_reason"))


def by_merit(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("n_flags"), F.col("best_rank").asc_nulls_last(), "cik")


def earlier(day: date, months: int) -> date:
    """The day so many months before, or the last of its month."""
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def snapshots(view: AsOfView, months: tuple[int, ...]) -> DataFrame:
    """State of every filer of the universe so many months before: as_of, months, flagged by which screens, and why it was
    excluded. All dates come from one scan of the facts."""
    past = ManyDates(view.store, tuple(earlier(view.as_of, m) for m in months), view.ciks)
    figures = Figures(past).keep()
    return history(figures, grouped_flags(Screens(figures)), view.as_of, months)


def history(figures: Figures, flags: DataFrame, day: date, months: tuple[int, ...]) -> DataFrame:
    """Of figures of several dates and their grouped flags the state at those that lie so many months before ``day``."""
    when = F.inline(F.array(*[F.struct(F.lit(earlier(day, m)).alias("as_of"), F.lit(m).alias("months")) for m in months]))
    rows = figures.universe_screened.select("as_of", "cik", "excluded_because").join(flags.select("as_of", "cik", "screens"), ["as_of", "cik"], "left")
    dates = F.broadcast(figures.view.store.filer.sparkSession.range(1).select(when))  # a row for each of the months
    return rows.join(dates, "as_of").select("cik", "as_of", "months", F.col("screens").isNotNull().alias("was_flagged"), F.coalesce("screens", F.lit("")).alias("screens"), "excluded_because")


def trend(history: str | Column) -> Column:
    """What earlier snapshots (nearest first) say: flagged in all, in none, in the oldest, or only since; null without any."""
    h = F.col(history) if isinstance(history, str) else history
    hit = lambda x: x["was_flagged"]
    word = F.when(F.forall(h, hit), "persistent").when(~F.exists(h, hit), "new").when(F.element_at(h, -1)["was_flagged"], "returning").otherwise("recent")
    return F.when(F.size(h) > 0, word)


def source_facts(figures: Figures, wanted: DataFrame, view: AsOfView | None = None) -> DataFrame:
    """The facts behind the figures of ``wanted`` (cik, years): of each filer's newest years, with their filings. ``view`` is
    the figures' own or one of the wanted filers alone. The few year ends meet the facts where these lie; facts are no side
    to broadcast, however small they are thought to be."""
    w = Window.partitionBy("cik").orderBy(F.desc("fy_end"))
    ends = figures.annual.select("cik", "fy_end").join(wanted, "cik").withColumn("rn", F.row_number().over(w)).where("rn <= years")
    f = (view or figures.view).fact_asof.where(F.col("tag").isin(list(ANNUAL_TAGS)) & (F.col("period_start").isNull() | fiscal_length("period_start", "period_end")))
    return f.join(ends.select("cik", F.col("fy_end").alias("period_end")).hint("shuffle_hash"), ["cik", "period_end"])


def candidates(view: AsOfView, limit: int = LIMIT, compare_months: tuple[int, ...] = ()) -> DataFrame:
    """The ``limit`` best flagged filers with price, shares, source facts, and their state at earlier dates, for which the
    facts are not read again."""
    compare_months = tuple(sorted(compare_months))
    every = Figures(ManyDates(view.store, (view.as_of, *[earlier(view.as_of, m) for m in compare_months]), view.ciks)).keep()
    flags = materialise(grouped_flags(Screens(every)), "flags")
    figures = every.on(view)
    best = materialise(by_merit(flags.where(F.col("as_of") == view.day).drop("as_of")).limit(limit), "best")
    u = figures.universe_screened.select(
        "cik", "ticker", "name", "market_cap", F.col("latest_fy_end").alias("fiscal_year_end"),
        F.struct(F.col("shares").alias("value"), F.col("shares_tag").alias("tag"), F.col("shares_date").alias("period_end"), F.col("shares_filed").alias("filed_date"), F.col("shares_accession").alias("accession_no")).alias("shares"),
    )
    price = view.price_asof.select("cik", F.struct("close", "price_date", "source").alias("price"))
    out = best.join(u, "cik").join(price, "cik", "left")
    years = best.select("cik", F.when(F.array_contains(F.split("screens", ","), "quality_at_price"), QUALITY_YEARS).otherwise(YEARS).alias("years"))
    # the few filers are known now, and their facts are read alone: the scan sees the filter
    ciks = tuple(r["cik"] for r in best.select("cik").collect())  # at most ``limit``
    facts = source_facts(figures, years, AsOfView(view.store, view.as_of, ciks))
    item = F.struct(F.negative(F.datediff("period_end", F.lit("1900-01-01").cast("date"))).alias("o"), "tag", "unit", "period_start", "period_end", "value", "filed_date", "accession_no")
    facts = facts.groupBy("cik").agg(F.array_sort(F.collect_list(item)).alias("inputs"))
    out = out.join(facts, "cik", "left").withColumn("inputs", F.transform("inputs", lambda x: x.dropFields("o")))
    if compare_months:
        past = history(every, flags, view.as_of, compare_months).join(F.broadcast(best.select("cik")), "cik")  # at most ``limit``
        past = past.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("months", "as_of", "was_flagged", "screens", "excluded_because"))).alias("history"))
        out = out.join(past, "cik", "left").withColumn("history", F.coalesce("history", F.array().cast("array<struct<months:int,as_of:date,was_flagged:boolean,screens:string,excluded_because:string>>")))
        out = out.withColumn("trend", trend("history"))
    return by_merit(out)


def summary(view: AsOfView) -> DataFrame:
    """Filers by reason of exclusion (null: eligible)."""
    return Figures(view).universe_screened.groupBy("excluded_because").agg(F.count("*").alias("filers"))

