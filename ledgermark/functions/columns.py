"""Column expressions shared by the plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A duration of so many days is a fiscal year (52- and 53-week years included).
FISCAL_DAYS = (350, 380)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """Quotient that is null for a zero or missing divisor."""
    return F.try_divide(col(a), col(b))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def sum_or_null(*cols: str | Column) -> Column:
    """Sum that takes missing parts as nothing, and is missing only if all parts are."""
    parts = [col(c) for c in cols]
    return F.when(F.coalesce(*parts).isNotNull(), reduce(Column.__add__, [or_zero(p) for p in parts]))


def months_back(day: Column, months: int) -> Column:
    """The same day number so many months earlier; days past a month's end run over into the next."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), -months), F.dayofmonth(day) - 1)


def months_before(day: Column, months: int) -> Column:
    """The same day number so many months earlier, or that month's last day."""
    return F.add_months(day, -months)


def fiscal_length(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start)).between(*FISCAL_DAYS)


def leading_int(c: str | Column) -> Column:
    """Integer that a text begins with; 0 if it begins with none."""
    return F.coalesce(F.regexp_extract(col(c), r"^\s*(\d+)", 1).try_cast("int"), F.when(col(c).isNotNull(), 0))


#: What a ticker's suffix says, tried in this order.
SUFFIXES = (("P[A-Z]?|PR[A-Z]?", "preferred"), ("W|WS|WT", "warrant"), ("WI", "when_issued"), ("U", "unit"), ("R|RT", "right"), ("[A-Z]", "common"))


def ticker_class(ticker: str | Column) -> Column:
    """Kind of security that a ticker names; null for no ticker."""
    t = F.upper(F.trim(col(ticker)))
    parts = F.split(t, "[-.]")
    kind = F.when(F.size(parts) == 1, "common").when((F.size(parts) > 2) | (F.get(parts, F.lit(0)) == ""), "unknown")
    for pattern, name in SUFFIXES:
        kind = kind.when(F.get(parts, F.lit(1)).rlike(f"^(?:{pattern})$"), name)
    return F.when(t.isNotNull() & (t != ""), kind.otherwise("unknown"))


def is_common_stock(ticker: str | Column) -> Column:
    return F.coalesce(ticker_class(ticker) == "common", F.lit(False))


def price_symbol(ticker: str | Column) -> Column:
    return F.replace(F.upper(F.trim(col(ticker))), F.lit("."), F.lit("-"))


def padded_cik(cik: str | Column) -> Column:
    return F.lpad(col(cik).cast("string"), 10, "0")


def archive_url(cik: str | Column, accession: str | Column, document: str | Column) -> Column:
    """Path of a filing's main document below the archive's root; null without a document."""
    return F.when(col(document).isNotNull(), F.concat(F.lit("edgar/data/"), col(cik).cast("string"), F.lit("/"), F.replace(col(accession), F.lit("-")), F.lit("/"), col(document)))


def percent(c: str | Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100)


def money_millions(c: str | Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.abs(col(c)) / 1e6, 1), F.lit("M"))
