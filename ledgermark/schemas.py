"""Schemas of the engine's base relations. Versions are bumped when a column is added; old files read with nulls."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"long": LongType, "int": IntegerType, "double": DoubleType, "string": StringType, "date": DateType, "timestamp": TimestampType, "boolean": BooleanType}


def schema(columns: str) -> StructType:
    """Schema of "name type" pairs, without a session."""
    return StructType([StructField(name, _TYPES[kind]()) for name, kind in (c.split() for c in columns.split(", "))])


SCHEMA_VERSION = 1

FILER = schema("cik long, name string, ticker string, exchange string, sic string, status string, status_date date, first_seen date, last_filing_date date")
FILING = schema("accession_no string, cik long, form_type string, filed_date date, period_end date, primary_doc_url string, fiscal_year int, fiscal_period string")
FACT = schema(
    "accession_no string, cik long, tag string, unit string, period_start date, period_end date, value double, fiscal_year int, fiscal_period string, form_type string, filed_date date"
)
PRICE = schema("cik long, ticker string, price_date date, close double, source string, fetched_at timestamp")
SECTION = schema("accession_no string, item string, text string, extraction_confidence double, char_count int, extracted_at timestamp, heading string, ended_at string")
FINDING = schema(
    "run_key string, cik long, accession_no string, item string, change_type string, quote string, implication string, severity string, "
    "prior_accession_no string, prior_quote string, pass string, prompt_version string, model string, created_at timestamp"
)

#: Key of each relation; a fact with no start is an instant (null start).
KEYS = {
    "filer": ["cik"],
    "filing": ["accession_no"],
    "fact": ["accession_no", "tag", "unit", "period_start", "period_end"],
    "price": ["cik", "price_date", "source"],
    "section": ["accession_no", "item"],
}

#: Statuses of a filer; all but the first are terminal.
STATUSES = ("active", "deregistered", "delisted_for_cause", "acquired")
TERMINAL = STATUSES[1:]
