"""Merges into the store's relations. Each returns the rows to write; ``write`` puts them down.

A relation is a folder of Parquet. Facts and prices are only appended (first version of a key wins); filers and filings are
merged and rewritten; candidates, findings, valuations, re-checks and sections are replaced by partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.schemas import KEYS


def same(keys: list[str], a: str = "n", b: str = "h") -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def new_rows(incoming: DataFrame, held: DataFrame, relation: str) -> DataFrame:
    """Rows whose key the store does not hold, each key once: of equal keys the row that sorts first (null starts count as equal).
    Both sides are shuffled: what is held is never sent whole to the driver, however small it is thought to be."""
    keys = KEYS[relation]
    once = first_of(incoming, keys)
    return once.alias("n").join(held.select(*keys).hint("merge").alias("h"), same(keys), "left_anti")


def first_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row that sorts first by its other columns."""
    rest = [c for c in rows.columns if c not in keys]
    body = F.struct(*rest)
    return rows.groupBy(*keys).agg(F.min(body).alias("__x")).select(*[F.col(c) if c in keys else F.col(f"__x.{c}").alias(c) for c in rows.columns])


def replaced(held: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A relation after a result was stored again: rows of a key that comes in are superseded, all others stay."""
    gone = incoming.select(*keys).distinct()
    stay = held.alias("n").join(gone.alias("h"), same(keys), "left_anti")
    return stay.unionByName(incoming, allowMissingColumns=True)


def merged_filers(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Filers after an ingest: names and tickers are the new ones, the first day is the earlier, the last the later,
    and a status is never undone."""
    n, h = incoming.alias("n"), held.alias("h")
    rows = h.join(n, F.col("h.cik") == F.col("n.cik"), "full")
    newer = [F.coalesce(f"n.{c}", f"h.{c}").alias(c) for c in ("cik", "name", "ticker", "exchange", "sic")]
    return rows.select(
        *newer, F.coalesce("h.status", F.lit("active")).alias("status"), F.col("h.status_date"), F.least("h.first_seen", "n.first_seen").alias("first_seen"),
        F.greatest("h.last_filing_date", "n.last_filing_date").alias("last_filing_date"),
    )


def merged_filings(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Filings after an ingest: what the store lacks is filled from the incoming rows."""
    rows = held.alias("h").join(first_of(incoming, ["accession_no"]).alias("n"), "accession_no", "full")
    return rows.select("accession_no", *[F.coalesce(f"n.{c}", f"h.{c}").alias(c) for c in held.columns if c != "accession_no"])


def stub_filings(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Filings that facts name and no list has: by each accession's earliest fact. (Known filings are not sent to the driver.)"""
    lost = facts.join(known.select("accession_no").hint("merge"), "accession_no", "left_anti")
    one = F.min_by(F.struct("cik", F.coalesce("form_type", F.lit("UNKNOWN")).alias("form_type"), "filed_date", "fiscal_year", "fiscal_period"), F.struct("filed_date", "tag", "period_end"))
    return lost.groupBy("accession_no").agg(one.alias("x")).select(
        "accession_no", "x.cik", "x.form_type", "x.filed_date", F.lit(None).cast("date").alias("period_end"), F.lit(None).cast("string").alias("primary_doc_url"), "x.fiscal_year", "x.fiscal_period"
    )


def ingest(held_filer: DataFrame, held_filing: DataFrame, held_fact: DataFrame, filers: DataFrame, filings: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filers, filings and facts to write for one ingest: listed filings and stubs for the rest, a filer's first day
    over both, and facts that are new."""
    stubs = stub_filings(facts, filings.select("accession_no").union(held_filing.select("accession_no")))
    all_filings = filings.unionByName(stubs, allowMissingColumns=True)
    first = all_filings.groupBy("cik").agg(F.min("filed_date").alias("first_seen"), F.max("filed_date").alias("last_filing_date"))
    seen = filers.drop("first_seen", "last_filing_date").join(first, "cik", "left")
    return merged_filers(held_filer, seen), merged_filings(held_filing, all_filings), new_rows(facts, held_fact, "fact")


def ingest_facts(held_filer: DataFrame, held_filing: DataFrame, held_fact: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filers, filings and facts after facts alone came in: stubs for filings that no list has, a filer's first day no
    later than its earliest fact, and facts that are new. Facts of a filer that the store does not hold stop the job."""
    known = held_filer.select(F.col("cik").alias("__known")).distinct()
    checked = facts.join(known, F.col("cik") == F.col("__known"), "left")
    lost = F.raise_error(F.concat(F.lit("facts of a filer that is not held: "), F.coalesce(F.col("cik").cast("string"), F.lit("none"))))
    facts = checked.withColumn("cik", F.when(F.col("__known").isNull(), lost.cast("long")).otherwise(F.col("cik"))).drop("__known")
    stubs = stub_filings(facts, held_filing)
    first = facts.groupBy("cik").agg(F.min("filed_date").alias("__first"))
    filers = held_filer.join(first, "cik", "left").withColumn("first_seen", F.least("first_seen", "__first")).drop("__first").select(*held_filer.columns)
    return filers, merged_filings(held_filing, stubs), new_rows(facts, held_fact, "fact")


def mark_terminal(filer: DataFrame, filing: DataFrame, records: DataFrame) -> DataFrame:
    """Filers after terminal filings (cik, filed_date, status): the earliest that no later annual or quarterly report
    contradicts marks an active filer, or moves the day of one with that status back."""
    reports = filing.where(F.col("form_type").isin("10-K", "10-K/A", "20-F", "10-Q")).groupBy("cik").agg(F.max("filed_date").alias("last_report"))
    good = records.where("status IS NOT NULL").join(reports, "cik", "left").where("last_report IS NULL OR last_report <= filed_date")
    first = good.groupBy("cik").agg(F.min_by("status", F.struct("filed_date", "status")).alias("new_status"), F.min("filed_date").alias("new_date"))
    rows = filer.join(first, "cik", "left")
    may = F.col("new_status").isNotNull() & ((F.col("status") == "active") | (F.col("status") == F.col("new_status")))
    moved = F.when(F.col("status") == "active", F.col("new_date")).otherwise(F.least("status_date", "new_date"))
    return rows.withColumn("status_date", F.when(may, moved).otherwise(F.col("status_date"))).withColumn("status", F.when(may, F.col("new_status")).otherwise(F.col("status"))).drop("new_status", "new_date")


def next_version(theses: DataFrame) -> DataFrame:
    """Next version number of each thesis (cik, as_of)."""
    return theses.groupBy("cik", "as_of").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def append_versions(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Theses to append: each incoming one (cik, as_of, written_at, ...) gets the version after all that its filer and day have."""
    now = next_version(held)
    order = Window.partitionBy("cik", "as_of").orderBy("written_at")
    rows = incoming.drop("version").withColumn("__n", F.row_number().over(order) - 1).join(now, ["cik", "as_of"], "left")
    return rows.withColumn("version", F.coalesce("next_version", F.lit(1)) + F.col("__n")).drop("__n", "next_version")


def to_payload(df: DataFrame, *keys: str) -> DataFrame:
    """Rows as stored results: their keys, and all of their columns as one JSON payload."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("payload"))


def from_payload(df: DataFrame, schema: str) -> DataFrame:
    """Rows of stored payloads; a payload that is no JSON of this shape gives nulls."""
    rest = [c for c in df.columns if c != "payload"]
    return df.withColumn("__p", F.from_json("payload", schema)).select(*rest, "__p.*")


def write(df: DataFrame, path: str, how: str = "append", by: list[str] | None = None) -> None:
    """Append rows, or replace the partitions (``by``) that they lie in."""
    w = df.write.mode("append" if how == "append" else "overwrite")
    if how == "replace":
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)

