"""Command line: ``python -m ledgermark VERB STORE --as-of DAY``. Prints a JSON line for each row, or writes Parquet.

``ingest`` merges a landing folder (submissions/*.json, companyfacts/*.json, bulk/*.zip) into the catalog, ``extract`` gives the
sections of filings' pages (Parquet of accession_no, form_type, html), ``value`` the valuations of eligible filers, ``recheck``
the stated conditions (Parquet or JSON of cik, metric, direction, threshold, window) as they stand on a day.
Exit code 0: done; 1: it could not be done, or nothing was found by ``value``; 2: wrong usage, or ``recheck`` found a breach.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.operators import documents
from ledgermark.plans import candidates, recheck, valuation
from ledgermark.plans.asof import AsOfView
from ledgermark.plans.figures import Figures
from ledgermark.plans.screens import SCREENS, Screens
from ledgermark.sources import archives, landing, store


def _screen(view: AsOfView, args: argparse.Namespace) -> DataFrame:
    return Screens(Figures(view).keep()).rows(args.screen)


def _coverage(view: AsOfView, args: argparse.Namespace) -> DataFrame:
    return Screens(Figures(view).keep()).coverage(args.screen)


def _value(view: AsOfView, args: argparse.Namespace) -> DataFrame:
    rows = valuation.inputs(Figures(view))
    for case, growth in zip(valuation.CASES, args.growth, strict=True):
        rows = rows.withColumn(f"growth_{case}", F.lit(growth)).withColumn(f"margin_{case}", F.col("owner_earnings_margin"))
    return valuation.value(rows)


def _recheck(view: AsOfView, args: argparse.Namespace) -> DataFrame:
    spark = view.store.filer.sparkSession
    stated = spark.read.schema(CONDITIONS).json(args.input) if args.input.endswith(("json", "jsonl")) else spark.read.parquet(args.input)
    if view.ciks:
        stated = stated.where(F.col("cik").isin(list(view.ciks)))
    return recheck.roll_up(recheck.evaluate(stated, recheck.metric_series(Figures(view).annual)), "cik")


def _extract(view: AsOfView, args: argparse.Namespace) -> DataFrame:
    """Sections of the filings that were known on the day."""
    pages = view.store.filer.sparkSession.read.parquet(args.input)
    return documents.sections(pages.join(view.filings().select("accession_no"), "accession_no", "left_semi"))


def _ingest(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Facts come from bulk archives, for filers that have a submission document, and from documents of their own."""
    listed = landing.read_documents(spark, f"{args.input}/submissions", landing.SUBMISSIONS)
    filers, filings = landing.submissions(listed)
    facts = []
    if archives.listed(spark, f"{args.input}/companyfacts"):
        facts.append(landing.company_facts(landing.read_documents(spark, f"{args.input}/companyfacts", landing.COMPANY_FACTS)))
    if bulk := archives.listed(spark, f"{args.input}/bulk/*.zip"):
        facts.append(landing.company_facts(landing.bulk_company_facts(archives.entries(spark, bulk), filers), expected_cik=F.col("wanted")))
    if not facts:
        raise ValueError(f"{args.input} holds neither companyfacts nor bulk archives")
    counts = store.ingest(spark, args.store, filers, filings, reduce(DataFrame.unionByName, facts))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))


CONDITIONS = "cik long, metric string, direction string, threshold double, window string"
VERBS: dict[str, Callable[[AsOfView, argparse.Namespace], DataFrame]] = {
    "universe": lambda view, args: Figures(view).universe_screened,
    "figures": lambda view, args: Figures(view).annual,
    "facts": lambda view, args: view.in_order(view.facts()),
    "filings": lambda view, args: view.filings(),
    "counts": lambda view, args: view.fingerprint(),
    "excluded": lambda view, args: candidates.summary(view),
    "metrics": lambda view, args: recheck.metric_series(Figures(view).annual),
    "screen": _screen,
    "coverage": _coverage,
    "value": _value,
    "recheck": _recheck,
    "extract": _extract,
    "candidates": lambda view, args: candidates.candidates(view, args.limit, tuple(args.compare)),
}


def parse(argv: Sequence[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="ledgermark", description=__doc__)
    p.add_argument("verb", choices=sorted((*VERBS, "ingest")))
    p.add_argument("store", help="folder of the stored catalog")
    p.add_argument("--as-of", type=date.fromisoformat, default=date.today())
    p.add_argument("--input", help="what ingest, extract and recheck read")
    p.add_argument("--growth", type=float, nargs=3, default=(0.0, 0.04, 0.08), metavar=("BEAR", "BASE", "BULL"), help="revenue growth in the three cases of value")
    p.add_argument("--cik", type=int, action="append", help="only these filers; the scan sees the filter")
    p.add_argument("--screen", choices=SCREENS, default=SCREENS[0])
    p.add_argument("--limit", type=int, default=candidates.LIMIT)
    p.add_argument("--compare", type=int, nargs="*", default=[], help="months before, for the trend")
    p.add_argument("--out", help="write Parquet there instead of printing")
    args = p.parse_args(argv)
    if args.verb in ("ingest", "extract", "recheck") and not args.input:
        p.error(f"{args.verb} needs --input")
    return args


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("ledgermark").getOrCreate()
    try:
        if args.verb == "ingest":
            rows = _ingest(spark, args)
        else:
            view = AsOfView(store.open_store(spark, args.store), args.as_of, tuple(args.cik) if args.cik else None)
            rows = VERBS[args.verb](view, args)
        if args.out:
            rows.write.parquet(args.out)
            return 0
        n = breached = 0
        for line in rows.toJSON().toLocalIterator():  # one partition at a time
            print(line)
            n += 1
            breached += '"status":"breached"' in line
    except (ValueError, PySparkException) as e:
        print(f"{args.verb}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 2 if args.verb == "recheck" and breached else 1 if args.verb == "value" and not n else 0


if __name__ == "__main__":
    sys.exit(main())
