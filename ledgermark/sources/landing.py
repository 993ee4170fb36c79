"""Readers of files as the public sources publish them: filer documents, fact documents, form indexes, price charts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermark.functions.columns import archive_url
from ledgermark.plans.figures import ANNUAL_TAGS, POINT_SHARES
from ledgermark.schemas import FACT

from . import archives

SUBMISSIONS = (
    "cik string, name string, entityName string, sic string, tickers array<string>, exchanges array<string>, filings struct<recent: struct<accessionNumber: array<string>, "
    "filingDate: array<string>, reportDate: array<string>, form: array<string>, primaryDocument: array<string>>>"
)
POINT = "struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>"
COMPANY_FACTS = f"cik long, entityName string, facts map<string, map<string, struct<units: map<string, array<{POINT}>>>>>"
CHART = (
    "chart struct<result: array<struct<meta: struct<gmtoffset: int>, timestamp: array<long>, events: struct<splits: map<string, struct<date: long, numerator: double, denominator: double>>>, "
    "indicators: struct<quote: array<struct<close: array<double>>>>>>, error: struct<code: string, description: string>>"
)
# Tags that are taken from fact documents besides those of the figures; forms of an index.
MORE_TAGS = (
    "IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "EarningsPerShareDiluted", "IncomeTaxExpenseBenefit", "ResearchAndDevelopmentExpense",
    "MarketableSecuritiesCurrent", "AccountsReceivableNetCurrent", "InventoryNet", "Goodwill", "IntangibleAssetsNetExcludingGoodwill", "OperatingLeaseLiabilityNoncurrent",
    "RetainedEarningsAccumulatedDeficit", "NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInFinancingActivities", "PaymentsOfDividends", "PaymentsForRepurchaseOfCommonStock",
)
TAGS = frozenset((*ANNUAL_TAGS, *POINT_SHARES, *MORE_TAGS))
ANNUAL_REPORTS = ("10-K", "10-KT", "10-K405", "10-KSB")
TERMINAL_FORMS = {"15-12B": "deregistered", "15-12G": "deregistered", "15F-12B": "deregistered", "15F-12G": "deregistered", "25": None, "25-NSE": None}


def filled(c: str | Column) -> Column:
    """A text, or null if it is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON document below ``path``."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def submissions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filers and filings of submission documents. Filings come as parallel arrays; short ones are continued by null."""
    docs = docs.withColumn("cik", F.col("cik").cast("long"))
    rows = docs.select("cik", F.inline(F.arrays_zip(*[F.col(f"filings.recent.{c}").alias(c) for c in ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")])))
    filings = rows.where("accessionNumber IS NOT NULL").select(
        F.col("accessionNumber").alias("accession_no"), "cik", F.col("form").alias("form_type"), filled("filingDate").cast("date").alias("filed_date"), filled("reportDate").cast("date").alias("period_end"),
        archive_url("cik", "accessionNumber", filled("primaryDocument")).alias("primary_doc_url"), F.lit(None).cast("int").alias("fiscal_year"), F.lit(None).cast("string").alias("fiscal_period"),
    )
    dates = filings.groupBy("cik").agg(F.min("filed_date").alias("first_seen"), F.max("filed_date").alias("last_filing_date"))
    filers = docs.select(
        "cik", F.coalesce(filled("name"), filled("entityName"), F.lit("")).alias("name"), F.get("tickers", F.lit(0)).alias("ticker"), F.get("exchanges", F.lit(0)).alias("exchange"), filled("sic").alias("sic")
    )
    return filers.join(dates, "cik", "left"), filings


def company_facts(docs: DataFrame, tags: Iterable[str] = TAGS, expected_cik: Column | None = None) -> DataFrame:
    """Facts of fact documents: listed tags, points with a filing day and accession. A document that names another
    filer than the expected one, or none where none is expected, stops the job."""
    cik = F.col("cik")
    if expected_cik is not None:
        wrong = cik.isNotNull() & (cik != expected_cik)
        cik = F.when(wrong, F.raise_error(F.concat(F.lit("facts describe another filer: "), F.col("cik").cast("string")))).otherwise(F.coalesce(expected_cik, cik))
    else:
        cik = F.when(cik.isNull(), F.raise_error(F.lit("facts name no filer"))).otherwise(cik)
    tag = docs.select(cik.cast("long").alias("cik"), F.explode("facts").alias("taxonomy", "t")).select("cik", F.explode("t").alias("tag", "body"))
    unit = tag.where(F.col("tag").isin(sorted(tags))).select("cik", "tag", F.explode("body.units").alias("unit", "points"))
    p = unit.select("cik", "tag", "unit", F.inline("points")).where("filed IS NOT NULL AND accn IS NOT NULL")
    return p.select(
        F.col("accn").alias("accession_no"), "cik", "tag", "unit", filled("start").cast("date").alias("period_start"), F.col("end").cast("date").alias("period_end"), F.col("val").alias("value"),
        F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), F.col("form").alias("form_type"), F.col("filed").cast("date").alias("filed_date"),
    ).select(*FACT.fieldNames())


def bulk_version(entries: DataFrame) -> DataFrame:
    """Newest time stamp of bulk archives' entries (null without any)."""
    return entries.agg(F.max("modified").alias("version"))


def bulk_company_facts(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fact documents of the ``wanted`` filers (cik) that bulk archives hold (rows of ``archives.entries``), with the filer of the
    member's name in ``wanted``; only these members are inflated, by the executors."""
    cik = F.regexp_extract("name", "CIK([0-9]+)[.]json$", 1).try_cast("long")
    named = entries.withColumn("wanted", cik).join(wanted.select(F.col("cik").alias("wanted")).distinct(), "wanted", "left_semi")
    docs = archives.members(named)
    doc = F.from_json("content", COMPANY_FACTS, {"mode": "FAILFAST"})
    return docs.select(cik.alias("wanted"), doc.alias("doc")).select("wanted", "doc.*")


def index_rows(lines: DataFrame) -> DataFrame:
    """Rows (form, company_name, cik, filed_date, path) of index lines (``value``); what is no row is skipped, and so
    are forms with a blank in them."""
    cells = F.split(F.rtrim(F.col("value")), " {2,}")  # columns are parted by two blanks or more; a name may hold some itself
    n = F.size("cells")
    rows = lines.withColumn("cells", cells).where((F.size("cells") >= 5) & ~F.contains(F.get("cells", F.lit(0)), F.lit(" ")) & (F.get("cells", F.lit(0)) != ""))
    cik, day, path = (F.get("cells", n - k) for k in (3, 2, 1))
    rows = rows.select(
        F.upper(F.get("cells", F.lit(0))).alias("form"), filled(F.trim(F.array_join(F.slice("cells", F.lit(2), n - 4), "  "))).alias("company_name"), F.when((F.length(cik) <= 10) & ~F.contains(cik, F.lit("-")), cik.try_cast("long")).alias("cik"),
        F.when(F.length(day) == 10, day.try_cast("date")).alias("filed_date"), path.alias("path"), *[c for c in lines.columns if c != "value"],
    )
    return rows.where("cik IS NOT NULL AND filed_date IS NOT NULL")


def index_url(year: int, quarter: int) -> str:
    if quarter not in (1, 2, 3, 4):
        raise ValueError(f"quarter must be 1 to 4, not {quarter}")
    return f"edgar/full-index/{year}/QTR{quarter}/form.idx"


def read_quarters(spark: SparkSession, root: str, from_year: int, to_year: int, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Index rows of all quarters below ``root`` with year and quarter, read in one go, and of each quarter its number of
    rows, null for a quarter that has no file. (The quarter is taken from the file's path.) A quarter's index is one file or
    several parts; ``parts`` (path) names those that count, where attempts may have left others."""
    every = spark.createDataFrame([(y, q) for y in range(from_year, to_year + 1) for q in (1, 2, 3, 4)], "year int, quarter int")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/edgar/full-index/*/QTR*/form*.idx")) or []
    path = F.col("_metadata.file_path")
    part = lambda name: F.regexp_extract(path, "/full-index/([0-9]{4})/QTR([1-4])/form[^/]*[.]idx$", name).cast("int")
    if not len(there):
        lines = spark.createDataFrame([], "value string, year int, quarter int, file string")
    else:
        lines = spark.read.text([f.getPath().toString() for f in there]).select("value", part(1).alias("year"), part(2).alias("quarter"), F.regexp_extract(path, "(edgar/full-index/.*)$", 1).alias("file"))
    if parts is not None:
        lines = lines.join(F.broadcast(parts.select(F.col("path").alias("file"))), "file", "left_semi")  # a path for each file
    rows = index_rows(lines.drop("file")).where(F.col("year").between(from_year, to_year))
    return rows, every.join(rows.groupBy("year", "quarter").agg(F.count("*").alias("rows")), ["year", "quarter"], "left")


def write_quarters(lines: DataFrame, root: str) -> DataFrame:
    """Lay down index lines (year, quarter, value) as a landing folder has them; year, quarter and path of every part.

    A quarter's folder has a part for each task that holds some of its lines: tasks get ranges of the lines in order and
    write them as they come, so no task holds a quarter, and a quarter's parts in order of their names are its index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        part = f"form-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.idx"
        open_, out, made = None, None, []
        for batch in batches:
            for year, quarter, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (year, quarter) != open_:
                    if out:
                        out.close()
                    open_ = year, quarter
                    name = index_url(year, quarter).replace("form.idx", part)
                    store.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                    made.append((year, quarter, name))
                out.write(f"{value}\n".encode())
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)], ["year", "quarter", "path"])

    dealt = lines.select("year", "quarter", "value").repartitionByRange("year", "quarter", "value").sortWithinPartitions("year", "quarter", "value")
    return dealt.mapInArrow(run, "year int, quarter int, path string")


def annual_filers(rows: DataFrame) -> DataFrame:
    """Filers with an annual report, each at its earliest; ties go to the form and path that sort first."""
    one = F.min_by(F.struct("form", "company_name", "filed_date"), F.struct("filed_date", "form", "path"))
    return rows.where(F.col("form").isin(*ANNUAL_REPORTS)).groupBy("cik").agg(one.alias("x")).select("cik", "x.*")


def terminal_filings(rows: DataFrame) -> DataFrame:
    """Filings that end a registration, with the status they support (null: none)."""
    status = F.create_map(*[x for k, v in TERMINAL_FORMS.items() if v for x in (F.lit(k), F.lit(v))])
    return rows.where(F.col("form").isin(*TERMINAL_FORMS)).withColumn("status", status[F.col("form")])


def unheld(rows: DataFrame, filer: DataFrame) -> DataFrame:
    """Rows of filers that the store does not hold."""
    return rows.join(filer.select("cik"), "cik", "left_anti")


def chart_closes(docs: DataFrame) -> DataFrame:
    """Closes as traded of chart documents (with their other columns): split adjustment is undone by the ratios of
    all later splits, days are the exchange's, prices are rounded to four digits. An error in a document stops the job;
    a document that says there is no data has no rows."""
    error = F.coalesce("chart.error.description", "chart.error.code")
    none = F.coalesce(F.lower(error).contains("no data found"), F.lit(False))
    rest = [c for c in docs.columns if c != "chart"]
    ok = docs.where(~none).withColumn("chart", F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.col("chart")))
    r = ok.select(*rest, F.get("chart.result", F.lit(0)).alias("r")).where("r IS NOT NULL").withColumn("__doc", F.monotonically_increasing_id())
    splits = r.select("__doc", F.explode(F.map_values("r.events.splits")).alias("s")).select("__doc", F.col("s.date").alias("at"), (F.col("s.numerator") / F.col("s.denominator")).alias("ratio"))
    points = r.select(*rest, "__doc", F.coalesce("r.meta.gmtoffset", F.lit(0)).alias("offset"), F.inline(F.arrays_zip(F.col("r.timestamp").alias("stamp"), F.get("r.indicators.quote", F.lit(0))["close"].alias("close"))))
    rows = as_traded(points.where("close IS NOT NULL AND stamp IS NOT NULL"), splits, "__doc")
    return rows.select(*rest, F.to_date(F.timestamp_seconds(F.col("stamp") + F.col("offset"))).alias("price_date"), "close")


def as_traded(closes: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Adjusted ``closes`` (key, stamp, close, ...) with the adjustment for later ``splits`` (key, at, ratio) undone, rounded to four
    digits. Closes and splits of a key meet in one order of time, in which the product of the ratios runs back from
    the last; a split at the very time of a close is part of it. Splits without a time or ratio say nothing."""
    rest = [c for c in closes.columns if c not in (key, "stamp", "close")]
    kind = lambda c: closes.schema[c].dataType
    said = splits.where("at IS NOT NULL AND ratio IS NOT NULL").select(
        F.col(key), F.col("at").cast("long").alias("stamp"), F.lit(None).cast("double").alias("close"), F.col("ratio").cast("double").alias("__ratio"), *[F.lit(None).cast(kind(c)).alias(c) for c in rest]
    )
    own = closes.select(F.col(key), F.col("stamp").cast("long").alias("stamp"), F.col("close").cast("double").alias("close"), F.lit(None).cast("double").alias("__ratio"), *rest)
    later = Window.partitionBy(key).orderBy(F.col("stamp").desc()).rangeBetween(Window.unboundedPreceding, -1)
    both = own.withColumn("__close", F.lit(True)).unionByName(said.withColumn("__close", F.lit(False)))
    factor = F.coalesce(F.product("__ratio").over(later), F.lit(1.0))
    return both.withColumn("close", F.bround(F.col("close") * factor, 4)).where("__close").select(*closes.columns)


def latest_of(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
