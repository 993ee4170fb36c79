"""Document operators: filing text, sections, notes, and quotes checked against their sources."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgermark.functions import text as tx
from ledgermark.tables import materialise

from . import lines, quotes

USABLE = 0.6

# What a finding may be called.
CHANGES = ("added", "removed", "reordered", "softened", "strengthened")
FOOTNOTE_FLAGS = ("policy_change", "estimate_change", "capitalisation_change", "related_party", "off_balance_sheet", "pension_assumption", "segment_change")
INCENTIVE_FLAGS = ("metric_mix", "metric_change", "target_change", "adjustment", "discretion", "vesting_change", "related_person", "ownership")
SEVERITIES = ("high", "medium", "low")


@F.pandas_udf(StringType())
def _filing_text(s: pd.Series) -> pd.Series:
    return s.map(tx.filing_text, na_action=None)


def filing_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text``, the lines of each page's text (null: empty)."""
    quotes.batched(df)
    return df.withColumn("text", _filing_text(F.col(html).cast("string")))


def sections(filings: DataFrame, html: str = "html", form: str = "form_type") -> DataFrame:
    """A row for each section of each filing; proxy statements by name, all others by item number. Markup is read by Python in
    Arrow batches, all else by expressions on the lines."""
    rest = [c for c in filings.columns if c != html]
    proxy = F.coalesce(F.startswith(F.upper(form), F.lit("DEF 14A")), F.lit(False))
    rows = filing_text(filings, html).select(*rest, proxy.alias("__proxy"), lines.lines("text").alias("__lines"))
    found = F.when(F.col("__proxy"), lines.proxy_sections(F.col("__lines"))).otherwise(lines.item_sections(F.col("__lines")))
    rows = rows.select(*rest, found.alias("__sections")).select(*rest, F.explode_outer("__sections").alias("__s")).where("__s IS NOT NULL").select(*rest, "__s.*")
    return rows.withColumnRenamed("confidence", "extraction_confidence").withColumn("char_count", F.length("text"))


def notes(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each numbered note of each row's text."""
    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, lines.lines(text).alias("__lines"))
    return rows.select(*rest, F.explode_outer(lines.split_notes(F.col("__lines"))).alias("__n")).select(*rest, "__n.*")


def note_index(text: str) -> Column:
    """Number, heading and length of each note of a text."""
    return F.transform(lines.given(lines.lines(text), lines.split_notes), lambda x: x.dropFields("text"))


def spoken(text: str | Column) -> Column:
    """Words of a text in lower case, and its other signs, each by itself: what only white space parts is next to each other."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    apart = F.regexp_replace(c, r"(?U)([^\w\s])", " $1 ")
    return F.filter(F.split(apart, r"(?U)\s+"), lambda w: w != "")


def _phrase(words: Column, at: Column, phrase: tuple[tuple[str, ...], ...], goes_on: bool = False) -> Column:
    """Whether a phrase stands at a place: at each next place one of the words that may stand there."""
    *first, last = [F.get(words, at + j) for j in range(len(phrase))]
    fits = [w.isin(*may) for w, may in zip(first, phrase[:-1], strict=True)]
    ends = reduce(Column.__or__, [last.startswith(w) for w in phrase[-1]]) if goes_on else last.isin(*phrase[-1])
    return F.coalesce(reduce(Column.__and__, [*fits, ends]), F.lit(False))


def advises(text: str | Column, imperative: bool = True) -> Column:
    """Whether a text says what to do with the shares: in a phrase anywhere, or (``imperative``) by the word it begins with."""
    return F.coalesce(lines.given(spoken(text), lambda words: _advised(words, imperative)), F.lit(False))


def _advised(words: Column, imperative: bool) -> Column:
    begins = sorted({w for p in (*tx.ADVICE, *tx.URGING) for w in p[0]})
    anywhere = lambda i: reduce(Column.__or__, [_phrase(words, i, p) for p in tx.ADVICE] + [_phrase(words, i, p, True) for p in tx.URGING])
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*begins), i)), lambda i: i.isNotNull())
    hit = F.exists(places, anywhere)
    if imperative:
        first = F.array_position(F.transform(words, lambda w: w.rlike(r"(?U)^\w")), True).cast("int") - 1
        hit = hit | lines.given(first, lambda at: (at >= 0) & reduce(Column.__or__, [_phrase(words, at, p) for p in tx.ORDERS]))
    return hit


def malformed(findings: DataFrame) -> Column:
    """Whether a finding's names are outside the vocabulary, or its implication advises."""
    known = F.col("change_type").isin(*CHANGES, *FOOTNOTE_FLAGS, *INCENTIVE_FLAGS) & F.col("severity").isin(*SEVERITIES)
    return ~F.coalesce(known, F.lit(False)) | advises("implication", imperative=False)


def with_sources(rows: DataFrame, sources: DataFrame, wanted: Column, *names: tuple[str, str, str, str]) -> DataFrame:
    """Adds, for each of ``names`` (prefix, quote, accession and item column), <prefix>sourced (the section that a row names is
    there) and <prefix>found (it holds the row's quote).

    Only ``wanted`` rows are looked up. All quotes, of whatever column, meet their sections together, so that a text is
    shuffled once. ``sources`` holds one text for each (accession_no, item). The answers are as many as the rows and are
    never broadcast: equal quotes make their file look small, whatever the rows."""
    ask = reduce(DataFrame.unionByName, [rows.where(wanted).select(F.col(a).alias("accession_no"), F.col(i).alias("item"), F.col(q).alias("quote")) for _, q, a, i in names])
    got = materialise(quotes.asked(ask.dropna(), sources), "quotes")  # each name's join reads it
    for prefix, q, a, i in names:
        own = got.select(F.col("accession_no").alias("__a"), F.col("item").alias("__i"), F.col("digest").alias("__q"), F.col("found").alias(f"{prefix}found"))
        same = (F.col(a) == F.col("__a")) & (F.col(i) == F.col("__i")) & (quotes.digest(q) == F.col("__q")) & wanted
        rows = rows.join(own.hint("merge"), same, "left").withColumn(f"{prefix}sourced", F.col("__a").isNotNull()).withColumn(f"{prefix}found", F.coalesce(f"{prefix}found", F.lit(False)))
        rows = rows.drop("__a", "__i", "__q")
    return rows


def validate_findings(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """``findings`` with the reason each is dropped for (null: kept); the first that applies.

    ``sources`` holds one text for each (accession_no, item)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    before = F.when(malformed(findings), "malformed").when(blank("quote"), "quote_missing")
    rows = findings.withColumn("__why", before)
    rows = with_sources(rows, sources, F.col("__why").isNull(), ("__", "quote", "accession_no", "item"), ("__prior_", "prior_quote", "prior_accession_no", "item"))
    now = F.when(~F.col("__sourced"), "source_unavailable").when(~F.col("__found"), "quote_not_found")
    prior = F.when(blank("prior_quote"), None).when(~F.col("__prior_sourced"), "prior_source_unavailable").when(~F.col("__prior_found"), "prior_quote_not_found")
    return rows.select(*findings.columns, F.coalesce("__why", now, prior).alias("drop_reason"))


def run_statistics(validated: DataFrame, *by: str) -> DataFrame:
    """Of each run: findings kept and dropped, and how many each reason dropped, as JSON (reasons in order)."""
    per = validated.groupBy(*by, "drop_reason").agg(F.count("*").alias("n"))
    kept = F.coalesce(F.sum(F.when(F.col("drop_reason").isNull(), F.col("n"))), F.lit(0)).alias("findings_kept")
    dropped = F.coalesce(F.sum(F.when(F.col("drop_reason").isNotNull(), F.col("n"))), F.lit(0)).alias("findings_dropped")
    why = F.array_sort(F.collect_list(F.when(F.col("drop_reason").isNotNull(), F.struct("drop_reason", "n"))))
    return per.groupBy(*by).agg(kept, dropped, F.to_json(F.map_from_entries(why)).alias("drop_reasons"))


def drop_rate(validated: DataFrame, *by: str) -> DataFrame:
    """Kept and dropped findings, and the dropped share (null for none)."""
    kept, dropped = F.count_if(F.col("drop_reason").isNull()), F.count_if(F.col("drop_reason").isNotNull())
    return validated.groupBy(*by).agg(kept.alias("kept"), dropped.alias("dropped"), F.try_divide(dropped, F.count("*")).alias("fabrication_rate"))


def drop_reasons(validated: DataFrame) -> DataFrame:
    return validated.where("drop_reason IS NOT NULL").groupBy("drop_reason").agg(F.count("*").alias("n"))


def severity_rank() -> Column:
    """0 for the gravest; names outside the vocabulary come last."""
    return F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(), "item")


def section_pairs(section: DataFrame, filing: DataFrame, item: str) -> DataFrame:
    """Current and prior section of an item for each filer: the two newest filings that hold it. Sections below the
    usable confidence are marked."""
    s = section.where(F.col("item") == item).join(filing.select("accession_no", "cik", "filed_date"), "accession_no")
    w = Window.partitionBy("cik").orderBy(F.desc("filed_date"), F.desc("accession_no"))
    s = s.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    one = F.struct("accession_no", "filed_date", "text", "extraction_confidence")
    out = s.groupBy("cik").agg(F.max(F.when(F.col("rn") == 1, one)).alias("current"), F.max(F.when(F.col("rn") == 2, one)).alias("prior"))
    low = lambda c: F.coalesce(F.col(f"{c}.extraction_confidence") < USABLE, F.lit(False))
    return out.withColumn("refused", low("current") | low("prior"))
