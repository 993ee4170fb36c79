"""Quotes sought in sections: those of a named section, and all places where some quote stands.

A quote stands in a section if its fragments (parted by ellipses) stand in it in order, in the form in which quotes are
matched. Places are found by an inverted index: each quote has an anchor, a run of whole words within its longest fragment,
which every section that holds the quote must hold too. Runs of the sections' words meet the anchors by their hash; only
sections that hold an anchor are looked at for the quote itself, and quotes are never paired with sections otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgermark.functions import text as tx

#: Rows of an Arrow batch: documents are long.
BATCH_ROWS = "64"
#: Words of an anchor, most first; a quote gets the longest that its fragment has room for. Without any whole word its anchor
#: is a run of so many characters of a word.
WORDS, LETTERS = (5, 3, 1), 6
#: Quotes up to which the index is broadcast, so that runs which are no anchor go where sections are read; beyond it both are
#: shuffled by their hashes.
FEW = 1 << 16
#: White space as it parts words, within a Java class.
_BLANK = "\\t-\\r\\x1C-\\x1F "


def batched(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@F.pandas_udf(StringType())
def _form(s: pd.Series) -> pd.Series:
    return s.map(tx.for_match, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _fragments(s: pd.Series) -> pd.Series:
    return s.map(tx.fragments, na_action="ignore")


def matched_form(text: str | Column) -> Column:
    """A text as quotes are matched against it (null: empty). Texts of ASCII alone stay in the JVM."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = ~c.rlike("[^\\x00-\\x7F]")
    return F.when(plain, F.lower(F.trim(F.regexp_replace(c, f"[{_BLANK}]+", " ")))).otherwise(_form(F.when(~plain, c)))


def fragments(quote: str | Column) -> Column:
    """Fragments of a quote in matched form; empty if it is too short to be sought, or null."""
    return F.coalesce(_fragments(F.col(quote) if isinstance(quote, str) else quote), F.array().cast("array<string>"))


def stands(parts: str, form: str) -> Column:
    """Whether all ``parts``, of which there is one at least, stand in ``form`` one after the other."""
    end = F.expr(f"aggregate({parts}, 1, (at, p) -> CASE WHEN at = 0 OR locate(p, {form}, at) = 0 THEN 0 ELSE locate(p, {form}, at) + length(p) END)")
    return F.coalesce((F.size(parts) > 0) & (end > 0), F.lit(False))


def digest(quote: str | Column) -> Column:
    """What stands for a quote where rows are dealt out: a quote is long, and asked for many times."""
    return F.unhex(F.sha2(quote, 256))


def asked(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """Which of ``quotes`` (accession_no, item, quote: any number of times) stand in the section that they name: accession_no, item,
    the quote's digest and found, a row for each quote whose section is there. ``sections`` (accession_no, item, text) holds one text
    for each; null ones are not there. A section's text is shuffled once, whatever the number of its quotes."""
    batched(quotes)
    key = ["accession_no", "item"]
    quotes = quotes.withColumn("digest", digest("quote"))
    named = quotes.select(*key, "digest").distinct()
    # sections of which nothing is asked go before their form is worked out; the others lie where the join wants them
    held = sections.where("text IS NOT NULL").select(*key, "text").join(quotes.select(*key).distinct(), key, "left_semi").select(*key, matched_form("text").alias("form"))
    # a quote is parted once, however often it is asked for
    known = quotes.select("digest", "quote").distinct().select("digest", fragments("quote").alias("parts"))
    return held.join(named.join(known, "digest"), key).select(*key, "digest", stands("parts", "form").alias("found"))


def _runs(hashes: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words, made of the words' hashes (0: of ``LETTERS`` characters of the text)."""
    if not k:
        return F.expr(f"transform(sequence(1, greatest(1, length(form) - {LETTERS - 1})), i -> xxhash64(0, substr(form, i, {LETTERS})))")
    own = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    return F.expr(f"CASE WHEN size({hashes}) >= {k} THEN transform(sequence(0, size({hashes}) - {k}), i -> xxhash64({k}, {own})) ELSE array() END")


def runs(sections: DataFrame, k: int) -> DataFrame:
    """accession_no, item and hash (run) of every run of ``k`` words of ``sections`` (accession_no, item, text), once each."""
    batched(sections)
    rows = sections.where("text IS NOT NULL").select("accession_no", "item", matched_form("text").alias("form")).withColumn("hashes", F.transform(F.split("form", " "), lambda w: F.xxhash64(w)))
    return rows.select("accession_no", "item", F.explode(F.array_distinct(_runs("hashes", k))).alias("run"))


def run_at(words: str, at: int, k: int) -> Column:
    """Hash of the run of ``k`` words that begins at a place of ``words``, as ``runs`` has it."""
    return F.xxhash64(F.lit(k), *[F.xxhash64(F.get(words, F.lit(at + j))) for j in range(k)])


def anchored(quotes: DataFrame) -> DataFrame:
    """``quotes`` (quote) with their fragments, and of each that can be sought the anchor's kind (k: words, or 0) and hash."""
    rows = quotes.select("quote").distinct().withColumn("parts", fragments("quote")).where("size(parts) > 0")
    longest = F.expr("array_max(transform(parts, p -> named_struct('n', size(split(p, ' ')), 'p', p)))")
    rows = rows.withColumn("words", F.split(longest["p"], " "))
    inner = F.size("words") - 2  # the first and the last word may be parts of words
    k = F.coalesce(*[F.when(inner >= n, n) for n in WORDS], F.lit(0))
    word = F.expr("array_max(transform(words, w -> named_struct('n', length(w), 'w', w)))")["w"]
    anchor = F.xxhash64(F.lit(0), F.substring(word, 1, LETTERS))
    for n in WORDS:
        anchor = F.when(F.col("k") == n, F.xxhash64(F.lit(n), *[F.xxhash64(F.get("words", F.lit(j))) for j in range(1, n + 1)])).otherwise(anchor)
    return rows.withColumn("k", k).withColumn("anchor", anchor).select("quote", "parts", "k", "anchor")


def candidates(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """quote, accession_no and item of every section of ``sections`` that holds the anchor of one of ``quotes``, and so of all that
    hold the quote."""
    batched(quotes)
    index = anchored(quotes).select("quote", "k", "anchor")
    kinds = [r["k"] for r in index.select("k").distinct().collect()]  # of four
    if not kinds:
        return sections.select(F.lit(None).cast("string").alias("quote"), "accession_no", "item").limit(0)
    rows = sections.where("text IS NOT NULL").select("accession_no", "item", matched_form("text").alias("form")).withColumn("hashes", F.transform(F.split("form", " "), lambda w: F.xxhash64(w)))
    runs = F.array_distinct(F.concat(*[_runs("hashes", k) for k in sorted(kinds)]))
    postings = rows.select("accession_no", "item", F.explode_outer(runs).alias("anchor"))  # numbers only: texts stay behind
    if index.count() <= FEW:
        index = F.broadcast(index)
    return postings.join(index.select("quote", "anchor"), "anchor").select("quote", "accession_no", "item").distinct()


def occurrences(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """quote, accession_no and item: every section of ``sections`` (accession_no, item, text) in which one of ``quotes`` (quote) stands.

    Null and too short quotes stand nowhere, null and empty texts hold none; repeated quotes are sought once; empty
    tables give no rows."""
    found = asked(candidates(quotes, sections), sections).where("found")
    return found.join(quotes.select("quote").distinct().withColumn("digest", digest("quote")), "digest").select("quote", "accession_no", "item")
