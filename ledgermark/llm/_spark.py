"""Session helpers: shared work folder, written intermediate tables, Arrow batch bounds, split of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermark.tables import materialise, shared_root

#: Rows and bytes of an Arrow batch: texts are long, and a worker holds one batch at a time.
ARROW_ROWS, ARROW_BYTES = "512", "16777216"


def workdir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one only where a session of one machine has none."""
    return shared_root(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing.
    ``ledgermark.tables.clear`` removes what was written, once nothing reads it any more."""
    return materialise(df, name)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get (session settings, read when a plan runs)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def remainder(doc_id: str | Column = "doc_id", parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % parts


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows that no model may learn from; a null id is not held out but is never learned from either."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def sampled(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """All rows of ``df`` if there are no more than ``bound``; else about ``bound`` of them, chosen by a hash of ``keys``, and of
    rows with equal keys one, so that many copies of a row neither fill the sample nor are missed by it."""
    h = F.xxhash64(F.lit("sample"), *keys)
    n, different = df.agg(F.count("*"), F.approx_count_distinct(h, 0.02)).first()
    if n <= bound:
        return df
    return df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / different))).dropDuplicates(list(keys))


def union_find(parent: dict, a, b) -> bool:
    """Join the sets of ``a`` and ``b``; the smaller root stays (path halving). False if they were one already."""
    for x in (a, b):
        parent.setdefault(x, x)
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


#: A key that holds more than one of so many rows is joined by broadcast: there are fewer such keys than this.
HOT = 1000


def with_values(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` with ``values`` (one row for each ``key``). Keys with more than a ``HOT``-th of the rows, fewer
    than ``HOT`` of them, are broadcast, and rows without a key are not joined, so no task gets the rows of one large key.
    ``rows`` is read several times: it should be a written table."""
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema if f.name != key]
    known = rows.where(F.col(key).isNotNull())
    per_key = known.groupBy(key).agg(F.count("*").alias("__n"))
    least = known.count() / HOT
    hot = F.broadcast(stage(per_key.where(F.col("__n") > least).select(key), "hot"))
    hot_values = F.broadcast(stage(values.join(hot, key), "hot"))
    cold = known.join(hot, key, "left_anti").join(values, key, "left")
    warm = known.join(hot, key, "left_semi").join(hot_values, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *more)
    return cold.unionByName(warm).unionByName(none)
