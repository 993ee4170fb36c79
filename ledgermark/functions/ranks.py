"""Places in an order over all rows, without a window that meets them in one task.

Rows are dealt out by ranges of the order (Spark samples the borders) and sorted within; each range is counted, and a
range begins after all rows of the ranges before it. The driver sees one row for each range, and the number of
ranges is a setting (``spark.sql.shuffle.partitions``), whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermark.tables import materialise

#: Spark's row ids: the number of the partition above these bits, the row's place in it below.
_BITS = 33


def _placed(rows: DataFrame, order: Sequence[Column], at: str) -> DataFrame:
    """``rows`` sorted within ranges of ``order``, written once so that every later pass sees the same ranges."""
    return materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "placed")


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _by_range(values: dict[int, int], part: Column) -> Column:
    """A value for each range, looked up in a constant array by the range's number."""
    if not values:
        return F.lit(0).cast("long")
    dense = [values.get(i, 0) for i in range(max(values) + 1)]
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in dense]), (part + 1).cast("int"))


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3 and so on in ``order`` (long). Rows that tie in the whole order follow each other in no
    particular order; an empty table stays empty."""
    at = _free(rows, "__at")
    placed = _placed(rows, order, at)
    part = F.shiftright(at, _BITS)
    counts = dict(placed.groupBy(part.alias("part")).count().collect())  # one row a range
    starts, before = {}, 0
    for p in sorted(counts):
        starts[p] = before
        before += counts[p]
    return placed.withColumn(name, _by_range(starts, part) + F.col(at).bitwiseAND(F.lit((1 << _BITS) - 1)) + 1).drop(at)


def _same(a: Sequence, b: Sequence) -> bool:
    """Whether two keys tie: nulls with nulls, NaN with NaN."""
    nan = lambda x: isinstance(x, float) and math.isnan(x)
    return all(x == y or (nan(x) and nan(y)) for x, y in zip(a, b, strict=True))


def ranked(rows: DataFrame, name: str, *by: tuple[str | Column, bool], among: Column | None = None, within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``name``: one more than the number of rows that come before (int), so rows that tie share a rank. With
    ``within`` (columns without nulls, of few values) only rows that are equal in these count.

    ``by`` names the values of the order, each with whether the largest come first (nulls then last, else first). With
    ``among`` only rows that it holds for are counted and ranked; the others' rank is null. Many rows that tie may
    lie in several ranges: ties are dealt out by a hash of the row, and a range whose first rows tie with the last ones of the
    range before takes their rank from there.
    """
    at, taken, tie, part, own = (_free(rows, x) for x in ("__at", "__among", "__tie", "__part", "__own"))
    keys = [_free(rows, f"__key{i}") for i in range(len(by))]
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() not in ("map", "variant")]
    held = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    values = [F.col(v) if isinstance(v, str) else v for v, _ in by]
    wide = rows.withColumns({taken: held, tie: F.xxhash64(*hashable)} | dict(zip(keys, values, strict=True)))
    # rows that are ranked come first; the others follow them and change no rank
    order = [F.col(taken).desc(), *map(F.col, within), *[F.col(k).desc() if down else F.col(k).asc() for k, (_, down) in zip(keys, by, strict=True)]]
    placed = _placed(wide, [*order, F.col(tie)], at).withColumn(part, F.shiftright(at, _BITS))
    placed = placed.withColumn(own, F.rank().over(Window.partitionBy(part).orderBy(*order)))
    key = F.struct(taken, *within, *keys)
    ends = placed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"), F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"), F.max(own).alias("own"))
    starts: dict[int, int] = {}
    firsts: dict[int, int] = {}  # the rank of a range's first rows
    before, last, rank = 0, None, 0
    for e in sorted(ends.collect(), key=lambda e: e["part"]):  # one row a range
        starts[e["part"]] = before
        firsts[e["part"]] = rank if last is not None and _same(last, e["first"]) else before + 1
        last, rank = e["last"], firsts[e["part"]] if e["own"] == 1 else before + e["own"]
        before += e["n"]
    place = F.when(F.col(own) == 1, _by_range(firsts, F.col(part))).otherwise(_by_range(starts, F.col(part)) + F.col(own))
    placed = placed.withColumn(own, place)
    if within:
        least = placed.where(taken).groupBy(*within).agg(F.min(own).alias(at))
        placed = placed.drop(at).join(least, list(within), "left").withColumn(own, F.col(own) - F.col(at) + 1)
    return placed.withColumn(name, F.when(F.col(taken), F.col(own)).cast("int")).select(*[F.col(f"`{c}`") for c in rows.columns if c != name], name)
