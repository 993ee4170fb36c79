"""Places over all rows against Spark's own windows: ties across ranges, nulls, NaN, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgermark.functions.ranks import numbered, ranked


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(7)
    some = [(i, r.choice([None, float("nan"), 0.0, -0.0, *range(5)]) if i % 3 else 2.0, r.choice("ab")) for i in range(600)]  # a third ties
    return spark.createDataFrame([(i, None if x is None else float(x), g) for i, x, g in some], "id long, x double, g string").withColumn("__at", F.lit("clash")).withColumn("m", F.create_map(F.lit("a"), F.col("x")))


@pytest.mark.parametrize("down", [True, False])
def test_rank_equals_the_window(spark, rows, down):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, so that ties cross their borders
    order = F.col("x").desc() if down else F.col("x").asc()
    try:
        got = {r["id"]: r["place"] for r in ranked(rows, "place", ("x", down)).collect()}
        both = {r["id"]: r["place"] for r in ranked(rows, "place", ("x", down), (F.length("g"), False), among=F.col("g") == "a").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {r["id"]: r["w"] for r in rows.withColumn("w", F.rank().over(Window.orderBy(order))).collect()}
    want = {r["id"]: r["w"] for r in rows.where("g = 'a'").withColumn("w", F.rank().over(Window.orderBy(order))).collect()}
    assert both == {i: want.get(i) for i in range(600)}


def test_rank_within_groups(rows):
    got = {r["id"]: r["place"] for r in ranked(rows, "place", ("x", True), among=F.col("id") > 50, within=("g",)).collect()}
    want = rows.where("id > 50").withColumn("w", F.rank().over(Window.partitionBy("g").orderBy(F.desc("x")))).collect()
    assert {i: p for i, p in got.items() if i > 50} == {r["id"]: r["w"] for r in want} and {p for i, p in got.items() if i <= 50} == {None}


def test_numbers_follow_the_order(spark, rows):
    got = numbered(rows, [F.col("x").desc_nulls_last(), F.col("id")], "n")
    assert [r["id"] for r in got.orderBy("n").collect()] == [r["id"] for r in rows.orderBy(F.col("x").desc_nulls_last(), "id").collect()]
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 601)) and got.columns == [*rows.columns, "n"]


def test_an_empty_table_stays_empty(rows):
    none = rows.limit(0)
    assert ranked(none, "place", ("x", True)).count() == 0 and numbered(none, [F.col("x")], "n").count() == 0


def test_no_window_meets_all_rows_in_one_task(rows):
    plan = ranked(rows, "place", ("x", True))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
