"""The sliced running sums against a plain pandas computation, with ties and a hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.functions.ordered import average_rank, exact_quantile, running_before
from bizlens.operators import inventory, metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    frame = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)),
            "k": np.where(rng.random(n) < 0.4, 7, rng.integers(0, 50, n)).astype("int64"),
            "id": np.arange(n),
            "v": rng.integers(0, 100, n),
        }
    )
    return frame, spark.createDataFrame(frame).repartition(6)


def expected(frame, by):
    frame = frame.sort_values(["k", "id"])
    sums = frame.groupby("g")["v"].cumsum() if by else frame["v"].cumsum()
    return dict(zip(frame["id"], sums - frame["v"]))


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_running_before_matches_a_sorted_cumsum(spark, rows, by, partitions):
    frame, df = rows
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running_before(df, [F.col("k"), F.col("id")], {"s": "v"}, by=by)
        assert out.select(F.spark_partition_id()).distinct().count() >= 1
        assert {r.id: r.s for r in out.collect()} == expected(frame, by)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cut_keeps_every_row_on_its_side(spark, rows):
    frame, df = rows
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = 20000
        out = running_before(
            df, [F.col("k"), F.col("id")], {"s": "v"}, by=["g"], total="t", cut=F.lit(cut)
        ).collect()
        want = expected(frame, ["g"])
        value = dict(zip(frame["id"], frame["v"]))
        assert len(out) == len(frame)
        for r in out:
            exact = want[r.id]
            taken = max(0, min(value[r.id], cut - exact))
            assert max(0, min(value[r.id], cut - r.s)) == taken
        totals = frame.groupby("g")["v"].sum().to_dict()
        assert {(r.g, r.t) for r in out} == set(totals.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.7, 1.0])
def test_quantile_interpolates(rows, fraction):
    frame, df = rows
    got = exact_quantile(df, "k", fraction, "q").first()["q"]
    assert got == pytest.approx(frame["k"].quantile(fraction))


def test_quantile_of_one_row_and_of_nothing(spark):
    one = spark.createDataFrame([(4.0,), (None,)], "x double")
    assert exact_quantile(one, "x", 0.7, "q").first()["q"] == 4.0
    assert exact_quantile(one.filter("x > 9"), "x", 0.7, "q").first()["q"] is None


def test_average_rank_shares_places(rows):
    frame, df = rows
    want = frame["k"].rank(ascending=False)
    got = {r.id: r.r for r in average_rank(df, "k", "r").collect()}
    assert got == dict(zip(frame["id"], want))


def test_no_row_is_lost_to_nulls(spark):
    """NULL groups, labels, costs, budgets and values keep their rows."""
    plan = spark.createDataFrame(
        [("A", 1, 10.0, 5.0, 50.0, 1), (None, 2, 10.0, 5.0, 50.0, 0),
         ("A", 3, 10.0, None, None, 0), ("B", 4, 7.0, 2.0, 14.0, 0)],
        "region string, sku int, recommended_order_qty double, unit_cost double, "
        "order_cost_total double, stockout_risk int",
    )
    got = {r.sku: r.funded_fraction for r in inventory.fund_orders(plan, 25.0).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None, 4: 1.0}
    got = {r.sku: r.funded_fraction for r in inventory.fund_orders(plan, 60.0, by=[]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: 0.714}
    nothing = inventory.fund_orders(plan, F.lit(None).cast("double")).collect()
    assert [r.funded_fraction for r in nothing] == [None] * 4
    labels = spark.createDataFrame([(1, None), (2, None), (3, 1), (4, 0)], "k int, y int")
    split = metrics.split_rows(labels, "k", ["y"])
    assert {(r.y, r.n) for r in split.groupBy("y").agg(F.sum("is_test").alias("n")).collect()} == {
        (None, 1), (0, 1), (1, 1)
    }
    assert split.count() == 4
    values = spark.createDataFrame([("a", None), ("b", 2.0)], "sku string, revenue double")
    assert {(r.sku, r.r) for r in average_rank(values, "revenue", "r").collect()} == {
        ("a", None), ("b", 1.0)
    }
