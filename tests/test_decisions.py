import itertools
import random

import pytest
from pyspark.sql import functions as F

from bizlens.operators import decisions as d
from bizlens.operators import inventory as inv

STOCK = (
    "region string, sku long, units_on_hand long, supplier_lead_time_days long, "
    "avg_daily_demand double, reorder_point double, unit_cost double"
)


def plan_rows(spark, rows):
    return inv.eoq_plan(inv.inventory_features(spark.createDataFrame(rows, STOCK)))


def test_inventory_edges(spark):
    rows = [
        ("a", 1, 10, 7, 0.0, 0.0, 5.0),      # no demand: no day count, no risk
        ("a", 2, 10, 7, 2.0, 21.0, 0.0),     # free item: no order quantity from the formula
        ("a", 3, 14, 7, 2.0, 21.0, 5.0),     # days equal the lead time: not at risk
        ("a", 4, 13, 7, 2.0, 900.0, 5.0),    # far below the reorder point
    ]
    out = {r.sku: r for r in plan_rows(spark, rows).collect()}
    assert out[1].days_of_supply is None and out[1].stockout_risk == 0
    assert out[1].recommended_order_qty == 0
    assert out[2].eoq == 0 and out[2].recommended_order_qty == 11 and out[2].order_cost_total == 0
    assert out[3].stockout_risk == 0 and out[4].stockout_risk == 1
    assert out[4].recommended_order_qty == 887
    assert out[3].eoq == round((2 * 730 * 150 / (5 * 0.02 * 365)) ** 0.5)


def best_value(items, budget):
    """Fractional knapsack by trying every item as the split one over every whole subset."""
    best = 0.0
    for size in range(len(items) + 1):
        for whole in itertools.combinations(range(len(items)), size):
            cost = sum(items[i][1] for i in whole)
            if cost > budget:
                continue
            value = sum(items[i][0] for i in whole)
            best = max(best, value)
            for j in set(range(len(items))) - set(whole):
                if items[j][1] > 0:
                    part = min(1.0, (budget - cost) / items[j][1])
                    best = max(best, value + part * items[j][0])
    return best


@pytest.mark.parametrize("budget", [0.0, 300.0, 2500.0, 1e9])
def test_funding_is_optimal_per_group(spark, budget):
    rng = random.Random(5)
    rows = [
        (region, sku, rng.randrange(50), 7, float(rng.randrange(0, 9)), float(rng.randrange(120)),
         rng.choice([0.0, 2.0, 5.0, 5.0, 20.0]))
        for region in ("a", "b")
        for sku in range(7)
    ]
    plan = plan_rows(spark, rows)
    out = inv.fund_orders(plan, budget).collect()
    assert len(out) == len(rows)
    for region in ("a", "b"):
        mine = [r for r in out if r.region == region]
        items = [(r.recommended_order_qty * r.priority_weight, r.order_cost_total) for r in mine]
        got = sum(r.funded_fraction * v for r, (v, _) in zip(mine, items))
        assert got == pytest.approx(best_value(items, budget), rel=2e-3, abs=1.0)
        spent = sum(r.funded_fraction * r.order_cost_total for r in mine)
        assert spent <= budget * 1.002 + 1
        assert all(0 <= r.funded_fraction <= 1 for r in mine)
        assert all(r.funded_fraction == 0 for r in mine if r.recommended_order_qty == 0)


def test_funding_does_not_depend_on_the_partitioning(spark, folder):
    from bizlens.plans.business import Business

    results = []
    for partitions in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = inv.fund_orders(Business(spark, folder).plan, 2e6)
        results.append(sorted((r.region, r.sku, r.funded_fraction) for r in out.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert results[0] == results[1]


def test_price_demo(spark):
    base = spark.createDataFrame(
        [("watch", 199.0, 1000.0, -1.3, 95.0)],
        "sku string, base_price double, base_demand double, elasticity double, unit_cost double",
    )
    grid = {r.price_change_pct: r for r in d.price_grid(base, ["sku"]).collect()}
    assert len(grid) == 8
    assert grid[0.0].estimated_profit == 104000.0
    assert grid[0.08].price == 214.92 and grid[0.08].estimated_demand == 896.0
    best = d.best_price(base, ["sku"]).first()
    assert best.estimated_profit == max(r.estimated_profit for r in grid.values())
    assert best.unchanged_profit == 104000.0


def test_best_price_takes_the_first_of_equals_and_demand_stays_positive(spark):
    base = spark.createDataFrame(
        [("flat", 0.0, 10.0, -1.0, 0.0), ("steep", 10.0, 10.0, -20.0, 1.0)],
        "sku string, base_price double, base_demand double, elasticity double, unit_cost double",
    )
    best = {r.sku: r for r in d.best_price(base, ["sku"]).collect()}
    assert best["flat"].recommended_price_change_pct == -0.15
    assert min(r.estimated_demand for r in d.price_grid(base, ["sku"]).collect()) == 0.0


def test_marketing_demo_and_infeasible_budget(spark):
    returns = spark.createDataFrame(
        [("North America", 3.2), ("Europe", 1.8), ("APAC", 4.1), ("Latin America", 2.5)],
        "region string, roi_per_dollar double",
    )
    requests = spark.createDataFrame([(1, 1_000_000.0), (2, 100_000.0)], "id int, budget double")
    rows = d.allocate_marketing(returns, requests).collect()
    first = {r.region: r for r in rows if r.id == 1}
    assert first["APAC"].allocated_budget == 850_000.0
    assert first["APAC"].predicted_incremental_revenue == 3_485_000.0
    assert first["Europe"].allocated_budget == 50_000.0
    second = [r for r in rows if r.id == 2]
    assert {r.status for r in second} == {"budget below floors"}
    assert {r.allocated_budget for r in second} == {None}


def test_marketing_keeps_the_rest_when_nothing_pays(spark):
    returns = spark.createDataFrame([("a", 0.0), ("b", -1.0)], "region string, roi_per_dollar double")
    requests = spark.createDataFrame([(500_000.0,)], "budget double")
    rows = d.allocate_marketing(returns, requests).collect()
    assert {r.allocated_budget for r in rows} == {50_000.0}


def supplier_rows(spark, volume, offers):
    return spark.range(1).select(
        F.lit("g").alias("g"), F.lit(float(volume)).alias("required_volume"),
        F.inline(d.supplier_offers(offers)),
    )


DEMO = (("Nordic", 42.0, 20000.0), ("Meridian", 45.0, 25000.0), ("Delta", 47.5, 15000.0))


def test_supplier_demo(spark):
    out = {r.supplier: r for r in d.select_suppliers(supplier_rows(spark, 40000, DEMO), ["g"]).collect()}
    assert [out[n].allocated_volume for n in ("Nordic", "Meridian", "Delta")] == [16000, 16000, 8000]
    assert out["Nordic"].share_of_total == 0.4
    assert {r.status for r in out.values()} == {"feasible"}


@pytest.mark.parametrize(
    "volume, relax, status, total",
    [
        (60000, True, "share limit relaxed", 60000),
        (60000, False, "infeasible", 0),
        (70000, True, "infeasible", 0),
        (0, True, "feasible", 0),
        (50000, True, "feasible", 50000),
    ],
)
def test_supplier_feasibility(spark, volume, relax, status, total):
    offers = (("a", 1.0, 30000.0), ("b", 2.0, 20000.0), ("c", 2.0, 10000.0))
    rows = d.select_suppliers(supplier_rows(spark, volume, offers), ["g"], relax=relax).collect()
    assert {r.status for r in rows} == {status}
    assert sum(r.allocated_volume for r in rows) == total


def test_no_change_scenario_has_no_like_for_like_change(spark, folder):
    from bizlens.plans.business import Business

    rows = d.scenario_elastic(Business(spark, folder).latest).filter("scenario = 'no change'")
    assert {r.like_for_like_pct for r in rows.collect()} == {0.0}
