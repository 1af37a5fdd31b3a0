"""The physical plans keep the shape they were designed for."""

import re

import pytest
from pyspark.sql import functions as F

from bizlens.operators import decisions, inventory, monthly
from bizlens.operators.retrieval import TextIndex, unit_weights
from bizlens.plans import briefing
from bizlens.plans.business import Business
from bizlens.plans.catalog import REGISTRY
from bizlens.sources import views


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def b(spark, folder):
    return Business(spark, folder)


CHEAP = [
    "monthly_sales", "monthly_features", "mom_change", "sku_performance", "customer_features",
    "scorecard_attribution", "churn_summary", "churn_histogram", "inventory_features", "eoq_plan",
    "price_grid", "price_best", "pricing_answer", "marketing_allocation", "supplier_allocation",
    "scenario_elastic", "chunk_documents", "tokenize_ngrams", "tag_questions", "root_cause",
]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_join_and_no_python(spark, folder, name):
    plan = plan_of(REGISTRY[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "MapInPandas" not in plan


def test_product_scan_reads_few_columns_and_filters_on_the_date(b):
    plan = plan_of(b.performance)
    scan = [line for line in plan.splitlines() if "lineitem" in line and "l_partkey" in line][0]
    assert "o_orderkey" not in plan
    assert "l_tax" in scan and "l_returnflag" not in scan and "l_orderkey" not in scan
    assert re.search(r"DataFilters: \[.*l_shipdate#\d+ >= ", scan)


def test_lines_are_aggregated_before_the_product_join(b):
    plan = plan_of(b.performance)
    join = plan.index("Join")
    assert "HashAggregate(keys=[sku" in plan[join:]


def test_best_price_adds_no_shuffle(spark, b):
    base = decisions.sku_price_base(b.performance)
    before = plan_of(base).count("Exchange")
    assert plan_of(decisions.best_price(base, ["sku"])).count("Exchange") == before


def test_latest_month_is_an_aggregate(b):
    assert "Window" not in plan_of(monthly.latest_month(b.monthly))


def test_retrieval_reads_postings_by_layer_and_never_crosses(spark, b):
    index = TextIndex.fit(b.base("documents"))
    queries = b.base("benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = unit_weights(queries, ["query_id"], index.vocabulary).select(
        "query_id", F.col("term_no").cast("int"), F.col("weight").alias("query_weight")
    )
    cells = asked.join(index.impacts.cells, "term_no").where("layer < 3")
    plan = plan_of(index.impacts.contributions(cells.select("query_id", "term_no", "layer", "query_weight", "salts")))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    # the layer is a folder: what lies deeper than any cell asked for is not read
    assert re.search(r"PartitionFilters: \[isnotnull\(layer#\d+\), \(layer#\d+ <= Subquery", plan)


@pytest.mark.parametrize("count", [10, 5000])
def test_retrieval_plan_does_not_depend_on_the_number_of_queries(spark, b, count):
    index = TextIndex.fit(b.base("documents"))
    index.impacts  # noqa: B018  written once, before the plans are taken
    queries = spark.range(count).select(F.col("id").alias("query_id"), F.lit("the price of tin and the rest").alias("text"))
    plan = plan_of(index.retrieve(queries))
    assert plan.count("WindowGroupLimit") >= 1
    assert "Union" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_window_without_key_only_sees_months(b):
    plan = plan_of(monthly.with_time_index(b.monthly))
    single = plan.index("SinglePartition")
    assert "HashAggregate(keys=[" in plan[single:]


def test_sentences_and_actions_keep_no_row_per_customer_or_product(spark, small):
    """narrative, action_plan: the order plan and the scores are read for their sums only."""
    for plan in (briefing.narrative, briefing.action_plan):
        b = Business(spark, small)
        plan(b)
        assert not {"plan", "scores"} & b.kept


def test_lines_travel_to_the_orders_with_their_stored_columns(spark, small):
    """narrative, action_plan: money columns are worked out behind the join."""
    plan = views.sales_by_region(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS revenue") < plan.index("Join Inner")


def test_stock_totals_add_up_to_the_summary(spark):
    rows = spark.createDataFrame(
        [("A", 1, 2.0, 0.1), ("A", 0, None, None), ("B", 1, 3.0, 0.2), (None, 0, 4.0, 0.3)],
        "region string, stockout_risk int, recommended_order_qty double, order_cost_total double",
    )
    found = inventory.stock_summary(inventory.stock_totals(rows)).collect()
    assert sorted(tuple(r) for r in found) == [
        ("A", 2, 1, 2, 0.1), ("ALL", 1, 0, 4, 0.3), ("ALL", 4, 2, 9, 0.6), ("B", 1, 1, 3, 0.2),
    ]


def test_answers_keep_totals_only(spark, small, monkeypatch):
    """No row per customer, product or stock item is written for the JSON answers."""

    class Enough(Exception):
        pass

    def stop(*args):
        raise Enough

    monkeypatch.setattr(briefing, "evidence_batch", stop)
    b = Business(spark, small)
    with pytest.raises(Enough):
        briefing.answers(b)
    assert not b.kept & {"scores", "plan", "customers", "performance"}
    assert all(getattr(b, name).count() <= 50 for name in b.kept - {"monthly", "features"})
    assert {"supply_totals", "plan_totals", "churn_totals", "weak_totals"} <= b.kept


def test_supply_totals_are_the_exposure_and_the_totals(spark, small):
    b = Business(spark, small)
    exposure = inventory.supplier_exposure(b.stock).select("region", "supplier", "units_on_hand")
    assert sorted(exposure.collect()) == sorted(b.supply_totals.select("region", "supplier", "units_on_hand").collect())
    names = ["region", "items", "stockout_risk", "recommended_order_qty", "order_cost_total"]
    whole = inventory.stock_totals(b.plan).select(names).collect()
    assert whole and sorted(whole) == sorted(b.plan_totals.select(names).collect())


def test_supply_totals_bear_null_figures(spark):
    kinds = "region string, supplier string, units_on_hand long, stockout_risk long, recommended_order_qty double, order_cost_total double"
    rows = [("A", "x", 1, 1, 3.0, 0.1), ("A", None, None, 0, None, None), ("A", "x", 2, 0, 4.0, 0.2), ("B", "y", 5, 1, None, None), (None, "y", 7, 0, 1.0, 9.99)]
    plan = spark.createDataFrame(rows, kinds)
    whole = {r.region: r for r in inventory.stock_totals(plan).collect()}
    assert whole == {r.region: r for r in inventory.region_totals(inventory.supply_totals(plan)).collect()}
