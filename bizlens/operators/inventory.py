"""Stock risk, order quantities and funding under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.exact import clip, flag, ratio, rounded
from bizlens.functions.ordered import running_before

# Daily holding rate, cost of placing one order, extra weight of items at risk.
HOLDING_RATE = 0.02
ORDER_COST = 150.0
RISK_WEIGHT = 2


def inventory_features(stock: DataFrame) -> DataFrame:
    """Days of supply and the stockout flag. Without demand there is no day count and no risk."""
    days = F.when(
        F.col("avg_daily_demand") > 0, ratio(F.col("units_on_hand"), F.col("avg_daily_demand"))
    )
    return stock.withColumn("days_of_supply", days).withColumn(
        "stockout_risk",
        flag(F.coalesce(F.col("days_of_supply") < F.col("supplier_lead_time_days"), F.lit(False))),
    )


def reorder_policy(demand: DataFrame) -> DataFrame:
    """Safety stock and reorder point from demand and lead time, to 1 place."""
    mean = F.coalesce(F.col("mean_units"), F.lit(0.0))
    safety = rounded(mean * F.col("supplier_lead_time_days") * F.lit(0.5), 1)
    return demand.select(
        "region",
        "sku",
        "supplier_lead_time_days",
        rounded(mean, 2).alias("avg_daily_demand"),
        safety.alias("safety_stock"),
        rounded(mean * F.col("supplier_lead_time_days") + safety, 1).alias("reorder_point"),
    )


def eoq_plan(
    stock: DataFrame, holding_rate: float = HOLDING_RATE, order_cost: float = ORDER_COST
) -> DataFrame:
    """Economic order quantity, recommended order and its cost. The holding rate counts per day."""
    plan = stock.withColumns(
        {
            "annual_demand": F.col("avg_daily_demand") * F.lit(365.0),
            "holding_cost_per_unit": F.col("unit_cost") * F.lit(holding_rate) * F.lit(365.0),
        }
    )
    squared = ratio(
        F.lit(2.0) * F.col("annual_demand") * F.lit(order_cost), F.col("holding_cost_per_unit")
    )
    plan = plan.withColumn(
        "eoq",
        rounded(F.coalesce(F.sqrt(F.greatest(squared, F.lit(0.0))), F.lit(0.0))),
    ).withColumn(
        "recommended_order_qty",
        rounded(
            F.greatest("eoq", F.col("reorder_point") - F.col("units_on_hand"), F.lit(0.0))
        ),
    )
    return plan.withColumn(
        "order_cost_total", rounded(F.col("recommended_order_qty") * F.col("unit_cost"), 2)
    )


def fund_orders(plan: DataFrame, budget: Column | float, by: list[str] | None = None) -> DataFrame:
    """Spend each group's budget where a unit of money moves the most weighted units.

    The quantities may be split, so filling in order of weighted units per cost is optimal. Rows
    are never gathered per group: see ``running_before``. A row without a cost takes none of the
    budget and, like every row without a budget, has no fraction.
    """
    by = ["region"] if by is None else by
    weight = F.lit(1) + F.lit(RISK_WEIGHT) * F.col("stockout_risk")
    rows = plan.withColumns(
        {
            "priority_weight": weight,
            "_density": ratio(F.col("recommended_order_qty") * weight, F.col("order_cost_total")),
            "_cost": F.col("order_cost_total").cast("decimal(18,2)"),
            "_budget": (budget if isinstance(budget, Column) else F.lit(budget)).cast(
                "decimal(18,2)"
            ),
        }
    )
    order = [F.col("_density").desc_nulls_first(), F.col("sku"), F.col("region")]
    rows = running_before(rows, order, {"_spent": "_cost"}, by=by, cut=F.col("_budget"))
    left = (F.col("_budget") - F.col("_spent")).cast("double")
    share = ratio(left, F.col("order_cost_total"))
    fraction = (
        F.when(F.col("recommended_order_qty") == 0, F.lit(0.0))
        .when(F.col("_cost") == 0, F.lit(1.0))
        .when(share.isNotNull(), rounded(clip(share, 0.0, 1.0), 3))
    )
    return (
        rows.withColumn("funded_fraction", fraction)
        .withColumn(
            "funded_order_qty", rounded(F.col("recommended_order_qty") * F.col("funded_fraction"))
        )
        .withColumn("funded_cost", rounded(F.col("funded_order_qty") * F.col("unit_cost"), 2))
        .drop("_density", "_cost", "_budget", "_spent")
    )


def at_risk(features: DataFrame) -> DataFrame:
    return features.filter(F.col("stockout_risk") == 1)


def supplier_exposure(stock: DataFrame) -> DataFrame:
    return stock.groupBy("region", "supplier").agg(F.sum("units_on_hand").alias("units_on_hand"))


def _plan_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("items"),
        F.sum("stockout_risk").alias("stockout_risk"),
        F.sum("recommended_order_qty").alias("recommended_order_qty"),
        F.sum(F.col("order_cost_total").cast("decimal(18,2)")).alias("order_cost_total"),
    ]


def stock_totals(plan: DataFrame) -> DataFrame:
    """Per region: items, and the sums that the summary and the suppliers' volumes are made of, under
    the names of the plan's columns."""
    return plan.groupBy("region").agg(*_plan_sums())


def supply_totals(plan: DataFrame) -> DataFrame:
    """The same per region and supplier, with the units on hand: the suppliers' exposure as well, from
    one pass over the plan."""
    return plan.groupBy("region", "supplier").agg(F.sum("units_on_hand").alias("units_on_hand"), *_plan_sums())


def region_totals(supply: DataFrame) -> DataFrame:
    """``stock_totals`` from ``supply_totals``. Quantities are whole numbers and money is decimal, so
    sums of sums are exact."""
    names = ["items", "stockout_risk", "recommended_order_qty", "order_cost_total"]
    return supply.groupBy("region").agg(*[F.sum(c).alias(c) for c in names])


def stock_summary(totals: DataFrame) -> DataFrame:
    """Per region and overall, from ``stock_totals``: items, items at risk, units and money to order."""
    return (
        totals.rollup("region")
        .agg(
            F.sum("items").alias("items"),
            F.sum("stockout_risk").alias("items_at_risk"),
            F.sum("recommended_order_qty").cast("long").alias("units_to_order"),
            F.sum("order_cost_total").cast("double").alias("order_cost_total"),
        )
        .withColumn("region", F.coalesce("region", F.lit("ALL")))
    )
