"""Price points, marketing budgets, supplier mixes and elasticity scenarios.

Parameter lists (price changes, suppliers, scenarios) are short literal arrays unfolded beside each
row. Nothing is cross-joined, and picking the best price needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.functions.exact import clip, exact_sum, ratio, rounded
from bizlens.functions.ordered import running_before

# Price changes tried, assumed elasticities, unit cost share of price.
PRICE_CHANGES = (-0.15, -0.10, -0.05, 0.0, 0.05, 0.08, 0.10, 0.15)
SENSITIVE_ELASTICITY = -1.3
DEFAULT_ELASTICITY = -1.0
COST_SHARE_OF_PRICE = 0.6
# Marketing budget and floor per region when the question names none.
DEFAULT_BUDGET = 1_000_000.0
REGION_FLOOR = 50_000.0
# The largest share one supplier may take.
SUPPLIER_SHARE = 0.4
# Scenario elasticities and the blended margin.
SCENARIO_ELASTICITY = -1.1
CROSS_ELASTICITY = 0.6
MARGIN_RATE = 0.35
# Supplier offers (name, unit cost, capacity).
SUPPLIER_OFFERS = (
    ("Nordic Supply Co", 42.0, 25000.0),
    ("Meridian Components", 45.0, 25000.0),
    ("PacificParts Ltd", 44.0, 22000.0),
    ("Delta Manufacturing", 47.5, 18000.0),
)
# Scenarios tried for every region: name, price, inflation points, competitor, marketing, elasticity.
SCENARIOS = (
    ("no change", 0.0, 0.0, 0.0, 0.0, SCENARIO_ELASTICITY),
    ("price up 8%", 0.08, 0.0, 0.0, 0.0, -1.2),
    ("inflation up 3 points", 0.0, 3.0, 0.0, 0.0, SCENARIO_ELASTICITY),
    ("competitor cuts 10%", 0.0, 0.0, -0.10, 0.0, SCENARIO_ELASTICITY),
    ("marketing up 20%", 0.0, 0.0, 0.0, 0.20, SCENARIO_ELASTICITY),
)


def region_elasticity(sensitive: str) -> Column:
    return F.when(F.col("region") == sensitive, SENSITIVE_ELASTICITY).otherwise(
        DEFAULT_ELASTICITY
    )


def price_options(changes: Sequence[float] = PRICE_CHANGES) -> Column:
    """All candidate prices of a row as one array. Reads ``base_price``, ``base_demand``,
    ``elasticity`` and ``unit_cost``."""

    def option(place: int, change: float) -> Column:
        price = F.col("base_price") * F.lit(1 + change)
        units = F.greatest(
            F.col("base_demand") * (F.lit(1.0) + F.col("elasticity") * F.lit(change)), F.lit(0.0)
        )
        return F.struct(
            F.lit(place).alias("option_no"),
            F.lit(float(change)).alias("price_change_pct"),
            rounded(price, 2).alias("price"),
            rounded(units, 1).alias("estimated_demand"),
            rounded(price * units, 2).alias("estimated_revenue"),
            rounded((price - F.col("unit_cost")) * units, 2).alias("estimated_profit"),
        )

    return F.array(*[option(place, change) for place, change in enumerate(changes, 1)])


def price_grid(base: DataFrame, keys: Sequence[str], changes=PRICE_CHANGES) -> DataFrame:
    return base.select(*keys, F.inline(price_options(changes)))


def best_price(base: DataFrame, keys: Sequence[str], changes=PRICE_CHANGES) -> DataFrame:
    """The most profitable option of each row, the earliest one among equals, and its gain over
    leaving the price alone."""
    options = price_options(changes)
    best = F.array_max(
        F.transform(
            options,
            lambda o: F.struct(
                o["estimated_profit"].alias("profit"), (-o["option_no"]).alias("first"), o.alias("o")
            ),
        )
    )["o"]
    unchanged = F.element_at(F.filter(options, lambda o: o["price_change_pct"] == 0.0), 1)
    return (
        base.withColumns({"_best": best, "_same": unchanged["estimated_profit"]})
        .select(
            *keys,
            F.col("_best.price_change_pct").alias("recommended_price_change_pct"),
            F.col("_best.price").alias("recommended_price"),
            F.col("_best.estimated_demand").alias("estimated_demand"),
            F.col("_best.estimated_revenue").alias("estimated_revenue"),
            F.col("_best.estimated_profit").alias("estimated_profit"),
            F.col("_same").alias("unchanged_profit"),
            rounded(F.col("_best.estimated_profit") - F.col("_same"), 2)
            .alias("projected_profit_impact"),
        )
    )


def region_price_base(latest: DataFrame, sensitive: str) -> DataFrame:
    return latest.select(
        "region",
        F.col("avg_unit_price").alias("base_price"),
        F.col("units_sold").cast("double").alias("base_demand"),
        region_elasticity(sensitive).alias("elasticity"),
        (F.col("avg_unit_price") * F.lit(COST_SHARE_OF_PRICE)).alias("unit_cost"),
    )


def sku_price_base(performance: DataFrame) -> DataFrame:
    """Price base per product: mean price actually paid, units sold and cost per unit."""
    return performance.select(
        "sku",
        rounded(ratio(F.col("revenue"), F.col("units")), 4).alias("base_price"),
        F.col("units").cast("double").alias("base_demand"),
        F.lit(DEFAULT_ELASTICITY).alias("elasticity"),
        rounded(ratio(F.col("cogs"), F.col("units")), 4).alias("unit_cost"),
    )


def allocate_marketing(returns: DataFrame, requests: DataFrame, floor: float = REGION_FLOOR) -> DataFrame:
    """Split every requested budget over the regions: each gets the floor, the rest goes to the
    highest return if that is positive. ``returns`` has one row per region and travels as one
    array; ``requests`` (any number of rows, with a ``budget``) is never shuffled."""
    ranked = returns.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("roi_per_dollar")).alias("order"), F.col("region"),
                    F.col("roi_per_dollar"),
                )
            )
        )
    ).scalar()
    count = F.size("_regions")
    rest = F.col("budget") - F.lit(floor) * count
    best = F.col("_regions")[0]
    filled = F.transform(
        F.col("_regions"),
        lambda r, i: F.struct(
            r["region"].alias("region"),
            r["roi_per_dollar"].alias("predicted_roi_per_dollar"),
            F.when(
                rest >= 0,
                F.lit(floor)
                + F.when((i == 0) & (best["roi_per_dollar"] > 0), rest).otherwise(F.lit(0.0)),
            ).alias("spend"),
        ),
    )
    return (
        requests.withColumn("_regions", ranked)
        .withColumn("status", F.when(rest >= 0, "allocated").otherwise("budget below floors"))
        .withColumn("_filled", filled)
        .select(*requests.columns, "status", F.inline("_filled"))
        .withColumns(
            {
                "allocated_budget": rounded(F.col("spend"), 2),
                "predicted_incremental_revenue": rounded(
                    rounded(F.col("spend"), 2) * F.col("predicted_roi_per_dollar"), 2
                ),
            }
        )
        .drop("spend")
    )


def supplier_offers(offers=SUPPLIER_OFFERS) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("supplier"),
                F.lit(float(cost)).alias("unit_cost"),
                F.lit(float(capacity)).alias("capacity"),
            )
            for name, cost, capacity in offers
        ]
    )


def given_offers(spark: SparkSession, offers=SUPPLIER_OFFERS) -> DataFrame:
    """The offers as a table: ``supplier, unit_cost, capacity``."""
    return spark.createDataFrame(
        [(n, float(c), float(k)) for n, c, k in offers], "supplier string, unit_cost double, capacity double"
    )


def shared_fill(offers: DataFrame, demand: DataFrame) -> DataFrame:
    """Offers whose capacity all regions share: the cheapest first, regions served in name order.

    Both sides are laid end to end by a running sum; what a region takes of an offer is the overlap of
    their stretches. Offers may be many (their sum is taken over slices); the regions are a short list
    and travel as one array. Regions left without any volume have one row without a supplier."""
    supply = running_before(
        offers.withColumn("_capacity", F.col("capacity").cast("decimal(18,2)")),
        [F.col("unit_cost"), F.col("supplier")], {"_from": "_capacity"}, total="_all",
    )
    wanted = demand.select(
        "region", F.col("required_volume").cast("decimal(18,2)").alias("volume")
    ).agg(F.array_sort(F.collect_list(F.struct("region", "volume"))).alias("regions")).scalar()
    zero = F.lit(0).cast("decimal(28,2)")
    # one running total beside each region of the short list
    placed = F.aggregate(
        F.col("_wanted"),
        F.struct(zero.alias("end"), F.array().cast(
            "array<struct<region:string,volume:decimal(18,2),at:decimal(28,2)>>").alias("rows")),
        lambda t, r: F.struct(
            (t["end"] + r["volume"]).cast("decimal(28,2)").alias("end"),
            F.concat(t["rows"], F.array(F.struct(r["region"], r["volume"], t["end"].alias("at")))).alias("rows"),
        ),
    )["rows"]
    start, end = F.col("_from"), F.col("_from") + F.col("_capacity")
    cut = F.transform(
        F.col("_regions"),
        lambda r: F.struct(
            r["region"].alias("region"), r["volume"].cast("double").alias("required_volume"),
            (F.least(end, r["at"] + r["volume"]) - F.greatest(start, r["at"])).cast("double").alias("allocated_volume"),
            F.when(r["at"] + r["volume"] <= F.col("_all"), "served").otherwise("partly served").alias("status"),
        ),
    )
    columns = ["region", "supplier", "unit_cost", "capacity", "required_volume", "status", "allocated_volume"]
    taken = (
        supply.withColumn("_wanted", wanted).withColumn("_regions", placed)
        .select("supplier", "unit_cost", "capacity", F.inline(F.filter(cut, lambda r: r["allocated_volume"] > 0)))
        .select(*columns)
    )
    whole = offers.agg(F.coalesce(F.sum(F.col("capacity").cast("decimal(18,2)")), zero)).scalar()
    short = (
        offers.sparkSession.range(1).select(wanted.alias("_wanted"), whole.alias("_whole"))
        .select(placed.alias("_regions"), "_whole").select("_whole", F.inline("_regions")).where((F.col("at") >= F.col("_whole")) & (F.col("volume") > 0))
        .select(
            "region", F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"),
            F.col("volume").cast("double"), F.lit("unserved"), F.lit(0.0),
        )
    )
    return taken.union(short).withColumn(
        "allocated_cost", F.coalesce(rounded(F.col("allocated_volume") * F.col("unit_cost"), 2), F.lit(0.0))
    )


def offers_from_stock(stock: DataFrame) -> DataFrame:
    """Supplier offers read from the stock table: mean unit cost, units on hand as capacity."""
    return stock.groupBy("region", "supplier").agg(
        rounded(exact_sum(F.col("unit_cost"), 2) / F.count(F.lit(1)), 2).alias("unit_cost"),
        F.sum("units_on_hand").cast("double").alias("capacity"),
    )


def select_suppliers(
    offers: DataFrame, by: Sequence[str], max_share: float = SUPPLIER_SHARE, relax: bool = False
) -> DataFrame:
    """Cheapest offers first, each up to its capacity and its share of the volume.

    ``offers`` holds one row per group and supplier with the group's ``required_volume``. With
    ``relax`` the share limit is lifted for groups that cannot be served under it; groups that
    cannot be served at all are reported as infeasible with no volume.
    """
    by = list(by)
    everyone = Window.partitionBy(*by)
    cheapest = (
        Window.partitionBy(*by)
        .orderBy("unit_cost", "supplier")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    volume = F.col("required_volume")
    capped = F.least(F.col("capacity"), F.lit(max_share) * volume)
    whole = F.least(F.col("capacity"), volume)
    rows = offers.withColumns(
        {"_capped": F.sum(capped).over(everyone), "_whole": F.sum(whole).over(everyone)}
    )
    # a volume that the shares meet exactly must not fail on the last bit of the sum
    meets = lambda total: F.col(total) >= volume - F.lit(1e-6)
    status = F.when(meets("_capped"), "feasible")
    if relax:
        status = status.when(meets("_whole"), "share limit relaxed")
    rows = rows.withColumn("status", status.otherwise("infeasible")).withColumn(
        "_limit",
        F.when(F.col("status") == "feasible", capped)
        .when(F.col("status") == "share limit relaxed", whole)
        .otherwise(F.lit(0.0)),
    )
    before = F.coalesce(F.sum("_limit").over(cheapest), F.lit(0.0))
    taken = F.greatest(F.lit(0.0), F.least(F.col("_limit"), volume - before))
    return (
        rows.withColumn("_taken", taken)
        .withColumns(
            {
                "allocated_volume": rounded(F.col("_taken"), 1),
                "allocated_cost": rounded(F.col("_taken") * F.col("unit_cost"), 2),
                "share_of_total": F.coalesce(
                    rounded(ratio(F.col("_taken"), volume), 3), F.lit(0.0)
                ),
            }
        )
        .drop("_capped", "_whole", "_limit", "_taken")
    )


def scenario_array(scenarios=SCENARIOS) -> Column:
    names = (
        "scenario", "price_change_pct", "inflation_delta_pts",
        "competitor_price_change_pct", "marketing_change_pct", "demand_elasticity",
    )
    return F.array(
        *[
            F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row)])
            for row in scenarios
        ]
    )


def shifted_inputs(rows: DataFrame) -> DataFrame:
    """Add the model inputs that a scenario changes. ``rows`` holds a region's newest month beside
    the scenario's parameters."""
    return rows.withColumns(
        {
            "scenario_inflation_rate_pct": rounded(
                F.col("inflation_rate_pct") + F.col("inflation_delta_pts"), 6
            ),
            "scenario_competitor_price_index": rounded(
                F.col("competitor_price_index")
                * (F.lit(1.0) + F.col("competitor_price_change_pct")),
                6,
            ),
            "scenario_marketing_spend": rounded(
                F.col("marketing_spend") * (F.lit(1.0) + F.col("marketing_change_pct")), 4
            ),
        }
    )


def scenario_inputs(latest: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Each region's newest row under each scenario, with the shifted model inputs beside it."""
    return shifted_inputs(latest.select("*", F.inline(scenario_array(scenarios))))


def scenario_outcome(
    rows: DataFrame,
    base_revenue: Column,
    base_demand: Column,
    model_demand: Column,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Demand, revenue and profit under each scenario against the base, with percent changes.
    ``like_for_like_pct`` compares demand times price on both sides, so no change gives zero."""
    reaction = clip(
        F.lit(1.0)
        + F.col("demand_elasticity") * F.col("price_change_pct")
        + F.lit(CROSS_ELASTICITY) * F.col("competitor_price_change_pct"),
        0.0,
        float("inf"),
    )
    rows = rows.withColumns(
        {
            "_r0": base_revenue,
            "_d0": base_demand,
            "_d1": model_demand * reaction,
            "_p1": F.col("avg_unit_price") * (F.lit(1.0) + F.col("price_change_pct")),
        }
    ).withColumn("_r1", F.col("_d1") * F.col("_p1"))
    change = lambda new, old: rounded(ratio(new - old, old) * 100, 2)
    margin = F.lit(MARGIN_RATE)
    return rows.select(
        "region",
        "scenario",
        "price_change_pct",
        "inflation_delta_pts",
        "competitor_price_change_pct",
        "marketing_change_pct",
        "demand_elasticity",
        rounded(F.col("_r0"), 2).alias("baseline_revenue"),
        rounded(F.col("_d0"), 1).alias("baseline_demand_units"),
        rounded(F.col("_r0") * margin, 2).alias("baseline_profit"),
        rounded(F.col("_r1"), 2).alias("scenario_revenue"),
        rounded(F.col("_d1"), 1).alias("scenario_demand_units"),
        rounded(F.col("_r1") * margin, 2).alias("scenario_profit"),
        change(F.col("_r1"), F.col("_r0")).alias("revenue_pct"),
        change(F.col("_d1"), F.col("_d0")).alias("demand_pct"),
        change(F.col("_r1") * margin, F.col("_r0") * margin).alias("profit_pct"),
        change(F.col("_r1"), F.col("_d0") * F.col("avg_unit_price")).alias("like_for_like_pct"),
        *extra,
    )


def scenario_elastic(latest: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Scenarios with the observed month in place of the model."""
    units = F.col("units_sold").cast("double")
    return scenario_outcome(scenario_inputs(latest, scenarios), F.col("revenue"), units, units)
