"""Business tables as views over the base tables.

A view keeps the column names of the business table it stands for. ``sales`` comes in three widths,
because an inner join on a foreign key drops no rows but still costs a shuffle: callers that need
no product attributes skip ``part``, callers that need no region skip ``orders`` and ``customer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.functions.exact import exact_avg, exact_sum, flag, rounded
from bizlens.functions.questions import SAMPLE_QUESTIONS
from bizlens.session import light_side
from bizlens.sources.tables import table

# Contract lengths and lead times taken in turn by key.
CONTRACT_MONTHS = (1, 12, 24, 36)
LEAD_DAYS = (7, 14, 21, 30)
# Share of revenue booked as other operating cost, cost share of retail price.
OTHER_OPEX_SHARE = 0.12
UNIT_COST_SHARE = 0.6


def _pick(key: Column, options) -> Column:
    chosen = F.lit(options[-1])
    for place, option in reversed(list(enumerate(options[:-1]))):
        chosen = F.when(key % len(options) == place, option).otherwise(chosen)
    return chosen.cast("long")


def line_measures(lines: DataFrame, *more: str) -> DataFrame:
    """Per-line money columns plus the keys needed for joins and the columns ``more``. Prices are whole cents and rates
    whole percents, so the products are exact in integers and are divided once."""
    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    discount = F.rint(F.col("l_discount") * 100).cast("long")
    tax = F.rint(F.col("l_tax") * 100).cast("long")
    return lines.select(
        "l_orderkey",
        F.col("l_partkey").alias("sku"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("long").alias("units_sold"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (cents * (100 - discount) / F.lit(1e4)).alias("revenue"),
        (cents * (55 + tax) / F.lit(1e4)).alias("cogs"),
        (cents * tax / F.lit(1e4)).alias("spend"),
        *more,
    )


def trailing(df: DataFrame, column: str, days: int) -> DataFrame:
    """Rows within ``days`` of the newest one. The bound is a scalar subquery on the bare column,
    so it reaches the Parquet scan."""
    kind = df.schema[column].dataType
    bound = df.select(F.date_sub(F.max(column).cast("date"), days).cast(kind)).scalar()
    return df.filter(F.col(column) >= bound)


def customer_regions(spark: SparkSession, path: str) -> DataFrame:
    return (
        table(spark, path, "customer")
        .join(table(spark, path, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumnRenamed("r_name", "region")
    )


def order_regions(spark: SparkSession, path: str) -> DataFrame:
    places = customer_regions(spark, path).select("c_custkey", "region")
    places = light_side(places, table(spark, path, "customer"))
    return table(spark, path, "orders").join(places, F.col("o_custkey") == F.col("c_custkey"))


def sales_by_product(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """Sale lines without region, optionally only the trailing days."""
    lines = table(spark, path, "lineitem")
    if days is not None:
        lines = trailing(lines, "l_shipdate", days)
    return line_measures(lines).drop("l_orderkey")


def sales_by_region(spark: SparkSession, path: str) -> DataFrame:
    """Sale lines with region and channel, without product attributes. Orders get their region
    first, so that the lines, by far the largest table, are shuffled once. They travel with their
    stored columns; the money columns are wider and are worked out behind the join."""
    orders = order_regions(spark, path).select(
        "o_orderkey", "region", F.col("o_orderpriority").alias("channel")
    )
    orders = light_side(orders, table(spark, path, "orders"))
    lines = table(spark, path, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return line_measures(lines, "region", "channel").drop("l_orderkey")


def products(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "part").select(
        F.col("p_partkey").alias("sku"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("list_price"),
    )


def sales(spark: SparkSession, path: str) -> DataFrame:
    """The full sales table."""
    return (
        sales_by_region(spark, path)
        .join(products(spark, path).drop("list_price"), "sku")
        .select(
            "date", "region", "channel", "sku", "product_name", "category",
            "units_sold", "unit_price", "revenue", "cogs", "spend",
        )
    )


def signal_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily outside signal per region, in the place of weather."""
    return (
        order_regions(spark, path)
        .groupBy(F.col("o_orderdate").cast("date").alias("date"), "region")
        .agg(
            rounded(exact_avg(F.col("o_totalprice")) / F.lit(10000.0), 4).alias("avg_temp_c"),
            F.count(F.lit(1)).cast("double").alias("precipitation_mm"),
        )
    )


def price_index(spark: SparkSession, path: str) -> DataFrame:
    """Monthly mean unit price of a category against its all-time mean, times 100."""
    category = table(spark, path, "part").select(
        F.col("p_partkey").alias("sku"), F.col("p_type").alias("category")
    )
    monthly = (
        sales_by_product(spark, path)
        .select("sku", F.trunc("date", "month").alias("month"), "revenue", "units_sold")
        .join(category, "sku")
        .groupBy("month", "category")
        .agg(exact_sum(F.col("revenue")).alias("_revenue"), F.sum("units_sold").alias("_units"))
    )
    ever = Window.partitionBy("category")
    here = F.col("_revenue") / F.col("_units")
    total = F.sum(F.col("_revenue").cast("decimal(28,4)")).over(ever).cast("double")
    mean = total / F.sum("_units").over(ever)
    return monthly.select(
        "month", "category", rounded(F.lit(100.0) * here / mean, 4).alias("competitor_price_index")
    )


def macro(spark: SparkSession, path: str) -> DataFrame:
    """One row per order month: sentiment from order status, inflation from urgency."""
    share = lambda condition: F.sum(flag(condition)) / F.count(F.lit(1))
    balance = F.sum(flag(F.col("o_orderstatus") == "F")) - F.sum(
        flag(F.col("o_orderstatus") == "P")
    )
    return (
        table(spark, path, "orders")
        .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
        .agg(
            rounded(balance / F.count(F.lit(1)), 3).alias("market_sentiment_score"),
            rounded(
                F.lit(2.0) + F.lit(10.0) * share(F.col("o_orderpriority") == "1-URGENT"), 2
            ).alias("inflation_rate_pct"),
        )
    )


def crm(spark: SparkSession, path: str) -> DataFrame:
    """One row per customer with orders. The orders are pre-aggregated per customer before the
    join, so a customer with very many orders costs one row there."""
    orders = table(spark, path, "orders")
    as_of = orders.select(F.max("o_orderdate").cast("date")).scalar()
    day = F.col("o_orderdate").cast("date")
    recent = day >= F.date_sub(F.col("as_of"), 365)
    stats = (
        orders.withColumn("as_of", as_of)
        .groupBy(F.col("o_custkey").alias("customer_id"), "as_of")
        .agg(
            F.min(day).alias("signup_date"),
            F.max(day).alias("last_order"),
            F.sum(flag(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")))
            .alias("support_tickets_last_year"),
            rounded(exact_avg(F.col("o_totalprice")), 2).alias("avg_order_value"),
            F.sum(flag(recent)).alias("orders_last_year"),
            F.sum(flag(recent & (F.col("o_orderstatus") == "P")))
            .alias("late_payments_last_year"),
        )
    )
    people = customer_regions(spark, path).select(
        F.col("c_custkey").alias("customer_id"),
        "region",
        F.col("c_mktsegment").alias("segment"),
        "c_acctbal",
    )
    return people.join(stats, "customer_id").select(
        "customer_id",
        "region",
        "segment",
        "signup_date",
        _pick(F.col("customer_id"), CONTRACT_MONTHS).alias("contract_length_months"),
        F.datediff("as_of", "signup_date").cast("long").alias("tenure_days"),
        "support_tickets_last_year",
        rounded(
            F.lit(1.0) + F.lit(9.0) * (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0), 3
        ).alias("satisfaction_score"),
        "avg_order_value",
        "orders_last_year",
        ((F.col("customer_id") % 20) / F.lit(100.0)).alias("discount_pct"),
        "late_payments_last_year",
        flag(F.col("last_order") < F.date_sub("as_of", 180)).alias("churned"),
    )


def demand(spark: SparkSession, path: str) -> DataFrame:
    """Mean units per sale row for each region and product."""
    return (
        sales_by_region(spark, path)
        .groupBy("region", "sku")
        .agg(F.avg("units_sold").alias("mean_units"))
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Stock position per region and product."""
    rows = demand(spark, path).join(products(spark, path), "sku")
    lead = _pick(F.col("sku"), LEAD_DAYS)
    rows = rows.withColumn("supplier_lead_time_days", lead)
    need = F.col("mean_units") * F.col("supplier_lead_time_days")
    return rows.select(
        "region",
        "sku",
        "product_name",
        "category",
        ((F.col("sku") * 37 + F.length("region") * 11) % 1500).alias("units_on_hand"),
        "supplier_lead_time_days",
        F.col("mean_units").alias("avg_daily_demand"),
        (need * F.lit(0.5)).alias("safety_stock"),
        (need * F.lit(1.5)).alias("reorder_point"),
        F.concat(F.lit("SUP-"), (F.col("sku") % 4).cast("string")).alias("supplier"),
        rounded(F.col("list_price") * F.lit(UNIT_COST_SHARE), 2).alias("unit_cost"),
    )


def questions(spark: SparkSession, path: str) -> DataFrame:
    """The question log: the sample questions and every user turn of the conversations."""
    samples = F.array(
        *[
            F.struct(F.lit(f"sample-{n:02d}").alias("question_id"), F.lit(text).alias("question"))
            for n, text in enumerate(SAMPLE_QUESTIONS, 1)
        ]
    )
    fixed = spark.range(1).select(F.inline(samples))
    log = (
        table(spark, path, "conversations")
        .filter(F.col("role") == "user")
        .select(
            F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("question_id"),
            F.col("text").alias("question"),
        )
    )
    return fixed.unionByName(log)
