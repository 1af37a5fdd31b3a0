"""Base tables and the schemas of the seven business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Column names and types of the business tables.
SCHEMAS = {
    "sales_transactions": (
        "date date, region string, channel string, sku string, product_name string, "
        "category string, units_sold long, unit_price double, revenue double, cogs double"
    ),
    "finance_statements": (
        "month date, region string, revenue double, cogs double, gross_profit double, "
        "marketing_spend double, opex_other double, operating_income double"
    ),
    "crm_customers": (
        "customer_id string, region string, segment string, signup_date date, "
        "contract_length_months long, tenure_days long, support_tickets_last_year long, "
        "satisfaction_score double, avg_order_value double, orders_last_year long, "
        "discount_pct double, late_payments_last_year long, churned int"
    ),
    "erp_inventory": (
        "region string, sku string, product_name string, category string, "
        "units_on_hand long, supplier_lead_time_days long, avg_daily_demand double, "
        "safety_stock double, reorder_point double, supplier string, unit_cost double"
    ),
    "weather_daily": "date date, region string, avg_temp_c double, precipitation_mm double",
    "competitor_prices": "month date, category string, competitor_price_index double",
    "market_news_sentiment": (
        "month date, market_sentiment_score double, inflation_rate_pct double"
    ),
}


_seen: dict[str, StructType] = {}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A base table. Its schema is read from the files once and then reused, which saves a footer
    job on every later use."""
    file = f"{path}/{name}.parquet"
    if file not in _seen:
        _seen[file] = spark.read.parquet(file).schema
    return spark.read.schema(_seen[file]).parquet(file)
