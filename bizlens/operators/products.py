"""Product performance and discontinuation candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.exact import exact_sum, ratio, rounded
from bizlens.functions.ordered import average_rank, exact_quantile
from bizlens.session import pinned


def sku_performance(sales: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Revenue, units, cost and margin share per product. With ``names`` the lines are summed per
    product first and only the sums are joined."""
    keys = ["sku"] if names is not None else ["sku", "product_name", "category"]
    sums = sales.groupBy(*keys).agg(
        exact_sum(F.col("revenue")).alias("revenue"),
        F.sum("units_sold").alias("units"),
        exact_sum(F.col("cogs")).alias("cogs"),
    )
    if names is not None:
        sums = sums.join(names.select("sku", "product_name", "category"), "sku")
    return sums.select(
        "sku", "product_name", "category", "revenue", "units", "cogs",
        rounded(ratio(F.col("revenue") - F.col("cogs"), F.col("revenue")), 6)
        .alias("gross_margin_pct"),
    )


def ranked(performance: DataFrame) -> DataFrame:
    return average_rank(performance, "revenue", "revenue_rank")


def discontinue_candidates(
    performance: DataFrame, rank_fraction: float = 0.7, margin_fraction: float = 0.5
) -> DataFrame:
    """Products past the 0.7 quantile of the revenue rank with a margin below the median."""
    rows = pinned(ranked(performance))
    rank_bound = exact_quantile(rows, "revenue_rank", rank_fraction, "bound").scalar()
    margin_bound = exact_quantile(rows, "gross_margin_pct", margin_fraction, "bound").scalar()
    return rows.filter(
        (F.col("revenue_rank") > rank_bound) & (F.col("gross_margin_pct") < margin_bound)
    ).select(
        "sku", "product_name", "category", "revenue", "units", "cogs",
        "gross_margin_pct", "revenue_rank",
    )
