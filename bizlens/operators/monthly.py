"""Monthly sales, outside signals, lags and changes per region.

Everything here first aggregates to months. The windows after that run on one row per region and
month, a size set by the calendar and the list of regions, not by the sales.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exact import exact_avg, exact_sum, ratio, rounded
from bizlens.sources.views import OTHER_OPEX_SHARE


def by_region():
    return Window.partitionBy("region").orderBy("month")


def monthly_sales(sales: DataFrame, spend: bool = False) -> DataFrame:
    """Sums of revenue, units and cost, and the unweighted mean unit price. ``spend=True`` also
    carries marketing spend, so that the finance columns need no second pass."""
    extra = [exact_sum(F.col("spend")).alias("marketing_spend")] if spend else []
    return sales.groupBy(F.trunc("date", "month").alias("month"), "region").agg(
        exact_sum(F.col("revenue")).alias("revenue"),
        F.sum("units_sold").alias("units_sold"),
        exact_sum(F.col("cogs")).alias("cogs"),
        rounded(exact_avg(F.col("unit_price"), 8), 6).alias("avg_unit_price"),
        *extra,
    )


def with_pnl(monthly: DataFrame) -> DataFrame:
    """Gross profit, other operating cost and operating income."""
    return monthly.withColumns(
        {
            "gross_profit": rounded(F.col("revenue") - F.col("cogs"), 4),
            "opex_other": rounded(F.col("revenue") * F.lit(OTHER_OPEX_SHARE), 2),
        }
    ).withColumn(
        "operating_income",
        rounded(F.col("gross_profit") - F.col("marketing_spend") - F.col("opex_other"), 4),
    )


def finance_pnl(sales: DataFrame) -> DataFrame:
    return with_pnl(monthly_sales(sales, spend=True)).select(
        "month", "region", "revenue", "cogs", "gross_profit",
        "marketing_spend", "opex_other", "operating_income",
    )


def monthly_signal(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.trunc("date", "month").alias("month"), "region").agg(
        rounded(exact_avg(F.col("avg_temp_c")), 6).alias("avg_temp_c"),
        exact_sum(F.col("precipitation_mm")).alias("total_precip_mm"),
    )


def monthly_price_index(index: DataFrame) -> DataFrame:
    return index.groupBy("month").agg(
        rounded(exact_avg(F.col("competitor_price_index")), 6).alias("competitor_price_index")
    )


def with_time_index(monthly: DataFrame) -> DataFrame:
    """Month number, year and a running month index counted from the first year of all rows."""
    everything = Window.partitionBy()
    return monthly.withColumns(
        {"month_num": F.month("month"), "year": F.year("month")}
    ).withColumn(
        "time_idx", (F.col("year") - F.min("year").over(everything)) * 12 + F.col("month_num")
    )


def with_lags(monthly: DataFrame) -> DataFrame:
    """The two rows before, and the mean of the three before, for revenue and units. The mean is
    NULL until three earlier rows exist."""
    added = {}
    for name in ("revenue", "units_sold"):
        first, second, third = (F.lag(name, n).over(by_region()) for n in (1, 2, 3))
        added[f"{name}_lag1"] = first
        added[f"{name}_lag2"] = second
        added[f"{name}_rolling3"] = (third + second + first) / F.lit(3.0)
    return monthly.withColumns(added)


def monthly_features(
    monthly: DataFrame,
    signal: DataFrame,
    index: DataFrame,
    macro: DataFrame,
    finance: DataFrame | None = None,
) -> DataFrame:
    """The model-ready table: one row per region and month from its second month on. Pass
    ``finance`` when it is a table of its own; leave it out when ``monthly`` carries the columns."""
    df = (
        monthly.withColumn("month_dt", F.col("month"))
        .join(signal, ["month", "region"], "left")
        .join(index, "month", "left")
        .join(macro, "month", "left")
    )
    if finance is not None:
        wanted = finance.select(
            "month", "region", "marketing_spend", "opex_other", "operating_income"
        )
        df = df.join(wanted, ["month", "region"], "left")
    return (
        with_time_index(with_lags(df))
        .dropna(subset=["revenue_lag1"])
        .select(
            "month", "region", "revenue", "units_sold", "cogs", "avg_unit_price", "month_dt",
            "avg_temp_c", "total_precip_mm", "competitor_price_index",
            "market_sentiment_score", "inflation_rate_pct",
            "marketing_spend", "opex_other", "operating_income",
            "revenue_lag1", "revenue_lag2", "revenue_rolling3",
            "units_sold_lag1", "units_sold_lag2", "units_sold_rolling3",
            "month_num", "year", "time_idx",
        )
    )


def latest_month(monthly: DataFrame) -> DataFrame:
    """The newest row per region, by aggregation instead of a sort."""
    others = [c for c in monthly.columns if c != "region"]
    return (
        monthly.groupBy("region")
        .agg(F.max_by(F.struct(*others), F.col("month")).alias("row"))
        .select("region", "row.*")
    )


def month_over_month(monthly: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Newest month, the row before it (itself if there is none) and the change in percent.
    ``extra`` columns are taken from the newest month."""
    backwards = Window.partitionBy("region").orderBy(F.col("month").desc())
    return (
        monthly.withColumns(
            {
                "prior_month_revenue": F.coalesce(
                    F.lag("revenue").over(by_region()), F.col("revenue")
                ),
                "_place": F.row_number().over(backwards),
            }
        )
        .filter("_place = 1")
        .select(
            "region",
            F.col("month").alias("latest_month"),
            rounded(F.col("revenue"), 2).alias("revenue"),
            rounded(F.col("prior_month_revenue"), 2).alias("prior_month_revenue"),
            rounded(
                ratio(
                    F.col("revenue") - F.col("prior_month_revenue"), F.col("prior_month_revenue")
                )
                * 100,
                2,
            ).alias("month_over_month_change_pct"),
            "units_sold",
            *extra,
        )
    )


def year_over_year(monthly: DataFrame) -> DataFrame:
    """Every month beside the same month a year earlier, where there is one."""
    earlier = monthly.select(
        "region",
        F.add_months("month", 12).alias("month"),
        F.col("revenue").alias("year_ago_revenue"),
    )
    return monthly.join(earlier, ["region", "month"], "left").select(
        "region",
        "month",
        rounded(F.col("revenue"), 2).alias("revenue"),
        rounded(F.col("year_ago_revenue"), 2).alias("year_ago_revenue"),
        rounded(
            ratio(F.col("revenue") - F.col("year_ago_revenue"), F.col("year_ago_revenue")) * 100, 2
        ).alias("year_over_year_change_pct"),
    )


def last_rows(monthly: DataFrame, rows: int = 6) -> DataFrame:
    """The newest ``rows`` months of each region, with the place counted from the oldest."""
    backwards = Window.partitionBy("region").orderBy(F.col("month").desc())
    return (
        monthly.withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= rows)
        .withColumn("step", F.row_number().over(by_region()))
        .drop("_back")
    )


def trend_long(trend: DataFrame) -> DataFrame:
    """Chart form: one row per region, month and series."""
    return trend.select(
        "region", "month", "revenue", F.col("units_sold").cast("double").alias("units_sold")
    ).unpivot(["region", "month"], ["revenue", "units_sold"], "series", "value")


def marketing_roi(monthly: DataFrame, months: int = 6) -> DataFrame:
    """Revenue per unit of spend over the newest months; 1.0 where nothing was spent."""
    return (
        last_rows(monthly, months)
        .groupBy("region")
        .agg(
            exact_sum(F.col("revenue")).alias("revenue_sum"),
            exact_sum(F.col("marketing_spend")).alias("marketing_spend_sum"),
        )
        .withColumn(
            "roi_per_dollar",
            F.when(
                F.col("marketing_spend_sum") > 0,
                rounded(ratio(F.col("revenue_sum"), F.col("marketing_spend_sum")), 6),
            ).otherwise(F.lit(1.0)),
        )
    )


def region_only(df: DataFrame, region: str | None) -> DataFrame:
    """No region means all rows."""
    return df if region is None else df.filter(F.col("region") == region)


def one_hot(df: DataFrame, column: str, categories) -> DataFrame:
    """One 0/1 column per listed category. The list is fixed when the model is fitted, so scoring
    new rows cannot change the columns."""
    return df.withColumns(
        {f"{column}_{c}": (F.col(column) == c).cast("int") for c in categories}
    )
