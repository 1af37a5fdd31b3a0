import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.operators import monthly as m


def month(n):
    return dt.date(2024, 1, 1) if n == 0 else (pd.Timestamp(2024, 1, 1) + pd.DateOffset(months=n)).date()


@pytest.fixture(scope="module")
def series(spark):
    rows = [
        (region, month(n), float(100 * (n + 1)), 10 * (n + 1), 50.0, 5.0)
        for region, length in (("one", 1), ("two", 2), ("three", 3), ("four", 4), ("long", 14))
        for n in range(length)
    ]
    return spark.createDataFrame(
        rows,
        "region string, month date, revenue double, units_sold long, cogs double, "
        "marketing_spend double",
    )


def test_lags_and_rolling_mean_start_null(series):
    rows = {(r.region, r.month): r for r in m.with_lags(series).collect()}
    assert rows["one", month(0)].revenue_lag1 is None
    assert rows["three", month(2)].revenue_lag2 == 100.0
    assert rows["three", month(2)].revenue_rolling3 is None
    assert rows["four", month(3)].revenue_rolling3 == 200.0
    assert rows["four", month(3)].units_sold_rolling3 == 20.0


def test_month_over_month_of_a_single_month_is_zero(series):
    rows = {r.region: r for r in m.month_over_month(series).collect()}
    assert rows["one"].month_over_month_change_pct == 0.0
    assert rows["two"].month_over_month_change_pct == 100.0


def test_year_over_year_needs_the_same_month(series):
    rows = {(r.region, r.month): r for r in m.year_over_year(series).collect()}
    assert rows["long", month(12)].year_over_year_change_pct == 1200.0
    assert rows["long", month(11)].year_ago_revenue is None


def test_time_index_counts_from_the_first_year(series):
    rows = {(r.region, r.month): r.time_idx for r in m.with_time_index(series).collect()}
    assert rows["one", month(0)] == 1
    assert rows["long", month(13)] == 14


def test_feature_rows_drop_only_the_first_month(spark, series):
    empty_signal = spark.createDataFrame(
        [], "month date, region string, avg_temp_c double, total_precip_mm double"
    )
    index = spark.createDataFrame([], "month date, competitor_price_index double")
    macro = spark.createDataFrame(
        [], "month date, market_sentiment_score double, inflation_rate_pct double"
    )
    finance = series.select(
        "month", "region", "marketing_spend", F.lit(1.0).alias("opex_other"),
        F.lit(2.0).alias("operating_income"),
    )
    full = series.drop("marketing_spend").withColumn("avg_unit_price", F.lit(1.0))
    out = m.monthly_features(full, empty_signal, index, macro, finance)
    assert len(out.columns) == 24
    assert out.count() == 24 - 5
    assert out.filter("avg_temp_c IS NOT NULL").count() == 0


def test_return_is_one_without_spend(spark, series):
    free = series.withColumn("marketing_spend", F.lit(0.0))
    assert {r.roi_per_dollar for r in m.marketing_roi(free).collect()} == {1.0}


def test_monthly_sales_of_the_csv_shape(spark):
    sales = spark.createDataFrame(
        [
            (dt.date(2024, 1, 3), "a", 2, 10.0, 20.0, 12.0),
            (dt.date(2024, 1, 9), "a", 1, 13.0, 13.0, 8.0),
            (dt.date(2024, 2, 1), "a", 4, 10.0, 40.0, 24.0),
        ],
        "date date, region string, units_sold long, unit_price double, revenue double, cogs double",
    )
    first = m.monthly_sales(sales).orderBy("month").first()
    assert (first.revenue, first.units_sold, first.cogs, first.avg_unit_price) == (33.0, 3, 20.0, 11.5)
