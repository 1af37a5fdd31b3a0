"""Customer features, the linear scorecard, and churn reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exact import exact_sum, flag, rounded

# Intercept and weights of the churn scorecard.
INTERCEPT = -1.6
WEIGHTS = {
    "low_satisfaction": 1.7,
    "high_risk_tickets": 1.5,
    "short_contract": 1.3,
    "late_payments": 1.0,
    "few_orders": 0.9,
    "enterprise": -0.7,
    "tenure_years": -0.4,
    "dissatisfaction": 0.15,
}
# Expected growth and the value lost with a churned customer.
VALUE_GROWTH = 1.05
CHURN_LOSS = 0.5
# Upper edges and labels of the probability buckets.
BUCKETS = ((0.2, "0%-20%"), (0.4, "20%-40%"), (0.6, "40%-60%"), (0.8, "60%-80%"), (1.0, "80%-100%"))
HIGH_RISK = 0.6
MEDIUM_RISK = 0.3


def customer_features(crm: DataFrame) -> DataFrame:
    return crm.withColumns(
        {
            "orders_per_month": F.col("orders_last_year") / F.lit(12.0),
            "is_high_risk_tickets": flag(F.col("support_tickets_last_year") > 5),
            "is_short_contract": flag(F.col("contract_length_months") <= 1),
            "revenue_last_year_est": rounded(
                F.col("avg_order_value") * F.col("orders_last_year"), 2
            ),
        }
    )


def value_label(features: DataFrame) -> DataFrame:
    """Twelve-month value used as training label: growth, halved for churned customers."""
    return features.withColumn(
        "clv_12mo",
        rounded(
            F.col("revenue_last_year_est")
            * F.lit(VALUE_GROWTH)
            * (F.lit(1.0) - F.lit(CHURN_LOSS) * F.col("churned")),
            2,
        ),
    )


def scorecard_terms(enterprise: str = "Enterprise") -> dict[str, Column]:
    return {
        "low_satisfaction": flag(F.col("satisfaction_score") < 6),
        "high_risk_tickets": flag(F.col("support_tickets_last_year") > 5),
        "short_contract": flag(F.col("contract_length_months") == 1),
        "late_payments": flag(F.col("late_payments_last_year") > 1),
        "few_orders": flag(F.col("orders_last_year") < 2),
        "enterprise": flag(F.col("segment") == enterprise),
        "tenure_years": F.col("tenure_days") / F.lit(365.0),
        "dissatisfaction": F.lit(10.0) - F.col("satisfaction_score"),
    }


def scorecard(features: DataFrame, enterprise: str = "Enterprise") -> DataFrame:
    """Churn probability from the weighted terms, to 3 places."""
    logit = F.lit(INTERCEPT)
    for name, term in scorecard_terms(enterprise).items():
        logit = logit + F.lit(WEIGHTS[name]) * term
    return features.withColumn("logit", rounded(logit, 9)).withColumn(
        "churn_probability", rounded(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("logit"))), 3)
    )


def scorecard_factors(features: DataFrame, enterprise: str = "Enterprise") -> Column:
    """Per customer and term, weight times the distance from the population mean, as one array. For a
    linear score this is the exact additive attribution. The means are one scalar row."""
    terms = scorecard_terms(enterprise)
    means = features.agg(
        F.struct(
            *[
                (exact_sum(rounded(term, 9), 9) / F.count(F.lit(1))).alias(name)
                for name, term in terms.items()
            ]
        ).alias("means")
    ).scalar()
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                term.cast("double").alias("value"),
                rounded(
                    F.lit(WEIGHTS[name]) * (term - means.getField(name)), 6
                ).alias("contribution"),
            )
            for name, term in terms.items()
        ]
    )


def scorecard_attribution(features: DataFrame, enterprise: str = "Enterprise") -> DataFrame:
    """Long form: a row per customer and term."""
    return features.withColumn("_factors", scorecard_factors(features, enterprise)).select(
        "customer_id", F.inline("_factors")
    )


def strongest_drivers(factors: Column, top: int = 3) -> Column:
    """``name (+0.12); name (-0.05)`` for the strongest of an array of contributions, in the row."""
    by_size = F.transform(
        factors,
        lambda f: F.struct(
            (-F.abs(f["contribution"])).alias("size"), f["feature"].alias("feature"),
            f["contribution"].alias("contribution"),
        ),
    )
    return driver_phrases(F.slice(F.array_sort(by_size), 1, top))


def driver_phrases(strongest: Column) -> Column:
    return F.array_join(
        F.transform(
            strongest,
            lambda s: F.format_string(
                "%s (%s%.2f)",
                s["feature"],
                F.when(s["contribution"] > 0, "+").otherwise("-"),
                rounded(F.abs(s["contribution"]), 2),
            ),
        ),
        "; ",
    )


def scored_customers(features: DataFrame, enterprise: str = "Enterprise", drivers: bool = False) -> DataFrame:
    """Probability and expected value per customer, from the scorecard; with ``drivers``, the three
    strongest contributions in words. One pass over the customers."""
    rows = scorecard(features, enterprise)
    if drivers:
        rows = rows.withColumn("_factors", scorecard_factors(features, enterprise))
    return rows.select(
        "customer_id",
        "region",
        "segment",
        "churn_probability",
        rounded(
            F.col("revenue_last_year_est")
            * F.lit(VALUE_GROWTH)
            * (F.lit(1.0) - F.lit(CHURN_LOSS) * F.col("churn_probability")),
            2,
        ).alias("predicted_clv_12mo"),
        *([strongest_drivers(F.col("_factors")).alias("top_churn_drivers")] if drivers else []),
    )


def risk_tier(probability: Column) -> Column:
    return (
        F.when(probability > HIGH_RISK, "High")
        .when(probability > MEDIUM_RISK, "Medium")
        .otherwise("Low")
    )


def churn_summary(scores: DataFrame, buckets: bool = False) -> DataFrame:
    """Counts, mean probability and value at risk, for every region and for all of them, and on
    request the bucket counts as columns."""
    high = F.col("churn_probability") > HIGH_RISK
    bucket = bucket_of(F.col("churn_probability"))
    counts = [
        F.count_if(bucket == place).alias(f"bucket_{place}")
        for place in range(1, len(BUCKETS) + 1)
    ]
    return (
        scores.rollup("region")
        .agg(
            F.count(F.lit(1)).alias("customers_analyzed"),
            F.count_if(high).alias("high_risk_count"),
            rounded(
                exact_sum(F.col("churn_probability"), 3) / F.count(F.lit(1)), 3
            ).alias("avg_churn_probability"),
            F.coalesce(
                exact_sum(F.when(high, F.col("predicted_clv_12mo")), 2), F.lit(0.0)
            ).alias("clv_at_risk"),
            *(counts if buckets else []),
        )
        .withColumn("region", F.coalesce("region", F.lit("ALL")))
    )


def bucket_of(probability: Column) -> Column:
    """Right-closed buckets; the first also takes zero."""
    bucket = F.lit(len(BUCKETS))
    for place, (edge, _) in reversed(list(enumerate(BUCKETS[:-1], 1))):
        bucket = F.when(probability <= edge, place).otherwise(bucket)
    return bucket


def churn_histogram(scores: DataFrame) -> DataFrame:
    """Customers per region and bucket; empty buckets are kept with 0. The counts are one
    conditional aggregate each, unfolded afterwards, so no bucket table is joined."""
    counts = scores.groupBy("region").agg(
        *[
            F.count_if(bucket_of(F.col("churn_probability")) == place).alias(f"b{place}")
            for place in range(1, len(BUCKETS) + 1)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(place).alias("bucket_no"),
                F.lit(label).alias("bucket"),
                F.col(f"b{place}").alias("customers"),
            )
            for place, (_, label) in enumerate(BUCKETS, 1)
        ]
    )
    return counts.select("region", F.inline(rows))


def top_by_region(scores: DataFrame, rows: int = 10, whole: str = "ALL") -> DataFrame:
    """``scope, place`` and the score columns: the riskiest customers of every region, and of all.
    Tasks keep ``rows`` rows per region before anything is shuffled; the overall list comes from
    those of the regions."""
    order = [F.col("churn_probability").desc(), F.col("customer_id")]

    def best(frame: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("scope").orderBy(*order))
        return frame.withColumn("place", place.cast("long")).filter(F.col("place") <= rows)

    own = best(scores.withColumn("scope", F.col("region")))
    every = best(own.withColumn("scope", F.lit(whole)))
    return own.unionByName(every).select("scope", "place", *scores.columns)


def top_at_risk(scores: DataFrame, rows: int = 10) -> DataFrame:
    return scores.orderBy(F.col("churn_probability").desc(), "customer_id").limit(rows)
