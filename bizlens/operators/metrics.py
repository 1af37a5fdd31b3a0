"""Model quality: regression and classification measures, AUC, exact splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.exact import exact_sum, ratio, rounded
from bizlens.functions.ordered import running_before


def regression_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MAPE and R² of ``prediction`` against ``actual``, in one aggregation over the pairs
    without a NULL (``rows`` counts those). The total sum of squares is a central moment, so nothing
    cancels; sums are doubles, so no amount is too large, and the results are rounded."""
    error = F.col("actual") - F.col("prediction")
    actual = F.when(error.isNotNull(), F.col("actual"))
    n = F.count(error)
    return (
        rows.groupBy(*by)
        .agg(
            n.alias("rows"),
            rounded(ratio(F.sum(F.abs(error)), n), 4).alias("mae"),
            rounded(ratio(F.sum(ratio(F.abs(error), F.abs(actual))), n), 6).alias("mape"),
            F.sum(error * error).alias("_residual"),
            (F.var_pop(actual) * n).alias("_total"),
        )
        .withColumn("r2", rounded(F.lit(1.0) - ratio(F.col("_residual"), F.col("_total")), 6))
        .drop("_residual", "_total")
    )


def classification_metrics(
    rows: DataFrame, by: Sequence[str] = (), cut: float = 0.5
) -> DataFrame:
    """Precision, recall and F1 of ``probability >= cut`` against the 0/1 ``label``."""
    said, truth = F.col("probability") >= cut, F.col("label") == 1
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(said & truth).alias("true_positives"),
        F.count_if(said & ~truth).alias("false_positives"),
        F.count_if(~said & truth).alias("false_negatives"),
    )
    tp, fp, fn = (
        F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives")
    )
    nought = lambda c: F.coalesce(rounded(c, 6), F.lit(0.0))
    return counts.withColumns(
        {
            "precision": nought(ratio(tp, tp + fp)),
            "recall": nought(ratio(tp, tp + fn)),
            "f1": nought(ratio(2 * tp, 2 * tp + fp + fn)),
        }
    )


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks. Rows are first reduced to one per distinct score."""
    scores = rows.groupBy("probability").agg(
        F.count_if(F.col("label") == 1).alias("_pos"),
        F.count_if(F.col("label") == 0).alias("_neg"),
    )
    placed = running_before(scores, [F.col("probability").asc()], {"_below": "_neg"})
    won = F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0))
    return placed.agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.sum(won.cast("decimal(28,1)")).cast("double").alias("_won"),
    ).select(
        "positives",
        "negatives",
        rounded(
            ratio(F.col("_won"), F.col("positives").cast("double") * F.col("negatives")), 6
        ).alias("auc"),
    )


def split_rows(
    df: DataFrame, key: str, by: Sequence[str] = (), fraction: float = 0.2
) -> DataFrame:
    """Mark exactly ``ceil(fraction * n)`` rows of each group as test rows, in the order of the
    key's hash. The same rows come out on every run and any cluster."""
    rows = df.withColumns({"_hash": F.md5(F.col(key).cast("string")), "_one": F.lit(1)})
    tests = F.ceil(F.col("_n") * F.lit(str(fraction)).cast("decimal(10,6)")).cast("long")
    order = [F.col("_hash"), F.col(key)]
    return (
        running_before(rows, order, {"_place": "_one"}, by=by, total="_n", cut=tests)
        .withColumn("is_test", (F.col("_place") < tests).cast("int"))
        .drop("_hash", "_one", "_n", "_place")
    )


def split_counts(split: DataFrame, label: str) -> DataFrame:
    return split.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("rows"),
        rounded(F.sum(label).cast("double") / F.count(F.lit(1)), 6).alias("label_rate"),
    )


def confidence_label(r2: Column, auc_value: Column) -> Column:
    score = F.coalesce(r2, auc_value)
    return (
        F.when(score.isNull(), "Unknown")
        .when(score >= 0.85, "High")
        .when(score >= 0.7, "Medium")
        .otherwise("Low")
    )


def mean_absolute(attribution: DataFrame, top: int = 8) -> DataFrame:
    """Features by mean absolute contribution, the largest first."""
    return (
        attribution.groupBy("feature")
        .agg(
            rounded(
                exact_sum(F.abs(F.col("contribution")), 6) / F.count(F.lit(1)), 6
            ).alias("mean_abs_contribution")
        )
        .orderBy(F.col("mean_abs_contribution").desc(), "feature")
        .limit(top)
    )
