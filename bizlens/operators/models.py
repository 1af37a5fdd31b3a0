"""Boosted-tree forecasts, churn and customer value: fit, score, save, load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.operators.metrics import auc, classification_metrics, regression_metrics
from bizlens.operators.monthly import one_hot
from bizlens.session import pinned, shared_folder

# Model input columns.
FORECAST_FEATURES = (
    "revenue_lag1", "revenue_lag2", "revenue_rolling3",
    "units_sold_lag1", "units_sold_lag2", "units_sold_rolling3",
    "avg_temp_c", "total_precip_mm", "competitor_price_index",
    "market_sentiment_score", "inflation_rate_pct",
    "marketing_spend", "month_num", "time_idx",
)
CHURN_FEATURES = (
    "tenure_days", "contract_length_months", "support_tickets_last_year",
    "satisfaction_score", "avg_order_value", "orders_last_year", "discount_pct",
    "late_payments_last_year", "is_high_risk_tickets", "is_short_contract",
)
VALUE_FEATURES = (*CHURN_FEATURES, "revenue_last_year_est")
# Trees, depth, learning rate, row sample, seed.
FORECAST_TREES, FORECAST_RATE = 250, 0.06
CUSTOMER_TREES, CUSTOMER_RATE = 200, 0.08
DEPTH, ROW_SAMPLE, SEED = 4, 0.9, 42
MISSING = -1.0e9
# Training rows of a task: every level of a tree is a job over all partitions.
FIT_ROWS = 50_000


@dataclass
class FittedModel:
    """A fitted pipeline with its input columns, so scoring always builds the same ones."""

    pipeline: PipelineModel
    numeric: Sequence[str]
    categories: dict[str, Sequence[str]] = field(default_factory=dict)
    classifier: bool = False

    @property
    def inputs(self) -> list[str]:
        return input_columns(self.numeric, self.categories)

    @property
    def trees(self):
        return self.pipeline.stages[-1]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (a number, or the probability of class 1) and the inputs."""
        # rows that another model has scored bring its inputs along
        plain = df.drop(*[f"x_{c}" for c in self.numeric])
        out = self.pipeline.transform(encoded(plain, self.categories))
        if self.classifier:
            out = out.withColumn("prediction", vector_to_array("probability")[1])
        return out.drop("features", "rawPrediction", "probability", *missing_flags(self.numeric))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, numeric, categories, classifier=False) -> "FittedModel":
        return cls(PipelineModel.load(path), numeric, categories, classifier)


def input_columns(numeric: Sequence[str], categories: dict[str, Sequence[str]]) -> list[str]:
    return [f"x_{c}" for c in numeric] + [
        f"{column}_{value}" for column, values in categories.items() for value in values
    ]


def missing_flags(numeric: Sequence[str]) -> list[str]:
    return [f"missing_{c}" for c in numeric]


def missing_stage(numeric: Sequence[str]) -> SQLTransformer:
    """The policy for missing values as a stage that is saved with the model: ``x_<name>`` holds the
    value, or for a missing one a far-off number that a tree can split away, and ``missing_<name>``
    is 1 where it was missing."""
    columns = ", ".join(
        f"coalesce(cast(`{c}` as double), {MISSING}D) AS `x_{c}`, "
        f"cast(`{c}` IS NULL as int) AS `missing_{c}`"
        for c in numeric
    )
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def missing_inputs(df: DataFrame, keys: Sequence[str], stage: SQLTransformer, numeric: Sequence[str]) -> DataFrame:
    """Long form of what the stage makes of every row: ``keys, feature, value, missing``."""
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"x_{c}").alias("value"), F.col(f"missing_{c}").alias("missing"))
            for c in numeric
        ]
    )
    return stage.transform(df).select(*keys, F.inline(entries))


def encoded(df: DataFrame, categories) -> DataFrame:
    """Each category becomes its own 0/1 column."""
    for column, values in categories.items():
        df = one_hot(df, column, values)
    return df


def prepared(df: DataFrame, numeric: Sequence[str], categories) -> DataFrame:
    """All inputs as plain numbers."""
    return missing_stage(numeric).transform(encoded(df, categories))


def fit(
    train: DataFrame,
    target: str,
    numeric: Sequence[str],
    categories: dict[str, Sequence[str]],
    trees: int,
    rate: float,
    classifier: bool = False,
) -> FittedModel:
    """``train`` is materialised once in the shared folder, because every tree reads it again, in as
    many partitions as its rows need."""
    shared_folder(train.sparkSession)
    inputs = input_columns(numeric, categories)
    rows = pinned(
        prepared(train, numeric, categories).select(
            *inputs, F.col(target).cast("double").alias("label")
        )
    )
    rows = rows.coalesce(max(1, -(-rows.count() // FIT_ROWS)))
    settings = dict(
        maxIter=trees, maxDepth=DEPTH, stepSize=rate, subsamplingRate=ROW_SAMPLE, seed=SEED,
        checkpointInterval=10,
    )
    booster = GBTClassifier(**settings) if classifier else GBTRegressor(**settings)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    stages = Pipeline(stages=[assembler, booster]).fit(rows).stages
    model = PipelineModel([missing_stage(numeric), *stages])
    return FittedModel(model, tuple(numeric), categories, classifier)


def category_values(df: DataFrame, column: str) -> list[str]:
    """The category list, fixed at fit time: one model input per value. NULL is no category."""
    known = df.filter(F.col(column).isNotNull())
    return [row[0] for row in known.select(column).distinct().orderBy(column).collect()]


def holdout_by_time(features: DataFrame, months: int = 12) -> DataFrame:
    """Test rows are the newest months; a split in time keeps the future out of the training."""
    newest = features.agg(F.max("time_idx")).scalar()
    return features.withColumn("is_test", (F.col("time_idx") > newest - months).cast("int"))


def evaluate_regression(model: FittedModel, test: DataFrame, target: str) -> DataFrame:
    scored = model.score(test).select(F.col(target).cast("double").alias("actual"), "prediction")
    return regression_metrics(scored)


def evaluate_classifier(model: FittedModel, test: DataFrame, label: str) -> DataFrame:
    scored = pinned(
        model.score(test).select(F.col(label).alias("label"), F.col("prediction").alias("probability"))
    )
    area = auc(scored).select("auc").scalar()
    return classification_metrics(scored).withColumn("auc", area)


def fit_forecast(
    train: DataFrame, target: str, trees: int = FORECAST_TREES, numeric=FORECAST_FEATURES
) -> FittedModel:
    regions = {"region": category_values(train, "region")}
    return fit(train, target, numeric, regions, trees, FORECAST_RATE)


def customer_categories(features: DataFrame) -> dict[str, list[str]]:
    return {c: category_values(features, c) for c in ("segment", "region")}


def fit_churn(train: DataFrame, trees: int = CUSTOMER_TREES) -> FittedModel:
    return fit(
        train, "churned", CHURN_FEATURES, customer_categories(train), trees, CUSTOMER_RATE, True
    )


def fit_value(train: DataFrame, trees: int = CUSTOMER_TREES) -> FittedModel:
    return fit(
        train, "clv_12mo", VALUE_FEATURES, customer_categories(train), trees, CUSTOMER_RATE
    )
