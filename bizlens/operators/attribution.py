"""Exact additive attributions of a boosted-tree model.

Each leaf is a product game over the features on its path (Lundberg et al., 2018): with a feature
known, the row either meets its conditions or not; with it unknown, the training share that goes
down the path counts. Paths hold at most ``depth`` features, so the Shapley sum over subsets is
small and exact. The trees are a few thousand numbers; the rows stay where Spark put them.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.functions.exact import rounded
from bizlens.operators.customers import driver_phrases, risk_tier
from bizlens.operators.decisions import scenario_outcome
from bizlens.operators.metrics import confidence_label
from bizlens.operators.models import MISSING, FittedModel
from bizlens.operators.monthly import last_rows
from bizlens.session import pinned, scratch_path


def tree_nodes(model: FittedModel, spark) -> pd.DataFrame:
    """The node table of the fitted trees, read back from the saved model. Its size is set by the
    number and depth of the trees."""
    path = scratch_path(spark, "trees")
    model.trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), "nodeData.*"
    )
    return nodes.select(
        "tree", "id", "prediction", "leftChild", "rightChild",
        F.col("rawCount").cast("double").alias("cover"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).toPandas()


def leaf_paths(nodes: pd.DataFrame, weights: list[float]):
    """Per leaf: weighted value and, per feature on the path, (feature, low, high, share).
    Conditions on one feature merge into one interval ``low < x <= high``."""
    paths = []
    for tree, frame in nodes.groupby("tree"):
        by_id = frame.set_index("id").to_dict("index")
        stack = [(0, {})]
        while stack:
            number, conditions = stack.pop()
            node = by_id[number]
            if node["leftChild"] < 0:
                value = weights[int(tree)] * node["prediction"]
                paths.append((value, [(f, *c) for f, c in sorted(conditions.items())]))
                continue
            feature, threshold = int(node["feature"]), node["threshold"]
            low, high, share = conditions.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in (
                (node["leftChild"], (low, min(high, threshold))),
                (node["rightChild"], (max(low, threshold), high)),
            ):
                part = by_id[child]["cover"] / node["cover"]
                stack.append((int(child), {**conditions, feature: (*bounds, share * part)}))
    return paths


def base_value(paths) -> float:
    """The expected output with no feature known."""
    return float(sum(value * np.prod([p[3] for p in parts]) for value, parts in paths))


def contribution_table(value: float, shares: list[float]) -> np.ndarray:
    """What a leaf adds to each feature of its path, for every pattern of conditions met (bit ``i``
    of the row number: condition ``i``). A path of ``depth`` features has at most 2 ** depth."""
    size = len(shares)
    meets = ((np.arange(1 << size)[:, None] >> np.arange(size)) & 1).astype(np.float64)
    table = np.zeros_like(meets)
    for i in range(size):
        others = [j for j in range(size) if j != i]
        total = np.zeros(len(meets))
        for known in range(size):
            weight = factorial(known) * factorial(size - known - 1) / factorial(size)
            for chosen in combinations(others, known):
                unknown = np.prod([shares[j] for j in others if j not in chosen])
                term = np.full(len(meets), weight * unknown)
                for j in chosen:
                    term *= meets[:, j]
                total += term
        table[:, i] = value * total * (meets[:, i] - shares[i])
    return np.asfortranarray(table)


def contribution_tables(paths) -> list:
    """Per leaf its conditions and its table; built once, looked up for every row."""
    return [
        ([p[:3] for p in parts], contribution_table(value, [p[3] for p in parts])) for value, parts in paths
    ]


def shapley_values(paths, matrix: np.ndarray, tables: list | None = None) -> np.ndarray:
    """Contributions, one column per feature: each row finds its place in the table of each leaf.
    ``tables`` are those of ``paths``, where a caller has many matrices."""
    tables = contribution_tables(paths) if tables is None else tables
    # a condition stands in many leaves, but is compared once; columns are contiguous
    columns = np.ascontiguousarray(matrix.T, dtype=np.float64)
    phi = np.zeros_like(columns)
    met: dict[tuple, np.ndarray] = {}
    for conditions, table in tables:
        place = np.zeros(columns.shape[1], np.intp)
        for i, (f, low, high) in enumerate(conditions):
            if (f, low, high) not in met:
                met[f, low, high] = ((columns[f] > low) & (columns[f] <= high)).astype(np.uint8)
            place += met[f, low, high].astype(np.intp) << i
        for i, (f, _, _) in enumerate(conditions):
            phi[f] += table[:, i][place]
    return phi.T


def tree_attribution(model: FittedModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: model output, base value and an array of (feature, value, contribution). For a
    classifier output and contributions are in log-odds."""
    scale = 2.0 if model.classifier else 1.0
    nodes = tree_nodes(model, df.sparkSession)
    paths = leaf_paths(nodes, [scale * w for w in model.trees.treeWeights])
    base, tables = base_value(paths), contribution_tables(paths)
    inputs = model.inputs
    names = [name.removeprefix("x_") for name in inputs]
    scored = model.score(df).select(*keys, *inputs, "prediction")

    def explain(frames):
        for frame in frames:
            values = frame[inputs].to_numpy(dtype=np.float64)
            out = frame[[*keys, "prediction"]].copy()
            out["base_value"] = base
            out["input_values"] = list(values)
            out["contributions"] = list(shapley_values(paths, values, tables))
            yield out

    kinds = ", ".join(f"`{k}` {scored.schema[k].dataType.simpleString()}" for k in keys)
    rows = scored.mapInPandas(
        explain,
        f"{kinds}, prediction double, base_value double, input_values array<double>, "
        "contributions array<double>",
    )
    return rows.select(
        *keys,
        "prediction",
        "base_value",
        F.transform(
            F.arrays_zip(
                F.array(*[F.lit(n) for n in names]).alias("feature"),
                F.col("input_values").alias("value"),
                F.col("contributions").alias("contribution"),
            ),
            lambda f: F.struct(
                f["feature"].alias("feature"),
                # what was missing has no value to show
                F.when(f["value"] != MISSING, f["value"]).alias("value"),
                f["contribution"].alias("contribution"),
            ),
        ).alias("factors"),
    )


def strongest_factors(attribution: DataFrame, top: int, up: str, down: str) -> DataFrame:
    """Cut the factor list to the ``top`` largest, rounded, with the direction in words."""
    largest = F.slice(
        F.array_sort(
            F.transform(
                "factors",
                lambda f: F.struct(
                    (-F.abs(f["contribution"])).alias("size"),
                    f["feature"].alias("feature"),
                    f["value"].alias("value"),
                    f["contribution"].alias("contribution"),
                ),
            )
        ),
        1,
        top,
    )
    return attribution.withColumn(
        "top_contributing_factors",
        F.transform(
            largest,
            lambda f: F.struct(
                f["feature"].alias("feature"),
                F.round(f["value"], 2).alias("value"),
                F.round(f["contribution"], 2).alias("contribution"),
                F.when(f["contribution"] > 0, up).otherwise(down).alias("direction"),
            ),
        ),
    ).drop("factors")


def forecast_card(model: FittedModel, rows: DataFrame, quality: DataFrame, top: int = 5) -> DataFrame:
    """Explanation card per region: forecast, base, confidence from the held-out R², factors."""
    r2 = quality.select("r2").scalar()
    cards = tree_attribution(model, rows, ["region", "month"])
    return (
        strongest_factors(cards, top, "increases", "decreases")
        .withColumn("_r2", r2)
        .select(
            "region",
            "month",
            F.round("prediction", 2).alias("prediction"),
            F.round("base_value", 2).alias("base_value"),
            F.round("_r2", 3).alias("confidence_score"),
            confidence_label(F.col("_r2"), F.lit(None).cast("double")).alias("confidence"),
            "top_contributing_factors",
        )
    )


def churn_card(model: FittedModel, rows: DataFrame, top: int = 5) -> DataFrame:
    """Explanation card per customer: probability, tier, factors."""
    cards = tree_attribution(model, rows, ["customer_id"])
    return strongest_factors(cards, top, "increases risk", "decreases risk").select(
        "customer_id",
        F.round("prediction", 3).alias("churn_probability"),
        risk_tier(F.round("prediction", 3)).alias("risk_tier"),
        "top_contributing_factors",
    )


def customer_scores(rows: DataFrame, churn: FittedModel, value: FittedModel) -> DataFrame:
    """One row per customer, riskiest first. Value and attributions are taken in one pass over the
    rows, so the two models need no join."""
    valued = value.score(rows).withColumnRenamed("prediction", "_value")
    keys = ["customer_id", "region", "segment", "_value"]
    cards = tree_attribution(churn, valued, keys)
    strongest = F.slice(
        F.array_sort(
            F.transform(
                "factors",
                lambda f: F.struct(
                    (-F.abs(f["contribution"])).alias("size"),
                    f["feature"].alias("feature"),
                    f["contribution"].alias("contribution"),
                ),
            )
        ),
        1,
        3,
    )
    # the sort reads its rows twice, to find the ranges and to deal them: they are computed once
    return pinned(
        cards.select(
            "customer_id",
            "region",
            "segment",
            F.round("prediction", 3).alias("churn_probability"),
            F.round("_value", 2).alias("predicted_clv_12mo"),
            driver_phrases(strongest).alias("top_churn_drivers"),
        )
    ).orderBy(F.col("churn_probability").desc(), "customer_id")


def scenario_scores(revenue: FittedModel, units: FittedModel, rows: DataFrame) -> DataFrame:
    """Base and scenario forecasts of both models for every row, in one plan. ``rows`` is a table of
    parameters beside the newest month of their region (``decisions.shifted_inputs``): any number
    of scenarios or questions is one batch."""
    shifted = ["inflation_rate_pct", "competitor_price_index", "marketing_spend"]
    inputs = [f"x_{c}" for c in revenue.numeric] + [
        c for c in revenue.inputs if not c.startswith("x_")
    ]

    def predict(model: FittedModel, df: DataFrame, name: str) -> DataFrame:
        return model.score(df).drop(*inputs).withColumnRenamed("prediction", name)

    rows = predict(units, predict(revenue, rows, "_base_revenue"), "_base_units")
    rows = rows.withColumns({f"_now_{c}": F.col(c) for c in shifted}).withColumns(
        {c: F.col(f"scenario_{c}") for c in shifted}
    )
    rows = predict(units, predict(revenue, rows, "_model_revenue"), "_model_units")
    return scenario_outcome(
        rows,
        F.col("_base_revenue"),
        F.col("_base_units"),
        F.col("_model_units"),
        [rounded(F.col("_model_revenue"), 2).alias("revenue_model_scenario")],
    )


def attribution_gap(attribution: DataFrame, keys: list[str], classifier: bool = False) -> DataFrame:
    """How far base value and contributions are from the model's output: 0 for an exact attribution.
    A classifier's output is compared as a probability, the scale of its contributions being
    log-odds."""
    total = F.aggregate("factors", F.col("base_value"), lambda t, f: t + f["contribution"])
    if classifier:
        total = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    size = F.greatest(F.abs("prediction"), F.lit(1.0))
    return attribution.select(*keys, F.abs(rounded((total - F.col("prediction")) / size, 6)).alias("gap"))


def change_drivers(model: FittedModel, features: DataFrame) -> DataFrame:
    """Why a region's forecast moved: for every input, its contribution in the newest month less that
    in the month before. ``region, month, place, feature, value_before, value_now, effect,
    predicted_before, predicted_now``; over a region the effects sum to the predicted change."""
    cards = tree_attribution(model, last_rows(features, 2), ["region", "month", "step"])
    rows = cards.select("region", "month", "step", "prediction", F.inline("factors"))
    now, before = F.col("step") == 2, F.col("step") == 1

    def of(which, column: str):
        return F.max(F.when(which, F.col(column)))

    effects = (
        rows.groupBy("region", "feature")
        .agg(
            F.max("month").alias("month"),
            of(before, "value").alias("value_before"), of(now, "value").alias("value_now"),
            (of(now, "contribution") - of(before, "contribution")).alias("effect"),
            of(before, "prediction").alias("predicted_before"), of(now, "prediction").alias("predicted_now"),
        )
        .where("predicted_now IS NOT NULL")
    )
    order = Window.partitionBy("region").orderBy(F.abs("effect").desc(), "feature")
    return effects.withColumn("place", F.row_number().over(order).cast("long")).select(
        "region", "month", "place", "feature", "value_before", "value_now", "effect",
        "predicted_before", "predicted_now",
    )


def change_gap(drivers: DataFrame) -> DataFrame:
    """Per region how far the effects are from the predicted change, relative to the forecast."""
    moved = F.max("predicted_now") - F.max("predicted_before")
    return drivers.groupBy("region").agg(
        F.abs(rounded((F.sum("effect") - moved) / F.greatest(F.abs(F.max("predicted_now")), F.lit(1.0)), 6)).alias("gap"),
        F.count(F.lit(1)).alias("features"),
    )
