"""Fitted trees, their attributions, metrics and splits."""

from itertools import combinations
from math import ceil, factorial
from threading import Barrier

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bizlens.operators import attribution as attr
from bizlens.operators import customers as cu
from bizlens.operators import decisions, metrics, models
from bizlens.operators.store import ModelStore, fingerprint
from bizlens.plans import catalog
from bizlens.plans.business import ENTERPRISE, Business
from bizlens.session import pinned


@pytest.fixture(scope="module")
def people(spark, folder):
    rows = cu.value_label(Business(spark, folder).customers)
    return pinned(metrics.split_rows(rows, "customer_id", ["churned"]))


@pytest.fixture(scope="module")
def churn(people):
    return models.fit_churn(people.filter("is_test = 0"), trees=8)


@pytest.fixture(scope="module")
def value(people):
    return models.fit_value(people.filter("is_test = 0"), trees=8)


def test_registered_models_have_all_their_trees(spark, folder, monkeypatch):
    monkeypatch.setattr(models, "fit", lambda *given: given[4])
    monkeypatch.setattr(ModelStore, "fitted", lambda store, name, train, columns, target, fit: fit())
    b = Business(spark, folder)
    assert [catalog._forecast(b, x)[0] for x in ("revenue", "units_sold")] == [250, 250]
    assert [b.churn_model, b.value_model] == [200, 200]


def test_store_fits_once_and_again_when_the_rows_change(spark, people, tmp_path):
    store, calls = ModelStore(spark, str(tmp_path / "store")), []

    def ask(rows):
        def fit():
            calls.append(1)
            return models.fit_value(rows, trees=3)

        return store.fitted("value", rows, ["segment", "region", *models.VALUE_FEATURES], "clv_12mo", fit)

    train = people.filter("is_test = 0")
    first = ask(train)
    again = ask(train.repartition(7).orderBy("customer_id"))
    assert calls == [1]
    key = F.col("customer_id")
    one = {r.customer_id: r.prediction for r in first.score(people).select(key, "prediction").collect()}
    assert one == {r.customer_id: r.prediction for r in again.score(people).select(key, "prediction").collect()}
    ask(train.withColumn("avg_order_value", F.col("avg_order_value") + F.when(key == train.first().customer_id, 1).otherwise(0)))
    ask(train)
    assert calls == [1, 1]
    entries = store.manifests("value").orderBy("version").collect()
    assert [e.version for e in entries] == [1, 2] and {e.trees for e in entries} == {3}
    assert store.load("value", 1).categories == first.categories
    with pytest.raises(LookupError):
        store.load("value", 9)
    with pytest.raises(LookupError):
        store.load("nothing")


def test_fingerprint_sees_lost_repeated_and_changed_rows(spark):
    rows = [(1, 2.0, None), (2, None, "a"), (3, 1.0, "b")]
    mark = lambda r: fingerprint(spark.createDataFrame(r, "k int, x double, s string"), ["k", "x", "s"])
    assert mark(rows) == mark(rows[::-1])
    others = [rows[:2], [*rows, rows[0]], [(1, 2.5, None), *rows[1:]], [rows[0], rows[0], rows[1]], []]
    assert len({mark(rows), *map(mark, others)}) == len(others) + 1


def test_missing_values_are_flagged_and_have_no_value_in_an_explanation(spark, value, people, tmp_path):
    columns = ["customer_id", "avg_order_value", "tenure_days"]
    rows = people.withColumn("avg_order_value", F.when(F.col("customer_id") % 2 == 0, F.col("avg_order_value")))
    stage = models.missing_stage(columns[1:])
    stage.write().save(str(tmp_path / "stage"))
    found = models.missing_inputs(rows, ["customer_id"], type(stage).load(str(tmp_path / "stage")), columns[1:])
    odd = found.where("customer_id % 2 = 1 AND feature = 'avg_order_value'")
    assert odd.count() and odd.where(f"missing = 0 OR value <> {models.MISSING}").count() == 0
    assert found.where("(customer_id % 2 = 0 OR feature = 'tenure_days') AND missing = 1").count() == 0
    card = attr.tree_attribution(value, rows.where("customer_id % 2 = 1").limit(3), ["customer_id"]).first()
    assert {f.feature: f.value for f in card.factors}["avg_order_value"] is None


@pytest.mark.parametrize("changed", ["inflation_rate_pct", "marketing_spend"])
def test_what_if_answers_react_to_inflation_and_spend(spark, changed):
    """Two models that have learnt both inputs: an asked change moves the answer, no change does not."""
    rng = np.random.default_rng(5)
    names = list(models.FORECAST_FEATURES)
    data = pd.DataFrame(rng.normal(size=(400, len(names))), columns=names)
    data["inflation_rate_pct"], data["marketing_spend"] = rng.uniform(0, 9, 400), rng.uniform(1, 9, 400)
    data["revenue"] = 1000 + 50 * data["marketing_spend"] - 40 * data["inflation_rate_pct"]
    data["units_sold"], data["avg_unit_price"], data["region"] = data["revenue"] / 10, 10.0, "R"
    rows = spark.createDataFrame(data)
    revenue, units = (models.fit_forecast(rows, t, trees=20) for t in ("revenue", "units_sold"))
    inflation = [0.0, 4.0, -4.0] if changed == "inflation_rate_pct" else [0.0] * 3
    spend = [0.0, 0.6, -0.6] if changed == "marketing_spend" else [0.0] * 3
    table = [(f"s{k}", 0.0, i, 0.0, m, -1.1) for k, (i, m) in enumerate(zip(inflation, spend, strict=True))]
    latest = rows.where("inflation_rate_pct BETWEEN 4 AND 5 AND marketing_spend BETWEEN 4 AND 6").limit(1)
    found = attr.scenario_scores(revenue, units, decisions.scenario_inputs(latest, table)).collect()
    by = {r.scenario: r for r in found}
    assert by["s0"].demand_pct == by["s0"].like_for_like_pct == 0
    up, down = ("s2", "s1") if changed == "inflation_rate_pct" else ("s1", "s2")
    assert by[up].demand_pct > 1 and by[down].demand_pct < -1


def test_effects_sum_to_the_predicted_change(spark, value, people):
    months = people.select("*", (F.col("customer_id") % 2 + 1).cast("int").alias("step0")).withColumn(
        "region", F.concat("region", F.lit("")))
    rows = months.withColumn("month", F.expr("make_date(2020, step0, 1)")).dropDuplicates(["region", "month"])
    drivers = attr.change_drivers(value, rows)
    gaps = attr.change_gap(drivers).collect()
    assert gaps and all(g.gap == 0 for g in gaps)


def test_split_sizes_are_exact_per_label(people):
    for r in people.groupBy("churned").agg(F.count("*").alias("n"), F.sum("is_test").alias("t")).collect():
        assert r.t == ceil(r.n * 0.2 - 1e-9)


def test_models_beat_chance(churn, value, people):
    test = people.filter("is_test = 1")
    assert models.evaluate_classifier(churn, test, "churned").first().auc > 0.75
    assert models.evaluate_regression(value, test, "clv_12mo").first().r2 > 0.5


@pytest.mark.parametrize("which", ["churn", "value"])
def test_contributions_add_up_to_the_prediction(which, churn, value, people):
    model = churn if which == "churn" else value
    rows = attr.tree_attribution(model, people, ["customer_id"]).collect()
    assert len(rows) == people.count()
    for r in rows:
        total = r.base_value + sum(f.contribution for f in r.factors)
        if model.classifier:
            total = 1 / (1 + np.exp(-total))
        assert total == pytest.approx(r.prediction, rel=1e-9, abs=1e-9)


def test_contributions_equal_the_shapley_definition(spark, value, people):
    """Conditional expectations down each tree, averaged over every order of the features."""
    nodes = attr.tree_nodes(value, spark)
    weights = list(value.trees.treeWeights)
    paths = attr.leaf_paths(nodes, weights)
    inputs = value.inputs
    sample = models.prepared(people, value.numeric, value.categories).select(*inputs).limit(3).toPandas()
    matrix = sample.to_numpy(float)
    used = sorted({f for _, parts in paths for f, *_ in parts})[:40]

    def expected(tree, node, row, known):
        n = tree[node]
        if n["leftChild"] < 0:
            return n["prediction"]
        if int(n["feature"]) in known:
            side = "leftChild" if row[int(n["feature"])] <= n["threshold"] else "rightChild"
            return expected(tree, n[side], row, known)
        return sum(
            tree[n[side]]["cover"] / n["cover"] * expected(tree, n[side], row, known)
            for side in ("leftChild", "rightChild")
        )

    tree = nodes[nodes["tree"] == 0].set_index("id").to_dict("index")
    features = sorted({int(n["feature"]) for n in tree.values() if n["leftChild"] >= 0})
    assert 1 < len(features) <= 15 and set(features) <= set(used)
    phi = attr.shapley_values(attr.leaf_paths(nodes[nodes["tree"] == 0], weights), matrix)
    for i, row in enumerate(matrix):
        for f in features:
            others = [g for g in features if g != f]
            total = 0.0
            for size in range(len(others) + 1):
                share = factorial(size) * factorial(len(others) - size) / factorial(len(features))
                for known in combinations(others, size):
                    gain = expected(tree, 0, row, {*known, f}) - expected(tree, 0, row, set(known))
                    total += share * gain
            assert phi[i, f] == pytest.approx(weights[0] * total, rel=1e-6, abs=1e-6)


def test_saved_model_scores_the_same(churn, people, tmp_path):
    churn.save(str(tmp_path / "churn"))
    back = models.FittedModel.load(str(tmp_path / "churn"), churn.numeric, churn.categories, True)
    one = churn.score(people).agg(F.sum("prediction")).first()[0]
    assert back.score(people).agg(F.sum("prediction")).first()[0] == pytest.approx(one, rel=1e-12)


def test_cards_and_scores(churn, value, people):
    card = attr.churn_card(churn, people).first()
    assert len(card.top_contributing_factors) == 5
    sizes = [abs(f.contribution) for f in card.top_contributing_factors]
    assert sizes == sorted(sizes, reverse=True)
    assert {f.direction for f in card.top_contributing_factors} <= {"increases risk", "decreases risk"}
    scores = attr.customer_scores(people, churn, value).collect()
    assert len(scores) == people.count()
    assert [r.churn_probability for r in scores] == sorted(
        (r.churn_probability for r in scores), reverse=True
    )
    assert all(r.top_churn_drivers.count(";") == 2 for r in scores)


def test_forecast_takes_missing_inputs(spark, folder):
    rows = models.holdout_by_time(pinned(Business(spark, folder).features))
    assert rows.filter("market_sentiment_score IS NULL").count() > 0
    model = models.fit_forecast(rows.filter("is_test = 0"), "revenue", trees=5)
    test = rows.filter("is_test = 1")
    assert model.score(test).filter("prediction IS NULL OR isnan(prediction)").count() == 0
    assert model.score(test).count() == test.count() == 60


def test_auc_and_classes_against_pairs(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"probability": np.round(rng.random(300), 1), "label": rng.integers(0, 2, 300)})
    df = spark.createDataFrame(frame)
    pos, neg = (frame.loc[frame["label"] == v, "probability"].to_numpy() for v in (1, 0))
    pairs = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert metrics.auc(df).first().auc == pytest.approx(pairs, abs=1e-6)
    out = metrics.classification_metrics(df).first()
    assert out.true_positives + out.false_negatives == len(pos)
    nothing = metrics.classification_metrics(df.withColumn("probability", F.lit(0.0))).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "actual double, prediction double")
    out = metrics.regression_metrics(df).first()
    assert out.mae == pytest.approx(2 / 3, abs=1e-4)
    assert out.mape == pytest.approx((1 + 0 + 0.25) / 3, abs=1e-6)
    assert out.r2 == pytest.approx(1 - 2 / (14 / 3), abs=1e-6)


def test_regression_metrics_of_large_amounts_and_nulls(spark):
    df = spark.createDataFrame(
        [(1e13, 2e13), (3e13, 3e13), (None, 1.0), (2.0, None)], "actual double, prediction double"
    )
    out = metrics.regression_metrics(df).first()
    assert (out.rows, out.mae, out.mape, out.r2) == (2, 5e12, 0.5, 0.5)
    none = metrics.regression_metrics(df.filter("prediction IS NULL")).first()
    assert (none.rows, none.mae, none.r2) == (0, None, None)


def test_confidence_words(spark):
    rows = [(0.85, None), (0.7, None), (0.69, 0.99), (None, 0.8), (None, None)]
    df = spark.createDataFrame(rows, "r2 double, auc double")
    words = [r[0] for r in df.select(metrics.confidence_label(F.col("r2"), F.col("auc"))).collect()]
    assert words == ["High", "Medium", "Low", "Medium", "Unknown"]


def test_probability_edges(spark):
    values = [0.0, 0.2, 0.200001, 0.3, 0.300001, 0.6, 0.600001, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    out = df.select(cu.risk_tier(F.col("p")).alias("t"), cu.bucket_of(F.col("p")).alias("b")).collect()
    assert [r.t for r in out] == ["Low"] * 4 + ["Medium"] * 2 + ["High"] * 2
    assert [r.b for r in out] == [1, 1, 2, 2, 2, 3, 4, 5]


def test_histogram_keeps_every_customer(spark, folder):
    b = Business(spark, folder)
    rows = cu.churn_histogram(b.scores).collect()
    assert sum(r.customers for r in rows) == b.customers.count()
    assert len(rows) == 25


def test_scorecard_attribution_adds_up(spark, folder):
    people = Business(spark, folder).customers
    logit = cu.scorecard(people, ENTERPRISE)
    mean = logit.agg(F.avg("logit")).first()[0]
    sums = cu.scorecard_attribution(people, ENTERPRISE).groupBy("customer_id").agg(
        F.sum("contribution").alias("c")
    )
    worst = sums.join(logit, "customer_id").select(F.max(F.abs(F.col("logit") - mean - F.col("c"))))
    assert worst.first()[0] < 1e-5


def test_contribution_tables_hold_every_pattern():
    """F8, F9: a row of the table is what the leaf adds to a row that meets these conditions."""
    shares = [0.25, 0.5, 0.8]
    table = attr.contribution_table(2.0, shares)
    assert table.shape == (8, 3)

    def worth(known, meets):
        return 2.0 * np.prod([meets[j] if j in known else shares[j] for j in range(3)])

    for pattern in range(8):
        meets = [(pattern >> j) & 1 for j in range(3)]
        for i in range(3):
            others = [j for j in range(3) if j != i]
            total = 0.0
            for size in range(3):
                for known in combinations(others, size):
                    share = factorial(size) * factorial(2 - size) / factorial(3)
                    total += share * (worth({*known, i}, meets) - worth(set(known), meets))
            assert table[pattern, i] == pytest.approx(total)


def test_customer_scores_attribute_once(churn, value, people):
    """F8: the sort reads its rows twice, so the attribution must not stand below it."""
    plan = attr.customer_scores(people, churn, value)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan


def test_models_are_fitted_together(spark, folder):
    """F8, F16: each of the two waits for the other one to start."""
    meeting = Barrier(2, timeout=20)
    b = Business(spark, folder)
    assert len(b.models_together(meeting.wait, meeting.wait)) == 2
    with pytest.raises(ZeroDivisionError):
        b.models_together(lambda: 1, lambda: 1 // 0)
