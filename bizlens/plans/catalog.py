"""Every registered query: name -> function of (session, data folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizlens.functions import questions as q
from bizlens.functions import text as tx
from bizlens.functions.exact import exact_sum, rounded
from bizlens.operators import customers, decisions, inventory, metrics, models, monthly, products
from bizlens.operators import attribution as attr
from bizlens.operators import retrieval as rt
from bizlens.operators.embedders import HashingEmbedder, TfidfEmbedder, embed
from bizlens.operators.store import fingerprint
from bizlens.plans import briefing
from bizlens.plans.business import ENTERPRISE, RECENT_DAYS, SENSITIVE_REGION, Business
from bizlens.session import pinned, scratch_path
from bizlens.sources import files, views

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters of the registered runs.
BUDGET_PER_REGION = 2_000_000.0
GLOBAL_BUDGET = 10_000_000.0


def query(name: str):
    def register(build: Callable[[Business], DataFrame]):
        REGISTRY[name] = lambda spark, path: build(Business(spark, path))
        return build

    return register


# --- sources and sinks -------------------------------------------------------------------------


@query("src_csv_roundtrip")
def _(b):
    """The customer table written as CSV and read back with its schema."""
    rows = views.crm(b.spark, b.path)
    folder = scratch_path(b.spark, "csv")
    files.write_csv(rows, folder)
    return files.read_csv(b.spark, folder, rows.schema)


@query("src_parquet_partitioned")
def _(b):
    """Monthly sales written by region folder and read back for one region."""
    folder = scratch_path(b.spark, "features")
    files.write_features(b.monthly, folder)
    back = monthly.region_only(b.spark.read.parquet(folder), SENSITIVE_REGION)
    return back.select("region", "month", "revenue", "units_sold")


@query("src_json_roundtrip")
def _(b):
    """The newest month per region written as JSON and read back with its schema."""
    rows = monthly.latest_month(b.monthly).select("region", "month", "revenue", "units_sold")
    folder = scratch_path(b.spark, "json")
    files.write_json(rows, folder)
    return files.read_json(b.spark, folder, rows.schema)


@query("src_documents")
def _(b):
    text = F.col("text")
    return b.base("documents").select(
        "doc_id", "source", F.length(text).cast("long").alias("chars"),
        F.length(tx.clean(text)).cast("long").alias("clean_chars"),
        tx.chunk_count(tx.clean(text)).cast("long").alias("chunks"),
    )


@query("src_text_folder")
def _(b):
    """The documents written as one text file each and read back as whole files."""
    folder = scratch_path(b.spark, "texts")
    files.write_text_folder(b.base("documents"), folder)
    return files.read_text_folders(b.spark, folder).select(
        "doc_id", F.split("source", "/")[0].alias("folder"), "bytes",
        F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"),
    )


def _sorted(b: Business, name: str, rows: DataFrame, order: list) -> DataFrame:
    """Written sorted and read back with the place of every row in the files."""
    folder = scratch_path(b.spark, name)
    files.write_sorted(rows, order, folder)
    return files.read_sorted(b.spark, folder)


@query("sorted_scores")
def _(b):
    """Customers, riskiest first."""
    return _sorted(b, "scores", b.scores, [F.col("churn_probability").desc(), F.col("customer_id")])


@query("sorted_products")
def _(b):
    """Products by revenue, largest first."""
    rows = b.performance.select("sku", "revenue")
    return _sorted(b, "products", rows, [F.col("revenue").desc_nulls_last(), F.col("sku")])


@query("sorted_candidates")
def _(b):
    """Products to discontinue, smallest revenue first."""
    rows = products.discontinue_candidates(b.performance).select("sku", "revenue")
    return _sorted(b, "candidates", rows, [F.col("revenue").asc_nulls_last(), F.col("sku")])


@query("sorted_plan")
def _(b):
    """The order plan, items at risk first."""
    rows = b.plan.select("region", "sku", "stockout_risk", "recommended_order_qty")
    return _sorted(b, "plan", rows, [F.col("stockout_risk").desc(), F.col("region"), F.col("sku")])


@query("sorted_supply")
def _(b):
    """The supplier allocation of every region, largest volume first."""
    rows = briefing.given_supplier_mix(b).select("region", "supplier", "allocated_volume", "allocated_cost")
    return _sorted(
        b, "supply", rows, [F.col("region"), F.col("allocated_volume").desc(), F.col("supplier")]
    )


@query("sorted_budget")
def _(b):
    """The marketing budgets of every question, largest share first."""
    rows = briefing.marketing_answers(b).select("question_id", "region", "allocated_budget")
    order = [F.col("question_id"), F.col("allocated_budget").desc_nulls_last(), F.col("region")]
    return _sorted(b, "budget", rows, order)


@query("answer_json")
def _(b):
    return briefing.answers(b)


# --- monthly ------------------------------------------------------------------------------------


@query("monthly_sales")
def _(b):
    return monthly.monthly_sales(views.sales_by_region(b.spark, b.path))


@query("monthly_by_region")
def _(b):
    return monthly.region_only(b.monthly, SENSITIVE_REGION).select(
        "month", "region", "revenue", "units_sold"
    )


@query("monthly_signal")
def _(b):
    return monthly.monthly_signal(views.signal_daily(b.spark, b.path))


@query("monthly_price_index")
def _(b):
    return monthly.monthly_price_index(views.price_index(b.spark, b.path))


@query("finance_pnl")
def _(b):
    return monthly.finance_pnl(views.sales_by_region(b.spark, b.path))


@query("time_index")
def _(b):
    return monthly.with_time_index(b.monthly).select(
        "region", "month", "month_num", "year", "time_idx"
    )


@query("lag_features")
def _(b):
    return monthly.with_lags(b.monthly).select(
        "region", "month", "revenue_lag1", "revenue_lag2", "units_sold_lag1", "units_sold_lag2"
    )


@query("rolling3")
def _(b):
    return monthly.with_lags(b.monthly).select(
        "region", "month", "revenue_rolling3", "units_sold_rolling3"
    )


@query("monthly_features")
def _(b):
    return b.features


@query("latest_month")
def _(b):
    return monthly.latest_month(b.monthly).select("region", "month", "revenue", "units_sold", "cogs")


@query("mom_change")
def _(b):
    return monthly.month_over_month(b.monthly)


@query("yoy_change")
def _(b):
    return monthly.year_over_year(b.monthly)


@query("trend_6m")
def _(b):
    return monthly.last_rows(b.monthly).select("region", "step", "month", "revenue", "units_sold")


@query("trend_long")
def _(b):
    return monthly.trend_long(monthly.last_rows(b.monthly))


@query("one_hot")
def _(b):
    return monthly.one_hot(
        b.features.select("region", "month"), "region", models.category_values(b.features, "region")
    )


@query("trailing_180d")
def _(b):
    return (
        views.sales_by_product(b.spark, b.path, RECENT_DAYS)
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            exact_sum(F.col("revenue")).alias("revenue"),
            F.sum("units_sold").alias("units"),
        )
    )


@query("marketing_roi")
def _(b):
    return monthly.marketing_roi(b.monthly)


# --- products -----------------------------------------------------------------------------------


@query("sku_performance")
def _(b):
    return b.performance


@query("sku_rank")
def _(b):
    return products.ranked(b.performance).select("sku", "revenue", "revenue_rank")


@query("discontinue_candidates")
def _(b):
    return products.discontinue_candidates(b.performance)


# --- customers ----------------------------------------------------------------------------------


@query("customer_features")
def _(b):
    return b.customers


@query("clv_label")
def _(b):
    return customers.value_label(b.customers).select("customer_id", "churned", "clv_12mo")


@query("scorecard")
def _(b):
    return customers.scorecard(b.customers, ENTERPRISE).select(
        "customer_id", rounded(F.col("logit"), 6).alias("logit"), "churn_probability"
    )


@query("scorecard_attribution")
def _(b):
    return customers.scorecard_attribution(b.customers, ENTERPRISE)


@query("global_drivers")
def _(b):
    return metrics.mean_absolute(customers.scorecard_attribution(b.customers, ENTERPRISE))


@query("customer_scores")
def _(b):
    return b.driven_scores


@query("top_customers")
def _(b):
    """The ten riskiest customers of every region, and of all, with value and drivers."""
    return customers.top_by_region(b.driven_scores)


@query("risk_tier")
def _(b):
    return b.scores.groupBy(
        customers.risk_tier(F.col("churn_probability")).alias("risk_tier"), "segment"
    ).agg(F.count(F.lit(1)).alias("customers"))


@query("churn_summary")
def _(b):
    return customers.churn_summary(b.scores)


@query("churn_histogram")
def _(b):
    return customers.churn_histogram(b.scores)


@query("top_at_risk")
def _(b):
    return customers.top_at_risk(b.scores)


@query("churn_answer")
def _(b):
    return briefing.churn(b.scores)


# --- metrics ------------------------------------------------------------------------------------


def _naive(b: Business) -> DataFrame:
    return (
        monthly.with_lags(b.monthly)
        .filter(F.col("revenue_rolling3").isNotNull())
        .select(
            "region", F.col("revenue").alias("actual"), F.col("revenue_rolling3").alias("prediction")
        )
    )


def _labelled(b: Business) -> DataFrame:
    return customers.scorecard(b.customers, ENTERPRISE).select(
        "region", F.col("churned").alias("label"), F.col("churn_probability").alias("probability")
    )


@query("regression_metrics")
def _(b):
    return metrics.regression_metrics(_naive(b), ["region"])


@query("naive_forecast_metrics")
def _(b):
    return metrics.regression_metrics(_naive(b))


@query("classification_metrics")
def _(b):
    return metrics.classification_metrics(_labelled(b), ["region"])


@query("auc")
def _(b):
    return metrics.auc(_labelled(b))


@query("confidence_label")
def _(b):
    """Naive forecast by R², scorecard by AUC."""
    naive = metrics.regression_metrics(_naive(b)).select(
        F.lit("naive forecast").alias("model"), "r2", F.lit(None).cast("double").alias("auc")
    )
    card = metrics.auc(_labelled(b)).select(
        F.lit("scorecard").alias("model"), F.lit(None).cast("double").alias("r2"), "auc"
    )
    return briefing.confidence(naive.unionByName(card))


def _labels(b: Business) -> DataFrame:
    return b.customers.select("customer_id", "churned")


@query("split_stratified")
def _(b):
    return metrics.split_rows(_labels(b), "customer_id", ["churned"]).select(
        "customer_id", "churned", "is_test"
    )


@query("split_counts")
def _(b):
    return metrics.split_counts(
        metrics.split_rows(_labels(b), "customer_id", ["churned"]), "churned"
    )


# --- inventory ----------------------------------------------------------------------------------


@query("inventory_features")
def _(b):
    return b.stock


@query("reorder_policy")
def _(b):
    demand = views.demand(b.spark, b.path).withColumn(
        "supplier_lead_time_days", views._pick(F.col("sku"), views.LEAD_DAYS)
    )
    return inventory.reorder_policy(demand)


@query("eoq_plan")
def _(b):
    return b.plan.select(
        "region", "sku", "eoq", "recommended_order_qty", "order_cost_total", "stockout_risk"
    )


_TO_FUND = [
    "region", "sku", "recommended_order_qty", "unit_cost", "order_cost_total", "stockout_risk",
]
_FUNDED = [
    "region", "sku", "recommended_order_qty", "order_cost_total", "priority_weight",
    "funded_fraction", "funded_order_qty", "funded_cost",
]


@query("fund_inventory")
def _(b):
    return inventory.fund_orders(b.plan.select(*_TO_FUND), BUDGET_PER_REGION).select(*_FUNDED)


@query("fund_inventory_global")
def _(b):
    return inventory.fund_orders(b.plan.select(*_TO_FUND), GLOBAL_BUDGET, by=[]).select(*_FUNDED)


@query("at_risk_stock")
def _(b):
    return inventory.at_risk(b.stock).select(
        "region", "sku", "units_on_hand", "supplier_lead_time_days", "days_of_supply"
    )


@query("inventory_answer")
def _(b):
    return inventory.stock_summary(b.plan_totals)


@query("supplier_exposure")
def _(b):
    return inventory.supplier_exposure(b.stock)


# --- decisions ----------------------------------------------------------------------------------


@query("price_grid")
def _(b):
    return decisions.price_grid(b.price_base, ["sku"])


@query("price_best")
def _(b):
    return decisions.best_price(b.price_base, ["sku"])


@query("pricing_answer")
def _(b):
    return briefing.pricing(b.latest)


@query("marketing_allocation")
def _(b):
    return briefing.marketing_answers(b)


@query("supplier_allocation")
def _(b):
    return briefing.supplier_mix(b.plan, relax=False)


@query("supplier_given")
def _(b):
    """Each region's volume from the table of given offers, at most 40% from one supplier."""
    return briefing.given_supplier_mix(b)


@query("supplier_shared")
def _(b):
    """All regions' volumes from the given offers, whose capacity they share."""
    return briefing.shared_supplier_fill(b)


@query("supplier_relaxed")
def _(b):
    """The same choice with at most 30% from one supplier, relaxed where that cannot be met."""
    return briefing.supplier_mix(b.plan, share=0.3, relax=True)


@query("scenario_inputs")
def _(b):
    return briefing.scenario_shift(b)


@query("scenario_elastic")
def _(b):
    return decisions.scenario_elastic(b.latest)


@query("scenario_answer")
def _(b):
    """Every scenario question through the stored models."""
    return briefing.scenario_answers(b)


@query("scenario_elastic_answer")
def _(b):
    return briefing.scenario_elastic_answers(b)


@query("scenario_table")
def _(b):
    """Inflation and marketing steps for every region through the stored models."""
    return briefing.scenario_table(b)


@query("scenario_unchanged")
def _(b):
    return briefing.scenario_unchanged(b)


# --- models -------------------------------------------------------------------------------------


def _forecast_rows(b: Business) -> tuple[DataFrame, DataFrame]:
    rows = models.holdout_by_time(b.settled("features").features)
    return rows.filter("is_test = 0"), rows.filter("is_test = 1")


def _forecast(b: Business, target: str):
    train, test = _forecast_rows(b)
    return b.forecast_model(target), train, test


def _forecast_report(b: Business, target: str) -> DataFrame:
    model, train, test = _forecast(b, target)
    drivers = (
        attr.tree_attribution(model, test, ["region", "month"])
        .select(F.inline("factors"))
        .transform(metrics.mean_absolute)
        .agg(F.collect_list(F.struct("feature", "mean_abs_contribution")).alias("top_drivers"))
    ).scalar()
    return models.evaluate_regression(model, test, target).select(
        F.lit(target).alias("target"), "mae", "mape", "r2", F.col("rows").alias("n_test"),
        train.agg(F.count(F.lit(1))).scalar().alias("n_train"), drivers.alias("top_drivers"),
    )


@query("forecast_revenue")
def _(b):
    return _forecast_report(b, "revenue")


@query("forecast_units")
def _(b):
    return _forecast_report(b, "units_sold")


def _customer_split(b: Business):
    rows = b.customer_rows
    return rows, rows.filter("is_test = 0"), rows.filter("is_test = 1")


@query("churn_model")
def _(b):
    _, train, test = _customer_split(b)
    model = b.churn_model
    return models.evaluate_classifier(model, test, "churned").select(
        "auc", "precision", "recall", "f1", F.col("rows").alias("n_test"),
        train.agg(F.count(F.lit(1))).scalar().alias("n_train"),
    )


@query("clv_model")
def _(b):
    _, train, test = _customer_split(b)
    model = b.value_model
    return models.evaluate_regression(model, test, "clv_12mo").select(
        "mae", "r2", F.col("rows").alias("n_test"),
        train.agg(F.count(F.lit(1))).scalar().alias("n_train"),
    )


@query("customer_scores_model")
def _(b):
    """All customers with both models: probability, value and the three strongest drivers."""
    rows, train, _ = _customer_split(b)
    churn, value = b.models_together(lambda: b.churn_model, lambda: b.value_model)
    return attr.customer_scores(rows, churn, value)


@query("tree_attribution")
def _(b):
    model, _, test = _forecast(b, "revenue")
    return attr.tree_attribution(model, test, ["region", "month"]).select(
        "region", "month", "prediction", "base_value", F.inline("factors")
    )


@query("explain_forecast")
def _(b):
    model, _, test = _forecast(b, "revenue")
    quality = pinned(models.evaluate_regression(model, test, "revenue"))
    newest = monthly.latest_month(b.features)
    return attr.forecast_card(model, newest, quality)


@query("explain_churn")
def _(b):
    rows, train, _ = _customer_split(b)
    return attr.churn_card(b.churn_model, rows)


@query("scenario_scored")
def _(b):
    """Every region and scenario scored by the fitted revenue and demand models."""
    revenue, units = b.forecast_models()
    return attr.scenario_scores(revenue, units, decisions.scenario_inputs(b.latest))


@query("change_drivers")
def _(b):
    """Why each region's revenue forecast moved in the newest month, input by input."""
    return attr.change_drivers(b.forecast_model("revenue"), b.settled("features").features)


@query("change_gap")
def _(b):
    """The effects of a region's inputs sum to its predicted change: gap 0."""
    return attr.change_gap(attr.change_drivers(b.forecast_model("revenue"), b.settled("features").features))


@query("attribution_gap")
def _(b):
    """Base value and contributions against the output of both forecasts, for every test row."""
    out = []
    _, test = _forecast_rows(b)
    for target, model in zip(("revenue", "units_sold"), b.forecast_models(), strict=True):
        gaps = attr.attribution_gap(attr.tree_attribution(model, test, ["region", "month"]), ["region", "month"])
        out.append(gaps.select(F.lit(target).alias("target"), "region", "month", "gap"))
    return out[0].unionByName(out[1])


@query("customer_attribution_gap")
def _(b):
    """The same for the churn model, for every customer."""
    rows, _, _ = _customer_split(b)
    cards = attr.tree_attribution(b.churn_model, rows, ["customer_id"])
    return attr.attribution_gap(cards, ["customer_id"], classifier=True)


@query("missing_inputs")
def _(b):
    """Every input of the forecasts with its missing flag, by the stage that is saved with a model."""
    folder = scratch_path(b.spark, "missing-stage")
    models.missing_stage(models.FORECAST_FEATURES).write().save(folder)
    stage = SQLTransformer.load(folder)
    return models.missing_inputs(b.features, ["region", "month"], stage, models.FORECAST_FEATURES)


@query("model_store")
def _(b):
    """A model fitted now, saved and read back: on how many rows do the two differ? Few trees, as the
    question is the store; the other queries read the full models from it."""
    train, test = _forecast_rows(b)
    fitted = models.fit_forecast(train, "revenue", trees=5)
    store = b.store
    rows, print_ = fingerprint(train, ["region", *models.FORECAST_FEATURES, "revenue"])
    name = f"roundtrip-{uuid.uuid4().hex}"
    version = store.save(name, fitted, "revenue", rows, print_)
    back = store.load(name, version)
    both = back.score(fitted.score(test).select(*test.columns, F.col("prediction").alias("_first")))
    entry = store.manifests(name)
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_first") != F.col("prediction")).alias("differing")
    ).select(
        F.lit(version).alias("version"), "rows", "differing",
        entry.agg(F.max("rows")).scalar().alias("trained_on"),
        entry.agg(F.max("trees")).scalar().alias("trees"),
        entry.agg(F.max(F.size("numeric"))).scalar().alias("inputs"),
    )


# --- text ---------------------------------------------------------------------------------------


@query("chunk_documents")
def _(b):
    return tx.chunk_documents(b.base("documents")).select(
        "doc_id", "source", F.col("chunk_no").cast("long").alias("chunk_no"),
        F.md5("text").alias("text_md5"),
    )


@query("tokenize_ngrams")
def _(b):
    """Words and pairs of every chunk."""
    return tx.with_terms(tx.chunk_documents(b.base("documents"))).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"),
        F.size("terms").cast("long").alias("terms"),
        F.md5(F.array_join("terms", "|")).alias("terms_md5"),
    )


@query("tfidf_vocab")
def _(b):
    return b.index.vocabulary.select("term", "total", "df", rounded(F.col("idf"), 6).alias("idf"))


@query("tfidf_weights")
def _(b):
    return b.index.weights.select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "term", "tf",
        rounded(F.col("weight"), 6).alias("weight"),
    )


def _benchmark(b: Business) -> DataFrame:
    return b.base("benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("retrieve_topk")
def _(b):
    return b.index.retrieve(_benchmark(b)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
        F.col("chunk_no").cast("long").alias("chunk_no"), "score",
    )


@query("evidence")
def _(b):
    hits = b.index.with_text(b.index.retrieve(_benchmark(b)))
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "source",
        tx.strip(F.substring("text", 1, 300)).alias("excerpt"),
        rounded(F.col("score"), 3).alias("relevance_score"),
    )


@query("evidence_sources")
def _(b):
    return b.index.evidence(_benchmark(b)).select(
        "query_id", F.array_join("sources", ", ").alias("sources")
    )


@query("vector_topk")
def _(b):
    vectors = b.base("embeddings")
    return rt.vector_topk(vectors, rt.label_centroids(vectors)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score"
    )


@query("embed_topk")
def _(b):
    """The benchmark against all chunks by a second embedder, hashed words and pairs, through the
    same search as given vectors. A chunk's number is doc_id times a million plus its place."""
    embedder = HashingEmbedder().fit(b.base("documents"))
    chunks = tx.with_terms(tx.chunk_documents(b.base("documents"))).select(
        (F.col("doc_id") * 1_000_000 + F.col("chunk_no")).alias("vec_id"), "terms"
    )
    asked = tx.with_terms(_benchmark(b)).select("query_id", "terms")
    found = rt.vector_topk(embed(chunks, ["vec_id"], embedder), embed(asked, ["query_id"], embedder))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query("embed_tfidf")
def _(b):
    """The weights of every chunk as vectors of the fitted vocabulary, by the first embedder: their
    squared length and largest weight."""
    embedder = TfidfEmbedder(size=256).fit(b.base("documents"))
    chunks = tx.with_terms(tx.chunk_documents(b.base("documents")))
    vectors = embed(chunks, ["doc_id", "chunk_no"], embedder)
    square = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return vectors.select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), rounded(square, 3).alias("length"),
        F.size("embedding").alias("dim"),
        rounded(F.array_max("embedding").cast("double"), 3).alias("largest"),
    )


# --- questions and briefing -----------------------------------------------------------------------


@query("tag_questions")
def _(b):
    return b.questions.select("question_id", q.answer_type(F.col("question")).alias("answer_type"))


@query("detect_region")
def _(b):
    rows = b.questions.withColumn("_names", q.region_list(b.base("region")))
    return rows.select(
        "question_id", q.detect_region(F.col("question"), F.col("_names")).alias("region")
    )


@query("parse_budget")
def _(b):
    return b.questions.select(
        "question_id", q.budget(F.col("question"), decisions.DEFAULT_BUDGET).alias("budget")
    )


@query("parse_scenario")
def _(b):
    return q.scenario_numbers(b.questions).drop("question")


@query("root_cause")
def _(b):
    return briefing.root_cause(b.features)


@query("action_plan")
def _(b):
    return briefing.action_plan(b)


@query("answer_rows")
def _(b):
    """The long lists behind the answers: products ranked, orders planned."""
    return briefing.answer_rows(b)


@query("kpi_rows")
def _(b):
    return briefing.kpi_rows(b)


@query("narrative")
def _(b):
    return briefing.narrative(b)
