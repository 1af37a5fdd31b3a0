"""Answers, KPI rows and action rows: joins of the analyses, for all regions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions import questions as q
from bizlens.functions.exact import rounded
from bizlens.operators import attribution, customers, decisions, inventory, metrics, models, monthly
from bizlens.operators.metrics import confidence_label
from bizlens.operators.products import discontinue_candidates, ranked
from bizlens.plans.business import ENTERPRISE, SCENARIO_REGION, SENSITIVE_REGION, Business
from bizlens.session import pinned, small_side

ALL = "ALL"
TOP_DRIVERS = 5
EXCERPT = 300
# What the sentences and the actions share: the monthly tables, and a row per region of the others.
TOTALS = ("monthly", "features", "churn_totals", "plan_totals")
# What the JSON answers read besides.
ANSWERED = ("supply_totals", *TOTALS, "weak_totals")


def tagged_questions(b: Business) -> DataFrame:
    """Every question with its answer type, region, budget and scenario numbers."""
    names = q.region_list(b.base("region"))
    rows = b.questions.withColumn("_names", names).select(
        "question_id",
        "question",
        q.answer_type(F.col("question")).alias("answer_type"),
        q.detect_region(F.col("question"), F.col("_names")).alias("region"),
        q.budget(F.col("question"), decisions.DEFAULT_BUDGET).alias("budget"),
    )
    return q.scenario_numbers(rows)


# --- analyses per region ---------------------------------------------------------------------------


def root_cause(features: DataFrame) -> DataFrame:
    """Newest month against the one before, with the outside signals of the month."""
    return monthly.month_over_month(
        features,
        [
            rounded(F.col("competitor_price_index"), 1).alias("competitor_price_index"),
            rounded(F.col("market_sentiment_score"), 3).alias("market_sentiment_score"),
        ],
    )


def trend_list(features: DataFrame) -> DataFrame:
    """The last six months of each region as one short list."""
    entry = F.struct(
        "month", rounded(F.col("revenue"), 2).alias("revenue"), "units_sold",
        "competitor_price_index", "market_sentiment_score",
    )
    return (
        monthly.last_rows(features)
        .groupBy("region")
        .agg(F.array_sort(F.collect_list(entry)).alias("trend"))
    )


def revenue_drivers(b: Business, top: int = TOP_DRIVERS) -> DataFrame:
    """Per region the model's forecast for the newest month and the month before, and the ``top``
    inputs whose contributions moved most between the two."""
    rows = attribution.change_drivers(b.forecast_model("revenue"), b.settled("monthly", "features").features)
    entry = F.struct(
        "place", "feature", rounded(F.col("value_before"), 4).alias("value_before"),
        rounded(F.col("value_now"), 4).alias("value_now"), rounded(F.col("effect"), 2).alias("effect"),
        F.when(F.col("effect") > 0, "up").when(F.col("effect") < 0, "down").otherwise("none").alias("direction"),
    )
    return (
        rows.where(F.col("place") <= top)
        .groupBy("region")
        .agg(
            rounded(F.max("predicted_before"), 2).alias("predicted_before"),
            rounded(F.max("predicted_now"), 2).alias("predicted_now"),
            F.array_sort(F.collect_list(entry)).alias("drivers"),
        )
    )


def model_confidence(b: Business) -> DataFrame:
    """One row: the revenue model's R² on the newest year, which it has not seen, in words."""
    test = models.holdout_by_time(b.settled("monthly", "features").features).filter("is_test = 1")
    quality = models.evaluate_regression(b.forecast_model("revenue"), test, "revenue")
    r2 = F.col("r2")
    return quality.select(
        rounded(r2, 3).alias("r2"), confidence_label(r2, F.lit(None).cast("double")).alias("confidence")
    )


def root_cause_full(b: Business) -> DataFrame:
    """Figures, trend, drivers and confidence of every region's newest month."""
    b = b.settled("monthly", "features")
    quality = model_confidence(b)
    return (
        root_cause(b.features)
        .join(trend_list(b.features), "region")
        .join(revenue_drivers(b), "region", "left")
        .withColumn("model_r2", quality.select("r2").scalar())
        .withColumn("confidence", quality.select("confidence").scalar())
    )


def pricing(latest: DataFrame) -> DataFrame:
    """Current price, assumed elasticity and the best price change per region."""
    base = decisions.region_price_base(latest, SENSITIVE_REGION).withColumns(
        {
            "current_avg_price": rounded(F.col("base_price"), 2),
            "elasticity_assumption": F.col("elasticity"),
        }
    )
    return decisions.best_price(base, ["region", "current_avg_price", "elasticity_assumption"])


def churn(scores: DataFrame, top: int = 10) -> DataFrame:
    """Per region and overall: the KPIs, the five bucket counts and the ids of the riskiest
    customers; see ``churn_full`` for their columns."""
    scores = pinned(scores)
    place = F.array_sort(F.collect_list(F.struct("place", "customer_id")))
    riskiest = customers.top_by_region(scores, top, ALL).groupBy(F.col("scope").alias("region")).agg(
        F.array_join(F.transform(place, lambda r: r["customer_id"].cast("string")), ",")
        .alias("top_at_risk_customers")
    )
    return customers.churn_summary(scores, buckets=True).join(riskiest, "region")


def churn_full(b: Business, top: int = 10) -> DataFrame:
    """The same with the riskiest customers in full: probability, value and drivers."""
    entry = F.struct(
        "place", "customer_id", F.col("home").alias("region"), "segment", "churn_probability",
        "predicted_clv_12mo", "top_churn_drivers",
    )
    riskiest = (
        customers.top_by_region(b.driven_scores, top, ALL).withColumnRenamed("region", "home")
        .groupBy(F.col("scope").alias("region"))
        .agg(F.array_sort(F.collect_list(entry)).alias("top_at_risk_customers"))
    )
    return b.churn_totals.join(riskiest, "region")


def required_volume(plan: DataFrame) -> DataFrame:
    """Units to order per region, from the plan or from its totals."""
    return plan.groupBy("region").agg(
        F.sum("recommended_order_qty").cast("long").cast("double").alias("required_volume")
    )


def supplier_mix(plan: DataFrame, share: float = decisions.SUPPLIER_SHARE, relax: bool = True):
    """Serve each region's recommended units from the suppliers found in its stock."""
    offers = decisions.offers_from_stock(plan).join(required_volume(plan), "region")
    return decisions.select_suppliers(offers, ["region"], share, relax)


def given_supplier_mix(b: Business, share: float = decisions.SUPPLIER_SHARE) -> DataFrame:
    """Serve each region's recommended units from the table of given offers, every region on its
    own; the offers are a short list and travel beside each region."""
    offers = b.offers.agg(F.collect_list(F.struct("supplier", "unit_cost", "capacity"))).scalar()
    rows = required_volume(b.plan_totals).withColumn("_offers", offers).select("region", "required_volume", F.inline("_offers"))
    return decisions.select_suppliers(rows, ["region"], share, relax=True)


def shared_supplier_fill(b: Business) -> DataFrame:
    """The same volumes from the same offers where all regions share each offer's capacity."""
    return decisions.shared_fill(b.offers, required_volume(b.plan_totals))


# --- questions ---------------------------------------------------------------------------------------


def scenario_questions(b: Business) -> DataFrame:
    """The parameters of every scenario question beside the newest month of its region."""
    asked = tagged_questions(b).filter(F.col("answer_type") == "scenario_simulation").select(
        F.coalesce("region", F.lit(SCENARIO_REGION)).alias("region"),
        F.col("question_id").alias("scenario"),
        "price_change_pct",
        "inflation_delta_pts",
        "competitor_price_change_pct",
        F.lit(0.0).alias("marketing_change_pct"),
        F.lit(decisions.SCENARIO_ELASTICITY).alias("demand_elasticity"),
    )
    return asked.join(b.settled("monthly", "features").latest, "region")


def scenario_answers(b: Business) -> DataFrame:
    """Every scenario question through both stored models, all questions in one batch."""
    rows = decisions.shifted_inputs(scenario_questions(b))
    return attribution.scenario_scores(*b.forecast_models(), rows)


def scenario_elastic_answers(b: Business) -> DataFrame:
    """The same with the observed month in place of both models: elasticities only."""
    units = F.col("units_sold").cast("double")
    return decisions.scenario_outcome(scenario_questions(b), F.col("revenue"), units, units)


def scenario_table(b: Business, steps=((0.0, 0.0), (3.0, 0.0), (-3.0, 0.0), (0.0, 0.5), (0.0, -0.5), (3.0, 0.5))) -> DataFrame:
    """Every region under steps of inflation points and marketing change, through both models."""
    table = [
        (f"inflation {points:+g}, marketing {spend:+.0%}", 0.0, points, 0.0, spend, decisions.SCENARIO_ELASTICITY)
        for points, spend in steps
    ]
    rows = decisions.scenario_inputs(b.settled("monthly", "features").latest, table)
    return attribution.scenario_scores(*b.forecast_models(), rows)


def scenario_unchanged(b: Business) -> DataFrame:
    """The scenario that changes nothing: model against model, every percentage must be 0."""
    return scenario_table(b, ((0.0, 0.0),)).select(
        "region", "demand_pct", "like_for_like_pct",
        rounded(F.col("revenue_model_scenario") - F.col("baseline_revenue"), 2).alias("model_difference"),
    )


def marketing_answers(b: Business) -> DataFrame:
    asked = tagged_questions(b).filter(
        F.col("answer_type") == "marketing_budget_allocation"
    ).select("question_id", "budget")
    return decisions.allocate_marketing(
        monthly.marketing_roi(b.monthly).select("region", "roi_per_dollar"), asked
    )


# --- briefing ----------------------------------------------------------------------------------------


def kpi_rows(b: Business) -> DataFrame:
    """The figures of the briefing, one per row; the last section says how far to trust the scores
    behind them. Monthly features and scores feed two sections each and are settled first."""
    b = b.settled("monthly", "features", "scores")
    labelled = customers.scorecard(b.customers, ENTERPRISE).select(
        F.col("churned").alias("label"), F.col("churn_probability").alias("probability")
    )
    blocks = [
        ("revenue", root_cause(b.features).select(
            "region", "revenue", "month_over_month_change_pct", "competitor_price_index")),
        ("churn", customers.churn_summary(b.scores).select(
            "region", F.col("customers_analyzed").cast("double").alias("customers_analyzed"),
            F.col("high_risk_count").cast("double").alias("high_risk_count"),
            "clv_at_risk", "avg_churn_probability")),
        ("pricing", pricing(b.latest).select(
            "region", "current_avg_price", "recommended_price_change_pct",
            "projected_profit_impact")),
        ("confidence", metrics.auc(labelled).select(F.lit(ALL).alias("region"), F.col("auc").alias("churn_auc"))),
    ]
    out = None
    for section, frame in blocks:
        names = [c for c in frame.columns if c != "region"]
        rows = frame.unpivot("region", names, "kpi", "value").select(
            "region", F.lit(section).alias("section"), "kpi", "value"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# Priority and owner of the four actions. The wording is ours.
ACTIONS = (
    (1, "VP Supply Chain", "Find a second source for stock that runs out before delivery"),
    (2, "VP Pricing", "Trial the price step with the best modelled profit"),
    (3, "VP Sales / Customer Success", "Call customers over the churn limit, largest value first"),
    (4, "CFO", "Restate the forecast from the newest month"),
)


def action_plan(b: Business) -> DataFrame:
    """Four prioritised rows per region with the reason for each, filled from the stock, pricing,
    churn and revenue analyses. The four are joined on region, then unfolded."""
    b = b.settled(*TOTALS)
    stock = inventory.stock_summary(b.plan_totals).select("region", "items_at_risk", "units_to_order")
    joined = (
        root_cause(b.features).select("region", "month_over_month_change_pct", "revenue")
        .join(pricing(b.latest).select(
            "region", "recommended_price_change_pct", "projected_profit_impact"), "region")
        .join(b.churn_totals.select("region", "high_risk_count", "clv_at_risk"), "region")
        .join(stock, "region")
    )
    # per priority: the two figures of the row and the reason as a pattern over them
    reasons = {
        1: ("items_at_risk", "units_to_order", "%.0f stock items have fewer days left than their delivery takes; %.0f units are due for order."),
        2: ("recommended_price_change_pct", "projected_profit_impact", "Of all price steps tried, %.2f earns most: %.2f more a month than today."),
        3: ("high_risk_count", "clv_at_risk", "%.0f customers score above 0.6; over a year they stand for %.2f."),
        4: ("month_over_month_change_pct", "revenue", "Revenue changed by %.2f percent in a month and now stands at %.2f."),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(priority).alias("priority"),
                F.lit(owner).alias("owner"),
                F.lit(action).alias("action"),
                F.col(reasons[priority][0]).cast("double").alias("figure"),
                F.col(reasons[priority][1]).cast("double").alias("amount"),
                F.format_string(
                    reasons[priority][2],
                    *[F.col(c).cast("double") for c in reasons[priority][:2]],
                ).alias("rationale"),
            )
            for priority, owner, action in ACTIONS
        ]
    )
    return joined.select("region", F.inline(rows))


def _said(kind: str, frame: DataFrame, pattern: str, *columns) -> DataFrame:
    return frame.select(
        "region", F.lit(kind).alias("answer_type"), F.format_string(pattern, *columns).alias("narrative")
    )


def _places(column: str, places: int = 2) -> Column:
    return rounded(F.col(column), places)


def narrative(b: Business) -> DataFrame:
    """One sentence per region and answer type, written from the figures. Numbers are rounded before
    they are printed, so that a sentence says the same on every engine."""
    b = b.settled(*TOTALS, "weak_totals")
    weak = b.weak_totals.select(
        F.lit(ALL).alias("region"), "weak", F.coalesce("revenue", F.lit(0.0)).alias("amount")
    )
    stock = inventory.stock_summary(b.plan_totals)
    budgets = decisions.allocate_marketing(
        monthly.marketing_roi(b.monthly).select("region", "roi_per_dollar"),
        b.spark.range(1).select(F.lit(decisions.DEFAULT_BUDGET).alias("budget")),
    )
    supply = given_supplier_mix(b).groupBy("region").agg(
        F.max("required_volume").alias("volume"), F.max("status").alias("status"),
        F.count_if(F.col("allocated_volume") > 0).alias("used"),
        F.sum(F.col("allocated_cost").cast("decimal(18,2)")).cast("double").alias("cost"),
    )
    what_if = decisions.scenario_elastic(b.latest).where("scenario = 'competitor cuts 10%'")
    plan = action_plan(b).groupBy("region").agg(F.min_by("action", "priority").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = [
        _said("revenue_root_cause", root_cause(b.features),
              "In %s the newest month brought %.2f, a change of %.2f percent on the month before.",
              "region", _places("revenue"), _places("month_over_month_change_pct")),
        _said("churn_prediction", b.churn_totals,
              "%s: %d out of %d customers are likely to go, and %.2f of yearly value with them.",
              "region", "high_risk_count", "customers_analyzed", _places("clv_at_risk")),
        _said("product_discontinuation", weak,
              "%d products sell little at a thin margin; together they brought %.2f lately.",
              "weak", _places("amount")),
        _said("inventory_recommendation", stock,
              "%s: %d items of %d run short before a delivery; ordering %d units costs %.2f.",
              "region", "items_at_risk", "items", "units_to_order", _places("order_cost_total")),
        _said("pricing_strategy", pricing(b.latest),
              "%s: with elasticity %.1f a step of %.2f earns %.2f a month, staying put %.2f.",
              "region", "elasticity_assumption", "recommended_price_change_pct",
              _places("estimated_profit"), _places("unchanged_profit")),
        _said("marketing_budget_allocation", budgets,
              "%s gets %.2f of a budget of %.2f and should return %.2f.",
              "region", "allocated_budget", "budget", "predicted_incremental_revenue"),
        _said("supplier_selection", supply,
              "%s needs %.0f units: %d suppliers at a cost of %.2f (%s).",
              "region", "volume", "used", "cost", "status"),
        _said("scenario_simulation", what_if,
              "%s: if competitors cut prices by a tenth, revenue goes from %.2f to %.2f.",
              "region", "baseline_revenue", "scenario_revenue"),
        _said("executive_action_plan", plan,
              "%s: %d steps in order of priority, beginning with this one: %s.", "region", "n", "first"),
        _said(q.DEFAULT_TYPE, b.base("documents").agg(
                  F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("m")
              ).select(F.lit(ALL).alias("region"), "*"),
              "No figures apply; the closest passages are taken from %d documents of %d sources.", "n", "m"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _pack(kind: str, key: str, frame: DataFrame) -> DataFrame:
    body = [c for c in frame.columns if c != key]
    return frame.select(
        F.lit(kind).alias("answer_type"), key, F.to_json(F.struct(*body)).alias("answer")
    )


def _listed(key: str, frame: DataFrame, name: str) -> DataFrame:
    body = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*body))).alias(name))


def evidence_batch(b: Business, general: DataFrame) -> DataFrame:
    """Passages for every document question, for the cause of each region's change and for the
    pricing policy, searched together: ``kind, key, evidence, sources``."""
    causes = b.base("region").select(
        F.lit("cause").alias("kind"), F.col("r_name").alias("key"),
        F.format_string("why did revenue change in %s causes", "r_name").alias("text"),
    )
    policy = b.spark.createDataFrame(
        [("policy", ALL, "pricing policy discount elasticity competitor response")], "kind string, key string, text string"
    )
    asked = general.select(F.lit("question").alias("kind"), F.col("question_id").cast("string").alias("key"), "text")
    batch = asked.unionByName(causes).unionByName(policy).select(F.struct("kind", "key").alias("query_id"), "text")
    found = b.index.evidence(batch, excerpt=EXCERPT)
    return pinned(found.select("query_id.kind", "query_id.key", "evidence", "sources"))


def region_payloads(b: Business, evidence: DataFrame) -> DataFrame:
    """One JSON answer per answer type and region, a few dozen rows. Lists inside are bounded by
    months, inputs, price points, suppliers, ten customers or actions. The long lists (all products
    ranked, the order plan) are tables that the question is joined to: see ``answer_rows``."""
    counts = b.weak_totals.select(
        F.lit(ALL).alias("region"), F.col("weak").alias("discontinuation_candidates"),
        F.col("revenue").alias("their_revenue"),
    )
    grid = decisions.price_grid(decisions.region_price_base(b.latest, SENSITIVE_REGION), ["region"])
    why = evidence.where("kind = 'cause'").select(
        F.col("key").alias("region"), F.slice("evidence", 1, 3).alias("supporting_evidence")
    )
    policy = evidence.where("kind = 'policy'").select(F.slice("evidence", 1, 2)).scalar()
    exposure = b.supply_totals.select("region", "units_on_hand", "supplier")
    supply = (
        _listed("region", given_supplier_mix(b), "supplier_allocation")
        .join(_listed("region", exposure, "supplier_exposure"), "region", "left")
    )
    parts = [
        _pack("revenue_root_cause", "region", root_cause_full(b).join(why, "region", "left")),
        _pack("churn_prediction", "region", churn_full(b)),
        _pack("product_discontinuation", "region", counts),
        _pack("inventory_recommendation", "region", inventory.stock_summary(b.plan_totals)),
        _pack("pricing_strategy", "region",
              pricing(b.latest).join(_listed("region", grid, "price_scenarios"), "region")
              .withColumn("policy_context", policy)),
        _pack("supplier_selection", "region", supply),
        _pack("executive_action_plan", "region",
              _listed("region", action_plan(b), "recommended_actions")),
    ]
    told = narrative(b).select("region", "answer_type", "narrative")
    return reduce(DataFrame.unionByName, parts).join(told, ["region", "answer_type"], "left")


def asked_regions(b: Business) -> DataFrame:
    """The questions with the region that their answer is about."""
    needs_region = F.col("answer_type").isin(
        "revenue_root_cause", "pricing_strategy", "supplier_selection", "executive_action_plan"
    )
    return tagged_questions(b).select(
        "question_id",
        "question",
        "answer_type",
        F.when(F.col("answer_type") == "product_discontinuation", F.lit(ALL))
        .when(needs_region, F.coalesce("region", F.lit(SENSITIVE_REGION)))
        .otherwise(F.coalesce("region", F.lit(ALL)))
        .alias("region"),
    )


def answer_rows(b: Business) -> DataFrame:
    """The long lists of the answers as rows, once per answer type and region: all products ranked
    with their candidates marked, and the order plan. A question is joined to them on ``answer_type``
    and ``region``; they are not repeated for every question."""
    weak = discontinue_candidates(b.performance).select("sku", F.lit(1).alias("weak"))
    everything = ranked(b.performance).join(weak, "sku", "left").select(
        F.lit("product_discontinuation").alias("answer_type"), F.lit(ALL).alias("region"),
        F.lit(ALL).alias("item_region"), F.col("sku").cast("long").alias("sku"),
        F.col("revenue").alias("amount"), F.coalesce("weak", F.lit(0)).alias("marked"),
    )
    orders = b.plan.select("region", "sku", "recommended_order_qty", "stockout_risk")
    own = orders.withColumn("item_region", F.col("region"))
    every = own.withColumn("region", F.lit(ALL))
    plan = own.unionByName(every).select(
        F.lit("inventory_recommendation").alias("answer_type"), "region", "item_region",
        F.col("sku").cast("long").alias("sku"), F.col("recommended_order_qty").cast("double").alias("amount"),
        F.col("stockout_risk").cast("int").alias("marked"),
    )
    return everything.unionByName(plan)


def answers(b: Business) -> DataFrame:
    """One row per question: its type, region, JSON answer and sentence. Answers that depend on type
    and region alone come from the small payload table; budgets, scenarios and document questions
    are answered per question. Of the customers, products and stock only sums are kept."""
    b = b.settled(*ANSWERED)
    asked = asked_regions(b)
    general = asked.filter(F.col("answer_type") == q.DEFAULT_TYPE).select(
        "question_id", F.col("question").alias("text")
    )
    evidence = evidence_batch(b, general)
    passages = evidence.where("kind = 'question'").select(
        F.col("key").cast(b.questions.schema["question_id"].dataType).alias("question_id"), "evidence", "sources"
    )
    own = (
        _pack("marketing_budget_allocation", "question_id",
              _listed("question_id", marketing_answers(b), "marketing_allocation"))
        .unionByName(_pack("scenario_simulation", "question_id",
                           scenario_answers(b).withColumnRenamed("scenario", "question_id")))
        .unionByName(_pack(q.DEFAULT_TYPE, "question_id", passages))
        .select("question_id", F.col("answer").alias("_own"))
    )
    return (
        asked.join(small_side(region_payloads(b, evidence)), ["answer_type", "region"], "left")
        .join(own, "question_id", "left")
        .select(
            "question_id", "question", "answer_type", "region",
            F.coalesce("answer", "_own").alias("answer"), "narrative",
        )
    )


def confidence(rows: DataFrame) -> DataFrame:
    """Metric rows (``model, r2, auc``) with their confidence in words."""
    return rows.withColumn("confidence", confidence_label(F.col("r2"), F.col("auc")))


def scenario_shift(b: Business) -> DataFrame:
    return decisions.scenario_inputs(
        b.latest.select(
            "region", "month", "inflation_rate_pct", "competitor_price_index", "marketing_spend"
        )
    )
