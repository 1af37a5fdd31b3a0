import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from bizlens.functions import questions as q
from bizlens.operators import customers as cu
from bizlens.operators import inventory as inv
from bizlens.operators import monthly as m
from bizlens.plans import briefing
from bizlens.plans.business import Business
from bizlens.sources import files


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "question string").select(column).first()[0]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Why did revenue drop last quarter?", "revenue_root_cause"),
        ("Which customers are likely to churn?", "churn_prediction"),
        ("Is stock at risk?", "churn_prediction"),
        ("Which products should be discontinued?", "product_discontinuation"),
        ("How much inventory should we order for Europe?", "inventory_recommendation"),
        ("What pricing strategy should we use for Europe?", "pricing_strategy"),
        ("How is the AD SPEND?", "marketing_budget_allocation"),
        ("Who is our secondary supplier?", "supplier_selection"),
        ("What will happen if inflation increases by 3%?", "scenario_simulation"),
        ("What should we do next?", "executive_action_plan"),
        ("Anything else", "general_document_qa"),
    ],
)
def test_answer_types(spark, text, kind):
    assert one(spark, q.answer_type(F.col("question")), text) == kind


@pytest.mark.parametrize(
    "text, amount",
    [
        ("no number here", 1_000_000.0),
        ("a budget of $2.5 million", 2_500_000.0),
        ("Budget: $1,250,000", 1_250_000.0),
        ("budget 300k", 300_000.0),
        ("budget 3m please", 3_000_000.0),
        ("budget 500 marketing", 500.0),
        ("budget , ", 1_000_000.0),
    ],
)
def test_budgets(spark, text, amount):
    assert one(spark, q.budget(F.col("question"), 1_000_000), text) == amount


@pytest.mark.parametrize(
    "text, numbers",
    [
        ("what if inflation rises 4.5%", (4.5, 0.0, 0.0)),
        ("raise every price by 8%", (0.0, 0.08, 0.0)),
        ("a competitor cuts 10 %", (0.0, 0.0, -0.1)),
        ("simulate something", (3.0, 0.0, 0.0)),
    ],
)
def test_scenario_numbers(spark, text, numbers):
    df = q.scenario_numbers(spark.createDataFrame([(text,)], "question string"))
    row = df.first()
    assert (row.inflation_delta_pts, row.price_change_pct, row.competitor_price_change_pct) == numbers


def test_first_listed_region_wins(spark):
    names = F.array(F.lit("AFRICA"), F.lit("EUROPE"))
    assert one(spark, q.detect_region(F.col("question"), names), "europe or Africa?") == "AFRICA"
    assert one(spark, q.detect_region(F.col("question"), names), "nowhere") is None


@pytest.fixture(scope="module")
def csv_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    (folder / "sales_transactions.csv").write_text(
        "date,region,channel,sku,product_name,category,units_sold,unit_price,revenue,cogs\n"
        "2024-01-03,North,Online,S1,Blender,Kitchen,2,89.0,178.0,101.25\n"
        "2024-02-04,North,Online,S1,Blender,Kitchen,1,89.0,89.0,50.5\n"
    )
    (folder / "erp_inventory.csv").write_text(
        "region,sku,product_name,category,units_on_hand,supplier_lead_time_days,"
        "avg_daily_demand,safety_stock,reorder_point,supplier,unit_cost\n"
        "North,S1,Blender,Kitchen,20,7,4.42,15.5,46.4,Meridian,50.98\n"
    )
    (folder / "crm_customers.csv").write_text(
        "customer_id,region,segment,signup_date,contract_length_months,tenure_days,"
        "support_tickets_last_year,satisfaction_score,avg_order_value,orders_last_year,"
        "discount_pct,late_payments_last_year,churned\n"
        "C1,North,Enterprise,2022-05-01,1,800,6,5.5,180.25,1,0.05,2,1\n"
    )
    (folder / "b.txt").write_text("second\n\n\n\nfile")
    (folder / "a.txt").write_text("first file")
    return str(folder)


def test_business_csv_files_feed_the_operators(spark, csv_folder):
    sales = files.read_business_table(spark, csv_folder, "sales_transactions")
    assert dict(sales.dtypes)["date"] == "date"
    assert m.monthly_sales(sales).count() == 2
    stock = inv.eoq_plan(
        inv.inventory_features(files.read_business_table(spark, csv_folder, "erp_inventory"))
    ).first()
    assert stock.stockout_risk == 1
    assert stock.eoq == round((2 * 4.42 * 365 * 150 / (50.98 * 0.02 * 365)) ** 0.5)
    person = cu.scored_customers(
        cu.customer_features(files.read_business_table(spark, csv_folder, "crm_customers"))
    ).first()
    logit = -1.6 + 1.7 + 1.5 + 1.3 + 1.0 + 0.9 - 0.7 - 0.4 * 800 / 365 + 0.15 * 4.5
    assert person.churn_probability == pytest.approx(1 / (1 + 2.718281828 ** -logit), abs=6e-4)


def test_text_folder_is_one_row_per_file(spark, csv_folder):
    rows = {r.source: r.text for r in files.read_text_folder(spark, csv_folder).collect()}
    assert rows == {"a.txt": "first file", "b.txt": "second\n\n\n\nfile"}


def test_feature_files_are_pruned_by_region(spark, folder, tmp_path):
    monthly = Business(spark, folder).monthly
    files.write_features(monthly, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    one_region = m.region_only(back, "ASIA")
    plan = one_region._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan
    assert back.count() == monthly.count()
    assert {r.region for r in one_region.select("region").distinct().collect()} == {"ASIA"}
    assert m.region_only(back, None).count() == back.count()


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a, \"b\"", 0.1 + 0.2)], "d date, s string, x double")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()


def test_every_question_gets_an_answer(spark, small):
    rows = briefing.answers(Business(spark, small)).collect()
    samples = {r.question_id: r for r in rows if r.question_id.startswith("sample")}
    assert len(samples) == len(q.SAMPLE_QUESTIONS)
    assert {r.answer_type for r in samples.values()} == {k for k, _ in q.RULES} | {q.DEFAULT_TYPE}
    for r in samples.values():
        if r.answer_type != q.DEFAULT_TYPE:
            assert json.loads(r.answer)
    cause = json.loads(samples["sample-01"].answer)
    assert len(cause["trend"]) == 6 and samples["sample-01"].region == "EUROPE"
    actions = json.loads(samples["sample-07"].answer)["recommended_actions"]
    assert [a["priority"] for a in actions] == [1, 2, 3, 4]
    budgets = json.loads(samples["sample-08"].answer)["marketing_allocation"]
    assert sum(a["allocated_budget"] for a in budgets) == pytest.approx(2_500_000)


def test_scenario_questions_settle_only_what_they_read(spark, small):
    """The order plan and the customer scores are no input of a scenario."""
    b = Business(spark, small)
    briefing.scenario_elastic_answers(b)
    assert b.kept == {"monthly", "features"}
