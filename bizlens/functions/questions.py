"""Reading a question: its answer type, region, budget and scenario numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sample questions, then three of ours for the answer types they leave out.
SAMPLE_QUESTIONS = (
    "Why did revenue drop last quarter?",
    "Which customers are likely to churn?",
    "Which products should be discontinued?",
    "How much inventory should we order for Europe?",
    "What pricing strategy should we use for Europe?",
    "What will happen if inflation increases by 3%?",
    "What should we do next?",
    "How should we split a marketing budget of $2.5 million across Asia and the rest?",
    "Which supplier risk do we carry in Africa?",
    "What if we raise prices by 8% while a competitor cuts 10% in America?",
    "What does the leave policy say?",
)
# Answer types with their keywords; the first rule that matches wins.
RULES = (
    ("revenue_root_cause",
     ("why did revenue", "revenue drop", "revenue decrease", "root cause", "why is revenue")),
    ("churn_prediction", ("churn", "at risk", "likely to leave", "retention")),
    ("product_discontinuation",
     ("discontinue", "which products should we", "underperforming product")),
    ("inventory_recommendation", ("inventory", "how much should we order", "reorder", "stock")),
    ("pricing_strategy",
     ("pricing strategy", "price increase", "what price", "should we price")),
    ("marketing_budget_allocation",
     ("marketing", "budget allocation", "ad spend", "spend allocation", "advertising")),
    ("supplier_selection",
     ("supplier", "supplier risk", "sourcing", "secondary supplier", "diversification",
      "supply chain")),
    ("scenario_simulation",
     ("inflation", "what happens if", "what if", "scenario", "simulate")),
    ("executive_action_plan",
     ("what should we do", "recommend", "next steps", "action plan")),
)
DEFAULT_TYPE = "general_document_qa"
# Patterns for numbers in a question, run on its lower-case form. The suffix of a
# budget must end a word, so that "500 marketing" stays 500.
BUDGET_PATTERN = r"budget(?: of|:)?\s*\$?(\d[\d,]*(?:\.\d+)?)(?:\s*(million|m|k)\b)?"
INFLATION_PATTERN = r"inflation.*?(\d+(?:\.\d+)?)\s*%"
PRICE_PATTERN = r"(?:increase|raise|hike).*?price.*?(\d+(?:\.\d+)?)\s*%"
COMPETITOR_PATTERN = r"competitor.*?(\d+(?:\.\d+)?)\s*%"
DEFAULT_INFLATION = 3.0


def answer_type(question: Column) -> Column:
    low = F.lower(question)
    kind = F.lit(DEFAULT_TYPE)
    for name, words in reversed(RULES):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        kind = F.when(hit, name).otherwise(kind)
    return kind


def region_list(regions: DataFrame) -> Column:
    """The region names in key order as one array; the region table is a fixed short list."""
    return regions.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]
        )
    ).scalar()


def detect_region(question: Column, names: Column) -> Column:
    """The first listed region named in the text, or NULL."""
    low = F.lower(question)
    return F.try_element_at(F.filter(names, lambda n: F.contains(low, F.lower(n))), F.lit(1))


def _number(question: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(F.lower(question), pattern, group)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).try_cast("double")


def budget(question: Column, default: float) -> Column:
    low = F.lower(question)
    suffix = F.regexp_extract(low, BUDGET_PATTERN, 2)
    factor = (
        F.when(suffix.isin("million", "m"), 1e6).when(suffix == "k", 1e3).otherwise(F.lit(1.0))
    )
    return F.coalesce(
        F.floor(_number(question, BUDGET_PATTERN) * factor).cast("double"), F.lit(float(default))
    )


def scenario_numbers(df: DataFrame, question: str = "question") -> DataFrame:
    """Inflation points, price change and competitor change. With none of them named, the
    inflation default applies."""
    text = F.col(question)
    inflation = _number(text, INFLATION_PATTERN)
    price = _number(text, PRICE_PATTERN) / F.lit(100.0)
    competitor = -_number(text, COMPETITOR_PATTERN) / F.lit(100.0)
    nothing = inflation.isNull() & price.isNull() & competitor.isNull()
    return df.withColumns(
        {
            "inflation_delta_pts": F.coalesce(
                inflation, F.when(nothing, DEFAULT_INFLATION), F.lit(0.0)
            ),
            "price_change_pct": F.coalesce(price, F.lit(0.0)),
            "competitor_price_change_pct": F.coalesce(competitor, F.lit(0.0)),
        }
    )
