"""The SQL each checkable query must agree with, run by DuckDB on the same Parquet tables.

The statements are written from the definitions, not from the Spark code: they join the whole base
tables, rank with plain windows and use the engine's own quantiles.
"""

from __future__ import annotations

import re

from bizlens.functions import questions as q
from bizlens.functions import text as tx
from bizlens.operators import customers as cu
from bizlens.operators import decisions as de

CHECKS: dict[str, str] = {}


def rnd(value: str, places: int = 0) -> str:
    """Half-to-even on doubles, scaled like the Spark side."""
    if places == 0:
        return f"round_even(({value})::DOUBLE, 0)"
    scale = f"1e{places}::DOUBLE"
    return f"(round_even(({value})::DOUBLE * {scale}, 0) / {scale})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return quoted(v) if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in rules) + f" ELSE {default} END"


def turn(key: str, options) -> str:
    return case([(f"{key} % 4 = {i}", str(o)) for i, o in enumerate(options)], "NULL")


MONEY = "l_extendedprice::DECIMAL(12,2)"
DISCOUNT = "l_discount::DECIMAL(4,2)"
TAX = "l_tax::DECIMAL(4,2)"
PNL_INCOME = rnd("gross_profit - marketing_spend - opex_other", 4)
TERMS = {
    "low_satisfaction": "(satisfaction_score < 6)::INT",
    "high_risk_tickets": "(support_tickets_last_year > 5)::INT",
    "short_contract": "(contract_length_months = 1)::INT",
    "late_payments": "(late_payments_last_year > 1)::INT",
    "few_orders": "(orders_last_year < 2)::INT",
    "enterprise": "(segment = 'MACHINERY')::INT",
    "tenure_years": "tenure_days / 365.0::DOUBLE",
    "dissatisfaction": "10.0::DOUBLE - satisfaction_score",
}
LOGIT = "-1.6::DOUBLE" + "".join(f" + {cu.WEIGHTS[n]}::DOUBLE * ({t})" for n, t in TERMS.items())
STOP = ", ".join(quoted(w) for w in tx.STOP_WORDS)
CLEAN = (
    f"regexp_replace(trim(text, '{tx.SPACE}'), '\\n{{2,}}', chr(10) || chr(10), 'g')"
)
CHUNKS_OF = (
    "CASE WHEN length(c) = 0 THEN 0 WHEN length(c) <= 500 THEN 1 "
    "ELSE ceil((length(c) - 500) / 400.0)::BIGINT + 1 END"
)


def words(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{tx.TOKEN_PATTERN}'), "
        f"lambda w: w NOT IN ({STOP}))"
    )


PAIRS = (
    "list_concat(w, list_transform(range(1, greatest(len(w), 1)::BIGINT), "
    "lambda i: w[i] || ' ' || w[i + 1]))"
)
GRID = values([(i, p) for i, p in enumerate(de.PRICE_CHANGES, 1)])


def number(pattern: str) -> str:
    return f"TRY_CAST(nullif(replace(regexp_extract(lower(question), '{pattern}', 1), ',', ''), '') AS DOUBLE)"


def grid_columns(price: str, units: str) -> str:
    return (
        f"{rnd(price, 2)} AS price, {rnd(units, 1)} AS estimated_demand, "
        f"{rnd(f'({price}) * ({units})', 2)} AS estimated_revenue, "
        f"{rnd(f'(({price}) - unit_cost) * ({units})', 2)} AS estimated_profit"
    )


NEW_PRICE = "base_price * (1 + price_change_pct)"
NEW_UNITS = "greatest(base_demand * (1.0 + elasticity * price_change_pct), 0.0)"


def best_of(base: str, key: str) -> str:
    return (
        f"g AS (SELECT *, {grid_columns(NEW_PRICE, NEW_UNITS)} FROM {base}, "
        f"(VALUES {GRID}) AS v(option_no, price_change_pct)), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} "
        "ORDER BY estimated_profit DESC, option_no) AS place, "
        "max(CASE WHEN price_change_pct = 0 THEN estimated_profit END) "
        f"OVER (PARTITION BY {key}) AS unchanged_profit FROM g)"
    )


BEST_COLUMNS = (
    "price_change_pct AS recommended_price_change_pct, price AS recommended_price, "
    "estimated_demand, estimated_revenue, estimated_profit, unchanged_profit, "
    f"{rnd('estimated_profit - unchanged_profit', 2)} AS projected_profit_impact"
)


def outcome(base_revenue: str, base_units: str) -> str:
    """Scenario figures over a relation with the scenario columns and the newest month."""
    units = (
        f"(({base_units}) * greatest(1.0 + demand_elasticity * price_change_pct + "
        "0.6 * competitor_price_change_pct, 0.0))"
    )
    revenue = f"({units} * (avg_unit_price * (1.0 + price_change_pct)))"
    r0, d0 = f"({base_revenue})", f"({base_units})"

    def change(new, old):
        return rnd(f"(({new}) - ({old})) / nullif({old}, 0) * 100", 2)

    return (
        "region, scenario, price_change_pct, inflation_delta_pts, competitor_price_change_pct, "
        "marketing_change_pct, demand_elasticity, "
        f"{rnd(r0, 2)} AS baseline_revenue, {rnd(d0, 1)} AS baseline_demand_units, "
        f"{rnd(r0 + ' * 0.35::DOUBLE', 2)} AS baseline_profit, "
        f"{rnd(revenue, 2)} AS scenario_revenue, {rnd(units, 1)} AS scenario_demand_units, "
        f"{rnd(revenue + ' * 0.35::DOUBLE', 2)} AS scenario_profit, "
        f"{change(revenue, r0)} AS revenue_pct, {change(units, d0)} AS demand_pct, "
        f"{change(revenue + ' * 0.35::DOUBLE', r0 + ' * 0.35::DOUBLE')} AS profit_pct, "
        f"{change(revenue, d0 + ' * avg_unit_price')} AS like_for_like_pct"
    )


SCENARIO_VALUES = values(de.SCENARIOS)
SCENARIO_NAMES = (
    "scenario, price_change_pct, inflation_delta_pts, competitor_price_change_pct, "
    "marketing_change_pct, demand_elasticity"
)

# Named parts; a statement lists only what it reads and the rest is pulled in by name.
PARTS = {
    "sales": f"""
        SELECT l_shipdate::DATE AS date, r_name AS region, o_orderpriority AS channel,
               l_partkey AS sku, p_name AS product_name, p_type AS category,
               l_quantity::BIGINT AS units_sold, l_extendedprice / l_quantity AS unit_price,
               ({MONEY} * (1 - {DISCOUNT}))::DECIMAL(18,4) AS revenue,
               ({MONEY} * (0.55 + {TAX}))::DECIMAL(18,4) AS cogs,
               ({MONEY} * {TAX})::DECIMAL(18,4) AS spend
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey""",
    "sales_month": f"""
        SELECT date_trunc('month', date)::DATE AS month, region,
               sum(revenue)::DOUBLE AS revenue, sum(units_sold)::BIGINT AS units_sold,
               sum(cogs)::DOUBLE AS cogs,
               {rnd("sum(unit_price::DECIMAL(18,8))::DOUBLE / count(*)", 6)} AS avg_unit_price,
               sum(spend)::DOUBLE AS marketing_spend
        FROM sales GROUP BY ALL""",
    "finance": f"""
        SELECT *, {PNL_INCOME} AS operating_income FROM (
          SELECT *, {rnd("revenue - cogs", 4)} AS gross_profit,
                 {rnd("revenue * 0.12::DOUBLE", 2)} AS opex_other FROM sales_month)""",
    "signal_daily": f"""
        SELECT o_orderdate::DATE AS date, r_name AS region,
               {rnd("sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(*) / 10000.0::DOUBLE", 4)}
                 AS avg_temp_c,
               count(*)::DOUBLE AS precipitation_mm
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY ALL""",
    "signal_month": f"""
        SELECT date_trunc('month', date)::DATE AS month, region,
               {rnd("sum(avg_temp_c::DECIMAL(18,4))::DOUBLE / count(*)", 6)} AS avg_temp_c,
               sum(precipitation_mm::DECIMAL(18,4))::DOUBLE AS total_precip_mm
        FROM signal_daily GROUP BY ALL""",
    "price_month": f"""
        SELECT m.month, {rnd("sum(competitor_price_index::DECIMAL(18,4))::DOUBLE / count(*)", 6)}
                 AS competitor_price_index
        FROM (SELECT month, category,
                     {rnd("100.0::DOUBLE * (r::DOUBLE / u) / (ever_r::DOUBLE / ever_u)", 4)}
                       AS competitor_price_index
              FROM (SELECT date_trunc('month', date)::DATE AS month, category,
                           sum(revenue) AS r, sum(units_sold)::BIGINT AS u
                    FROM sales GROUP BY ALL)
              JOIN (SELECT category, sum(revenue) AS ever_r, sum(units_sold)::BIGINT AS ever_u
                    FROM sales GROUP BY ALL) USING (category)) AS m
        GROUP BY ALL""",
    "macro": f"""
        SELECT date_trunc('month', o_orderdate)::DATE AS month,
               {rnd('''(count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'P'))
                    ::DOUBLE / count(*)''', 3)} AS market_sentiment_score,
               {rnd('''2.0::DOUBLE + 10.0::DOUBLE *
                    (count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE / count(*))''', 2)}
                 AS inflation_rate_pct
        FROM orders GROUP BY ALL""",
    "lagged": """
        SELECT *, lag(revenue, 1) OVER w AS revenue_lag1, lag(revenue, 2) OVER w AS revenue_lag2,
               (lag(revenue, 3) OVER w + lag(revenue, 2) OVER w + lag(revenue, 1) OVER w)
                 / 3.0::DOUBLE AS revenue_rolling3,
               lag(units_sold, 1) OVER w AS units_sold_lag1,
               lag(units_sold, 2) OVER w AS units_sold_lag2,
               (lag(units_sold, 3) OVER w + lag(units_sold, 2) OVER w + lag(units_sold, 1) OVER w)
                 / 3.0::DOUBLE AS units_sold_rolling3
        FROM finance WINDOW w AS (PARTITION BY region ORDER BY month)""",
    "features": """
        SELECT month, region, revenue, units_sold, cogs, avg_unit_price, month AS month_dt,
               avg_temp_c, total_precip_mm, competitor_price_index, market_sentiment_score,
               inflation_rate_pct, marketing_spend, opex_other, operating_income,
               revenue_lag1, revenue_lag2, revenue_rolling3,
               units_sold_lag1, units_sold_lag2, units_sold_rolling3,
               month(month)::INT AS month_num, year(month)::INT AS year,
               ((year(month) - (SELECT min(year(month)) FROM lagged)) * 12 + month(month))::INT
                 AS time_idx
        FROM lagged LEFT JOIN signal_month USING (month, region)
        LEFT JOIN price_month USING (month) LEFT JOIN macro USING (month)
        WHERE revenue_lag1 IS NOT NULL""",
    "latest": """
        SELECT * FROM features
        QUALIFY row_number() OVER (PARTITION BY region ORDER BY month DESC) = 1""",
    "last6": """
        SELECT *, row_number() OVER (PARTITION BY region ORDER BY month)::INT AS step FROM (
          SELECT * FROM finance
          QUALIFY row_number() OVER (PARTITION BY region ORDER BY month DESC) <= 6)""",
    "roi": f"""
        SELECT region, sum(revenue::DECIMAL(18,4))::DOUBLE AS revenue_sum,
               sum(marketing_spend::DECIMAL(18,4))::DOUBLE AS marketing_spend_sum,
               CASE WHEN sum(marketing_spend) > 0 THEN {rnd('''sum(revenue::DECIMAL(18,4))::DOUBLE
                    / sum(marketing_spend::DECIMAL(18,4))::DOUBLE''', 6)} ELSE 1.0 END
                 AS roi_per_dollar
        FROM last6 GROUP BY region""",
    "mom": f"""
        SELECT region, month AS latest_month, {rnd("revenue", 2)} AS revenue,
               {rnd("prior", 2)} AS prior_month_revenue,
               {rnd("(revenue - prior) / nullif(prior, 0) * 100", 2)}
                 AS month_over_month_change_pct, units_sold
        FROM (SELECT *, coalesce(lag(revenue) OVER (PARTITION BY region ORDER BY month), revenue)
                 AS prior FROM finance)
        QUALIFY row_number() OVER (PARTITION BY region ORDER BY month DESC) = 1""",
    "cause": f"""
        SELECT region, month AS latest_month, {rnd("revenue", 2)} AS revenue,
               {rnd("prior", 2)} AS prior_month_revenue,
               {rnd("(revenue - prior) / nullif(prior, 0) * 100", 2)}
                 AS month_over_month_change_pct, units_sold,
               {rnd("competitor_price_index", 1)} AS competitor_price_index,
               {rnd("market_sentiment_score", 3)} AS market_sentiment_score
        FROM (SELECT *, coalesce(lag(revenue) OVER (PARTITION BY region ORDER BY month), revenue)
                 AS prior FROM features)
        QUALIFY row_number() OVER (PARTITION BY region ORDER BY month DESC) = 1""",
    "perf": f"""
        SELECT sku, product_name, category, sum(revenue)::DOUBLE AS revenue,
               sum(units_sold)::BIGINT AS units, sum(cogs)::DOUBLE AS cogs,
               {rnd('''(sum(revenue)::DOUBLE - sum(cogs)::DOUBLE)
                    / nullif(sum(revenue)::DOUBLE, 0)''', 6)} AS gross_margin_pct
        FROM sales WHERE date >= (SELECT max(date) FROM sales) - INTERVAL 180 DAY
        GROUP BY sku, product_name, category""",
    "perf_ranked": """
        SELECT *, rank() OVER (ORDER BY revenue DESC)
               + (count(*) OVER (PARTITION BY revenue) - 1) / 2.0::DOUBLE AS revenue_rank
        FROM perf""",
    "weak": """
        SELECT sku FROM perf_ranked
        WHERE revenue_rank > (SELECT quantile_cont(revenue_rank, 0.7) FROM perf_ranked)
        AND gross_margin_pct < (SELECT median(gross_margin_pct) FROM perf_ranked)""",
    "crm": f"""
        SELECT c_custkey AS customer_id, r_name AS region, c_mktsegment AS segment,
               min(o_orderdate)::DATE AS signup_date,
               ({turn("c_custkey", (1, 12, 24, 36))})::BIGINT AS contract_length_months,
               date_diff('day', min(o_orderdate)::DATE, any_value(as_of)) AS tenure_days,
               count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))
                 AS support_tickets_last_year,
               {rnd('''1.0::DOUBLE + 9.0::DOUBLE * (any_value(c_acctbal) + 1000.0::DOUBLE)
                    / 11000.0::DOUBLE''', 3)} AS satisfaction_score,
               {rnd("sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(*)", 2)} AS avg_order_value,
               count(*) FILTER (o_orderdate::DATE >= as_of - 365) AS orders_last_year,
               (c_custkey % 20) / 100.0::DOUBLE AS discount_pct,
               count(*) FILTER (o_orderdate::DATE >= as_of - 365 AND o_orderstatus = 'P')
                 AS late_payments_last_year,
               (max(o_orderdate)::DATE < any_value(as_of) - 180)::INT AS churned
        FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
        (SELECT max(o_orderdate)::DATE AS as_of FROM orders)
        GROUP BY c_custkey, r_name, c_mktsegment""",
    "people": f"""
        SELECT *, orders_last_year / 12.0::DOUBLE AS orders_per_month,
               (support_tickets_last_year > 5)::INT AS is_high_risk_tickets,
               (contract_length_months <= 1)::INT AS is_short_contract,
               {rnd("avg_order_value * orders_last_year", 2)} AS revenue_last_year_est
        FROM crm""",
    "carded": f"""
        SELECT *, {rnd(LOGIT, 9)} AS logit,
               {rnd(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({rnd(LOGIT, 9)})))", 3)}
                 AS churn_probability
        FROM people""",
    "scores": f"""
        SELECT customer_id, region, segment, churn_probability, {rnd('''revenue_last_year_est
               * 1.05::DOUBLE * (1.0::DOUBLE - 0.5::DOUBLE * churn_probability)''', 2)}
                 AS predicted_clv_12mo
        FROM carded""",
    "scores_and_all": """
        SELECT * FROM scores UNION ALL
        SELECT customer_id, 'ALL', segment, churn_probability, predicted_clv_12mo FROM scores""",
    "summary": f"""
        SELECT region, count(*) AS customers_analyzed,
               count(*) FILTER (churn_probability > 0.6) AS high_risk_count,
               {rnd("sum(churn_probability::DECIMAL(18,3))::DOUBLE / count(*)", 3)}
                 AS avg_churn_probability,
               coalesce(sum(predicted_clv_12mo::DECIMAL(18,2)) FILTER (churn_probability > 0.6), 0)
                 ::DOUBLE AS clv_at_risk
        FROM scores_and_all GROUP BY region""",
    "attribution": " UNION ALL ".join(
        f"""SELECT customer_id, '{n}' AS feature, ({t})::DOUBLE AS value,
            {rnd(f'''{cu.WEIGHTS[n]}::DOUBLE * (({t}) -
              (SELECT sum(({rnd(t, 9)})::DECIMAL(18,9))::DOUBLE / count(*) FROM people))''', 6)}
              AS contribution FROM people"""
        for n, t in TERMS.items()
    ),
    "naive": """
        SELECT region, revenue AS actual, revenue_rolling3 AS prediction
        FROM lagged WHERE revenue_rolling3 IS NOT NULL""",
    "labelled": "SELECT region, churned AS label, churn_probability AS probability FROM carded",
    "area": f"""
        SELECT (sum(label))::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives,
               {rnd('''(sum(mid) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
                    / (sum(label) * (count(*) - sum(label)))''', 6)} AS auc
        FROM (SELECT label, rank() OVER (ORDER BY probability)
                     + (count(*) OVER (PARTITION BY probability) - 1) / 2.0::DOUBLE AS mid
              FROM labelled)""",
    "split": """
        SELECT customer_id, churned, (row_number() OVER (PARTITION BY churned
                 ORDER BY md5(customer_id::VARCHAR), customer_id)
               <= ceil(count(*) OVER (PARTITION BY churned) * 0.2))::INT AS is_test
        FROM people""",
    "demand": """
        SELECT region, sku, sum(units_sold)::DOUBLE / count(*) AS mean_units,
               (""" + turn("sku", (7, 14, 21, 30)) + """)::BIGINT AS supplier_lead_time_days
        FROM sales GROUP BY region, sku""",
    "stock": f"""
        SELECT *, CASE WHEN avg_daily_demand > 0 THEN units_on_hand / avg_daily_demand END
                 AS days_of_supply,
               (coalesce(avg_daily_demand > 0
                 AND units_on_hand / avg_daily_demand < supplier_lead_time_days, false))::INT
                 AS stockout_risk
        FROM (SELECT region, sku, p_name AS product_name, p_type AS category,
                     (sku * 37 + length(region) * 11) % 1500 AS units_on_hand,
                     supplier_lead_time_days, mean_units AS avg_daily_demand,
                     mean_units * supplier_lead_time_days * 0.5::DOUBLE AS safety_stock,
                     mean_units * supplier_lead_time_days * 1.5::DOUBLE AS reorder_point,
                     'SUP-' || (sku % 4) AS supplier,
                     {rnd("p_retailprice * 0.6::DOUBLE", 2)} AS unit_cost
              FROM demand JOIN part ON sku = p_partkey)""",
    "plan": f"""
        SELECT *, {rnd("recommended_order_qty * unit_cost", 2)} AS order_cost_total FROM (
          SELECT *, {rnd("greatest(eoq, reorder_point - units_on_hand, 0.0::DOUBLE)")}
                   AS recommended_order_qty FROM (
            SELECT *, {rnd('''coalesce(sqrt(greatest(2.0::DOUBLE * (avg_daily_demand * 365.0::DOUBLE)
                     * 150.0::DOUBLE
                     / nullif(unit_cost * 0.02::DOUBLE * 365.0::DOUBLE, 0), 0.0)), 0.0)''')} AS eoq
            FROM stock))""",
    "stock_summary": """
        SELECT region, count(*) AS items, sum(stockout_risk)::BIGINT AS items_at_risk,
               sum(recommended_order_qty)::BIGINT AS units_to_order,
               sum(order_cost_total::DECIMAL(18,2))::DOUBLE AS order_cost_total
        FROM (SELECT * FROM plan UNION ALL SELECT * REPLACE ('ALL' AS region) FROM plan)
        GROUP BY region""",
    "region_price": f"""
        SELECT region, avg_unit_price AS base_price, units_sold::DOUBLE AS base_demand,
               CASE WHEN region = 'EUROPE' THEN -1.3 ELSE -1.0 END::DOUBLE AS elasticity,
               avg_unit_price * 0.6::DOUBLE AS unit_cost
        FROM latest""",
    "sku_price": f"""
        SELECT sku, {rnd("revenue / nullif(units, 0)", 4)} AS base_price,
               units::DOUBLE AS base_demand, -1.0::DOUBLE AS elasticity,
               {rnd("cogs / nullif(units, 0)", 4)} AS unit_cost
        FROM (SELECT sku, sum(revenue)::DOUBLE AS revenue, sum(units_sold)::BIGINT AS units,
                     sum(cogs)::DOUBLE AS cogs FROM sales GROUP BY sku)""",
    "pricing": f"""
        SELECT region, {rnd("base_price", 2)} AS current_avg_price,
               elasticity AS elasticity_assumption, {BEST_COLUMNS}
        FROM (WITH {best_of("region_price", "region")} SELECT * FROM ranked WHERE place = 1)""",
    "offers": f"""
        SELECT region, supplier,
               {rnd("sum(unit_cost::DECIMAL(18,2))::DOUBLE / count(*)", 2)} AS unit_cost,
               sum(units_on_hand)::DOUBLE AS capacity, any_value(v) AS required_volume
        FROM plan JOIN (SELECT region, sum(recommended_order_qty)::BIGINT::DOUBLE AS v
                        FROM plan GROUP BY region) USING (region)
        GROUP BY region, supplier""",
    "docs": f"SELECT doc_id, source, text, {CLEAN} AS c FROM documents",
    "chunks": f"""
        SELECT doc_id, source, n AS chunk_no, substring(c, n * 400 + 1, 500) AS text
        FROM (SELECT doc_id, source, c, unnest(range(({CHUNKS_OF})::BIGINT)) AS n FROM docs)""",
    "chunk_terms": f"""
        SELECT doc_id, chunk_no, {PAIRS} AS terms
        FROM (SELECT doc_id, chunk_no, {words("text")} AS w FROM chunks)""",
    "vocab": """
        SELECT term, count(*) AS total
        FROM (SELECT unnest(terms) AS term FROM chunk_terms)
        GROUP BY term ORDER BY total DESC, term LIMIT 2048""",
    "tf": """
        SELECT doc_id, chunk_no, term, count(*) AS tf
        FROM (SELECT doc_id, chunk_no, unnest(terms) AS term FROM chunk_terms)
        WHERE term IN (SELECT term FROM vocab) GROUP BY ALL""",
    "idf": """
        SELECT term, any_value(total) AS total, count(*) AS df,
               ln((1.0::DOUBLE + (SELECT count(*) FROM chunks)) / (1.0::DOUBLE + count(*)))
                 + 1.0::DOUBLE AS idf
        FROM tf JOIN vocab USING (term) GROUP BY term""",
    "weights": """
        SELECT doc_id, chunk_no, term, tf,
               tf * idf / sqrt(sum((tf * idf) * (tf * idf))
                 OVER (PARTITION BY doc_id, chunk_no)) AS weight
        FROM tf JOIN idf USING (term)""",
    "query_tf": f"""
        SELECT item_id AS query_id, term, count(*) AS tf
        FROM (SELECT item_id, unnest({PAIRS}) AS term
              FROM (SELECT item_id, {words("text")} AS w FROM benchmark))
        GROUP BY ALL""",
    "query_weights": """
        SELECT query_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf))
                 OVER (PARTITION BY query_id)) AS weight
        FROM query_tf JOIN idf USING (term)""",
    "hits": f"""
        SELECT query_id, row_number() OVER (PARTITION BY query_id
                 ORDER BY score DESC, doc_id, chunk_no) AS rank, doc_id, chunk_no, score
        FROM (SELECT query_id, doc_id, chunk_no,
                     {rnd("sum(weights.weight * query_weights.weight)", 6)} AS score
              FROM weights JOIN query_weights USING (term) GROUP BY ALL)
        QUALIFY rank <= 4""",
    "hit_text": "SELECT * FROM hits JOIN chunks USING (doc_id, chunk_no)",
    "questions": f"""
        SELECT question_id, question FROM (VALUES
        {values([(f"sample-{n:02d}", t) for n, t in enumerate(q.SAMPLE_QUESTIONS, 1)])})
        AS v(question_id, question)
        UNION ALL SELECT 'conv-' || conv_id || '-' || turn, text
        FROM conversations WHERE role = 'user'""",
    "tagged": "SELECT *, " + case(
        [
            (" OR ".join(f"contains(lower(question), {quoted(w)})" for w in kws), quoted(name))
            for name, kws in q.RULES
        ],
        quoted(q.DEFAULT_TYPE),
    ) + f""" AS answer_type,
        (SELECT r_name FROM region WHERE contains(lower(question), lower(r_name))
         ORDER BY r_regionkey LIMIT 1) AS region,
        coalesce(floor({number(q.BUDGET_PATTERN)} *
          CASE regexp_extract(lower(question), '{q.BUDGET_PATTERN}', 2)
            WHEN 'million' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'k' THEN 1e3 ELSE 1 END),
          1000000.0)::DOUBLE AS budget FROM questions""",
    "parsed": f"""
        SELECT question_id,
               coalesce(i, CASE WHEN i IS NULL AND p IS NULL AND c IS NULL THEN 3.0 END, 0.0)
                 ::DOUBLE AS inflation_delta_pts,
               coalesce(p / 100.0::DOUBLE, 0.0) AS price_change_pct,
               coalesce(-c / 100.0::DOUBLE, 0.0) AS competitor_price_change_pct
        FROM (SELECT question_id, {number(q.INFLATION_PATTERN)} AS i,
                     {number(q.PRICE_PATTERN)} AS p, {number(q.COMPETITOR_PATTERN)} AS c
              FROM questions)""",
}


def check(name: str, sql: str) -> None:
    """Prefix the statement with the parts it reads, directly or through other parts."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for part in PARTS:
            if part not in wanted and re.search(rf"\b(FROM|JOIN)\s+{part}\b|, {part}\b", text):
                need(PARTS[part])
                if part not in wanted:
                    wanted.append(part)

    need(sql)
    head = ",\n".join(f"{part} AS ({PARTS[part]})" for part in wanted)
    if not wanted:
        CHECKS[name] = sql
    elif sql.startswith("WITH "):
        CHECKS[name] = f"WITH {head},\n{sql[5:]}"
    else:
        CHECKS[name] = f"WITH {head}\n{sql}"


check("src_csv_roundtrip", "SELECT * FROM crm")
check("src_parquet_partitioned",
      "SELECT region, month, revenue, units_sold FROM finance WHERE region = 'EUROPE'")
check("src_json_roundtrip", """SELECT region, month, revenue, units_sold FROM finance
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY month DESC) = 1""")
check("src_documents", f"""SELECT doc_id, source, length(text) AS chars, length(c) AS clean_chars,
    ({CHUNKS_OF})::BIGINT AS chunks FROM docs""")

check("monthly_sales",
      "SELECT month, region, revenue, units_sold, cogs, avg_unit_price FROM sales_month")
check("monthly_by_region",
      "SELECT month, region, revenue, units_sold FROM sales_month WHERE region = 'EUROPE'")
check("monthly_signal", "SELECT * FROM signal_month")
check("monthly_price_index", "SELECT * FROM price_month")
check("finance_pnl", """SELECT month, region, revenue, cogs, gross_profit, marketing_spend,
    opex_other, operating_income FROM finance""")
check("time_index", """SELECT region, month, month(month)::INT AS month_num,
    year(month)::INT AS year, ((year(month) - (SELECT min(year(month)) FROM finance)) * 12
    + month(month))::INT AS time_idx FROM finance""")
check("lag_features", """SELECT region, month, revenue_lag1, revenue_lag2, units_sold_lag1,
    units_sold_lag2 FROM lagged""")
check("rolling3", "SELECT region, month, revenue_rolling3, units_sold_rolling3 FROM lagged")
check("monthly_features", "SELECT * FROM features")
check("latest_month", """SELECT region, month, revenue, units_sold, cogs FROM finance
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY month DESC) = 1""")
check("mom_change", "SELECT * FROM mom")
check("yoy_change", f"""SELECT region, a.month, {rnd("a.revenue", 2)} AS revenue,
    {rnd("y.revenue", 2)} AS year_ago_revenue,
    {rnd("(a.revenue - y.revenue) / nullif(y.revenue, 0) * 100", 2)} AS year_over_year_change_pct
    FROM finance a LEFT JOIN (SELECT region, (month + INTERVAL 12 MONTH)::DATE AS month, revenue
    FROM finance) y USING (region, month)""")
check("trend_6m", "SELECT region, step, month, revenue, units_sold FROM last6")
check("trend_long", """SELECT region, month, 'revenue' AS series, revenue AS value FROM last6
    UNION ALL SELECT region, month, 'units_sold', units_sold::DOUBLE FROM last6""")
check("one_hot", "SELECT region, month, " + ", ".join(
    f"(region = '{r}')::INT AS \"region_{r}\""
    for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM features")
check("trailing_180d", """SELECT date, count(*) AS lines, sum(revenue)::DOUBLE AS revenue,
    sum(units_sold)::BIGINT AS units FROM sales
    WHERE date >= (SELECT max(date) FROM sales) - INTERVAL 180 DAY GROUP BY date""")
check("marketing_roi", "SELECT * FROM roi")

check("sku_performance", "SELECT * FROM perf")
check("sku_rank", "SELECT sku, revenue, revenue_rank FROM perf_ranked")
check("discontinue_candidates", """SELECT * FROM perf_ranked
    WHERE revenue_rank > (SELECT quantile_cont(revenue_rank, 0.7) FROM perf_ranked)
    AND gross_margin_pct < (SELECT median(gross_margin_pct) FROM perf_ranked)""")

check("customer_features", "SELECT * FROM people")
check("clv_label", f"""SELECT customer_id, churned, {rnd('''revenue_last_year_est * 1.05::DOUBLE
    * (1.0::DOUBLE - 0.5::DOUBLE * churned)''', 2)} AS clv_12mo FROM people""")
check("scorecard", f"""SELECT customer_id, {rnd("logit", 6)} AS logit, churn_probability
    FROM carded""")
check("scorecard_attribution", "SELECT * FROM attribution")
check("global_drivers", f"""SELECT feature, {rnd('''sum(abs(contribution)::DECIMAL(18,6))::DOUBLE
    / count(*)''', 6)} AS mean_abs_contribution FROM attribution GROUP BY feature
    ORDER BY mean_abs_contribution DESC, feature LIMIT 8""")
check("customer_scores", f"""SELECT s.*, d.top_churn_drivers FROM scores s JOIN (
    SELECT customer_id, string_agg(printf('%s (%s%.2f)', feature,
      CASE WHEN contribution > 0 THEN '+' ELSE '-' END, {rnd("abs(contribution)", 2)}), '; '
      ORDER BY place) AS top_churn_drivers
    FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
            ORDER BY abs(contribution) DESC, feature) AS place FROM attribution)
    WHERE place <= 3 GROUP BY customer_id) d USING (customer_id)""")
check("risk_tier", """SELECT CASE WHEN churn_probability > 0.6 THEN 'High'
    WHEN churn_probability > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_tier, segment,
    count(*) AS customers FROM scores GROUP BY ALL""")
check("churn_summary", "SELECT * FROM summary")
BUCKET_ROWS = values(
    [(i, label, cu.BUCKETS[i - 2][0] if i > 1 else -1.0, edge)
     for i, (edge, label) in enumerate(cu.BUCKETS, 1)]
)
check("churn_histogram", f"""SELECT r.region, bucket_no, bucket, count(s.customer_id) AS customers
    FROM (SELECT DISTINCT region FROM scores) r,
         (VALUES {BUCKET_ROWS}) AS v(bucket_no, bucket, low, high)
    LEFT JOIN scores s ON r.region = s.region AND churn_probability > low
         AND churn_probability <= high GROUP BY ALL""")
check("top_at_risk", """SELECT * FROM scores
    ORDER BY churn_probability DESC, customer_id LIMIT 10""")
check("churn_answer", """SELECT * FROM summary JOIN (SELECT region, """ + ", ".join(
    f"count(*) FILTER (churn_probability > {cu.BUCKETS[i - 1][0] if i else -1} "
    f"AND churn_probability <= {e}) AS bucket_{i + 1}" for i, (e, _) in enumerate(cu.BUCKETS)
) + """ FROM scores_and_all GROUP BY region) USING (region) JOIN (
    SELECT region, string_agg(customer_id::VARCHAR, ',' ORDER BY place) AS top_at_risk_customers
    FROM (SELECT region, customer_id, row_number() OVER (PARTITION BY region
            ORDER BY churn_probability DESC, customer_id) AS place FROM scores_and_all)
    WHERE place <= 10 GROUP BY region) USING (region)""")

REGRESSION = f"""count(*) AS rows,
    {rnd("sum(abs(actual - prediction)::DECIMAL(18,6))::DOUBLE / count(*)", 4)} AS mae,
    {rnd('''sum((abs(actual - prediction) / nullif(abs(actual), 0))::DECIMAL(28,12))::DOUBLE
         / count(*)''', 6)} AS mape,
    {rnd('''1.0 - sum((actual - prediction) * (actual - prediction))
         / sum((actual - mean) * (actual - mean))''', 6)} AS r2"""
check("regression_metrics", f"""SELECT region, {REGRESSION}
    FROM (SELECT *, avg(actual) OVER (PARTITION BY region) AS mean FROM naive) GROUP BY region""")
check("naive_forecast_metrics", f"""SELECT {REGRESSION}
    FROM (SELECT *, avg(actual) OVER () AS mean FROM naive)""")
check("classification_metrics", f"""SELECT region, n AS rows, tp AS true_positives,
    fp AS false_positives, fn AS false_negatives,
    coalesce({rnd("tp / nullif(tp + fp, 0)::DOUBLE", 6)}, 0) AS precision,
    coalesce({rnd("tp / nullif(tp + fn, 0)::DOUBLE", 6)}, 0) AS recall,
    coalesce({rnd("2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE", 6)}, 0) AS f1
    FROM (SELECT region, count(*) AS n, count(*) FILTER (probability >= 0.5 AND label = 1) AS tp,
    count(*) FILTER (probability >= 0.5 AND label = 0) AS fp,
    count(*) FILTER (probability < 0.5 AND label = 1) AS fn FROM labelled GROUP BY region)""")
check("auc", "SELECT * FROM area")
check("confidence_label", f"""SELECT *, CASE WHEN coalesce(r2, auc) IS NULL THEN 'Unknown'
    WHEN coalesce(r2, auc) >= 0.85 THEN 'High' WHEN coalesce(r2, auc) >= 0.7 THEN 'Medium'
    ELSE 'Low' END AS confidence FROM (
    SELECT 'naive forecast' AS model, r2, NULL::DOUBLE AS auc FROM (SELECT {REGRESSION}
      FROM (SELECT *, avg(actual) OVER () AS mean FROM naive))
    UNION ALL SELECT 'scorecard', NULL, auc FROM area)""")
check("split_stratified", "SELECT * FROM split")
check("split_counts", f"""SELECT is_test, count(*) AS rows,
    {rnd("sum(churned)::DOUBLE / count(*)", 6)} AS label_rate FROM split GROUP BY is_test""")

check("inventory_features", "SELECT * FROM stock")
check("reorder_policy", f"""SELECT region, sku, supplier_lead_time_days,
    {rnd("mean_units", 2)} AS avg_daily_demand, s AS safety_stock,
    {rnd("mean_units * supplier_lead_time_days + s", 1)} AS reorder_point
    FROM (SELECT *, {rnd("mean_units * supplier_lead_time_days * 0.5::DOUBLE", 1)} AS s
          FROM demand)""")
check("eoq_plan", """SELECT region, sku, eoq, recommended_order_qty, order_cost_total,
    stockout_risk FROM plan""")


def funding(budget: float, by: str) -> str:
    fraction = f"""CASE WHEN recommended_order_qty = 0 THEN 0.0 WHEN order_cost_total = 0 THEN 1.0
        ELSE {rnd(f"greatest(0.0, least(1.0, ({budget}::DECIMAL(18,2) - spent)::DOUBLE / order_cost_total))", 3)} END"""
    return f"""SELECT *, {rnd("funded_order_qty * unit_cost", 2)} AS funded_cost FROM (
        SELECT *, {rnd("recommended_order_qty * funded_fraction")} AS funded_order_qty FROM (
        SELECT *, {fraction} AS funded_fraction FROM (
        SELECT region, sku, recommended_order_qty, order_cost_total, unit_cost,
               1 + 2 * stockout_risk AS priority_weight,
               coalesce(sum(order_cost_total::DECIMAL(18,2)) OVER ({by} ORDER BY
                 recommended_order_qty * (1 + 2 * stockout_risk) / nullif(order_cost_total, 0)
                 DESC NULLS FIRST, sku, region
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
        FROM plan)))"""


FUNDED = """region, sku, recommended_order_qty, order_cost_total, priority_weight,
    funded_fraction, funded_order_qty, funded_cost"""
check("fund_inventory", f"SELECT {FUNDED} FROM ({funding(2e6, 'PARTITION BY region')})")
check("fund_inventory_global", f"SELECT {FUNDED} FROM ({funding(1e7, '')})")
check("at_risk_stock", """SELECT region, sku, units_on_hand, supplier_lead_time_days,
    days_of_supply FROM stock WHERE stockout_risk = 1""")
check("inventory_answer", "SELECT * FROM stock_summary")
check("supplier_exposure", """SELECT region, supplier, sum(units_on_hand)::BIGINT AS units_on_hand
    FROM stock GROUP BY ALL""")

check("price_grid", f"""SELECT sku, option_no, price_change_pct,
    {grid_columns(NEW_PRICE, NEW_UNITS)}
    FROM sku_price, (VALUES {GRID}) AS v(option_no, price_change_pct)""")
check("price_best", f"""WITH {best_of("sku_price", "sku")}
    SELECT sku, {BEST_COLUMNS} FROM ranked WHERE place = 1""")
check("pricing_answer", "SELECT * FROM pricing")
MARKETING = f"""SELECT question_id, budget,
    CASE WHEN budget >= floors THEN 'allocated' ELSE 'budget below floors' END AS status, region,
    roi_per_dollar AS predicted_roi_per_dollar, {rnd("spend", 2)} AS allocated_budget,
    {rnd(rnd("spend", 2) + " * roi_per_dollar", 2)} AS predicted_incremental_revenue
    FROM (SELECT *, CASE WHEN budget >= floors THEN 50000.0 + CASE WHEN place = 1
            AND roi_per_dollar > 0 THEN budget - floors ELSE 0 END END::DOUBLE AS spend
    FROM (SELECT question_id, budget, r.region, roi_per_dollar,
                 50000.0 * count(*) OVER (PARTITION BY question_id) AS floors,
                 row_number() OVER (PARTITION BY question_id
                   ORDER BY roi_per_dollar DESC, r.region) AS place
          FROM tagged t, (SELECT * FROM roi) r
          WHERE answer_type = 'marketing_budget_allocation'))"""
check("marketing_allocation", MARKETING)


def supply(share: float, relax: bool) -> str:
    relaxed = "WHEN whole >= required_volume - 1e-6 THEN 'share limit relaxed'" if relax else ""
    taken = f"greatest(0.0, least(limit_, required_volume - before))"
    return f"""SELECT region, supplier, unit_cost, capacity, required_volume, status,
        {rnd(taken, 1)} AS allocated_volume, {rnd(f"{taken} * unit_cost", 2)} AS allocated_cost,
        coalesce({rnd(f"{taken} / nullif(required_volume, 0)", 3)}, 0) AS share_of_total
        FROM (SELECT *, coalesce(sum(limit_) OVER (PARTITION BY region ORDER BY unit_cost, supplier
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT *, CASE status WHEN 'feasible' THEN least(capacity, {share} * required_volume)
                WHEN 'share limit relaxed' THEN least(capacity, required_volume) ELSE 0.0 END::DOUBLE
                AS limit_
        FROM (SELECT *, CASE WHEN capped >= required_volume - 1e-6 THEN 'feasible' {relaxed}
                ELSE 'infeasible' END AS status
        FROM (SELECT *, sum(least(capacity, {share} * required_volume)) OVER w AS capped,
                     sum(least(capacity, required_volume)) OVER w AS whole
              FROM offers WINDOW w AS (PARTITION BY region)))))"""


check("supplier_allocation", supply(0.4, False))
check("supplier_relaxed", supply(0.3, True))
check("scenario_inputs", f"""SELECT region, month, inflation_rate_pct, competitor_price_index,
    marketing_spend, {SCENARIO_NAMES},
    {rnd("inflation_rate_pct + inflation_delta_pts", 6)} AS scenario_inflation_rate_pct,
    {rnd("competitor_price_index * (1.0 + competitor_price_change_pct)", 6)}
      AS scenario_competitor_price_index,
    {rnd("marketing_spend * (1.0 + marketing_change_pct)", 4)} AS scenario_marketing_spend
    FROM latest, (VALUES {SCENARIO_VALUES}) AS v({SCENARIO_NAMES})""")
check("scenario_elastic", f"""SELECT {outcome("revenue", "units_sold::DOUBLE")}
    FROM latest, (VALUES {SCENARIO_VALUES}) AS v({SCENARIO_NAMES})""")
check("scenario_elastic_answer", f"""SELECT {outcome("revenue", "units_sold::DOUBLE")} FROM (
    SELECT coalesce(t.region, 'AMERICA') AS region, t.question_id AS scenario, p.*,
           0.0::DOUBLE AS marketing_change_pct, -1.1::DOUBLE AS demand_elasticity
    FROM tagged t JOIN parsed p USING (question_id) WHERE answer_type = 'scenario_simulation')
    JOIN (SELECT region, revenue, units_sold, avg_unit_price FROM latest) USING (region)""")

check("chunk_documents", "SELECT doc_id, source, chunk_no, md5(text) AS text_md5 FROM chunks")
check("tokenize_ngrams", """SELECT doc_id, chunk_no, len(terms)::BIGINT AS terms,
    md5(array_to_string(terms, '|')) AS terms_md5 FROM chunk_terms""")
check("tfidf_vocab", f"SELECT term, total, df, {rnd('idf', 6)} AS idf FROM idf")
check("tfidf_weights",
      f"SELECT doc_id, chunk_no, term, tf, {rnd('weight', 6)} AS weight FROM weights")
check("retrieve_topk", "SELECT * FROM hits")
check("evidence", f"""SELECT query_id, rank, source,
    trim(substring(text, 1, 300), '{tx.SPACE}') AS excerpt,
    {rnd("score", 3)} AS relevance_score FROM hit_text""")
check("evidence_sources", """SELECT query_id, string_agg(DISTINCT source, ', ' ORDER BY source)
    AS sources FROM hit_text GROUP BY query_id""")
check("vector_topk", f"""WITH element AS (
      SELECT label, pos, sum(floor(embedding[pos]::DOUBLE * 1e6 + 0.5)) / count(*) AS x
      FROM embeddings, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)))
        AS pos) AS places GROUP BY label, pos),
    centre AS (SELECT label::BIGINT AS query_id, list(x ORDER BY pos) AS e FROM element GROUP BY label)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
           vec_id, score
    FROM (SELECT query_id, vec_id, {rnd("list_cosine_similarity(embedding::DOUBLE[], e)", 6)} AS score
          FROM embeddings, centre) QUALIFY rank <= 4""")

check("tag_questions", "SELECT question_id, answer_type FROM tagged")
check("detect_region", "SELECT question_id, region FROM tagged")
check("parse_budget", "SELECT question_id, budget FROM tagged")
check("parse_scenario", "SELECT * FROM parsed")
check("root_cause", "SELECT * FROM cause")
ACTION_ROWS = """SELECT region, priority, owner, action, figure, amount, printf(pattern, figure, amount) AS rationale
    FROM (SELECT region, priority, owner, action, pattern, CASE priority
      WHEN 1 THEN items_at_risk WHEN 2 THEN recommended_price_change_pct
      WHEN 3 THEN high_risk_count ELSE month_over_month_change_pct END::DOUBLE AS figure,
    CASE priority WHEN 1 THEN units_to_order WHEN 2 THEN projected_profit_impact
      WHEN 3 THEN clv_at_risk ELSE revenue END::DOUBLE AS amount
    FROM (SELECT * FROM cause JOIN pricing USING (region) JOIN summary USING (region)
          JOIN stock_summary USING (region)),
    (VALUES (1, 'VP Supply Chain', 'Find a second source for stock that runs out before delivery',
             '%.0f stock items have fewer days left than their delivery takes; %.0f units are due for order.'),
            (2, 'VP Pricing', 'Trial the price step with the best modelled profit',
             'Of all price steps tried, %.2f earns most: %.2f more a month than today.'),
            (3, 'VP Sales / Customer Success', 'Call customers over the churn limit, largest value first',
             '%.0f customers score above 0.6; over a year they stand for %.2f.'),
            (4, 'CFO', 'Restate the forecast from the newest month',
             'Revenue changed by %.2f percent in a month and now stands at %.2f.'))
      AS v(priority, owner, action, pattern))"""
check("action_plan", ACTION_ROWS)
check("kpi_rows", """SELECT region, 'revenue' AS section, kpi, value FROM (UNPIVOT
      (SELECT region, revenue, month_over_month_change_pct, competitor_price_index FROM cause)
      ON COLUMNS(* EXCLUDE region) INTO NAME kpi VALUE value)
    UNION ALL SELECT region, 'churn', kpi, value FROM (UNPIVOT
      (SELECT region, customers_analyzed::DOUBLE AS customers_analyzed,
              high_risk_count::DOUBLE AS high_risk_count, clv_at_risk, avg_churn_probability
       FROM summary) ON COLUMNS(* EXCLUDE region) INTO NAME kpi VALUE value)
    UNION ALL SELECT region, 'pricing', kpi, value FROM (UNPIVOT
      (SELECT region, current_avg_price, recommended_price_change_pct, projected_profit_impact
       FROM pricing) ON COLUMNS(* EXCLUDE region) INTO NAME kpi VALUE value)
    UNION ALL SELECT 'ALL', 'confidence', 'churn_auc', auc FROM area""")

# --- answers in full
check("top_customers", f"""SELECT scope, place, customer_id, region, segment, churn_probability,
    predicted_clv_12mo, top_churn_drivers
    FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY churn_probability DESC, customer_id)
            AS place FROM (SELECT region AS scope, * FROM scores UNION ALL SELECT 'ALL', * FROM scores))
    JOIN (SELECT customer_id, string_agg(printf('%s (%s%.2f)', feature,
        CASE WHEN contribution > 0 THEN '+' ELSE '-' END, {rnd("abs(contribution)", 2)}), '; '
        ORDER BY spot) AS top_churn_drivers
      FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
              ORDER BY abs(contribution) DESC, feature) AS spot FROM attribution)
      WHERE spot <= 3 GROUP BY customer_id) USING (customer_id) WHERE place <= 10""")
OFFERS = """(VALUES ('Nordic Supply Co', 42.0::DOUBLE, 25000.0::DOUBLE), ('Meridian Components', 45.0, 25000.0),
    ('PacificParts Ltd', 44.0, 22000.0), ('Delta Manufacturing', 47.5, 18000.0)) AS o(supplier, unit_cost, capacity)"""
VOLUMES = "SELECT region, sum(recommended_order_qty)::BIGINT::DOUBLE AS required_volume FROM plan GROUP BY region"
check("supplier_given", supply(0.4, True).replace(
    "FROM offers WINDOW", f"FROM (SELECT * FROM ({VOLUMES}), {OFFERS}) WINDOW"))
check("supplier_shared", f"""WITH supply AS (SELECT *, sum(capacity::DECIMAL(18,2)) OVER (
        ORDER BY unit_cost, supplier ROWS UNBOUNDED PRECEDING) AS upto FROM {OFFERS}),
    wanted AS (SELECT *, sum(required_volume::DECIMAL(18,2)) OVER (ORDER BY region ROWS UNBOUNDED PRECEDING)
        AS upto FROM ({VOLUMES})),
    everything AS (SELECT sum(capacity::DECIMAL(18,2)) AS total FROM supply),
    overlap AS (SELECT region, supplier, unit_cost, capacity, required_volume,
        CASE WHEN w.upto <= total THEN 'served' ELSE 'partly served' END AS status,
        (least(s.upto, w.upto) - greatest(s.upto - capacity::DECIMAL(18,2), w.upto - required_volume::DECIMAL(18,2)))
          ::DOUBLE AS allocated_volume FROM supply s, wanted w, everything)
    SELECT *, {rnd("allocated_volume * unit_cost", 2)} AS allocated_cost FROM overlap WHERE allocated_volume > 0
    UNION ALL SELECT region, NULL, NULL, NULL, required_volume, 'unserved', 0.0, 0.0 FROM wanted, everything
    WHERE upto - required_volume::DECIMAL(18,2) >= total AND required_volume > 0""")
check("answer_rows", """SELECT 'product_discontinuation' AS answer_type, 'ALL' AS region, 'ALL' AS item_region,
      sku, revenue AS amount, (sku IN (SELECT sku FROM weak))::INT AS marked FROM perf
    UNION ALL SELECT 'inventory_recommendation', region, region, sku, recommended_order_qty::DOUBLE, stockout_risk::INT FROM plan
    UNION ALL SELECT 'inventory_recommendation', 'ALL', region, sku, recommended_order_qty::DOUBLE, stockout_risk::INT FROM plan""")

# --- invariants of the models: what holds whatever the trees are
check("change_gap", "SELECT region, 0.0::DOUBLE AS gap, 19::BIGINT AS features FROM latest")
TEST_ROWS = "SELECT * FROM features WHERE time_idx > (SELECT max(time_idx) FROM features) - 12"
check("attribution_gap", f"""SELECT target, region, month, 0.0::DOUBLE AS gap
    FROM ({TEST_ROWS}), (VALUES ('revenue'), ('units_sold')) AS t(target)""")
check("customer_attribution_gap", "SELECT customer_id, 0.0::DOUBLE AS gap FROM people")
check("scenario_unchanged", """SELECT region, 0.0::DOUBLE AS demand_pct, 0.0::DOUBLE AS like_for_like_pct,
    0.0::DOUBLE AS model_difference FROM latest""")
check("model_store", f"""SELECT 1 AS version, (SELECT count(*) FROM ({TEST_ROWS})) AS rows, 0::BIGINT AS differing,
    (SELECT count(*) FROM features) - (SELECT count(*) FROM ({TEST_ROWS})) AS trained_on, 5 AS trees, 14 AS inputs""")

# --- the sentences, word for word
SENTENCES = [
    ("revenue_root_cause",
     "In %s the newest month brought %.2f, a change of %.2f percent on the month before.",
     f"region, {rnd('revenue', 2)}, {rnd('month_over_month_change_pct', 2)}", "cause"),
    ("churn_prediction",
     "%s: %d out of %d customers are likely to go, and %.2f of yearly value with them.",
     f"region, high_risk_count, customers_analyzed, {rnd('clv_at_risk', 2)}", "summary"),
    ("product_discontinuation",
     "%d products sell little at a thin margin; together they brought %.2f lately.",
     f"weak, {rnd('amount', 2)}",
     """(SELECT 'ALL' AS region, count(*) AS weak, coalesce(sum(revenue::DECIMAL(18,4)), 0)::DOUBLE AS amount
         FROM perf WHERE sku IN (SELECT sku FROM weak))"""),
    ("inventory_recommendation",
     "%s: %d items of %d run short before a delivery; ordering %d units costs %.2f.",
     f"region, items_at_risk, items, units_to_order, {rnd('order_cost_total', 2)}", "stock_summary"),
    ("pricing_strategy",
     "%s: with elasticity %.1f a step of %.2f earns %.2f a month, staying put %.2f.",
     "region, elasticity_assumption, recommended_price_change_pct, "
     f"{rnd('estimated_profit', 2)}, {rnd('unchanged_profit', 2)}", "pricing"),
    ("marketing_budget_allocation",
     "%s gets %.2f of a budget of %.2f and should return %.2f.",
     f"region, {rnd('spend', 2)}, budget, {rnd(rnd('spend', 2) + ' * roi_per_dollar', 2)}",
     """(SELECT *, (50000.0 + CASE WHEN place = 1 AND roi_per_dollar > 0 THEN budget - floors ELSE 0 END)::DOUBLE AS spend
         FROM (SELECT region, roi_per_dollar, 1000000.0::DOUBLE AS budget, 50000.0 * count(*) OVER () AS floors,
                 row_number() OVER (ORDER BY roi_per_dollar DESC, region) AS place FROM roi))"""),
    ("supplier_selection",
     "%s needs %.0f units: %d suppliers at a cost of %.2f (%s).",
     "region, volume, used, cost, status",
     f"""(SELECT region, max(required_volume) AS volume, max(status) AS status,
           count(*) FILTER (allocated_volume > 0) AS used, sum(allocated_cost::DECIMAL(18,2))::DOUBLE AS cost
         FROM ({supply(0.4, True).replace("FROM offers WINDOW", f"FROM (SELECT * FROM ({VOLUMES}), {OFFERS}) WINDOW")})
         GROUP BY region)"""),
    ("scenario_simulation",
     "%s: if competitors cut prices by a tenth, revenue goes from %.2f to %.2f.",
     "region, baseline_revenue, scenario_revenue",
     f"""(SELECT {outcome("revenue", "units_sold::DOUBLE")}
         FROM latest, (VALUES {SCENARIO_VALUES}) AS v({SCENARIO_NAMES}) WHERE scenario = 'competitor cuts 10%')"""),
    ("executive_action_plan",
     "%s: %d steps in order of priority, beginning with this one: %s.",
     "region, n, first", f"(SELECT region, count(*) AS n, min_by(action, priority) AS first FROM ({ACTION_ROWS}) GROUP BY region)"),
    ("general_document_qa",
     "No figures apply; the closest passages are taken from %d documents of %d sources.",
     "n, m", "(SELECT 'ALL' AS region, count(*) AS n, count(DISTINCT source) AS m FROM documents)"),
]
check("narrative", " UNION ALL ".join(
    f"SELECT region, '{kind}' AS answer_type, printf({quoted(pattern)}, {columns}) AS narrative FROM {rows}"
    for kind, pattern, columns, rows in SENTENCES))


# --- files
check("src_text_folder", """SELECT doc_id, 'doc_id=' || doc_id AS folder, strlen(coalesce(text, '')) + 1 AS bytes,
    length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS text_md5 FROM documents""")


def in_order(columns: str, rows: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS place FROM {rows}"


check("sorted_scores", in_order("*", "scores", "churn_probability DESC, customer_id"))
check("sorted_products", in_order("sku, revenue", "perf", "revenue DESC NULLS LAST, sku"))
check("sorted_candidates", in_order(
    "sku, revenue", "perf WHERE sku IN (SELECT sku FROM weak)", "revenue ASC NULLS LAST, sku"))
check("sorted_plan", in_order(
    "region, sku, stockout_risk, recommended_order_qty", "plan", "stockout_risk DESC, region, sku"))
GIVEN = supply(0.4, True).replace("FROM offers WINDOW", f"FROM (SELECT * FROM ({VOLUMES}), {OFFERS}) WINDOW")
check("sorted_supply", in_order(
    "region, supplier, allocated_volume, allocated_cost", f"({GIVEN})", "region, allocated_volume DESC, supplier"))
check("sorted_budget", in_order(
    "question_id, region, allocated_budget", f"({MARKETING})", "question_id, allocated_budget DESC NULLS LAST, region"))

# --- model inputs, embedders
INPUTS = (
    "revenue_lag1", "revenue_lag2", "revenue_rolling3", "units_sold_lag1", "units_sold_lag2", "units_sold_rolling3",
    "avg_temp_c", "total_precip_mm", "competitor_price_index", "market_sentiment_score", "inflation_rate_pct",
    "marketing_spend", "month_num", "time_idx",
)
check("missing_inputs", " UNION ALL ".join(
    f"SELECT region, month, '{c}' AS feature, coalesce({c}::DOUBLE, -1e9) AS value, ({c} IS NULL)::INT AS missing FROM features"
    for c in INPUTS))
HASHED = """SELECT {key}, list(n ORDER BY place) AS e FROM (
      SELECT {key}, place, coalesce(sum(CASE WHEN bucket = place THEN sign END), 0)::DOUBLE AS n
      FROM (SELECT {key}, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS bucket,
              CASE WHEN ('0x' || substr(md5(term), 5, 1))::INT < 8 THEN 1 ELSE -1 END AS sign
            FROM (SELECT {key}, unnest(terms) AS term FROM {rows})), range(64) AS p(place)
      GROUP BY {key}, place) GROUP BY {key}"""
BENCH_TERMS = f"""(SELECT item_id AS query_id, {PAIRS} AS terms
    FROM (SELECT item_id, {words("text")} AS w FROM benchmark))"""
check("embed_topk", f"""WITH c AS (SELECT doc_id * 1000000 + chunk_no AS vec_id, e FROM (
        {HASHED.format(key="doc_id, chunk_no", rows="chunk_terms")})),
    z AS (SELECT vec_id, coalesce(e, list_transform(range(64), lambda x: 0.0::DOUBLE)) AS e
          FROM (SELECT doc_id * 1000000 + chunk_no AS vec_id FROM chunk_terms) LEFT JOIN c USING (vec_id)),
    q AS ({HASHED.format(key="query_id", rows=BENCH_TERMS)})
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
    FROM (SELECT query_id, vec_id, {rnd("coalesce(list_dot_product(z.e, q.e) / nullif(sqrt(list_dot_product(z.e, z.e)) * sqrt(list_dot_product(q.e, q.e)), 0), 0.0)", 6)}
            AS score FROM z, q) QUALIFY rank <= 4""")
check("embed_tfidf", f"""WITH v AS (SELECT term FROM (SELECT unnest(terms) AS term FROM chunk_terms)
        GROUP BY term ORDER BY count(*) DESC, term LIMIT 256),
    t AS (SELECT doc_id, chunk_no, term, count(*) AS tf
          FROM (SELECT doc_id, chunk_no, unnest(terms) AS term FROM chunk_terms) JOIN v USING (term) GROUP BY ALL),
    i AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM chunks)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
          FROM t GROUP BY term),
    w AS (SELECT doc_id, chunk_no, max(tf * idf) / sqrt(sum(tf * idf * tf * idf)) AS most FROM t JOIN i USING (term)
          GROUP BY doc_id, chunk_no)
    SELECT doc_id, chunk_no, CASE WHEN most IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS length,
        (SELECT count(*) FROM v)::INT AS dim, coalesce({rnd("most", 3)}, 0.0::DOUBLE) AS largest
    FROM chunks LEFT JOIN w USING (doc_id, chunk_no)""")
