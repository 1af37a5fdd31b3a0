"""The standing tables every answer starts from, composed from views and operators."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.exact import exact_sum
from bizlens.operators import customers, decisions, inventory, metrics, models, monthly, products
from bizlens.operators.models import FittedModel
from bizlens.operators.retrieval import TextIndex
from bizlens.operators.store import ModelStore
from bizlens.session import pinned
from bizlens.sources import views
from bizlens.sources.tables import table

# Parameters of the supplied tables: the price-sensitive region, the region a scenario is about
# when the question names none, the segment that counts as enterprise, the length of "recent".
SENSITIVE_REGION = "EUROPE"
SCENARIO_REGION = "AMERICA"
ENTERPRISE = "MACHINERY"
RECENT_DAYS = 180


@dataclass
class Business:
    """Lazy tables over one data folder. Nothing runs until a table is used."""

    spark: SparkSession
    path: str
    kept: set[str] = field(default_factory=set)

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    @cached_property
    def monthly(self) -> DataFrame:
        """Sales per region and month with the finance columns, from one pass over the lines."""
        lines = views.sales_by_region(self.spark, self.path)
        return monthly.with_pnl(monthly.monthly_sales(lines, spend=True))

    @cached_property
    def features(self) -> DataFrame:
        return monthly.monthly_features(
            self.monthly,
            monthly.monthly_signal(views.signal_daily(self.spark, self.path)),
            monthly.monthly_price_index(views.price_index(self.spark, self.path)),
            views.macro(self.spark, self.path),
        )

    @cached_property
    def latest(self) -> DataFrame:
        return monthly.latest_month(self.features)

    @cached_property
    def performance(self) -> DataFrame:
        """Products over the recent days; the lines are summed before the names are joined."""
        return products.sku_performance(
            views.sales_by_product(self.spark, self.path, RECENT_DAYS),
            views.products(self.spark, self.path),
        )

    @cached_property
    def price_base(self) -> DataFrame:
        """Price base of every product that was ever sold, from all lines."""
        return decisions.sku_price_base(
            products.sku_performance(
                views.sales_by_product(self.spark, self.path),
                views.products(self.spark, self.path),
            )
        )

    @cached_property
    def customers(self) -> DataFrame:
        return customers.customer_features(views.crm(self.spark, self.path))

    @cached_property
    def scores(self) -> DataFrame:
        return customers.scored_customers(self.customers, ENTERPRISE)

    @cached_property
    def store(self) -> ModelStore:
        return ModelStore.shared(self.spark)

    def forecast_model(self, target: str) -> FittedModel:
        """The stored forecast of ``revenue`` or ``units_sold``, fitted on all but the newest year."""
        train = models.holdout_by_time(self.settled("features").features).filter("is_test = 0")
        return self.store.fitted(
            f"forecast-{target}", train, ["region", *models.FORECAST_FEATURES], target,
            lambda: models.fit_forecast(train, target),
        )

    def forecast_models(self) -> list[FittedModel]:
        """Both forecasts, of ``revenue`` and ``units_sold``."""
        self.settled("features")  # once, before the two ask for it
        return self.models_together(*[partial(self.forecast_model, x) for x in ("revenue", "units_sold")])

    @cached_property
    def customer_rows(self) -> DataFrame:
        """Customers with their value label, split in training and test rows."""
        return pinned(metrics.split_rows(customers.value_label(self.customers), "customer_id", ["churned"]))

    def customer_model(self, name: str, target: str, features, fit) -> FittedModel:
        train = self.customer_rows.filter("is_test = 0")
        return self.store.fitted(name, train, ["segment", "region", *features], target, lambda: fit(train))

    @cached_property
    def churn_model(self) -> FittedModel:
        return self.customer_model("churn", "churned", models.CHURN_FEATURES, models.fit_churn)

    @cached_property
    def value_model(self) -> FittedModel:
        return self.customer_model("value", "clv_12mo", models.VALUE_FEATURES, models.fit_value)

    def models_together(self, *fits: Callable[[], FittedModel]) -> list[FittedModel]:
        """Models that do not read each other, at the same time: a level of a tree is a short job, and
        the jobs of one fit fill the waits of the other."""
        runs = [inheritable_thread_target(self.spark)(fit) for fit in fits]
        with ThreadPoolExecutor(len(runs)) as pool:
            return [done.result() for done in [pool.submit(run) for run in runs]]

    @cached_property
    def driven_scores(self) -> DataFrame:
        """The scores with the three strongest drivers of each customer."""
        return customers.scored_customers(self.customers, ENTERPRISE, drivers=True)

    @cached_property
    def offers(self) -> DataFrame:
        return decisions.given_offers(self.spark)

    @cached_property
    def stock(self) -> DataFrame:
        return inventory.inventory_features(views.inventory(self.spark, self.path))

    @cached_property
    def plan(self) -> DataFrame:
        return inventory.eoq_plan(self.stock)

    @cached_property
    def supply_totals(self) -> DataFrame:
        """The sums of the order plan and of the stock in it, a row per region and supplier."""
        return inventory.supply_totals(self.plan)

    @cached_property
    def plan_totals(self) -> DataFrame:
        """The sums of the order plan, a row per region."""
        return inventory.region_totals(self.supply_totals)

    @cached_property
    def churn_totals(self) -> DataFrame:
        """The churn figures and bucket counts of every region and of all."""
        return customers.churn_summary(self.scores, buckets=True)

    @cached_property
    def weak_totals(self) -> DataFrame:
        """One row: the products to discontinue and their revenue (null: no such product)."""
        return products.discontinue_candidates(self.performance).agg(
            F.count(F.lit(1)).alias("weak"), exact_sum(F.col("revenue")).alias("revenue")
        )

    @cached_property
    def index(self) -> TextIndex:
        return TextIndex.fit(self.base("documents"))

    @cached_property
    def questions(self) -> DataFrame:
        return views.questions(self.spark, self.path)

    def settled(self, *names: str) -> "Business":
        """The same tables, with those that several answers share computed once and kept in the
        shared folder: a row per region and month, per customer, and per region and product. With
        ``names``, only these: what reads the totals alone needs no row per customer or product."""
        for name in names or ("monthly", "features", "scores", "plan"):
            if name not in self.kept:
                self.kept.add(name)
                setattr(self, name, pinned(getattr(self, name)))
                self.__dict__.pop("latest", None)
        return self
