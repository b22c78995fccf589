"""Analysis of one sales table: the plan behind the dashboard and predictions.

``SalesAnalysis`` is lazy: it only declares DataFrames. Every public method
returns a DataFrame whose plan starts at the table's scan, so each can be run
(or written) on its own and Catalyst prunes what that output does not read.
``persist_aggregate()`` is available when several outputs of the same table
are produced in one job (registry snapshots, reports).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.operators import assistant as qa
from caisse.operators import forecast as fc
from caisse.operators.insights import merge_rows
from caisse.operators.kpis import (
    TOP_LISTS, aggregate_sales, dashboard_fold, dashboard_row, month_deltas, monthly_revenue, top_k, top_lists,
)
from caisse.operators.measures import Measures, prepare_measures
from caisse.roles import assistant_roles, forecast_roles, role_map
from caisse.session import stored


class SalesAnalysis:
    def __init__(self, df: DataFrame, roles: dict[str, str | None] | None = None, selected: Column | None = None):
        self.df, self.selected = df, selected
        self._persisted: DataFrame | None = None
        self.roles = dict(roles) if roles is not None else role_map(df.columns)

    # -- shared aggregate -------------------------------------------------
    @cached_property
    def measures(self) -> Measures:
        return prepare_measures(self.df, self.roles, self.selected)

    @property
    def aggregate(self) -> DataFrame:
        """The grouping-sets aggregate, built anew for each reader.

        Two readers of one frame in a plan would get an ``Expand`` that Spark
        renames for the second of them and then does not recognise; frames
        built apart compare equal, and the second reader reuses the exchange.
        """
        return self._persisted if self._persisted is not None else aggregate_sales(self.measures)

    def persist_aggregate(self) -> DataFrame:
        """Writes the aggregate once; readers find it however Spark renames the columns of their plans (a cached ``Expand`` it does not)."""
        self._persisted = stored(aggregate_sales(self.measures), "aggregate")
        return self._persisted

    # -- dashboard --------------------------------------------------------
    def dashboard(self) -> DataFrame:
        return dashboard_row(self.measures, self.aggregate)

    def dashboard_record(self) -> DataFrame:
        """The 22 keys in one row; lists are arrays, absent values are null."""
        row = merge_rows(dashboard_fold(self.measures, self.aggregate), top_lists(self.aggregate))

        def best(dim: str):
            item = F.struct(F.col(f"best_{dim}").alias("name"), F.col(f"best_{dim}_value").alias("value"))
            return F.when(F.col(f"best_{dim}").isNotNull(), item).alias(f"best_{dim}")

        growth = F.struct(F.col("best_growth_month").alias("month"), F.col("best_growth_value").alias("value"),
                          F.col("best_growth_previous_month").alias("previous_month"))
        return row.select(
            "revenue_total", "margin_total", "margin_rate", "client_count", "product_count", "order_count", "average_basket",
            "paid_order_count", "unpaid_order_count", "unknown_payment_count",
            F.col("months").alias("monthly_evolution"),
            F.when(F.col("best_growth_month").isNotNull(), growth).alias("best_monthly_growth"),
            *TOP_LISTS.values(), best("city"), best("channel"), best("seller"),
            F.col("top_cities").alias("city_breakdown"), F.col("top_channels").alias("channel_breakdown"),
        )

    def tops(self, k: int = 5) -> DataFrame:
        """``(dimension, rank, name, value)``; empty without a revenue role
        (every group's revenue sum is then null and filtered out)."""
        return top_k(self.aggregate, k)

    def monthly(self) -> DataFrame:
        """K12 ``(month, value)``."""
        return monthly_revenue(self.aggregate).select("month", "value")

    def month_deltas(self) -> DataFrame:
        return month_deltas(monthly_revenue(self.aggregate).select("month", "value"))

    # -- predictions ------------------------------------------------------
    @cached_property
    def _forecast_source(self) -> tuple[DataFrame, bool]:
        rev, date = forecast_roles(self.df.columns)
        if not rev or not date:
            return self.aggregate, False
        if rev == self.roles.get("revenue") and date == self.roles.get("date"):
            return self.aggregate, True
        roles = dict(self.roles, revenue=rev, date=date)
        return aggregate_sales(prepare_measures(self.df, roles, self.selected)), True

    def forecast_summary(self) -> DataFrame:
        agg, has_roles = self._forecast_source
        return fc.model_summary(agg, has_roles=has_roles)

    def forecast(self) -> DataFrame:
        return fc.forecast_rows(self.forecast_summary())

    def historical(self) -> DataFrame:
        return fc.historical_rows(self.forecast_summary())

    def anomalies(self) -> DataFrame:
        return fc.anomalies(self.forecast_summary())

    def chart_series(self) -> DataFrame:
        return fc.chart_series(self.forecast_summary())

    def chart_summary(self) -> DataFrame:
        return fc.chart_summary(self.forecast_summary())

    def model_row(self) -> DataFrame:
        return self.forecast_summary().drop("_points", "_has_history")


#: Assistant role key -> dimension of the top lists.
ASSISTANT_DIMENSIONS = {"client": "client", "produit": "product", "ville": "city", "canal": "channel", "vendeur": "seller"}


def stored_answers(record: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """N2-N6 as the assistant answers about a stored dataset: ``(intent, answer)``.

    Totals, counts and months are those of the stored dashboard ``record``
    (``dashboard_record``). Rankings are taken afresh from the ``cleaned``
    rows, under the assistant's own roles; a dimension that gives none there
    (no such column, no revenue, no rows, no table) falls back on the stored
    list.
    """
    item = "struct<dimension:string,rank:int,name:string,value:double>"

    def listed(dim: str, key: str):
        return F.transform(F.col(key), lambda x, i: F.struct(
            F.lit(dim).alias("dimension"), (i + 1).cast("int").alias("rank"), x["name"].alias("name"), x["value"].alias("value")))

    kept = F.concat(*[listed(dim, key) for dim, key in TOP_LISTS.items()])
    row = record.withColumns({"months": F.col("monthly_evolution"), "_stored": kept.cast(f"array<{item}>")})
    if cleaned is None:
        row = row.withColumn("_fresh", F.array().cast(f"array<{item}>"))
    else:
        roles = {k: None for k in role_map(cleaned.columns)}
        found = assistant_roles(cleaned.columns)
        roles |= {dim: found[key] for key, dim in ASSISTANT_DIMENSIONS.items()} | {"revenue": found["revenue"]}
        fresh = top_k(aggregate_sales(prepare_measures(cleaned, roles)), 5, round_values=False)
        row = merge_rows(row, fresh.agg(F.collect_list(F.struct("dimension", "rank", "name", "value")).alias("_fresh")))
    rest = F.filter("_stored", lambda s: ~F.exists("_fresh", lambda f: f["dimension"] == s["dimension"]))
    return qa.answers(row.withColumn("tops", F.concat("_fresh", rest)))
