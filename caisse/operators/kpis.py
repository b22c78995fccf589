"""Dashboard KPIs (K1-K20), top-k (F12) and month-over-month windows.

Plan shape
----------
All dashboard numbers come from **one** aggregate over the fact table::

    GROUPING SETS ((k_client), (k_product), (k_city), (k_channel), (k_seller),
                   (_order), (_month), (_pay), ())

* the five dimension sets give the top lists *and* the exact distinct client /
  product counts (number of non-null groups);
* the ``_order`` set gives the exact distinct order count;
* the ``_month`` set is the monthly revenue series;
* the ``_pay`` set counts rows per payment text (classified afterwards);
* the empty set is the grand total (revenue, margin).

Partial aggregation runs map-side right after the ``Expand``, so a key holding
a third of all rows still sends one row per map task into the shuffle. Top-k
per dimension is ``row_number() <= k`` over the aggregate; Spark inserts a
partial ``WindowGroupLimit`` before the exchange, so only k rows per map
partition and dimension are shuffled, whatever the number of clients.

Windows without a partition key (W1, W6) only ever run on the monthly series,
whose size is bounded by the calendar, never on the fact table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caisse.functions.arrays import at
from caisse.functions.cache import jvm_cached
from caisse.functions.payment import PAID, UNKNOWN, UNPAID, classify_payment
from caisse.operators.measures import Measures
from caisse.roles import TOP_DIMENSIONS

# Grouping-set labels, in the order the sets are declared.
SET_NAMES = [*TOP_DIMENSIONS, "order", "month", "payment", "total"]
GROUP_KEYS = [*(f"k_{d}" for d in TOP_DIMENSIONS), "_order", "_month", "_pay"]


def money(c: Column, digits: int = 2) -> Column:
    """Round a sum to ``digits`` decimals and expose it as a double."""
    return F.round(c, digits).cast("double")


@jvm_cached
def _sales_aggs(margin_mode: str, counted: bool = False) -> tuple[Column, ...]:
    if margin_mode == "direct":
        margin = F.coalesce(F.col("_margin"), F.lit(0))
    elif margin_mode == "derived":
        margin = F.coalesce(F.col("_rev"), F.lit(0)) - F.coalesce(F.col("_cost"), F.lit(0))
    else:
        margin = F.lit(0)
    return (
        F.grouping_id(*GROUP_KEYS).alias("_gid"),
        F.sum("_rev").alias("sum_rev"),
        (F.count("_row") if counted else F.count(F.lit(1))).alias("n_rows"),
        F.sum(margin).alias("sum_margin"),
        F.sum("_nmiss").alias("sum_missing"),
        *([F.count(F.lit(1)).alias("n_all")] if counted else []),
    )


@jvm_cached
def _set_columns() -> tuple[Column, ...]:
    # grouping_id bit i (from the left) is 1 when key i is *not* grouped.
    n = len(GROUP_KEYS)
    label = F.lit("total")
    name: Column = F.lit(None).cast("string")
    for i, key in enumerate(GROUP_KEYS):
        gid = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        label = F.when(F.col("_gid") == gid, F.lit(SET_NAMES[i])).otherwise(label)
        name = F.when(F.col("_gid") == gid, F.col(key).cast("string")).otherwise(name)
    return (label.alias("set"), name.alias("name"))


def aggregate_sales(m: Measures) -> DataFrame:
    """The single grouping-sets aggregate behind the dashboard.

    Output: ``set`` (label), ``name`` (group value as text), ``sum_rev``
    (exact sum of non-null revenue; null when none), ``n_rows`` and, on the
    total row, the margin. Payment texts are a grouping set of their own: the
    classifier (string functions and regexes) then runs once per distinct
    text in the fold, not once per row.
    """
    # Only the sets whose role exists: an absent role is a literal null key
    # whose set would be a single useless group, at the price of one more
    # Expand projection per input row.
    sets = [[f"k_{d}"] for d in TOP_DIMENSIONS if d in m.dims]
    sets += [["_order"]] if m.has_order else []
    sets += [["_month"]] if m.has_revenue and m.has_date else []
    sets += [["_pay"]] if m.has_payment else []
    sets.append([])
    # Months only count rows that have both a date and a revenue.
    src = m.df.withColumn("_month", F.when(F.col("_rev").isNotNull(), F.col("_month")))
    agg = src.groupingSets(sets, *GROUP_KEYS).agg(*_sales_aggs(m.margin_mode, m.counted))
    return agg.select(*_set_columns(), *_sums(m.counted))


def _sums(counted: bool) -> list[str]:
    return ["sum_rev", "n_rows", "sum_margin", "sum_missing", *(["n_all"] if counted else [])]


def _ranked_groups(agg: DataFrame, dims: list[str]) -> DataFrame:
    """The groups of ``dims`` that have a name and a revenue.

    The condition is asked of all sums of a group, so it stays above the
    aggregate and reads the columns that the fold reads: where one plan has
    both, they share the aggregate's exchange and the fact rows are expanded
    once. Below the aggregate, the condition would make two aggregates.
    """
    # Counts are never null, which the optimizer knows.
    sums = [F.col(c) > 0 if c.startswith("n_") else F.col(c).isNotNull() for c in agg.columns if c in _sums(True)]
    known = reduce(lambda a, b: a | b, sums)
    return agg.filter(F.when(known, F.col("set").isin(dims) & F.col("name").isNotNull() & F.col("sum_rev").isNotNull()))


def top_k(agg: DataFrame, k: int = 5, dims: list[str] | None = None, round_values: bool = True) -> DataFrame:
    """F12 for all dimensions: ``(dimension, rank, name, value)``, rank 1..k.

    Order: exact sum descending, then name ascending (fixed tie order).
    """
    dims = list(dims or TOP_DIMENSIONS)
    ranked = _ranked_groups(agg, dims)
    w = W.partitionBy("set").orderBy(F.desc("sum_rev"), F.asc("name"))
    value = money(F.col("sum_rev")) if round_values else F.col("sum_rev").cast("double")
    return (
        ranked.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select(F.col("set").alias("dimension"), F.col("rank").cast("int").alias("rank"), "name", value.alias("value"))
    )


#: Dimension -> key of its top list in the dashboard record.
TOP_LISTS = {"client": "top_clients", "product": "top_products", "city": "top_cities", "channel": "top_channels", "seller": "top_sellers"}


def top_lists(agg: DataFrame, k: int = 5) -> DataFrame:
    """K13-K17 as one row: per dimension an array of at most ``k`` (name, value), best first."""
    item = F.struct("rank", "name", "value")
    return top_k(agg, k).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("dimension") == dim, item))),
                    lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias(key)
        for dim, key in TOP_LISTS.items()
    ])


def monthly_revenue(agg: DataFrame) -> DataFrame:
    """``(month, value)`` for months with at least one dated revenue; unrounded ``exact``."""
    return agg.filter(
        (F.col("set") == "month") & F.col("name").isNotNull() & F.col("sum_rev").isNotNull()
    ).select(F.col("name").alias("month"), money(F.col("sum_rev")).alias("value"), F.col("sum_rev").alias("exact"))


def month_deltas(monthly: DataFrame) -> DataFrame:
    """Position, previous present month and delta of rounded values.

    ``monthly`` has one row per month (calendar-bounded), so the
    un-partitioned window is cheap by construction.
    """
    w = W.orderBy("month")
    return monthly.select(
        "month",
        "value",
        (F.row_number().over(w) - 1).alias("position"),
        F.lag("month").over(w).alias("previous_month"),
        F.lag("value").over(w).alias("previous_value"),
    ).withColumn("delta", money(F.col("value") - F.col("previous_value")))


def payment_count(cls: str) -> Column:
    """K10 in the fold: rows of the payment texts of class ``cls``."""
    is_text = (F.col("set") == "payment") & F.col("name").isNotNull()
    return F.coalesce(F.sum(F.when(is_text & (classify_payment(F.col("name")) == cls), F.col("n_rows"))), F.lit(0))


def best_of(set_name: str, field: Column) -> Column:
    """Rank-1 row of a dimension as an aggregate: max sum, then smallest name."""
    hit = (F.col("set") == set_name) & F.col("name").isNotNull() & F.col("sum_rev").isNotNull()
    return F.min_by(F.when(hit, field), F.when(hit, F.struct(-F.col("sum_rev"), F.col("name"))))


def growth_of(months: Column) -> Column:
    """W2 on a sorted ``array<struct<month, value>>``: max delta, earliest on ties.

    Returns ``struct(delta, neg_pos, month, previous_month)`` or null (< 2 months).
    """
    deltas = F.transform(
        F.sequence(F.lit(1), F.size(months) - 1),
        lambda i: F.struct(
            money(at(months, i + 1)["value"] - at(months, i)["value"]).alias("delta"),
            (-i).alias("neg_pos"),
            at(months, i + 1)["month"].alias("month"),
            at(months, i)["month"].alias("previous_month"),
        ),
    )
    return F.when(F.size(months) >= 2, F.array_max(deltas))


DASHBOARD_COLUMNS = [
    "revenue_total", "margin_total", "margin_rate", "client_count", "product_count", "order_count",
    "average_basket", "paid_order_count", "unpaid_order_count", "unknown_payment_count",
    "best_city", "best_city_value", "best_channel", "best_channel_value", "best_seller", "best_seller_value",
    "best_growth_month", "best_growth_value", "best_growth_previous_month",
]
INACTIVE_CLIENT_THRESHOLD = 100
TOP_K = 5


def dashboard_fold(m: Measures, agg: DataFrame) -> DataFrame:
    """K20 and the helper fields of insights / alerts / answers, one row, one pass.

    Every field is an aggregate over ``agg`` (no window, no join), so the fact
    table is scanned once. The month list collected here is bounded by the
    calendar (one entry per month), never by the data volume. Besides the
    public dashboard columns it carries ``months`` (sorted ``array<struct<month,
    value>>``), best client / product, and ``clients_listed`` /
    ``clients_listed_over`` for the inactive-client rule (the 5th best client
    is under 100 exactly when fewer than ``min(n, 5)`` clients reach 100), and
    ``rows`` / ``missing_ratio`` of the source table for the quality rules.
    """
    return agg.agg(*_fold_aggs(m.counted)).select(
        *_fold_select(m.has_order, "client" in m.dims, "product" in m.dims, m.n_columns, m.counted)
    )


@jvm_cached
def _fold_aggs(counted: bool = False) -> tuple[Column, ...]:
    is_total = F.col("set") == "total"

    def distinct(set_name: str) -> Column:
        return F.count_if((F.col("set") == set_name) & F.col("name").isNotNull())

    is_month = (F.col("set") == "month") & F.col("name").isNotNull() & F.col("sum_rev").isNotNull()
    client_row = (F.col("set") == "client") & F.col("name").isNotNull() & F.col("sum_rev").isNotNull()
    return (
        # One struct: whatever an output reads of it, the aggregate below keeps all its sums (see _ranked_groups).
        F.max(F.when(is_total, F.struct(*_sums(counted)))).alias("_total"),
        distinct("client").alias("client_count"),
        distinct("product").alias("product_count"),
        distinct("order").alias("_distinct_orders"),
        *[payment_count(cls).alias(alias) for cls, alias in
          ((PAID, "paid_order_count"), (UNPAID, "unpaid_order_count"), (UNKNOWN, "unknown_payment_count"))],
        *[best_of(d, F.col("name")).alias(f"best_{d}") for d in ("city", "channel", "seller", "client", "product")],
        *[best_of(d, money(F.col("sum_rev"))).alias(f"best_{d}_value") for d in ("city", "channel", "seller", "client", "product")],
        F.count_if(client_row).alias("_clients_ranked"),
        F.count_if(client_row & (money(F.col("sum_rev")) >= INACTIVE_CLIENT_THRESHOLD)).alias("_clients_over"),
        F.array_sort(
            F.collect_list(F.when(is_month, F.struct(F.col("name").alias("month"), money(F.col("sum_rev")).alias("value"))))
        ).alias("months"),
    )


@jvm_cached
def _fold_select(has_order: bool, has_client: bool, has_product: bool, n_columns: int, counted: bool = False) -> tuple[Column, ...]:
    def total(c: str) -> Column:
        return F.coalesce(F.col("_total")[c], F.lit(0))

    rows = total("n_rows").cast("long")
    orders = F.col("_distinct_orders") if has_order else rows
    revenue = total("sum_rev")
    growth = growth_of(F.col("months"))
    zero = F.lit(0).cast("long")
    return (
        money(revenue).alias("revenue_total"),
        money(total("sum_margin")).alias("margin_total"),
        F.when(revenue != 0, F.round(total("sum_margin").cast("double") / revenue.cast("double") * 100, 1))
        .otherwise(F.lit(0.0))
        .alias("margin_rate"),
        (F.col("client_count").cast("long") if has_client else zero).alias("client_count"),
        (F.col("product_count").cast("long") if has_product else zero).alias("product_count"),
        orders.cast("long").alias("order_count"),
        F.when(revenue != 0, F.round(revenue.cast("double") / F.greatest(F.lit(1), orders).cast("double"), 2))
        .otherwise(F.lit(0.0))
        .alias("average_basket"),
        F.col("paid_order_count").cast("long").alias("paid_order_count"),
        F.col("unpaid_order_count").cast("long").alias("unpaid_order_count"),
        F.col("unknown_payment_count").cast("long").alias("unknown_payment_count"),
        "best_city", "best_city_value", "best_channel", "best_channel_value", "best_seller", "best_seller_value",
        growth["month"].alias("best_growth_month"),
        growth["delta"].alias("best_growth_value"),
        growth["previous_month"].alias("best_growth_previous_month"),
        "best_client", "best_client_value", "best_product", "best_product_value",
        F.least(F.col("_clients_ranked"), F.lit(TOP_K)).cast("long").alias("clients_listed"),
        F.least(F.col("_clients_over"), F.lit(TOP_K)).cast("long").alias("clients_listed_over"),
        "months",
        rows.alias("row_count"),
        *([total("n_all").cast("long").alias("total_row_count")] if counted else []),
        # Q6 without another scan: mean over columns of the missing share
        # = missing cells / (rows x columns).
        rows.alias("rows"),
        (F.when(rows > 0, total("sum_missing") / (rows * F.lit(max(n_columns, 1))))
         .otherwise(F.lit(None).cast("double")) if n_columns else F.lit(0.0)).alias("missing_ratio"),
    )


def dashboard_row(m: Measures, agg: DataFrame) -> DataFrame:
    """The public dashboard scalars as one row."""
    return dashboard_fold(m, agg).select(*DASHBOARD_COLUMNS)
