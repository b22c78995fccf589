"""Role-standardised measures: the narrow projection every KPI reads.

Given a cleaned sales table and its role map, ``prepare_measures`` projects only
the columns the KPIs need, under fixed names:

=========== ================================================================
``_rev``    revenue coerced to a number (null when not numeric)
``_cost``   cost, same coercion
``_margin`` margin, same coercion
``_date``   date coerced to a timestamp
``_month``  ``yyyy-MM`` of ``_date``
``_order``  order id (as stored)
``_pay``    payment text as the classifier reads it (null when no role); it
            is classified per distinct value after aggregation
``k_<dim>`` dimension value for client / product / city / channel / seller
``_nmiss``  number of missing cells of the row (all source columns), so the
            table's missing ratio comes out of the same aggregate
=========== ================================================================

Column pruning then reaches the Parquet scan: a KPI never reads a column the
roles do not name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.functions.payment import payment_text
from caisse.functions.text import month_key, number_text
from caisse.roles import TOP_DIMENSIONS, role_map


def numeric(df: DataFrame, col: str | None) -> Column:
    """Number or null (``pd.to_numeric(errors='coerce')``)."""
    if not col or col not in df.columns:
        return F.lit(None).cast("double")
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.BooleanType):
        return F.col(col).cast("int")
    if isinstance(dtype, T.NumericType):
        return F.col(col)
    if isinstance(dtype, T.StringType):
        return F.expr(f"try_cast(`{col}` AS double)")
    return F.lit(None).cast("double")


def as_timestamp(df: DataFrame, col: str | None) -> Column:
    """Timestamp or null (``pd.to_datetime(errors='coerce')``)."""
    if not col or col not in df.columns:
        return F.lit(None).cast("timestamp")
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(col).cast("timestamp")
    if isinstance(dtype, T.StringType):
        return F.expr(f"try_to_timestamp(`{col}`)")
    return F.lit(None).cast("timestamp")


def as_text(df: DataFrame, col: str) -> Column:
    """``str(value)`` of a dimension value; timestamps print as ``yyyy-MM-dd HH:mm:ss``."""
    dtype = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(c)
    return c.cast("string")


@dataclass(frozen=True)
class Measures:
    """The standardised projection plus what was found in the source."""

    df: DataFrame
    roles: dict[str, str | None]
    dims: tuple[str, ...]  # dimensions that have a column
    has_revenue: bool
    has_date: bool
    has_order: bool
    has_payment: bool
    margin_mode: str  # "direct", "derived" or "none"
    n_columns: int = 0  # source columns counted by ``_nmiss``
    counted: bool = False  # all rows are there, those outside the selection with null measures and without ``_row``


def prepare_measures(df: DataFrame, roles: dict[str, str | None] | None = None, selected: Column | None = None) -> Measures:
    """The projection of ``df`` that the KPIs read.

    With ``selected`` (a predicate on ``df``) all rows stay, but those outside
    the selection only count as rows of the table: one pass then gives the
    selection's KPIs and the table's row count.
    """
    roles = dict(roles) if roles is not None else role_map(df.columns)
    cols = set(df.columns)

    def present(role: str) -> str | None:
        name = roles.get(role)
        return name if name and name in cols else None

    rev, cost, margin = present("revenue"), present("cost"), present("margin")
    date, order, payment = present("date"), present("order"), present("payment")
    margin_mode = "direct" if roles.get("margin") else ("derived" if roles.get("cost") and rev else "none")

    exprs: list[Column] = [
        numeric(df, rev).alias("_rev"),
        numeric(df, cost).alias("_cost"),
        numeric(df, margin).alias("_margin"),
    ]
    ts = as_timestamp(df, date)
    exprs += [ts.alias("_date"), month_key(ts).alias("_month")]
    exprs.append((F.col(order) if order else F.lit(None).cast("string")).alias("_order"))
    if payment:
        exprs.append(payment_text(payment, df.schema[payment].dataType).alias("_pay"))
    else:
        exprs.append(F.lit(None).cast("string").alias("_pay"))
    data_cols = [c for c in df.columns if c != "_row_id"]
    missing = [
        F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`")), 1).otherwise(0)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        else F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0)
        for c in data_cols
    ]
    exprs.append((sum(missing[1:], missing[0]) if missing else F.lit(0)).alias("_nmiss"))
    dims = []
    for dim in TOP_DIMENSIONS:
        col = present(dim)
        if col:
            dims.append(dim)
            exprs.append(as_text(df, col).alias(f"k_{dim}"))
        else:
            exprs.append(F.lit(None).cast("string").alias(f"k_{dim}"))
    rows = df.select(*exprs)
    if selected is not None:
        rows = df.select(*exprs, F.coalesce(selected, F.lit(False)).alias("_in")).select(
            *[F.when(F.col("_in"), F.col(c)).alias(c) for c in rows.columns], F.when(F.col("_in"), F.lit(1)).alias("_row"))
    return Measures(
        df=rows,
        roles=roles,
        dims=tuple(dims),
        has_revenue=rev is not None,
        has_date=date is not None,
        has_order=order is not None,
        has_payment=payment is not None,
        margin_mode=margin_mode,
        n_columns=len(data_cols),
        counted=selected is not None,
    )
