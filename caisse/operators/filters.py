"""Filters, search, sort and pagination.

Filters are plain ``DataFrame.filter`` predicates over the cleaned table, so
Catalyst pushes them into the Parquet scan of a materialised cleaned dataset
(``PushedFilters``) and prunes partitions when the table is partitioned by
month. The fill values of the cleaning come from the whole table: filtering
happens after cleaning, never before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.functions.text import date_display, natural_key, number_text
from caisse.operators.measures import as_text, as_timestamp
from caisse.operators.ranking import SortedTable
from caisse.roles import role_map

# ---------------------------------------------------------------------------
# Filter keys and the role each one targets; paging constants.
# ---------------------------------------------------------------------------
FILTER_KEYS = ["start_date", "end_date", "ville", "canal", "client", "produit", "vendeur"]
DIMENSION_FILTERS = {
    "ville": "city",
    "city": "city",
    "canal": "channel",
    "channel": "channel",
    "client": "client",
    "produit": "product",
    "product": "product",
    "vendeur": "seller",
    "seller": "seller",
}
PAGE_SIZE = 10
LOW_DATA_MIN_ROWS = 3
LOW_DATA_SHARE = 0.02
EMPTY_EXPORT = "Aucune donnée à exporter avec les filtres sélectionnés"


def filter_map(**values: str | None) -> dict[str, str]:
    """keep the known keys that carry a non-empty value."""
    return {k: v for k, v in values.items() if k in FILTER_KEYS and v}


def filter_predicate(df: DataFrame, filters: dict[str, str], roles: dict[str, str | None] | None = None) -> Column:
    """F1-F3 as one predicate (AND of all active filters)."""
    roles = roles or role_map(df.columns)
    preds: list[Column] = []
    for key, role in DIMENSION_FILTERS.items():
        value = filters.get(key)
        col = roles.get(role)
        if value and col and col in df.columns:
            preds.append(as_text(df, col) == F.lit(str(value)))
    date_col = roles.get("date")
    if date_col and date_col in df.columns:
        dtype = df.schema[date_col].dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            # Compare the stored column with the bound cast to the column's own
            # type, so the predicate reaches the Parquet scan (PushedFilters).
            dates = F.col(f"`{date_col}`")

            def bound(text: str) -> Column:
                return F.try_to_timestamp(F.lit(text)).cast(dtype)
        else:
            dates = as_timestamp(df, date_col)

            def bound(text: str) -> Column:
                return F.try_to_timestamp(F.lit(text))
        if filters.get("start_date"):
            # An unparsable bound compares as null: no row passes (F2).
            preds.append(dates >= bound(filters["start_date"]))
        if filters.get("end_date"):
            # The end bound is midnight of that day: later times are excluded.
            preds.append(dates <= bound(filters["end_date"]))
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def apply_filters(df: DataFrame, filters: dict[str, str] | None, roles: dict[str, str | None] | None = None) -> DataFrame:
    """F1-F3 as plain conjuncts (a null comparison drops the row), so Catalyst can
    push each one to the scan that produces its column."""
    if not filters:
        return df
    return df.filter(filter_predicate(df, filters, roles))


def filter_counts(df: DataFrame, filters: dict[str, str] | None, roles: dict[str, str | None] | None = None) -> DataFrame:
    """F5 + F6: ``(row_count, total_row_count, low_data)`` in one aggregate."""
    pred = F.coalesce(filter_predicate(df, filters or {}, roles), F.lit(False)) if filters else F.lit(True)
    counts = df.agg(F.count_if(pred).alias("row_count"), F.count(F.lit(1)).alias("total_row_count"))
    return counts.select(
        F.col("row_count").cast("long").alias("row_count"),
        F.col("total_row_count").cast("long").alias("total_row_count"),
        ((F.col("row_count") > 0)
         & (F.col("row_count") <= F.greatest(F.lit(LOW_DATA_MIN_ROWS).cast("double"), F.col("total_row_count") * LOW_DATA_SHARE)))
        .alias("low_data"),
    )


def display_value(df: DataFrame, col: str) -> Column:
    """The text a grid shows for a value: ``-`` for null, ``dd/MM/yyyy`` for dates,
    integral numbers without a decimal part."""
    dtype = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return date_display(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        integral = (d == F.floor(d)) & (F.abs(d) < 1e15)
        text = F.when(integral, d.cast("long").cast("string")).otherwise(number_text(d))
        return F.coalesce(text, F.lit("-"))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.when(c, F.lit("true")).otherwise(F.lit("false")), F.lit("-"))
    return F.coalesce(c.cast("string"), F.lit("-"))


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """rows where any displayed value contains ``query`` (case-insensitive, trimmed)."""
    q = query.strip().lower()
    if not q:
        return df
    cols = columns or [c for c in df.columns if not c.startswith("_")]
    hit = reduce(lambda a, b: a | b, [F.lower(display_value(df, c)).contains(q) for c in cols])
    return df.filter(hit)


def sort_keys(df: DataFrame, column: str, ascending: bool = True, tie_break: list[str] | None = None) -> list[tuple[Column, bool]]:
    """F8: (key, ascending) pairs that sort on the typed column (numbers numerically), text with
    the French collation and its digit runs as numbers (``a9`` before ``a10``); ties ascend by ``tie_break``."""
    c = F.col(f"`{column}`")
    text = isinstance(df.schema[column].dataType, T.StringType)
    keys = [F.collate(natural_key(c), "fr"), F.collate(c, "fr")] if text else [c]
    return [*[(key, ascending) for key in keys], *[(F.col(f"`{c}`"), True) for c in (tie_break or []) if c != column]]


def sort_rows(df: DataFrame, column: str, ascending: bool = True, tie_break: list[str] | None = None) -> DataFrame:
    """F8 on the whole table."""
    return df.orderBy(*[k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in sort_keys(df, column, ascending, tie_break)])


def sorted_table(df: DataFrame, column: str, ascending: bool = True, tie_break: list[str] | None = None, path: str | None = None) -> SortedTable:
    """F8 + F9 at any page: the table written once in range partitions of the sort order, with a rank index."""
    return SortedTable.write(df, sort_keys(df, column, ascending, tie_break), path)


def page(sorted_df: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """rows of page ``number`` (1-based) of an ordered frame. For the first pages: one task gathers
    the rows of all pages up to this one; ``sorted_table`` reads far pages."""
    number = max(1, int(number))
    return sorted_df.offset((number - 1) * size).limit(size)


def page_count(n_rows: int, size: int = PAGE_SIZE) -> int:
    """``max(1, ceil(n / size))``."""
    return max(1, -(-n_rows // size))


def ensure_not_empty(df: DataFrame) -> DataFrame:
    """Refuse to export an empty selection."""
    if df.isEmpty():
        raise ValueError(EMPTY_EXPORT)
    return df
