"""Profiling and quality (Q1-Q15).

Per-column statistics for all columns come from a single aggregate; the
result is unpivoted with ``stack``. Duplicate counting is one
``groupBy(all columns).count()`` (map-side combined). Quality scores fold
both into one row without joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.operators.measures import as_text, as_timestamp
from caisse.sources.files import ROW_ID

# ---------------------------------------------------------------------------
# Type labels and quality weights.
# ---------------------------------------------------------------------------
LABEL_DATE, LABEL_INT, LABEL_FLOAT, LABEL_TEXT, LABEL_BOOL = "Date", "Nombre entier", "Nombre décimal", "Texte", "Oui / Non"
MISSING_WEIGHT, DUPLICATE_WEIGHT = 55, 35
HEAD_DEFAULT, HEAD_DETAIL = 10, 20
OPTION_CAP = 150


#: Spark types, the dtype string a dataframe user sees for them (Q2), and its French label (Q11). Fixed values.
TYPE_NAMES: list[tuple[tuple[type[T.DataType], ...], str, str]] = [
    ((T.TimestampType, T.TimestampNTZType, T.DateType), "datetime64[ns]", LABEL_DATE),
    ((T.LongType,), "int64", LABEL_INT),
    ((T.IntegerType,), "int32", LABEL_INT),
    ((T.ShortType,), "int16", LABEL_INT),
    ((T.ByteType,), "int8", LABEL_INT),
    ((T.FloatType,), "float32", LABEL_FLOAT),
    ((T.DoubleType, T.DecimalType), "float64", LABEL_FLOAT),
    ((T.BooleanType,), "bool", LABEL_BOOL),
    ((T.StringType,), "object", LABEL_TEXT),
]


def dtype_name(dt: T.DataType) -> str:
    """Q2: the dtype string of a Spark type; other types keep Spark's own name."""
    return next((name for kinds, name, _ in TYPE_NAMES if isinstance(dt, kinds)), dt.simpleString())


def type_label(dtype: str) -> str:
    """Q11: French label of a dtype string from ``dtype_name``."""
    return {name: label for _, name, label in TYPE_NAMES}.get(dtype, dtype)


def _data_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def _is_missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def column_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """Q3, Q4, Q10, Q11, Q15: ``(column, position, type, type_label, missing, missing_rate, unique)``.

    The exact counts come from one narrow shuffle of distinct (column, value)
    pairs; ``distinct='approx'`` swaps them for HyperLogLog sketches.
    """
    cols = _data_cols(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, position int, type string, type_label string, missing long, missing_rate double, unique long"
        )
    counts = _exact_counts(df, cols) if distinct == "exact" else _sketched_counts(df, cols)
    known = F.broadcast(df.sparkSession.createDataFrame(
        [(i, c, dtype_name(df.schema[c].dataType)) for i, c in enumerate(cols)], "position int, column string, type string"))
    long = known.join(counts, "position", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_n", "missing", "unique")})
    label = F.lit(None).cast("string")
    for t in sorted({dtype_name(df.schema[c].dataType) for c in cols}):
        label = F.when(F.col("type") == t, F.lit(type_label(t))).otherwise(label)
    return long.select(
        F.col("column"),
        F.col("position").cast("int").alias("position"),
        F.col("type"),
        label.alias("type_label"),
        F.col("missing").cast("long").alias("missing"),
        F.when(F.col("_n") > 0, F.round(F.col("missing") / F.col("_n") * 100, 1)).otherwise(F.lit(None).cast("double"))
        .alias("missing_rate"),
        F.col("unique").cast("long").alias("unique"),
    )


def _value_text(df: DataFrame, c: str) -> Column:
    """Text that tells the values of a column apart as grouping does; null where the value is missing."""
    col, dtype = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        col = col + F.lit(0.0).cast(dtype)  # one zero
    text = F.hex(col) if isinstance(dtype, T.BinaryType) else col.cast("string") if isinstance(dtype, T.AtomicType) else F.to_json(F.struct(col))
    return F.when(~_is_missing(df, c), text)


def _exact_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(position, _n, missing, unique): every row becomes one narrow (column, value) row per column; equal
    ones are counted in the map tasks, then grouped once, and the groups are counted per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), _value_text(df, c).alias("v")) for i, c in enumerate(cols)]))
    counted = df.select(pairs.alias("p")).groupBy("p.position", "p.v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("position").agg(
        F.sum("n").alias("_n"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("v").alias("unique"))


def _sketched_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """As ``_exact_counts``, with HyperLogLog sketches in one aggregate without a shuffle of values."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(_is_missing(df, c)).alias(f"m{i}"))
        aggs.append(F.approx_count_distinct(F.when(~_is_missing(df, c), F.col(f"`{c}`"))).alias(f"u{i}"))
    stack = ", ".join(f"{i}, m{i}, u{i}" for i in range(len(cols)))
    return df.agg(*aggs).selectExpr("_n", f"stack({len(cols)}, {stack}) AS (position, missing, unique)")


def group_stats(groups: DataFrame, copies: str = "_copies") -> DataFrame:
    """``table_stats`` of a table given as its distinct rows with copy counts.

    Row count = sum of copies, duplicates = sum of (copies - 1), missing
    values of a column = sum of the copies of the rows where it is missing:
    one aggregate over the (already shuffled) groups.
    """
    cols = [c for c in groups.columns if c not in (ROW_ID, copies)]
    n_cols = len(cols)
    folded = groups.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col(copies) - 1), F.lit(0)).alias("duplicate_count"),
        *[F.coalesce(F.sum(F.when(_is_missing(groups, c), F.col(copies))), F.lit(0)).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    return _stats_row(folded, n_cols)


def _stats_row(folded: DataFrame, n_cols: int) -> DataFrame:
    missing_total = sum((F.col(f"m{i}") for i in range(n_cols)), F.lit(0)) if n_cols else F.lit(0)
    ratio = (
        sum((F.col(f"m{i}") / F.col("rows") for i in range(n_cols)), F.lit(0.0)) / n_cols if n_cols else F.lit(0.0)
    )
    return folded.select(
        F.col("rows").cast("long").alias("rows"),
        F.lit(n_cols).cast("int").alias("columns"),
        missing_total.cast("long").alias("missing_total"),
        F.when(F.col("rows") > 0, ratio).otherwise(F.lit(None).cast("double")).alias("missing_ratio"),
        F.col("duplicate_count").cast("long").alias("duplicate_count"),
        (F.col("duplicate_count") / F.greatest(F.lit(1), F.col("rows"))).alias("duplicate_ratio"),
    )


def table_stats(df: DataFrame) -> DataFrame:
    """Q1, Q5-Q8 as one row: rows, columns, missing_total, missing_ratio, duplicate_count, duplicate_ratio.

    One pass: every row is reduced to its fingerprint and the bit mask of its
    missing values, equal ones are merged in the map tasks, and every count is
    folded from the groups. The width of the rows does not reach the shuffle.
    """
    cols = _data_cols(df)
    if not cols:  # a table without columns: all its rows are copies of the empty row
        groups = df.groupBy().agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 0)
        return group_stats(groups, "_k")
    masks = missing_masks(df, cols)
    keys = [f"_m{i}" for i in range(len(masks))]
    rows = df.select(*fingerprint(df, cols, masks), *[m.alias(k) for m, k in zip(masks, keys)])
    groups = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_k"))
    folded = groups.agg(
        F.coalesce(F.sum("_k"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("duplicate_count"),
        *[F.coalesce(F.sum(F.when(F.col(keys[i // 63]).bitwiseAND(F.lit(1 << i % 63)) != 0, F.col("_k"))), F.lit(0)).alias(f"m{i}") for i in range(len(cols))],
    )
    return _stats_row(folded, len(cols))


def missing_masks(df: DataFrame, cols: list[str]) -> list[Column]:
    """A bit per column that is set where its value is missing, 63 columns to a long."""
    bits = [F.when(_is_missing(df, c), F.lit(1 << i % 63).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cols)]
    return [reduce(lambda a, b: a.bitwiseOR(b), bits[i : i + 63]) for i in range(0, len(bits), 63)]


def fingerprint(df: DataFrame, cols: list[str], masks: list[Column]) -> list[Column]:
    """Three 64-bit hashes ``_f0`` to ``_f2`` of a row; rows that grouping takes as equal have equal ones.

    Missing values leave a hash as it is, so the masks are hashed too. Among
    10**12 unlike rows, the chance that any two agree is about 1e-34.
    """
    values = [_hashable(df, c) for c in cols]
    return [F.xxhash64(F.lit(seed).cast("long"), *masks, *values).alias(f"_f{seed}") for seed in range(3)]


def _hashable(df: DataFrame, c: str) -> Column:
    col, dtype = F.col(f"`{c}`"), df.schema[c].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col + F.lit(0.0).cast(dtype))
    return col if isinstance(dtype, T.AtomicType) else F.to_json(F.struct(col))


def missing_stats(df: DataFrame) -> DataFrame:
    """Q1 + Q6 only: ``(rows, missing_ratio)`` from one global aggregate (no shuffle)."""
    cols = _data_cols(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    ratio = sum((F.col(f"m{i}") / F.col("rows") for i in range(len(cols))), F.lit(0.0)) / len(cols) if cols else F.lit(0.0)
    return counts.select(
        F.col("rows").cast("long").alias("rows"),
        F.when(F.col("rows") > 0, ratio).otherwise(F.lit(None).cast("double")).alias("missing_ratio"),
    )


def quality_score(missing_ratio: Column, duplicate_ratio: Column) -> Column:
    """Q9: clamp(round(100 - missing*55 - dup*35, 1), 0, 100); NaN ratios count as 0."""
    mr = F.coalesce(missing_ratio, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 - mr * MISSING_WEIGHT - duplicate_ratio * DUPLICATE_WEIGHT, 1)))


def quality_report(raw: DataFrame, cleaned: DataFrame, raw_stats: DataFrame | None = None) -> DataFrame:
    """Dataset detail numbers: quality before (raw) and after (cleaned), one row.

    ``raw_stats`` may be given as ``group_stats(report.raw_groups)`` from the
    cleaning, which saves a second shuffle of the raw rows.
    """
    before = (raw_stats if raw_stats is not None else table_stats(raw)).select(
        F.col("rows").alias("rows_before"), F.col("columns").alias("columns_before"),
        F.col("missing_total").alias("missing_total_before"), F.col("duplicate_count").alias("duplicate_count_before"),
        quality_score(F.col("missing_ratio"), F.col("duplicate_ratio")).alias("quality_score_before"),
    )
    after = table_stats(cleaned).select(
        F.col("rows").alias("row_count"), F.col("columns").alias("column_count"),
        F.col("missing_total").alias("missing_total"), F.col("duplicate_count").alias("duplicate_count"),
        quality_score(F.col("missing_ratio"), F.col("duplicate_ratio")).alias("quality_score_after"),
    )
    merged = before.unionByName(after, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in [*before.columns, *after.columns]])


def head_sample(df: DataFrame, n: int = HEAD_DEFAULT) -> DataFrame:
    """Q12: the first ``n`` rows in file order (top-n by ``_row_id``, no global sort).

    The last of their ids is found first, from the ids alone, so that the
    other columns are computed for the rows up to it and not for all.
    """
    if ROW_ID not in df.columns:
        return df.limit(n)
    last = df.select(ROW_ID).orderBy(ROW_ID).limit(n).agg(F.max(ROW_ID)).first()[0]
    if last is None:  # rows without an id, of which any will do, or none at all
        return df.orderBy(ROW_ID).limit(n)
    to = F.struct(*[F.lit(x) for x in last]) if isinstance(last, Row) else F.lit(last)
    kept = F.col(ROW_ID).isNull() | (F.col(ROW_ID) <= to.cast(df.schema[ROW_ID].dataType))
    return df.filter(kept).orderBy(ROW_ID).limit(n)


def filter_options(df: DataFrame, columns: dict[str, str | None], cap: int = OPTION_CAP) -> DataFrame:
    """Q13: ``(option, position, value)`` — sorted distinct texts per dimension, first ``cap``; the texts are those that F1 compares.

    One unpivot + distinct + ``row_number() <= cap`` (partial limit before the
    shuffle): the number of distinct values never reaches one task.
    """
    present = [(k, c) for k, c in columns.items() if c and c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "option string, position int, value string")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("option"), as_text(df, c).alias("value")) for k, c in present]))
    values = df.select(pairs.alias("p")).select("p.option", "p.value").filter(F.col("value").isNotNull()).distinct()
    w = W.partitionBy("option").orderBy("value")
    return values.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= cap).select(
        "option", F.col("position").cast("int").alias("position"), "value"
    )


def date_range(df: DataFrame, date_col: str | None) -> DataFrame:
    """Q14: ``(date_min, date_max)`` as ISO dates of the parsable values."""
    if not date_col or date_col not in df.columns:
        return df.sparkSession.createDataFrame([(None, None)], "date_min string, date_max string")
    ts = as_timestamp(df, date_col)
    return df.agg(
        F.date_format(F.min(ts), "yyyy-MM-dd").alias("date_min"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("date_max")
    )
