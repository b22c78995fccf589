"""Cleaning and type inference.

Fixed order: rename -> dedup -> trim/null -> dates -> numbers -> drop empty
columns -> fill. Every decision that depends on the data is taken from one
aggregate over all columns at once, never one job per column:

===== ==================================================================
job 1 dedup (``groupBy(all columns)`` keeping the first ``_row_id``)
job 2 one ``agg``: row count, non-null counts, first non-null value of
      date-named columns and numeric-parse counts of text columns
job 3 modes with non-null counts (one unpivot + count + top-1; this also
      gives the parsed count of date columns) and medians (``exact_medians``,
      only of the numeric columns that job 2 found with nulls)
===== ==================================================================

The result is a lazy ``select`` over the deduplicated table, which is written
to ``spark.checkpoint.dir`` as Parquet (or persisted on demand; the caller then releases
``CleaningReport.raw_groups``) because the statistics jobs and the caller all
read it. NaN is missing from the start, whatever the table was read with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.functions.text import unicode_strip
from caisse.operators.stats import exact_medians, modes_with_counts
from caisse.roles import normalize_columns
from caisse.session import stored
from caisse.sources.files import ROW_ID, cast_text, is_float_text, is_int_text

# ---------------------------------------------------------------------------
# Text treated as missing after trimming; date-name markers.
# ---------------------------------------------------------------------------
NULL_TEXTS = ["nan", "None", ""]
DATE_NAME_MARKERS = ["date", "created"]

# Date shapes: regex -> Spark patterns, month-first before day-first where the
# numbers alone do not tell. A time of day may follow each.
DATE_SHAPES: list[tuple[str, list[str]]] = [
    (r"\d{4}/\d{1,2}/\d{1,2}", ["yyyy/M/d"]),
    (r"\d{4}\.\d{1,2}\.\d{1,2}", ["yyyy.M.d"]),
    (r"\d{8}", ["yyyyMMdd"]),
    *[(rf"\d{{1,2}}[{sep}]\d{{1,2}}[{sep}]\d{{{len(year)}}}", [f"M{sep}d{sep}{year}", f"d{sep}M{sep}{year}"])
      for sep in "/-." for year in ("yyyy", "yy")],
    (r"\d{1,2} [A-Za-z]{3} \d{4}", ["d MMM yyyy"]),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", ["d-MMM-yyyy"]),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", ["d MMMM yyyy"]),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", ["MMM d, yyyy"]),
    (r"[A-Za-z]{4,9} \d{1,2}, \d{4}", ["MMMM d, yyyy"]),
]
TIMES = [("", ""), (r" \d{1,2}:\d{2}", " H:mm"), (r" \d{1,2}:\d{2}:\d{2}", " H:mm:ss")]
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
ISO_TIMESTAMP = ISO_DATE + r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?"
#: The first value has no known shape: each value is read by its own.
MIXED = "mixed"
#: Two-digit years up to this one are of this century.
LAST_SHORT_YEAR = 2068


def guess_date_pattern(first: str | None) -> str | None:
    """Pattern for the whole column, guessed from its first non-null value.

    None stands for an ISO timestamp or no known shape. Between month-first
    and day-first, a first number above 12 decides.
    """
    if first is None:
        return None
    v = first.strip()
    if re.fullmatch(ISO_DATE, v):
        return "yyyy-M-d"
    if re.fullmatch(ISO_TIMESTAMP, v):
        return None
    for rx, patterns in DATE_SHAPES:
        for time_rx, time in TIMES:
            if re.fullmatch(rx + time_rx, v):
                day_first = len(patterns) > 1 and int(re.match(r"\d+", v).group()) > 12
                return patterns[1 if day_first else 0] + time
    return None


def column_pattern(first: str | None) -> str | None:
    """The guessed pattern; MIXED where the first value has no known shape."""
    pattern = guess_date_pattern(first)
    known = first is None or pattern is not None or re.fullmatch(ISO_TIMESTAMP, first.strip())
    return pattern if known else MIXED


def _by_pattern(c: Column, pattern: str) -> Column:
    # No date without a digit; a failing parse costs far more than this test.
    ts = F.when(c.rlike("[0-9]"), F.try_to_timestamp(c, F.lit(pattern)))
    if "yyyy" in pattern:
        return ts
    # Spark reads all two-digit years as 20yy.
    return F.when(F.year(ts) > LAST_SHORT_YEAR, ts - F.make_ym_interval(F.lit(100), F.lit(0))).otherwise(ts)


def mixed_dates(c: Column) -> Column:
    """Each value by its own shape; one regex per shape stands before the parsers."""
    v = F.trim(c)
    time = r"( \d{1,2}:\d{2}(:\d{2})?)?"
    options = [F.when(v.rlike(f"^({ISO_DATE}|{ISO_TIMESTAMP})$"), F.try_to_timestamp(v))]
    for rx, patterns in DATE_SHAPES:
        options.append(F.when(v.rlike(f"^{rx}{time}$"), F.coalesce(*[_by_pattern(v, p + "[ H:mm[:ss]]") for p in patterns])))
    return F.coalesce(*options)


def parse_date(c: Column, pattern: str | None) -> Column:
    if pattern == MIXED:
        return mixed_dates(c)
    return _by_pattern(c, pattern) if pattern else F.try_to_timestamp(c)


def is_date_name(name: str) -> bool:
    low = name.lower()
    return any(marker in low for marker in DATE_NAME_MARKERS)


@dataclass
class CleaningReport:
    renamed: dict[str, str] = field(default_factory=dict)
    rows_in: int = 0
    rows_out: int = 0
    date_patterns: dict[str, str | None] = field(default_factory=dict)
    numeric_casts: dict[str, str] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    # Deduplicated raw rows with their copy counts (written or persisted): the
    # raw table's statistics are folded from it (``profile.group_stats``).
    raw_groups: DataFrame | None = None


def rename(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """C1 on every column but ``_row_id``; NaN becomes null."""
    cols = [c for c in df.columns if c != ROW_ID]
    names = normalize_columns(cols)
    mapping = dict(zip(cols, names))
    exprs = [_not_nan(df, c).alias(mapping[c]) if c != ROW_ID else F.col(ROW_ID) for c in df.columns]
    return df.select(*exprs), mapping


def _not_nan(df: DataFrame, c: str) -> Column:
    """The column with null for NaN."""
    col = F.col(f"`{c}`")
    return F.when(~F.isnan(col), col) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col


COPIES = "_copies"


def deduplicate(df: DataFrame, keep_copies: bool = False) -> DataFrame:
    """Full-row duplicates removed, first row kept (nulls compare equal).

    One hash aggregate on all columns; the map-side partial aggregate merges
    copies before the shuffle, so a row repeated millions of times costs one
    row per map task. ``keep_copies`` adds the group size (``_copies``), from
    which the raw table's row, duplicate and missing counts follow without
    another pass.
    """
    keys = [c for c in df.columns if c != ROW_ID]
    if ROW_ID not in df.columns:
        return df.dropDuplicates()
    extra = [F.count(F.lit(1)).alias(COPIES)] if keep_copies else []
    if not keys:
        return df.agg(F.min(ROW_ID).alias(ROW_ID), *extra).filter(F.col(ROW_ID).isNotNull())
    out = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.min(ROW_ID).alias(ROW_ID), *extra)
    return out.select(*df.columns, *([COPIES] if keep_copies else []))


def trim_nulls(df: DataFrame) -> DataFrame:
    """C4: text columns stripped; ``nan`` / ``None`` / empty -> null."""
    texts = {c for c, t in df.dtypes if t == "string" and c != ROW_ID}
    # Two projections, so that each value is stripped once and not once per mention.
    stripped = df.select(*[unicode_strip(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    return stripped.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def _materialize(df: DataFrame, how: str | None) -> DataFrame:
    if how == "checkpoint":
        return stored(df, "groups")
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def clean(df: DataFrame, materialize: str | None = "checkpoint") -> tuple[DataFrame, CleaningReport]:
    """The whole cleaning; returns the cleaned table (with ``_row_id``) and a report."""
    report = CleaningReport()
    if ROW_ID not in df.columns:
        # Frames that do not come from ``read_sales`` get their order here.
        df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    renamed, report.renamed = rename(df)
    groups = _materialize(deduplicate(renamed, keep_copies=True), materialize)
    report.raw_groups = groups
    dedup = trim_nulls(groups.drop(COPIES))
    schema = {f.name: f.dataType for f in dedup.schema.fields}
    cols = [c for c in dedup.columns if c != ROW_ID]

    # -- job 2: every data-dependent decision in one aggregate ------------
    date_text = [c for c in cols if is_date_name(c) and isinstance(schema[c], T.StringType)]
    date_num = [c for c in cols if is_date_name(c) and isinstance(schema[c], T.NumericType)]
    text = [c for c in cols if isinstance(schema[c], T.StringType) and c not in date_text]
    # Per-row values are projected once (each regex at most once per value),
    # then one aggregate counts them.
    proj: list[Column] = [F.col(ROW_ID)]
    for i, c in enumerate(cols):
        proj.append(F.col(f"`{c}`").isNotNull().alias(f"nn{i}"))
    for i, c in enumerate(date_text):
        proj.append(F.col(f"`{c}`").alias(f"d{i}"))
    for i, c in enumerate(text):
        col = F.col(f"`{c}`")
        is_float = is_float_text(col)
        proj += [is_float.alias(f"num{i}"), is_int_text(col, is_float).alias(f"int{i}")]
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"nn{i}")).alias(f"nn{i}") for i in range(len(cols))]
    aggs += [F.min_by(F.col(f"d{i}"), F.when(F.col(f"d{i}").isNotNull(), F.col(ROW_ID))).alias(f"first{i}")
             for i in range(len(date_text))]
    for i in range(len(text)):
        aggs += [F.count_if(F.col(f"num{i}")).alias(f"num{i}"), F.count_if(F.col(f"int{i}")).alias(f"int{i}")]
    stats = dedup.select(*proj).agg(*aggs).first()
    n = stats["_n"]
    report.rows_in = n
    nonnull = {c: stats[f"nn{i}"] for i, c in enumerate(cols)}

    conv: dict[str, Column] = {}
    for i, c in enumerate(date_text):
        pattern = column_pattern(stats[f"first{i}"])
        report.date_patterns[c] = pattern
        conv[c] = parse_date(F.col(f"`{c}`"), pattern)
        nonnull[c] = None  # known after parsing (from the mode job below)
    for c in date_num:
        # Numbers in a date-named column are read as epoch nanoseconds.
        conv[c] = F.timestamp_micros(F.floor(F.col(f"`{c}`").cast("double") / 1000).cast("long"))
    for i, c in enumerate(text):
        n_num, n_int = stats[f"num{i}"], stats[f"int{i}"]
        if n_num > n / 2:
            to = "long" if n_int == n else "double"
            report.numeric_casts[c] = to
            col = F.col(f"`{c}`")
            conv[c] = F.when(is_float_text(col), cast_text(col, to))
            nonnull[c] = n_num

    typed_all = dedup.select(*[conv.get(c, F.col(f"`{c}`")).alias(c) for c in cols], F.col(ROW_ID))
    typed_schema = {f.name: f.dataType for f in typed_all.schema.fields}

    # -- job 3: modes (and parsed counts of date columns), medians ---------
    mode_cols = [c for c in cols if not isinstance(typed_schema[c], T.NumericType)
                 and (nonnull[c] is None or 0 < nonnull[c] < n)]
    mode_info = modes_with_counts(typed_all, mode_cols)
    for c in date_text:
        nonnull[c] = mode_info[c][1]

    # -- C7: drop columns without any value (all columns of an empty table)
    keep = [c for c in cols if nonnull[c] > 0]
    report.dropped = [c for c in cols if c not in keep]
    typed = typed_all.select(*[F.col(f"`{c}`") for c in keep], F.col(ROW_ID))

    # -- C8 / C9: fills for the columns that still have nulls --------------
    need = [c for c in keep if nonnull[c] < n]
    numeric = [c for c in need if isinstance(typed_schema[c], T.NumericType)]
    # Truth values with nulls are filled like text, by their mode (false on ties).
    other = [c for c in need if c not in numeric]
    medians = exact_medians(typed, numeric)
    fills: dict[str, Column] = {}
    for c in numeric:
        if medians[c] is not None:
            report.fills[c] = medians[c]
            fills[c] = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(medians[c]))
    for c in other:
        mode = mode_info.get(c, (None, 0))[0]
        if mode is not None:
            report.fills[c] = mode
            fills[c] = F.coalesce(F.col(f"`{c}`"), F.lit(mode).cast(typed_schema[c]))
    cleaned = typed.select(*[fills.get(c, F.col(f"`{c}`")).alias(c) for c in keep], F.col(ROW_ID))
    report.rows_out = n
    return cleaned, report


def clean_frame(df: DataFrame, materialize: str | None = "checkpoint") -> DataFrame:
    return clean(df, materialize)[0]
