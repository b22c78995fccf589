"""Sales file sources (S1, S2) with read-level typing.

A CSV is read with every column as text (no schema inference pass by Spark),
then typed the way a default CSV reader would: missing-value tokens become
null, a column whose non-null values are all integers (and has no null)
becomes ``long``, all numbers becomes ``double``, all ``True``/``False``
without null becomes ``boolean``. The decision for all columns is one
aggregate job; the casts are one ``select``.

``_row_id`` records file order, so "first row" and "head" keep their meaning
across partitions. In one file it is ``monotonically_increasing_id`` taken
right after the scan, which grows with the split offset. Several files are
packed into tasks by size, so there it is (file path, split offset, position).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "_row_id"

# ---------------------------------------------------------------------------
# Tokens a default CSV reader turns into missing values, and the
# boolean spellings it recognises.
# ---------------------------------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]

INT_PATTERN = r"^\s*[+-]?\d+\s*$"
FLOAT_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"


UNSUPPORTED = "Format de fichier non supporte"
FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def detect_format(path: str) -> str:
    """Reader from the (lower-cased) extension."""
    ext = Path(path.rstrip("/")).suffix.lower()
    if ext not in FORMATS:
        raise ValueError(UNSUPPORTED)
    return FORMATS[ext]


# First characters a number can start with (after optional white space).
SPACES = " \t\n\r\x0b\f"
NUMBER_STARTS = list("0123456789+-.iI" + SPACES)


def is_float_text(c: Column) -> Column:
    """Text of a number (``FLOAT_PATTERN``).

    A first-character test rejects ordinary words before the regex runs, so
    text columns cost one substring per value, numeric ones one regex.
    """
    return F.substring(c, 1, 1).isin(*NUMBER_STARTS) & c.rlike(FLOAT_PATTERN)


def is_int_text(c: Column, is_float: Column | None = None) -> Column:
    """Text of a 64-bit integer (``INT_PATTERN``); pass ``is_float`` to test only numbers.

    Longer integers (tracking numbers) are numbers, but not integers here.
    """
    number = is_float if is_float is not None else is_float_text(c)
    return number & c.rlike(INT_PATTERN) & F.btrim(c, F.lit(SPACES)).try_cast("long").isNotNull()


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def _file_order(df: DataFrame) -> Column:
    position = F.monotonically_increasing_id()
    if len(df.inputFiles()) <= 1:
        return position.alias(ROW_ID)
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return F.struct(*place, position.alias("position")).alias(ROW_ID)


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a CSV value may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(path).filter(F.col("value").contains('"') & (quotes % 2 == 1)).isEmpty()


def read_raw(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """The file as read, with ``_row_id``; CSV columns are text with NA tokens nulled.

    ``multi_line`` reads CSV values that hold line breaks; each file is then
    one task, as a split could begin inside a value. Unset, a pass over the
    lines decides, so files without such values are split.
    """
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        multi_line = spans_lines(spark, path) if multi_line is None else multi_line
        df = (
            spark.read.option("header", True)
            .option("inferSchema", False)
            .option("multiLine", multi_line)
            .option("escape", '"')
            .option("nullValue", "\u0000")  # keep empty strings: they are matched as NA tokens below
            .option("emptyValue", "")
            .csv(path)
        )
        values = [null_tokens(F.col(f"`{c}`")).alias(c) for c in df.columns]
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.json(path)
    else:
        raise ValueError(UNSUPPORTED)
    if fmt != "csv":
        # NaN is a missing value, as in the text formats.
        floats = {c for c, t in df.dtypes if t in ("float", "double")}
        values = [F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]
    return df.select(*values, _file_order(df))


def infer_read_types(df: DataFrame) -> dict[str, str]:
    """Read-level type per text column: ``long`` / ``double`` / ``boolean`` / ``string``.

    Rules (a) and (b): all non-null numeric -> number however sparse; all
    integers with no null -> long; all booleans with no null -> boolean; a
    column with no value at all -> double (an all-missing column).
    """
    text_cols = [c for c, t in df.dtypes if t == "string" and c != ROW_ID]
    if not text_cols:
        return {}
    # Per-row flags are projected once, then counted: each regex runs at most
    # once per value, and only on values that start like a number.
    flags = []
    for i, c in enumerate(text_cols):
        col = F.col(f"`{c}`")
        is_float = is_float_text(col)  # a common subexpression of the two flags below
        flags += [
            col.isNotNull().alias(f"nn{i}"),
            is_float.alias(f"nf{i}"),
            is_int_text(col, is_float).alias(f"ni{i}"),
            col.isin(*TRUE_WORDS, *FALSE_WORDS).alias(f"nb{i}"),
        ]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i in range(len(text_cols)):
        aggs += [F.count_if(F.col(f"{k}{i}")).alias(f"{k}{i}") for k in ("nn", "nf", "ni", "nb")]
    row = df.select(*flags).agg(*aggs).first()
    n = row["_n"]
    out: dict[str, str] = {}
    for i, c in enumerate(text_cols):
        nn, ni, nf, nb = row[f"nn{i}"], row[f"ni{i}"], row[f"nf{i}"], row[f"nb{i}"]
        if nn == 0:
            out[c] = "double"
        elif ni == nn and nn == n:
            out[c] = "long"
        elif nf == nn:
            out[c] = "double"
        elif nb == nn and nn == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def cast_text(c: Column, to: str) -> Column:
    if to == "long":
        return F.btrim(c, F.lit(SPACES)).try_cast("long")
    if to == "double":
        return c.try_cast("double")  # white space around it and the spellings of infinity included
    if to == "boolean":
        return F.when(c.isin(*TRUE_WORDS), F.lit(True)).when(c.isin(*FALSE_WORDS), F.lit(False))
    return c


def apply_read_types(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    types = infer_read_types(df) if types is None else types
    return df.select(*[cast_text(F.col(f"`{c}`"), types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def read_sales(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """S1+S2: typed table with ``_row_id``, as a default reader would type it."""
    raw = read_raw(spark, path, fmt, multi_line)
    return apply_read_types(raw) if (fmt or detect_format(path)) == "csv" else raw
