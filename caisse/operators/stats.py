"""Exact medians and modes for many columns at once, without single-task collects.

``exact_medians`` brackets the median of every column by a mergeable quantile
sketch (``percentile_approx``, whose rank error is at most n / SKETCH), all
columns in one aggregate. One grouped count then gives the number of values
below each bracket and the copies of each value inside it (some 4 / SKETCH of
the rows, a frequent value being one row per map task), and the target ranks
are read from a range-partitioned sort of those (``ranking.ranked_values``).
The number of jobs does not depend on the size. A rank that its bracket does
not hold would be looked up among all values of the column.

``modes_with_counts`` finds the most frequent value per column (ties: smallest
value) with one unpivot + ``groupBy(column, value).count()`` + a top-1 window,
which Spark runs with a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caisse.operators.ranking import ranked_values

#: Accuracy of the quantile sketch: its rank error is at most one row in so many.
SKETCH = 10_000


def _unpivot(df: DataFrame, cols: list[str], value_type: str) -> DataFrame:
    """``(cid, v)`` rows for the given columns (nulls dropped)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("cid"), F.col(f"`{c}`").cast(value_type).alias("v")) for i, c in enumerate(cols)])
    )
    return df.select(pairs.alias("p")).select("p.cid", "p.v").filter(F.col("v").isNotNull())


def _number(c: str | Column) -> Column:
    """A value as a double; NaN as null."""
    d = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(d), d)


def median_bracket(value: Column) -> Column:
    """(n, lo, hi) as an aggregate: count, and two values between which the median of the doubles ``value`` lies."""
    bounds = F.percentile_approx(value, F.array(F.lit(0.5 - 2 / SKETCH), F.lit(0.5 + 2 / SKETCH)), F.lit(SKETCH))
    return F.struct(F.count(value).alias("n"), bounds[0].alias("lo"), bounds[1].alias("hi"))


def exact_medians(df: DataFrame, cols: list[str], brackets: dict[str, tuple[int, float | None, float | None]] | None = None) -> dict[str, float | None]:
    """Exact median of each column (mean of the two middle values; nulls and NaN ignored); None when a column has no value.

    ``brackets`` may give the (n, lo, hi) of ``median_bracket`` per column when the
    caller already computed them in another aggregate.
    """
    if not cols:
        return {}
    if brackets is None or any(c not in brackets for c in cols):
        row = df.select(*[_number(c).alias(f"v{i}") for i, c in enumerate(cols)]).agg(*[median_bracket(F.col(f"v{i}")).alias(f"b{i}") for i in range(len(cols))]).first()
        brackets = {c: tuple(row[f"b{i}"]) for i, c in enumerate(cols)}
    ranks = {i: sorted({(n + 1) // 2, n // 2 + 1}) for i, c in enumerate(cols) if (n := brackets[c][0])}
    bounds = {i: brackets[cols[i]][1:] for i in ranks}
    found: dict[int, dict[int, float]] = {}
    values = _unpivot(df.select(*[_number(c).alias(c) for c in cols]), cols, "double")
    while ranks:
        found |= ranked_values(_bracketed(values, bounds), ranks)
        # A value of null stands for those below the bracket, no value for those above it.
        ranks = {i: r for i, r in ranks.items() if any(found.get(i, {}).get(k) is None for k in r)}
        bounds = {i: (None, None) for i in ranks}
    return {c: sum(found[i].values()) / len(found[i]) if i in found else None for i, c in enumerate(cols)}


def _bracketed(values: DataFrame, bounds: dict[int, tuple[float | None, float | None]]) -> DataFrame:
    """(cid, v, n): copies of each value inside its column's bounds, and as null of those below."""
    below, above = F.lit(False), F.lit(True)
    for i, (lo, hi) in bounds.items():
        mine = F.col("cid") == i
        below = F.when(mine, F.col("v") < F.lit(lo) if lo is not None else F.lit(False)).otherwise(below)
        above = F.when(mine, F.col("v") > F.lit(hi) if hi is not None else F.lit(False)).otherwise(above)
    inside = values.filter(~above).select("cid", F.when(~below, F.col("v")).alias("v"))
    return inside.groupBy("cid", "v").agg(F.count(F.lit(1)).alias("n"))


def modes_with_counts(df: DataFrame, cols: list[str]) -> dict[str, tuple[str | None, int]]:
    """``(mode, non-null count)`` per column, from one aggregate + top-1 window."""
    if not cols:
        return {}
    pairs = _unpivot(df, cols, "string")
    counted = pairs.groupBy("cid", "v").agg(F.count(F.lit(1)).alias("n"))
    # Top-1 per column (partial WindowGroupLimit before the shuffle) and the
    # per-column totals (partial aggregate) share the same counted exchange.
    w = W.partitionBy("cid").orderBy(F.desc("n"), F.asc("v"))
    top = counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1).select(
        "cid", "v", F.col("n").alias("x"), F.lit("mode").alias("k"))
    tot = counted.groupBy("cid").agg(F.sum("n").alias("x")).select(
        "cid", F.lit(None).cast("string").alias("v"), "x", F.lit("total").alias("k"))
    found: dict[int, list] = {}
    for r in top.unionByName(tot).collect():
        slot = found.setdefault(r["cid"], [None, 0])
        if r["k"] == "mode":
            slot[0] = r["v"]
        else:
            slot[1] = int(r["x"])
    return {c: tuple(found.get(i, (None, 0))) for i, c in enumerate(cols)}
