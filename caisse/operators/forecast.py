"""Revenue forecast and anomaly months (M1-M9).

The model is an ordinary least-squares line through the monthly revenue, with
the month *position* (0..n-1, not the calendar distance) as regressor. The
monthly series is an aggregate of the fact table with one row per calendar
month, so everything here runs on a few hundred rows at most: the series is
folded into a single row holding a calendar-bounded ``array<struct<pos, y>>``
and the fit is computed on that array with higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.functions.arrays import at
from caisse.functions.cache import jvm_cached

# ---------------------------------------------------------------------------
# Texts and thresholds of the forecast.
# ---------------------------------------------------------------------------
METHOD_TEXT = (
    "Régression linéaire sur le chiffre d'affaires mensuel. "
    "La fourchette est estimée à partir de l'erreur historique moyenne."
)
MSG_NO_ROLES = "Données insuffisantes : une colonne date et une colonne chiffre d'affaires sont nécessaires."
MSG_FEW_MONTHS = "Données insuffisantes : au moins 3 mois d'historique sont recommandés pour une prévision fiable."
MSG_OK = "Prévision calculée à partir de l'historique mensuel disponible."
ANOMALY_TEXT = "Ce mois est {direction} de la moyenne mensuelle avec un écart statistique élevé."
ABOVE, BELOW = "au-dessus", "en dessous"
HORIZON = 3
TREND_SHARE = 0.03
BAND_SHARE = 0.08
Z_THRESHOLD = 1.5
CONFIDENCE_MIN, CONFIDENCE_MAX = 35, 95
CONFIDENCE_FEW_MONTHS = 25


def _money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


POINT_TYPE = "array<struct<pos:int,month:string,value:double,y:double>>"


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, p: acc + f(p))


def model_summary(agg: DataFrame, has_roles: bool = True) -> DataFrame:
    """M1-M4, M7: the fitted line and its quality in one row.

    ``agg`` is the grouping-sets aggregate of ``caisse.operators.kpis``: its
    ``month`` rows are the series (calendar-bounded) and its ``total`` row
    gives the source row count for the "fewer than 2 rows" gate. The series
    is folded into a sorted array; slope and intercept use the centred
    least-squares formulas, the residuals a second pass over the same array.
    """
    staged = agg.filter(F.col("set").isin("month", "total")).agg(*_series_aggs())
    for stage in _fit_stages():
        staged = staged.select("*", *stage)
    return staged.select(*_summary_columns(has_roles))


@jvm_cached
def _series_aggs() -> tuple[Column, ...]:
    is_month = (F.col("set") == "month") & F.col("name").isNotNull() & F.col("sum_rev").isNotNull()
    return (
        F.array_sort(
            F.collect_list(
                F.when(
                    is_month,
                    F.struct(
                        F.col("name").alias("month"),
                        F.round(F.col("sum_rev"), 2).cast("double").alias("value"),
                        F.col("sum_rev").cast("double").alias("y"),
                    ),
                )
            )
        ).alias("_sorted"),
        F.max(F.when(F.col("set") == "total", F.col("n_rows"))).alias("_src_rows"),
    )


@jvm_cached
def _fit_stages() -> tuple[tuple[Column, ...], ...]:
    pts = F.transform(
        F.col("_sorted"),
        lambda p, i: F.struct(i.alias("pos"), p["month"].alias("month"), p["value"].alias("value"), p["y"].alias("y")),
    )
    points = F.col("_points")
    s1 = (pts.alias("_points"), F.coalesce(F.col("_src_rows"), F.lit(0)).alias("_src_rows_n"), F.size(pts).alias("n_months"))
    ybar = F.try_divide(_sum(points, lambda p: p["y"]), F.col("n_months"))
    s2 = (ybar.alias("_ybar"), ((F.col("n_months") - 1) / 2.0).alias("_xbar"))
    sxy = _sum(points, lambda p: (p["pos"] - F.col("_xbar")) * (p["y"] - F.col("_ybar")))
    sxx = _sum(points, lambda p: (p["pos"] - F.col("_xbar")) * (p["pos"] - F.col("_xbar")))
    syy = _sum(points, lambda p: (p["y"] - F.col("_ybar")) * (p["y"] - F.col("_ybar")))
    s3 = (F.try_divide(sxy, sxx).alias("_slope"), F.sqrt(F.try_divide(syy, F.col("n_months"))).alias("_std"))
    s4 = ((F.col("_ybar") - F.col("_slope") * F.col("_xbar")).alias("_intercept"),)
    mae = F.try_divide(
        _sum(points, lambda p: F.abs(p["y"] - (F.col("_intercept") + F.col("_slope") * p["pos"]))),
        F.col("n_months"),
    )
    mean = F.when(F.coalesce(F.col("_ybar"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_ybar"))
    s5 = (mae.alias("_mae"), mean.alias("_mean"))
    return (s1, s2, s3, s4, s5)


@jvm_cached
def _summary_columns(has_roles: bool) -> tuple[Column, ...]:
    enough_rows = F.lit(has_roles) & (F.col("_src_rows_n") >= 2)
    fitted = enough_rows & (F.col("n_months") >= 3)
    confidence = F.greatest(
        F.lit(CONFIDENCE_MIN), F.least(F.lit(CONFIDENCE_MAX), F.round(100 - F.col("_mae") / F.col("_mean") * 100, 0))
    )
    trend = (
        F.when(F.col("_slope") > F.col("_mean") * TREND_SHARE, F.lit("hausse"))
        .when(F.col("_slope") < -F.col("_mean") * TREND_SHARE, F.lit("baisse"))
        .otherwise(F.lit("stable"))
    )
    return (
        F.col("n_months").cast("long").alias("n_months"),
        F.when(fitted, F.col("_slope")).alias("slope"),
        F.when(fitted, F.col("_intercept")).alias("intercept"),
        F.when(fitted, F.col("_mae")).alias("mae"),
        F.when(fitted, F.col("_mean")).alias("mean"),
        F.when(fitted, F.col("_std")).alias("std"),
        F.when(fitted, F.greatest(F.col("_mae"), F.col("_mean") * BAND_SHARE)).alias("interval"),
        F.when(enough_rows, at(F.col("_points"), -1)["month"]).alias("last_month"),
        F.when(fitted, trend).otherwise(F.lit("insufficient_data")).alias("trend"),
        F.when(fitted, confidence.cast("int"))
        .when(enough_rows, F.lit(CONFIDENCE_FEW_MONTHS))
        .otherwise(F.lit(0))
        .alias("confidence_score"),
        F.when(fitted, F.lit(MSG_OK))
        .when(enough_rows, F.lit(MSG_FEW_MONTHS))
        .otherwise(F.lit(MSG_NO_ROLES))
        .alias("message"),
        F.lit(METHOD_TEXT).alias("method"),
        F.when(fitted, F.lit("linear_regression")).alias("model"),
        enough_rows.alias("_has_history"),
        F.col("_points"),
    )


def _forecast_array(horizon: int = HORIZON) -> Column:
    """``array<struct<month, value, low, high>>`` of the next ``horizon`` months (empty if unfitted)."""
    first_day = F.to_date(F.concat(F.col("last_month"), F.lit("-01")))

    def step(h: Column) -> Column:
        raw = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n_months") + h - 1))
        return F.struct(
            F.date_format(F.add_months(first_day, h.cast("int")), "yyyy-MM").alias("month"),
            _money(raw).alias("value"),
            _money(F.greatest(F.lit(0.0), raw - F.col("interval"))).alias("low"),
            _money(raw + F.col("interval")).alias("high"),
        )

    arr = F.transform(F.sequence(F.lit(1), F.lit(horizon)), step)
    return F.when(F.col("slope").isNotNull(), arr).otherwise(F.array().cast(arr_type()))


def arr_type() -> str:
    return "array<struct<month:string,value:double,low:double,high:double>>"


def _anomaly_array() -> Column:
    """``array<struct<month, value, z_score, reason>>`` of anomaly months."""
    z = lambda p: F.abs(p["y"] - F.col("mean")) / F.col("std")
    hits = F.filter(F.col("_points"), lambda p: z(p) >= Z_THRESHOLD)
    arr = F.transform(
        hits,
        lambda p: F.struct(
            p["month"].alias("month"),
            _money(p["y"]).alias("value"),
            F.round(z(p), 2).alias("z_score"),
            F.when(p["y"] > F.col("mean"), F.lit(ANOMALY_TEXT.format(direction=ABOVE)))
            .otherwise(F.lit(ANOMALY_TEXT.format(direction=BELOW)))
            .alias("reason"),
        ),
    )
    empty = F.array().cast("array<struct<month:string,value:double,z_score:double,reason:string>>")
    return F.when(F.col("slope").isNotNull() & (F.col("std") > 0), arr).otherwise(empty)


def forecast_rows(summary: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """M5: ``(month, value, low, high, kind)`` for the next ``horizon`` calendar months."""
    return summary.select(F.explode(_forecast_array(horizon)).alias("f")).select(
        "f.month", "f.value", "f.low", "f.high", F.lit("forecast").alias("kind")
    )


def historical_rows(summary: DataFrame) -> DataFrame:
    """M8: ``(month, value, kind)`` from the folded series; empty when the roles/row gate fails."""
    pts = F.when(F.col("_has_history"), F.col("_points")).otherwise(F.array().cast(POINT_TYPE))
    return summary.select(F.explode(pts).alias("p")).select(
        F.col("p.month").alias("month"), F.col("p.value").alias("value"), F.lit("historical").alias("kind")
    )


def anomalies(summary: DataFrame) -> DataFrame:
    """M6: months with ``|v - mean| / std_pop >= 1.5``; none when std is 0 or the model is not fitted."""
    return summary.select(F.explode(_anomaly_array()).alias("a")).select("a.month", "a.value", "a.z_score", "a.reason")


def chart_series(summary: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Historical and forecast rows on one month axis (absent measures null), one pass."""
    pts = F.when(F.col("_has_history"), F.col("_points")).otherwise(F.array().cast(POINT_TYPE))
    hist = F.transform(
        pts,
        lambda p: F.struct(
            p["month"].alias("month"), F.lit("historical").alias("kind"), p["value"].alias("value"),
            F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ),
    )
    fc = F.transform(
        _forecast_array(horizon),
        lambda f: F.struct(
            f["month"].alias("month"), F.lit("forecast").alias("kind"), f["value"].alias("value"),
            f["low"].alias("low"), f["high"].alias("high"),
        ),
    )
    return summary.select(F.explode(F.concat(hist, fc)).alias("r")).select("r.month", "r.kind", "r.value", "r.low", "r.high")


def trend_label(trend: Column) -> Column:
    """M9 label of a trend code."""
    return (
        F.when(trend == "hausse", F.lit("Hausse"))
        .when(trend == "baisse", F.lit("Baisse"))
        .when(trend == "stable", F.lit("Stable"))
        .otherwise(F.lit("Données insuffisantes"))
    )


def chart_summary(summary: DataFrame) -> DataFrame:
    """M9: next-month value, anomaly count and trend label in one row."""
    fc = _forecast_array()
    return summary.select(
        at(fc, 1)["value"].alias("next_month_value"),
        F.size(_anomaly_array()).cast("long").alias("anomaly_count"),
        trend_label(F.col("trend")).alias("trend_label"),
        "trend",
        "confidence_score",
    )
