"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables of ``sf_dir`` (or data Spark derives from
them) in full; nothing is sampled or capped except where a limit is the
feature itself (top-k lists, pagination, the 150-value option lists).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.functions.arrays import at
from caisse.operators import assistant as qa
from caisse.operators import insights as ins
from caisse.operators import filters as flt
from caisse.operators import profile as prof
from caisse.plans.report import Report
from caisse.operators.kpis import dashboard_fold, top_k
from caisse.operators.cleaning import clean
from caisse.plans.sales import SalesAnalysis
from caisse.roles import role_map
from caisse.sources.dirty import CLIENT_TEXT, coded_orders, date_extract, dirty_raw
from caisse.sources.files import ROW_ID
from caisse.sources.starschema import sales_view

Query = Callable[[SparkSession, str], DataFrame]


def _analysis(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> SalesAnalysis:
    return SalesAnalysis(sales_view(spark, sf_dir, columns))


# Columns each family of outputs reads from the sales view (role names).
DASHBOARD_COLS = None  # all columns
MONTHLY_COLS = ["date_vente", "chiffre_affaires"]


def k20_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).dashboard()


def k13_k17_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).tops(5)


def k12_monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, MONTHLY_COLS).monthly()


def w1_month_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, MONTHLY_COLS).month_deltas().select(
        "month", "value", "position", "previous_month", "delta"
    )


def m5_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, MONTHLY_COLS).forecast()


def m_model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _analysis(spark, sf_dir, MONTHLY_COLS).model_row()
    return row.select(
        "n_months",
        F.round("slope", 2).alias("slope"),
        F.round("intercept", 2).alias("intercept"),
        F.round("mae", 2).alias("mae"),
        F.round("mean", 2).alias("mean"),
        F.round("interval", 2).alias("interval"),
        "last_month",
        "trend",
        "confidence_score",
        "message",
        "model",
    )


def m6_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, MONTHLY_COLS).anomalies()


def j2_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, MONTHLY_COLS).chart_series()


def m9_chart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir, MONTHLY_COLS).chart_summary()


def _cleaned_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(dirty_raw(spark, sf_dir))[0]


def _export_view(df: DataFrame) -> DataFrame:
    """Rows as exported: timestamps as ISO text, internal row id dropped."""
    exprs = []
    for c, t in df.dtypes:
        if c == ROW_ID:
            continue
        if t.startswith("timestamp"):
            exprs.append(F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss").alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def c10_clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _export_view(_cleaned_dirty(spark, sf_dir))


def q9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dirty_raw(spark, sf_dir)
    cleaned, report = clean(raw)
    return prof.quality_report(raw, cleaned, prof.group_stats(report.raw_groups))


def q15_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.column_profile(_cleaned_dirty(spark, sf_dir))


def q15_sales_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.column_profile(sales_view(spark, sf_dir))


def q7_sales_table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.table_stats(sales_view(spark, sf_dir))


OPTION_KEYS = {"villes": "city", "canaux": "channel", "clients": "client", "produits": "product", "vendeurs": "seller"}


def q13_filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales_view(spark, sf_dir)
    roles = role_map(df.columns)
    return prof.filter_options(df, {k: roles[r] for k, r in OPTION_KEYS.items()})


def q14_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales_view(spark, sf_dir, ["date_vente"])
    return prof.date_range(df, "date_vente")


def c_clean_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SalesAnalysis(_cleaned_dirty(spark, sf_dir).drop(ROW_ID)).dashboard()


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard fold of the sales view (it carries the table's missing ratio)."""
    a = SalesAnalysis(sales_view(spark, sf_dir))
    return dashboard_fold(a.measures, a.aggregate)


def a1_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.insights(_summary(spark, sf_dir))


def a2_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.alerts(_summary(spark, sf_dir))


def a7_alert_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.status_counts(ins.alerts(_summary(spark, sf_dir)))


def _answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = SalesAnalysis(sales_view(spark, sf_dir))
    tops = top_k(a.aggregate, 5, round_values=False).agg(
        F.collect_list(F.struct("dimension", "rank", "name", "value")).alias("tops")
    )
    return qa.answers(ins.merge_rows(dashboard_fold(a.measures, a.aggregate), tops))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


def n1_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", qa.route(F.col("question")).alias("intent"))


def n_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = qa.answer_questions(_questions(spark, sf_dir), "question", _answer_table(spark, sf_dir))
    return routed.select("conv_id", "turn", "intent", "answer")


def n_answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer_table(spark, sf_dir)


# A user selection: one city over a date window.
DEMO_FILTERS = {"ville": "NATION_7", "start_date": "1996-01-01", "end_date": "1999-06-30"}


def f_filtered_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SalesAnalysis(flt.apply_filters(sales_view(spark, sf_dir), DEMO_FILTERS)).dashboard()


def f5_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt.filter_counts(sales_view(spark, sf_dir), DEMO_FILTERS)


def f7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales_view(spark, sf_dir)
    hits = flt.search(df, "Supplier#000000042")
    return hits.select(*[flt.display_value(df, c).alias(c) for c in df.columns])


def f9_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales_view(spark, sf_dir)
    ordered = flt.sort_rows(df, "chiffre_affaires", ascending=False, tie_break=list(df.columns))
    return flt.page(ordered, 3).select(
        "id_commande", F.col("chiffre_affaires").cast("double").alias("chiffre_affaires"), "client", "produit", "vendeur"
    )


def _report(spark: SparkSession, sf_dir: str) -> Report:
    return Report(sales_view(spark, sf_dir), DEMO_FILTERS)


def s10_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).resume()


def s11_kpi_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).kpi_lines()


def s11_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).text_lines()


def s12_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).bars()


def k10_k11_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 counts and K11 payment rate (paid rows / classified rows x 100)."""
    d = SalesAnalysis(sales_view(spark, sf_dir, ["statut_paiement"])).dashboard()
    total = F.col("paid_order_count") + F.col("unpaid_order_count") + F.col("unknown_payment_count")
    return d.select(
        "paid_order_count", "unpaid_order_count", "unknown_payment_count",
        F.when(total > 0, F.round(F.col("paid_order_count") / total * 100, 1)).otherwise(F.lit(0.0)).alias("payment_rate"),
    )


def k19_best_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month with the highest revenue (earliest on ties)."""
    fold = dashboard_fold(*_measures_agg(spark, sf_dir, MONTHLY_COLS))
    best = at(F.array_sort(F.transform(F.col("months"), lambda m, i: F.struct(
        (-m["value"]).alias("k"), i.alias("i"), m.alias("m")))), 1)["m"]
    return fold.filter(F.size("months") > 0).select(best["month"].alias("month"), best["value"].alias("value"))


def _measures_agg(spark: SparkSession, sf_dir: str, cols: list[str] | None = None):
    a = _analysis(spark, sf_dir, cols)
    return a.measures, a.aggregate


def q12_head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: the first rows of the cleaned extract in file order (detail view: 20)."""
    return _export_view(prof.head_sample(_cleaned_dirty(spark, sf_dir), prof.HEAD_DETAIL))


def x_text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3-X7 on the top lists: money, report money, share, axis and short labels."""
    from caisse.functions import text as X

    a = _analysis(spark, sf_dir)
    tops = top_k(a.aggregate, 5)
    total = a.dashboard().select("revenue_total")
    rows = tops.unionByName(total, allowMissingColumns=True)
    # The total is one row; attach it with a window over the (at most 25 + 1) rows.
    from pyspark.sql import Window as W
    with_total = rows.withColumn("_total", F.max("revenue_total").over(W.partitionBy())).filter(F.col("dimension").isNotNull())
    return with_total.select(
        "dimension", "rank", "name",
        X.format_money("value").alias("money"),
        X.format_eur("value").alias("money_eur"),
        X.format_percent(F.col("value") / F.col("_total") * 100).alias("share"),
        X.axis_label("value").alias("axis"),
        X.short_label("name").alias("short_name"),
        X.short_label("name", 8).alias("shorter_name"),
    )


def c5_date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 on every order: French date-times, two-digit years, month names, and a column of several shapes that begins with junk."""
    return _export_view(clean(date_extract(spark, sf_dir))[0])


def f1_numeric_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders of one client whose code is a double above 1e7."""
    return flt.apply_filters(coded_orders(spark, sf_dir), {"client": CLIENT_TEXT})


def f7_numeric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same code searched as the grid shows it."""
    return flt.search(coded_orders(spark, sf_dir), CLIENT_TEXT, ["client"])


QUERIES: dict[str, Query] = {
    "c5_date_shapes": c5_date_shapes,
    "f1_numeric_client": f1_numeric_client,
    "f7_numeric_search": f7_numeric_search,
    "k20_dashboard": k20_dashboard,
    "k13_k17_top5": k13_k17_top5,
    "k12_monthly_revenue": k12_monthly_revenue,
    "w1_month_deltas": w1_month_deltas,
    "m5_forecast": m5_forecast,
    "m_model_summary": m_model_summary,
    "m6_anomalies": m6_anomalies,
    "j2_chart_series": j2_chart_series,
    "m9_chart_summary": m9_chart_summary,
    "c10_clean_rows": c10_clean_rows,
    "q9_quality": q9_quality,
    "q15_column_profile": q15_column_profile,
    "q15_sales_profile": q15_sales_profile,
    "q7_sales_table_stats": q7_sales_table_stats,
    "q13_filter_options": q13_filter_options,
    "q14_date_range": q14_date_range,
    "c_clean_dashboard": c_clean_dashboard,
    "a1_insights": a1_insights,
    "a2_alerts": a2_alerts,
    "a7_alert_status_counts": a7_alert_status_counts,
    "n1_intents": n1_intents,
    "n_answer_table": n_answer_table,
    "n_answers": n_answers,
    "f_filtered_dashboard": f_filtered_dashboard,
    "f5_filter_counts": f5_filter_counts,
    "f7_search": f7_search,
    "f9_sorted_page": f9_sorted_page,
    "s10_resume": s10_resume,
    "s11_kpi_lines": s11_kpi_lines,
    "s11_text_lines": s11_text_lines,
    "s12_bars": s12_bars,
    "k10_k11_payments": k10_k11_payments,
    "k19_best_month": k19_best_month,
    "q12_head_sample": q12_head_sample,
    "x_text_formats": x_text_formats,
}
