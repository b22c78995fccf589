"""Registered queries of files, registry, exports and of the rules that need an input of their own.

Files and registries are written to a new folder under the shared checkpoint
folder, from rows that Spark derives from the driver tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.operators import filters as flt
from caisse.operators import insights as ins
from caisse.operators.kpis import TOP_LISTS, dashboard_fold
from caisse.plans.report import Report, write_csv
from caisse.plans.sales import SalesAnalysis
from caisse.session import scratch_folder
from caisse.sources.dirty import dirty_text
from caisse.sources.files import ROW_ID, read_sales
from caisse.sources.ledger import dated_ledger, ledger
from caisse.sources.registry import Registry, with_company
from caisse.sources.starschema import sales_view, table

COMPANY, OTHER_COMPANY, USER = 7, 8, 1
SELECTION = {"ville": "NATION_7", "start_date": "1996-01-01", "end_date": "1999-06-30"}
SCALARS = [
    "revenue_total", "margin_total", "margin_rate", "client_count", "product_count", "order_count", "average_basket",
    "paid_order_count", "unpaid_order_count", "unknown_payment_count",
]


def k20_full_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 22 keys as (key, position, name, value, previous); a key without a value keeps one row of nulls."""
    record = SalesAnalysis(sales_view(spark, sf_dir)).dashboard_record()
    entry = "key string, name string, value double, previous string"

    def one(key: str, name=None, value=None, previous=None):
        parts = [F.lit(key), *[F.lit(None) if x is None else x for x in (name, value, previous)]]
        return F.array(F.struct(*parts).cast(f"struct<{entry.replace(' ', ':').replace(',:', ',')}>"))

    def many(key: str, name: str):
        items = F.transform(F.col(key), lambda x: one(key, x[name], x["value"])[0])
        return F.when(F.size(key) > 0, items).otherwise(one(key))

    growth = F.col("best_monthly_growth")
    keys = [one(k, value=F.col(k)) for k in SCALARS]
    keys += [many("monthly_evolution", "month"), one("best_monthly_growth", growth["month"], growth["value"], growth["previous_month"])]
    keys += [many(k, "name") for k in [*TOP_LISTS.values(), "city_breakdown", "channel_breakdown"]]
    keys += [one(k, F.col(k)["name"], F.col(k)["value"]) for k in ("best_city", "best_channel", "best_seller")]
    rows = record.select(F.explode(F.array(*keys)).alias("items")).select(F.posexplode("items").alias("position", "x"))
    return rows.select("x.key", "position", "x.name", "x.value", "x.previous")


def _extract_csv(spark: SparkSession, sf_dir: str) -> str:
    """The dirty extract as a folder of CSV files; its path."""
    path = f"{scratch_folder(spark, 'extract')}/extrait.csv"
    rows = dirty_text(spark, sf_dir).drop(ROW_ID)
    rows.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def s1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract written as CSV, read back and typed."""
    return read_sales(spark, _extract_csv(spark, sf_dir)).drop(ROW_ID)


def s3_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract imported and analysed again; its history as the company and another one see it."""
    registry = Registry(spark, scratch_folder(spark, "registry"))
    dataset = registry.import_file(_extract_csv(spark, sf_dir), USER, COMPANY)
    registry.reanalyse(dataset, COMPANY, USER)
    dashboard = json.loads(registry.snapshot(dataset, COMPANY, "dashboard"))
    current = registry.record(dataset, COMPANY).select("id", "version", "company_id")
    return registry.history(COMPANY).join(current, "id").select(
        "company_id", "version", "original_name", "row_count", "column_count",
        F.lit(float(dashboard["revenue_total"])).alias("revenue_total"), F.lit(dashboard["order_count"]).cast("long").alias("order_count"),
        F.lit(len(dashboard["monthly_evolution"])).cast("long").alias("months"), F.lit(len(dashboard)).cast("long").alias("keys"),
        F.lit(registry.record(dataset, OTHER_COMPANY).count()).cast("long").alias("seen_by_others"),
    )


def s8_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected rows exported as CSV; every field as the file's text."""
    path = f"{scratch_folder(spark, 'export')}/lignes.csv"
    write_csv(flt.apply_filters(sales_view(spark, sf_dir), SELECTION), path)
    return spark.read.option("header", True).csv(path)


def s9_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report tables written and read back as (table, name, value)."""
    paths = Report(sales_view(spark, sf_dir), SELECTION).write(scratch_folder(spark, "report"))
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    resume = read["resume"]
    figures = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in resume.columns])
    parts = [
        read["donnees_filtrees"].agg(F.lit("donnees_filtrees").alias("table"), F.lit("lignes").alias("name"), F.count(F.lit(1)).cast("double").alias("value")),
        resume.select(F.lit("resume").alias("table"), F.inline(figures)),
        *[read[t].select(F.lit(t).alias("table"), "name", "value") for t in ("top_clients", "top_produits")],
        read["alertes"].select(F.lit("alertes").alias("table"), F.concat_ws(" | ", "type", "severity", "status", "message").alias("name"), F.lit(None).cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def s13_empty_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard's answer for a selection without rows and for one with rows."""
    sales, said = sales_view(spark, sf_dir), []
    for case, ville in (("vide", "nulle part"), ("pleine", SELECTION["ville"])):
        try:
            flt.ensure_not_empty(flt.apply_filters(sales, {"ville": ville}))
            said.append((case, "ok"))
        except ValueError as e:
            said.append((case, str(e)))
    return spark.createDataFrame(said, "selection string, answer string")


def f4_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """empty values leave the filter map."""
    chosen = flt.filter_map(ville=SELECTION["ville"], canal="", client=None, start_date=SELECTION["start_date"], page="3")
    return flt.filter_counts(sales_view(spark, sf_dir), chosen)


def _ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = SalesAnalysis(ledger(spark, sf_dir))
    return dashboard_fold(a.measures, a.aggregate)


def k2_direct_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SalesAnalysis(ledger(spark, sf_dir)).dashboard()


def a1_sparse_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.insights(_ledger_summary(spark, sf_dir))


def a3_a5_sparse_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.alerts(_ledger_summary(spark, sf_dir))


def _alerts_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's alerts; statuses are known for the even positions, dealt by region."""
    key = F.col("r_regionkey")
    words = F.array(*[F.lit(s) for s in ins.STATUS_VALUES])
    status = table(spark, sf_dir, "region").select((key * 2).cast("int").alias("position"), F.element_at(words, (key % 3 + 1).cast("int")).alias("status"))
    return ins.alerts_with_status(ins.alerts(_ledger_summary(spark, sf_dir)), status)


def j3_alert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts_seen(spark, sf_dir)


def a7_mixed_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.status_counts(_alerts_seen(spark, sf_dir))


def j1_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a record of its customer's company."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return with_company(records, companies).select("id", "company_id", "company_name")


def m7_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the ledger without a date, and with two months."""
    cases = {"sans date": ledger(spark, sf_dir), "deux mois": dated_ledger(spark, sf_dir)}
    rows = [
        SalesAnalysis(df).model_row().select(F.lit(name).alias("input"), "n_months", "trend", "confidence_score", "message", "model")
        for name, df in cases.items()
    ]
    return rows[0].unionByName(rows[1])


def c12_forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose only amount is called ``total``: the dashboard reads it, the forecast does not."""
    a = SalesAnalysis(sales_view(spark, sf_dir, ["date_vente", "chiffre_affaires"]).withColumnRenamed("chiffre_affaires", "total"))
    model = a.model_row().select("trend", "confidence_score", "message")
    return ins.merge_rows(a.dashboard().select("revenue_total"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        k20_full_dashboard, s1_csv_scan, s3_registry, s8_csv_export, s9_report_tables, s13_empty_export, f4_filter_counts,
        k2_direct_margin, a1_sparse_insights, a3_a5_sparse_alerts, j3_alert_status, a7_mixed_status_counts, j1_company,
        m7_gates, c12_forecast_revenue,
    )
}
