"""Degenerate inputs through the whole analysis: nothing may raise."""
from pyspark.sql import functions as F

from caisse.operators import assistant as qa
from caisse.operators import insights as ins
from caisse.operators import profile as prof
from caisse.operators.cleaning import clean
from caisse.operators.kpis import dashboard_fold, top_k
from caisse.plans.sales import SalesAnalysis
from caisse.sources.files import read_sales
from tests.helpers import write_csv


def everything(spark, df):
    a = SalesAnalysis(df)
    summary = ins.merge_rows(dashboard_fold(a.measures, a.aggregate), prof.missing_stats(df))
    tops = top_k(a.aggregate, 5, round_values=False).agg(F.collect_list(F.struct("dimension", "rank", "name", "value")).alias("tops"))
    out = {
        "dashboard": a.dashboard().collect(),
        "tops": a.tops().collect(),
        "monthly": a.monthly().collect(),
        "model": a.model_row().collect(),
        "forecast": a.forecast().collect(),
        "anomalies": a.anomalies().collect(),
        "series": a.chart_series().collect(),
        "chart": a.chart_summary().collect(),
        "insights": ins.insights(summary).collect(),
        "alerts": ins.alerts(summary).collect(),
        "answers": {r.intent: r.answer for r in qa.answers(ins.merge_rows(summary, tops)).collect()},
        "profile": prof.column_profile(df).collect(),
        "stats": prof.table_stats(df).collect(),
    }
    return out


def test_empty_sales_table(spark):
    df = spark.createDataFrame([], "date_vente timestamp, chiffre_affaires double, client string, statut_paiement string")
    out = everything(spark, df)
    d = out["dashboard"][0]
    assert (d.revenue_total, d.order_count, d.client_count, d.average_basket) == (0.0, 0, 0, 0.0)
    assert out["tops"] == [] and out["monthly"] == [] and out["forecast"] == []
    assert out["model"][0].trend == "insufficient_data" and out["model"][0].confidence_score == 0
    assert out["insights"] == [] and out["alerts"] == []
    assert out["answers"]["decline"].startswith("Je n'ai pas assez d'historique")
    assert out["answers"]["top_client"].startswith("Je n'ai pas trouvé les colonnes")


def test_table_without_roles(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "foo string, bar long")
    out = everything(spark, df)
    d = out["dashboard"][0]
    assert (d.revenue_total, d.order_count, d.product_count) == (0.0, 2, 0)
    assert out["model"][0].message.startswith("Données insuffisantes : une colonne date")
    assert out["answers"]["summary"].count("Non disponible") == 4


def test_cleaned_empty_file(spark):
    cleaned, _ = clean(read_sales(spark, write_csv(["date", "ca"], [])))
    out = everything(spark, cleaned.drop("_row_id"))
    assert out["dashboard"][0].revenue_total == 0.0 and out["profile"] == []
    assert out["stats"][0].rows == 0


def test_negative_and_single_month(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), -50.0, "a"), (dt.datetime(2024, 1, 2), 20.0, "b")],
                               "date_vente timestamp, ca double, client string")
    out = everything(spark, df)
    assert out["dashboard"][0].revenue_total == -30.0
    assert out["model"][0].confidence_score == 25 and out["forecast"] == []
    assert [r.type for r in out["alerts"]] == ["client_inactif"]
