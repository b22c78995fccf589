import datetime as dt

import pytest
from pyspark.sql import functions as F

from caisse.operators import assistant as qa
from caisse.operators import insights as ins
from caisse.operators import profile as prof
from caisse.operators.kpis import dashboard_fold, top_k
from caisse.plans.sales import SalesAnalysis

README_QUESTIONS = {
    "Quels sont mes meilleurs clients ?": "top_client",
    "Quels sont mes meilleurs produits ?": "top_product",
    "Quel canal génère le plus de chiffre d'affaires ?": "top_channel",
    "Quelle ville est la plus performante ?": "top_city",
    "Quel vendeur est le plus performant ?": "top_seller",
    "Le chiffre d'affaires est-il en baisse ?": "decline",
    "Fais-moi un résumé du mois.": "summary",
    "Propose-moi 3 actions commerciales.": "actions",
    "Combien de clients ?": "client_count",
    "Et les produits ?": "product_count",
    "Bonjour": "help",
}


def test_router(spark):
    df = spark.createDataFrame([(q,) for q in README_QUESTIONS], "q string")
    got = {r.q: r.intent for r in df.select("q", qa.route(F.col("q")).alias("intent")).collect()}
    assert got == README_QUESTIONS


def _summary(spark, rows, extra_cols=""):
    df = spark.createDataFrame(rows, "date_vente timestamp, ca double, client string" + extra_cols)
    a = SalesAnalysis(df)
    return a, ins.merge_rows(dashboard_fold(a.measures, a.aggregate), prof.missing_stats(df))


def test_weak_client_and_quality_alerts(spark):
    rows = [(dt.datetime(2024, 1, 1), 50.0, "a"), (dt.datetime(2024, 2, 1), 500.0, "b"),
            (dt.datetime(2024, 2, 2), None, None), (None, None, "c")]
    a, summary = _summary(spark, rows)
    types = [r.type for r in ins.alerts(summary).orderBy("position").collect()]
    # 5 of 12 cells missing (> 20 %); last of top clients is 'a' with 50 < 100
    assert types == ["mauvaise_qualite", "client_inactif"]
    texts = [r.text for r in ins.insights(summary).collect()]
    assert texts[-1].startswith("La qualite des donnees")


def test_drop_alert_and_answers(spark):
    rows = [(dt.datetime(2024, 1, 1), 1000.0, "a"), (dt.datetime(2024, 2, 1), 800.0, "b")]
    a, summary = _summary(spark, rows)
    assert [r.type for r in ins.alerts(summary).collect()] == ["baisse_ca"]
    tops = top_k(a.aggregate, 5, round_values=False).agg(F.collect_list(F.struct("dimension", "rank", "name", "value")).alias("tops"))
    answers = {r.intent: r.answer for r in qa.answers(ins.merge_rows(summary, tops)).collect()}
    assert answers["decline"].splitlines()[0] == (
        "Le chiffre d'affaires du dernier mois est en baisse de 20,0 % par rapport au mois precedent.")
    assert answers["top_city"].startswith("Je n'ai pas trouvé les colonnes nécessaires pour classer les villes.")
    top = answers["top_client"].splitlines()
    assert top[0] == "Voici vos 5 meilleurs clients par chiffre d'affaires :"
    assert top[2:4] == ["1. a : 1 000,00 €", "2. b : 800,00 €"]
    assert top[5] == "Le premier client représente environ 55,6 % du chiffre d'affaires analysé."
    assert "- Meilleur mois : 2024-01 avec 1 000,00 €" in answers["summary"]
    assert "en priorité a," in answers["actions"]


def test_status_counts(spark):
    alerts = spark.createDataFrame([(1, "paiements", "warning", "lu", "m", "moyen"), (2, "x", "info", "nouveau", "m", "faible")],
                                   "position int, type string, severity string, status string, message string, level string")
    counts = {r.status: r["count"] for r in ins.status_counts(alerts).collect()}
    assert counts == {"nouveau": 1, "lu": 1, "résolu": 0}
    status = spark.createDataFrame([(2, "résolu")], "position int, status string")
    merged = {r.position: r.status for r in ins.alerts_with_status(alerts, status).collect()}
    assert merged == {1: "lu", 2: "résolu"}
