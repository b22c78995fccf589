"""FIXTURES.md §1: the sample sales file, end to end."""
import pytest

from caisse.operators.cleaning import clean
from caisse.plans.sales import SalesAnalysis
from caisse.sources.files import read_sales
from tests.conftest import SAMPLE


@pytest.fixture(scope="module")
def analysis(spark):
    cleaned, _ = clean(read_sales(spark, SAMPLE))
    return SalesAnalysis(cleaned.drop("_row_id"))


def test_dashboard(analysis):
    d = analysis.dashboard().first().asDict()
    assert d["revenue_total"] == 572332.27
    assert (d["order_count"], d["average_basket"]) == (220, 2601.51)
    assert (d["client_count"], d["product_count"]) == (30, 5)
    assert d["margin_total"] == 0.0 and d["margin_rate"] == 0.0
    assert (d["paid_order_count"], d["unpaid_order_count"], d["unknown_payment_count"]) == (0, 0, 0)
    assert d["best_seller"] is None
    assert (d["best_growth_month"], d["best_growth_value"], d["best_growth_previous_month"]) == ("2024-03", 14876.1, "2024-02")


def test_tops(analysis):
    rows = {(r.dimension, r.rank): (r.name, r.value) for r in analysis.tops().collect()}
    assert [rows[("client", i)] for i in range(1, 6)] == [
        ("Client 3", 44087.43), ("Client 18", 32698.58), ("Client 26", 32614.28), ("Client 23", 31418.84), ("Client 10", 27113.23)]
    assert [rows[("product", i)] for i in range(1, 6)] == [
        ("Produit E", 137380.70), ("Produit B", 136642.83), ("Produit D", 116399.72), ("Produit C", 91004.38), ("Produit A", 90904.64)]
    assert [rows[("city", i)] for i in range(1, 6)] == [
        ("Paris", 134545.39), ("Lille", 127654.74), ("Lyon", 121929.92), ("Marseille", 95473.10), ("Bordeaux", 92729.12)]
    assert [rows[("channel", i)] for i in range(1, 5)] == [
        ("Direct", 197077.97), ("B2B", 140415.73), ("Web", 121455.59), ("Partenaire", 113382.98)]


def test_monthly_and_forecast(analysis):
    monthly = [tuple(r) for r in analysis.monthly().orderBy("month").collect()]
    assert monthly == [("2024-01", 70554.25), ("2024-02", 72144.42), ("2024-03", 87020.52), ("2024-04", 87212.06),
                       ("2024-05", 86438.47), ("2024-06", 74995.20), ("2024-07", 70210.17), ("2024-08", 23757.18)]
    m = analysis.model_row().first()
    assert m.slope == pytest.approx(-4453.574881, abs=1e-5)
    assert m.intercept == pytest.approx(87129.045833, abs=1e-5)
    assert m.mae == pytest.approx(14825.672113, abs=1e-5)
    assert m.mean == pytest.approx(71541.53375, abs=1e-6)
    assert (m.confidence_score, m.trend) == (79, "baisse")
    fc = [tuple(r) for r in analysis.forecast().orderBy("month").collect()]
    assert fc == [("2024-09", 51500.45, 36674.77, 66326.12, "forecast"), ("2024-10", 47046.87, 32221.20, 61872.54, "forecast"),
                  ("2024-11", 42593.30, 27767.62, 57418.97, "forecast")]
    an = analysis.anomalies().collect()
    assert [(r.month, r.z_score) for r in an] == [("2024-08", 2.47)]
    for r in fc:
        assert r[2] <= r[1] <= r[3]


def test_quality_and_alerts(spark, analysis):
    from caisse.operators import insights as ins
    from caisse.operators import profile as prof
    from caisse.operators.kpis import dashboard_fold

    raw = read_sales(spark, SAMPLE)
    cleaned, _ = clean(raw)
    q = prof.quality_report(raw, cleaned).first()
    assert (q.quality_score_before, q.quality_score_after) == (100.0, 100.0)
    summary = ins.merge_rows(dashboard_fold(analysis.measures, analysis.aggregate),
                             prof.missing_stats(analysis.df))
    assert [r.type for r in ins.alerts(summary).collect()] == ["baisse_ca"]
    texts = [r.text for r in ins.insights(summary).orderBy("position").collect()]
    assert texts[0] == "Le chiffre d'affaires total est de 572 332,27 €."
    assert texts[1] == "Vous avez 30 clients distincts dans la base actuelle."
    assert texts[2] == "Le client le plus important est Client 3 avec 44 087,43 € de chiffre d'affaires."
