import pytest

from caisse.plans.sales import SalesAnalysis


def analysis(spark, rows):
    df = spark.createDataFrame(rows, "date_vente timestamp, chiffre_affaires double")
    return SalesAnalysis(df)


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


def test_no_rows(spark):
    m = analysis(spark, []).model_row().first()
    assert (m.trend, m.confidence_score) == ("insufficient_data", 0)
    assert analysis(spark, []).historical().count() == 0


def test_one_row(spark):
    a = analysis(spark, [(ts("2024-01-05"), 10.0)])
    m = a.model_row().first()
    assert (m.trend, m.confidence_score) == ("insufficient_data", 0)
    assert a.historical().count() == 0


def test_two_months(spark):
    a = analysis(spark, [(ts("2024-01-05"), 10.0), (ts("2024-02-05"), 20.0)])
    m = a.model_row().first()
    assert (m.trend, m.confidence_score) == ("insufficient_data", 25)
    assert a.historical().count() == 2 and a.forecast().count() == 0


def test_constant_revenue_is_stable(spark):
    a = analysis(spark, [(ts(f"2024-0{i}-01"), 100.0) for i in range(1, 5)])
    m = a.model_row().first()
    assert m.trend == "stable" and m.std == 0 and m.confidence_score == 95
    assert a.anomalies().count() == 0
    assert [r.value for r in a.forecast().orderBy("month").collect()] == [100.0, 100.0, 100.0]
    assert [r.low for r in a.forecast().collect()] == [92.0, 92.0, 92.0]  # band = 8 % of the mean


def test_gap_uses_position_not_calendar(spark):
    a = analysis(spark, [(ts("2024-01-01"), 10.0), (ts("2024-03-01"), 20.0), (ts("2024-04-01"), 30.0)])
    m = a.model_row().first()
    assert m.slope == pytest.approx(10.0)
    assert [r.month for r in a.forecast().orderBy("month").collect()] == ["2024-05", "2024-06", "2024-07"]
    assert [r.value for r in a.forecast().orderBy("month").collect()] == [40.0, 50.0, 60.0]
    deltas = a.month_deltas().orderBy("month").collect()
    assert [(r.month, r.previous_month, r.delta) for r in deltas][1] == ("2024-03", "2024-01", 10.0)


def test_forecast_floor_at_zero(spark):
    a = analysis(spark, [(ts("2024-01-01"), 300.0), (ts("2024-02-01"), 200.0), (ts("2024-03-01"), 100.0)])
    fc = a.forecast().orderBy("month").collect()
    assert [r.value for r in fc] == [0.0, 0.0, 0.0] and all(r.low == 0.0 for r in fc)
