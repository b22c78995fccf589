import datetime as dt

import pytest

from caisse.operators import filters as flt
from caisse.operators.cleaning import clean
from caisse.plans.report import Report, bar_widths, write_csv
from caisse.plans.sales import SalesAnalysis
from caisse.sources.files import read_sales
from tests.conftest import SAMPLE


@pytest.fixture(scope="module")
def cleaned(spark):
    return clean(read_sales(spark, SAMPLE))[0]


def test_dimension_and_dates(spark, cleaned):
    f = flt.filter_map(ville="Paris", canal="Web", start_date="2024-02-01", end_date="2024-03-31", produit="")
    assert f == {"ville": "Paris", "canal": "Web", "start_date": "2024-02-01", "end_date": "2024-03-31"}
    out = flt.apply_filters(cleaned, f)
    rows = out.collect()
    assert rows and all(r.ville == "Paris" and r.canal == "Web" for r in rows)
    assert all(dt.datetime(2024, 2, 1) <= r.date_vente <= dt.datetime(2024, 3, 31) for r in rows)
    counts = flt.filter_counts(cleaned, f).first()
    assert counts.row_count == len(rows) and counts.total_row_count == 220


def test_invalid_start_gives_no_rows(cleaned):
    assert flt.apply_filters(cleaned, {"start_date": "pas une date"}).count() == 0


def test_end_date_excludes_later_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 10), 5.0), (dt.datetime(2024, 1, 31), 7.0)],
                               "date_vente timestamp, ca double")
    assert [r.ca for r in flt.apply_filters(df, {"end_date": "2024-01-31"}).collect()] == [7.0]


def test_filters_never_increase_rows(cleaned):
    n = cleaned.count()
    for f in [{"ville": "Lyon"}, {"client": "Client 3"}, {"start_date": "2024-05-01"}, {"vendeur": "x"}]:
        assert flt.apply_filters(cleaned, f).count() <= n


def test_low_data_flag(cleaned):
    low = flt.filter_counts(cleaned, {"client": "Client 3", "end_date": "2024-01-10"}).first()
    assert low.row_count <= 4 and (low.low_data == (low.row_count > 0))


def test_search_sort_page(cleaned):
    hits = flt.search(cleaned, "  LYON ")
    assert hits.count() == cleaned.filter("ville = 'Lyon'").count()
    assert flt.search(cleaned, "15/03/2024").count() == cleaned.filter("date_vente = '2024-03-15'").count()
    ordered = flt.sort_rows(cleaned, "chiffre_affaires", ascending=False, tie_break=["_row_id"])
    p1 = [r.chiffre_affaires for r in flt.page(ordered, 1).collect()]
    p2 = [r.chiffre_affaires for r in flt.page(ordered, 2).collect()]
    assert len(p1) == 10 and p1 == sorted(p1, reverse=True) and p1[-1] >= p2[0]


def test_report_tables(spark, cleaned, tmp_dir):
    rep = Report(cleaned, {"ville": "Paris"})
    resume = rep.resume().first()
    assert resume.lignes_totales == 220 and resume.lignes_filtrees == cleaned.filter("ville = 'Paris'").count()
    assert resume.colonnes == 7
    kpis = [tuple(r) for r in rep.kpi_lines().orderBy("position").collect()]
    assert kpis[0][1] == "Chiffre d'affaires" and kpis[0][2] == "134 545,39 EUR"
    assert kpis[2][2] == "0.0 %"
    paths = rep.write(tmp_dir)
    assert set(paths) == {"donnees_filtrees", "resume", "top_clients", "top_produits", "alertes"}
    assert spark.read.parquet(paths["top_clients"]).count() == 5
    write_csv(rep.filtered, f"{tmp_dir}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/csv")
    assert back.count() == resume.lignes_filtrees
    assert back.first().date_vente.count("-") == 2 and ":" not in back.first().date_vente


def test_empty_export_guard(cleaned):
    with pytest.raises(ValueError, match="Aucune donnée"):
        Report(cleaned, {"ville": "Nulle part"}).tables()


def test_bars(spark, cleaned):
    a = SalesAnalysis(cleaned.drop("_row_id"))
    from caisse.operators.kpis import top_k
    bars = {(r.dimension, r.rank): r for r in bar_widths(top_k(a.aggregate, 5, ["client", "product"])).collect()}
    assert bars[("client", 1)].width == 150.0
    assert bars[("client", 5)].width == pytest.approx(27113.23 / 44087.43 * 150)
    assert bars[("product", 1)].value_text == "137 380,70 EUR"
