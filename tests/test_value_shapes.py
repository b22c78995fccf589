"""Date shapes, number texts and text order that a clean extract does not reach."""
import pytest

from caisse.functions.text import number_text
from caisse.operators.cleaning import MIXED, clean, column_pattern
from caisse.operators.filters import apply_filters, search, sort_rows


def dates(spark, values):
    rows = [(k, v, float(k)) for k, v in enumerate(values)]
    cleaned, report = clean(spark.createDataFrame(rows, "_row_id long, date_vente string, montant double"))
    out = [str(r.date_vente) for r in cleaned.orderBy("_row_id").collect()]
    report.raw_groups.unpersist()
    return out


@pytest.mark.parametrize("values,want", [
    (["15/03/2024 10:30", "02/01/2024 08:05"], ["2024-03-15 10:30:00", "2024-01-02 08:05:00"]),
    (["15/03/24", "01/12/99"], ["2024-03-15 00:00:00", "1999-12-01 00:00:00"]),
    (["15 Mar 2024", "1 Jan 2023"], ["2024-03-15 00:00:00", "2023-01-01 00:00:00"]),
    (["x", "16/04/2024", "03/04/2024", "2024-04-16", "April 16, 2024"],
     ["2024-04-16 00:00:00", "2024-04-16 00:00:00", "2024-03-04 00:00:00", "2024-04-16 00:00:00", "2024-04-16 00:00:00"]),
])
def test_date_shapes(spark, values, want):
    assert dates(spark, values) == want


def test_first_value_decides():
    assert column_pattern("x") == MIXED and column_pattern(None) is None
    assert column_pattern("2024-01-05T10:00:00") is None and column_pattern("2024/1/5 7:30") == "yyyy/M/d H:mm"


def test_number_text(spark):
    values = [12345678.0, 12345678.9, -2e7, 0.0005, 0.00012345, 1.5, 0.0, 1e15, 123456789012345.67]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(number_text(df.v)).collect()] == [repr(v) if v >= 1e-3 or v <= 0 else f"{v:.8f}".rstrip("0") for v in values]


def test_numeric_client_and_search(spark):
    df = spark.createDataFrame([(1, 12345678.0), (2, 12345678.9), (3, None)], "id_commande long, client double")
    assert [r.id_commande for r in apply_filters(df, {"client": "12345678.0"}).collect()] == [1]
    assert [r.id_commande for r in search(df, "12345678.9").collect()] == [2]


def test_text_order(spark):
    df = spark.createDataFrame([(v,) for v in ["a10", "été", "a9", "eté", "zoo", None, "a09b", "a9b"]], "v string")
    got = [r.v for r in sort_rows(df, "v").collect()]
    assert got[:1] == [None] and got.index("a9") < got.index("a10") and got.index("été") < got.index("zoo")
    assert [r.v for r in sort_rows(df, "v", ascending=False).collect()] == got[::-1]
