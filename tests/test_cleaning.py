import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caisse.operators.cleaning import clean, guess_date_pattern
from caisse.operators.stats import exact_medians, modes_with_counts
from caisse.sources.files import read_sales
from tests.helpers import write_csv


def test_read_level_types(spark):
    path = write_csv(["a", "b", "c", "d", "e", "f"], [
        ["007", "1.5", "True", "x", "", "1"],
        ["2", "", "False", "y", "", "NA"],
        ["3", "2", "True", "z", "", "3"],
    ])
    df = read_sales(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "double",
                               "f": "double", "_row_id": "bigint"}
    assert [r.a for r in df.orderBy("_row_id").collect()] == [7, 2, 3]


def test_dedup_before_trim_and_parsed_equality(spark):
    path = write_csv(["Client", "Montant"], [["A", "1.0"], ["A", "1.00"], [" A", "1.0"], ["B", "2"]])
    cleaned, rep = clean(read_sales(spark, path))
    rows = sorted((r.client, r.montant) for r in cleaned.collect())
    # '1.0' and '1.00' are one parsed value -> one duplicate removed; ' A' is only equal after trimming
    assert rows == [("A", 1.0), ("A", 1.0), ("B", 2.0)]
    assert rep.rows_in == 3


def test_trim_nulls_median_mode_and_drop(spark):
    path = write_csv(["Ville", "Montant", "Vide", "Note"], [
        ["  Paris ", "10", "", "b"], ["Lyon", "n/d", "", "a"], ["None", "30", "", "b"],
        ["Paris", "20", "", "a"], ["nan", "40", "", ""],
    ])
    cleaned, rep = clean(read_sales(spark, path))
    assert "vide" not in cleaned.columns and rep.dropped == ["vide"]
    got = {r._row_id: r for r in cleaned.collect()}
    order = sorted(got)
    assert [got[i].ville for i in order] == ["Paris", "Lyon", "Paris", "Paris", "Paris"]
    assert [got[i].montant for i in order] == [10.0, 25.0, 30.0, 20.0, 40.0]  # median of 10,20,30,40
    assert [got[i].note for i in order] == ["b", "a", "b", "a", "a"]  # tie a/b -> smallest


def test_date_first_value_format(spark):
    path = write_csv(["date_vente", "ca"], [["15/01/2024", "1"], ["2024-02-01", "2"], ["16/02/2024", "3"], ["x", "4"]])
    cleaned, rep = clean(read_sales(spark, path))
    assert rep.date_patterns["date_vente"] == "d/M/yyyy"
    dates = [r.date_vente for r in cleaned.orderBy("_row_id").collect()]
    # the ISO value and 'x' do not follow the first value's format: null, then filled with the mode (ties: smallest)
    assert [d.strftime("%Y-%m-%d") for d in dates] == ["2024-01-15", "2024-01-15", "2024-02-16", "2024-01-15"]


def test_guess_patterns():
    assert guess_date_pattern("2024-01-05") == "yyyy-M-d"
    assert guess_date_pattern("01/05/2024") == "M/d/yyyy"
    assert guess_date_pattern("13/05/2024") == "d/M/yyyy"
    assert guess_date_pattern("2024-01-05 10:00:00") is None
    assert guess_date_pattern("x") is None


def test_majority_numeric(spark):
    path = write_csv(["code", "prix"], [["a1", "1"], ["b2", "2"], ["3", "x"], ["4", "y"], ["5", "5"]])
    cleaned, rep = clean(read_sales(spark, path))
    assert rep.numeric_casts == {"code": "double", "prix": "double"}
    assert dict(cleaned.dtypes)["code"] == "double"


def test_empty_table_drops_everything(spark):
    path = write_csv(["a", "b"], [])
    cleaned, rep = clean(read_sales(spark, path))
    assert [c for c in cleaned.columns if c != "_row_id"] == [] and cleaned.count() == 0


@pytest.mark.parametrize("n,hot", [(1, False), (2, False), (1001, False), (60_000, False), (60_001, True)])
def test_exact_median_matches_numpy(spark, n, hot):
    rnd = random.Random(n)
    vals = [rnd.uniform(-1e6, 1e6) for _ in range(n)]
    if hot:
        vals = [42.5 if i % 3 == 0 else v for i, v in enumerate(vals)]
    nulls = [None] * 7
    df = spark.createDataFrame([(v, float(i % 5)) for i, v in enumerate(vals + nulls)], "x double, y double")
    got = exact_medians(df, ["x", "y"])
    assert got["x"] == pytest.approx(float(np.median(vals)), rel=0, abs=1e-9)
    assert got["y"] == float(np.median([float(i % 5) for i in range(n + 7)]))


def test_modes_ties_smallest(spark):
    df = spark.createDataFrame([("b", None), ("a", 2), ("b", 2), ("a", 1), (None, 1)], "s string, n int")
    assert {c: m for c, (m, _) in modes_with_counts(df, ["s", "n"]).items()} == {"s": "a", "n": "1"}


def test_no_null_left(spark):
    path = write_csv(["date", "montant", "client"], [["2024-01-01", "1", ""], ["", "", "x"], ["2024-01-03", "3", "y"]])
    cleaned, _ = clean(read_sales(spark, path))
    row = cleaned.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cleaned.columns]).first()
    assert all(v == 0 for v in row)


def test_frame_without_row_id(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 3.0)], "Client string, Montant double").coalesce(1)
    cleaned, rep = clean(df)
    assert sorted((r.client, r.montant) for r in cleaned.collect()) == [("a", 1.0), ("a", 3.0)]
