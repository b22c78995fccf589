"""Cases of the second round: order statistics of extreme values, long integers, import ids, NaN."""
import os
import shutil

import pytest
from pyspark.sql import functions as F

from caisse.operators.profile import type_label
from caisse.operators.stats import exact_medians
from caisse.sources.files import read_sales
from caisse.sources.registry import Registry
from caisse.streaming.landing import start_import
from tests.conftest import SAMPLE
from tests.helpers import write_csv


@pytest.mark.parametrize(
    "values",
    [
        [float("-inf")] * 40 + [1.0] * 70 + [float("inf")] * 90,
        [-1.7e308, 1.7e308] * 60 + [3.0],
        [2.0**k for k in range(-500, 500)],
        [7.0] * 400 + [float(k) for k in range(800)],
        [5e-324, 0.0, 1e-323] * 30,
    ],
)
def test_median_ends_on_extreme_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    s, n = sorted(values), len(values)
    want = s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
    assert exact_medians(df, ["x"])["x"] == want


def test_long_integers_and_odd_spaces_do_not_stop_the_read(spark):
    path = write_csv(["suivi", "qte"], [["12345678901234567890", "\n12"], ["22345678901234567890", "13"]])
    df = read_sales(spark, path)
    assert dict(df.dtypes)["suivi"] == "double"
    assert dict(df.dtypes)["qte"] == "bigint"
    assert sorted(r.qte for r in df.collect()) == [12, 13]


def test_nan_reads_as_null(spark, tmp_dir):
    spark.createDataFrame([(1.0,), (float("nan"),)], "montant double").write.parquet(f"{tmp_dir}/a.parquet")
    assert read_sales(spark, f"{tmp_dir}/a.parquet").filter(F.col("montant").isNull()).count() == 1


def test_two_landing_folders_of_one_company_keep_all_files(spark, tmp_dir):
    reg = Registry(spark, f"{tmp_dir}/root")
    for name in ("x", "y"):
        os.makedirs(f"{tmp_dir}/{name}")
        shutil.copy(SAMPLE, f"{tmp_dir}/{name}/{name}.csv")
        start_import(spark, f"{tmp_dir}/{name}", reg, 1, 3, checkpoint=f"{tmp_dir}/c{name}", once=True).awaitTermination(300)
    rows = reg.history(3).collect()
    assert sorted(r.original_name for r in rows) == ["x.csv", "y.csv"]
    assert all(reg.cleaned(r.id, 3).count() == 220 for r in rows)


def test_companies_may_share_an_id(spark, tmp_dir):
    reg = Registry(spark, f"{tmp_dir}/root")
    for company in (1, 2):
        reg.import_file(SAMPLE, 1, company, dataset_id=5)
    assert reg.latest().count() == 2
    reg.import_file(SAMPLE, 1, 1, dataset_id=5)  # again: nothing new
    assert reg.table().count() == 2


def test_import_releases_its_cache(spark, tmp_dir):
    spark.catalog.clearCache()
    Registry(spark, f"{tmp_dir}/root").import_file(SAMPLE, 1, 1)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_type_labels():
    assert [type_label(t) for t in ("datetime64[ns]", "int64", "float64", "object", "bool", "array<int>")] == ["Date", "Nombre entier", "Nombre décimal", "Texte", "Oui / Non", "array<int>"]
