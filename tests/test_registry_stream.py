import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from caisse.sources.files import ROW_ID, read_raw, read_sales
from caisse.sources.registry import Registry, with_company
from caisse.streaming.landing import start_import
from tests.conftest import SAMPLE


def test_import_history_guard_and_versions(spark, tmp_dir):
    reg = Registry(spark, f"{tmp_dir}/root")
    ds = reg.import_file(SAMPLE, user_id=1, company_id=7)
    hist = reg.history(7).collect()
    assert [(r.id, r.row_count, r.column_count) for r in hist] == [(ds, 220, 7)]
    dash = json.loads(reg.snapshot(ds, 7, "dashboard"))
    assert dash["revenue_total"] == 572332.27
    preds = json.loads(reg.snapshot(ds, 7, "predictions"))
    assert preds["trend"] == "baisse" and len(preds["forecast"]) == 3
    summary = json.loads(reg.snapshot(ds, 7, "summary"))
    assert summary["rows"] == 220 and len(summary["sample_rows"]) == 10
    assert summary["sample_rows"][0]["client"] == "Client 1"
    with pytest.raises(LookupError):
        reg.snapshot(ds, 8)  # another tenant
    filtered = reg.reanalyse(ds, 7, user_id=1, filters={"ville": "Paris"}).first()
    assert filtered.row_count < 220
    assert reg.table().count() == 1  # filtered analysis is not stored
    reg.reanalyse(ds, 7, user_id=1)
    assert reg.table().count() == 2 and reg.latest(7).first().version == 2
    companies = spark.createDataFrame([(7, "PME Sept")], "id long, name string")
    assert with_company(reg.latest(), companies).first().company_name == "PME Sept"
    assert reg.cleaned(ds, 7).count() == 220


def test_snapshot_keeps_the_whole_dashboard(spark, tmp_dir):
    reg = Registry(spark, f"{tmp_dir}/root")
    dash = json.loads(reg.snapshot(reg.import_file(SAMPLE, 1, 7), 7, "dashboard"))
    assert len(dash) == 22 and len(dash["monthly_evolution"]) > 1
    assert dash["best_city"] == dash["top_cities"][0] == dash["city_breakdown"][0]
    assert set(dash["best_monthly_growth"]) == {"month", "value", "previous_month"}


def test_default_root_outlives_the_application(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        assert Registry(spark).root == f"{base.rstrip('/')}/caisse-registry"
    else:
        with pytest.raises(ValueError, match="root folder"):
            Registry(spark)


def test_rows_of_several_files_keep_file_order(spark, tmp_dir):
    for name, values in (("a", [1, 2]), ("b", range(3, 2000))):
        with open(f"{tmp_dir}/{name}.csv", "w") as f:
            f.write("v\n" + "".join(f"{v}\n" for v in values))
    got = [r.v for r in read_sales(spark, tmp_dir, "csv").orderBy(ROW_ID).collect()]
    assert got == list(range(1, 2000))


def test_csv_is_split_unless_values_hold_line_breaks(spark, tmp_dir):
    path = f"{tmp_dir}/big.csv"
    with open(path, "w") as f:
        f.write("v\n" + "".join(f"{v}\n" for v in range(200_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        df = read_raw(spark, path)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 200_000
        with open(path, "a") as f:
            f.write('"a\n""b"\n')
        broken = read_raw(spark, path)
        assert broken.rdd.getNumPartitions() == 1 and broken.filter(F.col("v") == 'a\n"b').count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_unknown_format(spark, tmp_dir):
    reg = Registry(spark, f"{tmp_dir}/root")
    with pytest.raises(ValueError, match="Format de fichier non supporte"):
        reg.import_file(SAMPLE, 1, 1, original_name="ventes.xlsx")


def test_landing_stream_imports_new_files(spark, tmp_dir):
    landing = f"{tmp_dir}/landing"
    os.makedirs(landing)
    shutil.copy(SAMPLE, f"{landing}/a.csv")
    shutil.copy(SAMPLE, f"{landing}/b.csv")
    reg = Registry(spark, f"{tmp_dir}/root")
    q = start_import(spark, landing, reg, user_id=1, company_id=3, checkpoint=f"{tmp_dir}/ckpt", once=True)
    q.awaitTermination(300)
    assert sorted(r.original_name for r in reg.history(3).collect()) == ["a.csv", "b.csv"]
    # a restart with the same checkpoint does not import the same files again
    q = start_import(spark, landing, reg, user_id=1, company_id=3, checkpoint=f"{tmp_dir}/ckpt", once=True)
    q.awaitTermination(300)
    assert reg.history(3).count() == 2
