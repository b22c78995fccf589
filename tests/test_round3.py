"""Medians by sketch, missing values, profiles by narrow pairs, fingerprints, sorted pages, stored answers."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from caisse.operators import filters as flt
from caisse.operators import profile as prof
from caisse.operators import ranking, stats
from caisse.operators.cleaning import clean
from caisse.operators.stats import exact_medians
from caisse.plans.sales import SalesAnalysis, stored_answers
from tests.conftest import SF001


def test_medians_with_infinities_nan_and_hot_values(spark):
    rng = random.Random(4)
    x = [rng.choice([math.inf, -math.inf, 7.0, 7.0, rng.uniform(-9, 9)]) for _ in range(5000)]
    rows = [(v, rng.choice([None, math.nan, 1.0, 2.0]), None, i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, `y.z` double, empty double, n long").repartition(5)
    got = exact_medians(df, ["x", "y.z", "empty", "n"])
    y = [r[1] for r in rows if r[1] is not None and not math.isnan(r[1])]
    assert got == {"x": float(np.median(x)), "y.z": float(np.median(y)), "empty": None, "n": 2499.5}
    assert exact_medians(df.filter("n < 0"), ["x"]) == {"x": None} and exact_medians(df, []) == {}
    assert exact_medians(df.filter("n = 3"), ["n"]) == {"n": 3.0}


def test_median_outside_its_bracket_is_looked_up_among_all_values(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    # Brackets that miss the median: above it, below it.
    got = exact_medians(df, ["x", "y"], {"x": (1000, 900.0, 950.0), "y": (1000, -990.0, -980.0)})
    assert got == {"x": 499.5, "y": -499.5}


def test_number_of_median_jobs_does_not_grow(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(stats, "ranked_values", lambda *a, f=ranking.ranked_values: calls.append(1) or f(*a))
    for n in (10, 100_000):
        df = spark.range(n).select((F.col("id") * 7919 % 99991).cast("double").alias("x"))
        assert exact_medians(df, ["x"])["x"] == float(np.median([i * 7919 % 99991 for i in range(n)]))
    assert len(calls) == 2


def test_clean_takes_nan_as_missing_and_fills_truth_values(spark):
    rows = [("a", 1.0, True, math.nan), ("b", math.nan, None, math.nan), ("c", 3.0, False, None), ("d", None, True, None)]
    df = spark.createDataFrame(rows, "nom string, montant double, actif boolean, vide double")
    cleaned, report = clean(df)
    assert report.dropped == ["vide"]
    assert sorted((r.nom, r.montant, r.actif) for r in cleaned.collect()) == [("a", 1.0, True), ("b", 2.0, True), ("c", 3.0, False), ("d", 2.0, True)]
    tied = clean(spark.createDataFrame([(1, True), (2, False), (3, None)], "n int, actif boolean"))[0]
    assert {r.n: r.actif for r in tied.collect()}[3] is False


def test_no_cached_rows_stay(spark):
    spark.catalog.clearCache()
    for name in ("c10_clean_rows", "q9_quality", "c5_date_shapes", "f9_far_page", "c8_medians"):
        E.queries()[name](spark, SF001).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_options_select_their_rows(spark):
    rows = spark.createDataFrame([(12345678.0,), (10000007.25,), (0.5,), (None,), (1e17,)], "client double")
    for r in prof.filter_options(rows, {"clients": "client"}).collect():
        assert flt.apply_filters(rows, {"client": r.value}).count() == 1, r.value


def test_profile_counts_values_as_grouping_does(spark):
    rows = [(0.0, b"a", [1], "x"), (-0.0, b"b", [1], None), (math.nan, b"a", [2], "x"), (None, None, None, "")]
    df = spark.createDataFrame(rows, "d double, b binary, a array<int>, s string")
    got = {r.column: (r.missing, r.unique, r.missing_rate) for r in prof.column_profile(df).collect()}
    assert got == {"d": (2, 1, 50.0), "b": (1, 2, 25.0), "a": (1, 2, 25.0), "s": (1, 2, 25.0)}
    empty = prof.column_profile(df.filter("s = 'no'")).collect()
    assert [(r.position, r.missing, r.unique, r.missing_rate) for r in sorted(empty, key=lambda r: r.position)] == [(i, 0, 0, None) for i in range(4)]
    assert {r.column: r.unique for r in prof.column_profile(df, "approx").collect()} == {"d": 1, "b": 2, "a": 2, "s": 2}


def test_duplicates_by_fingerprint(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), ("a", None, math.nan), ("a", None, math.nan), ("ab", "c", 1.0), ("a", "bc", 1.0)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    r = prof.table_stats(df).first()
    assert (r["rows"], r.duplicate_count, r.missing_total) == (7, 2, 7)
    wide = spark.range(50).select(*[F.when(F.col("id") % (i + 2) != 0, F.col("id") % 5).alias(f"c{i}") for i in range(70)])
    seen = [tuple(x) for x in wide.collect()]
    r = prof.table_stats(wide.union(wide)).first()
    assert (r["rows"], r.duplicate_count, r.missing_total) == (100, 100 - len(set(seen)), 2 * sum(v is None for x in seen for v in x))
    plan = prof.table_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_f0" in plan and "Aggregate [x" not in plan


@pytest.mark.parametrize("ascending", [True, False])
def test_sorted_table_pages(spark, ascending):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice([None, "a9", "a10", "été", "Ete"])) for i in range(503)]
    df = spark.createDataFrame(rows, "id int, v int, t string").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = flt.sorted_table(df, "v", ascending, tie_break=["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = [r.id for r in flt.sort_rows(df, "v", ascending, tie_break=["id"]).collect()]
    assert len(table.index) > 3 and table.rows == 503 and table.columns == ["id", "v", "t"]
    for number in (1, 7, 30, 50, 51, 52):
        page = table.page(number, 10).collect()
        assert [r.id for r in page] == want[(number - 1) * 10 : number * 10], number
        if page:
            at = (number - 1) * 10 + len(page)
            assert [r.id for r in table.after(page[-1], 10).collect()] == want[at : at + 10], number
    # A page reads the partitions that hold it, not those before.
    paths = table.page(30, 10).inputFiles()
    assert 0 < len(table.page(30, 10)._jdf.queryExecution().optimizedPlan().toString()) and len({p.split("_part=")[1].split("/")[0] for p in paths}) >= 1
    parts = [p for p, before, n in table.index if before < 300 and before + n > 290]
    assert len(parts) <= 2
    text = flt.sorted_table(df, "t", ascending, tie_break=["id"])
    assert [r.id for r in text.rank_range(100, 50).collect()] == [r.id for r in flt.sort_rows(df, "t", ascending, tie_break=["id"]).collect()][100:150]
    assert flt.sorted_table(df.filter("id < 0"), "v").page(1, 10).count() == 0
    assert [flt.page_count(n) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_stored_answers_fall_back_on_the_stored_lists(spark):
    rows = [("c1", "p1", "2024-01-05", 10.0), ("c2", "p1", "2024-02-05", 30.0), ("c1", "p2", "2024-03-05", 5.0)]
    df = spark.createDataFrame(rows, "client string, produit string, date string, montant double").withColumn("date", F.to_timestamp("date"))
    record = SalesAnalysis(df).dashboard_record()
    said = lambda cleaned: {r.intent: r.answer for r in stored_answers(record, cleaned).collect()}
    whole = said(df)
    assert "c2" in whole["actions"] and said(None) == whole and said(df.filter("montant < 0")) == whole
    # Fresh rows rank afresh; a column they lack comes from the stored list.
    fresh = said(df.filter("client = 'c1'").drop("produit"))
    assert "c2" not in fresh["actions"] and "p1" in fresh["actions"]
    assert fresh["revenue"] == whole["revenue"]
