"""Findings of round 3: what the cleaning and the registry read again is written once, by columns."""

from caisse.functions.text import unicode_strip
from caisse.operators import profile as prof
from caisse.operators.cleaning import clean
from caisse.plans.sales import SalesAnalysis
from caisse.session import RUNTIME_CONF, stored
from caisse.sources.files import cast_text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaned_columns_are_read_alone(spark):
    rows = [(i, f" v{i % 3} ", float(i) if i % 4 else None, "2024-01-0%d" % (i % 9 + 1) if i % 5 else "x") for i in range(40)]
    cleaned, report = clean(spark.createDataFrame(rows, "_row_id long, ville string, montant double, date_vente string"))
    assert report.raw_groups.inputFiles() and report.fills["montant"] == 20.0
    plan = _plan(cleaned.select("ville"))
    assert plan.count("string") and "struct<c1:string>" in plan
    got = {r._row_id: r for r in cleaned.collect()}
    assert got[4].ville == "v1" and got[4].montant == 20.0 and got[1].date_vente.day == 2 and got[0].date_vente is not None


def test_head_filters_by_the_last_id(spark):
    rows = [(None, "n"), (5, "e"), (3, "c"), (1, "a"), (None, "m"), (2, "b"), (2, "B")]
    df = spark.createDataFrame(rows, "_row_id long, v string")
    head = prof.head_sample(df, 4)
    assert "<= 2" in head._jdf.queryExecution().optimizedPlan().toString()
    assert [r._row_id for r in head.collect()] == [None, None, 1, 2]
    assert [r.v for r in prof.head_sample(df, 1).collect()][0] in ("n", "m") and prof.head_sample(df.limit(0), 3).count() == 0
    placed = spark.createDataFrame([(("f1", 0, 7), "b"), (("f0", 9, 1), "a"), (("f1", 4, 0), "c")], "_row_id struct<file:string,start:long,position:long>, v string")
    assert [r.v for r in prof.head_sample(placed, 2).collect()] == ["a", "b"]


def test_aggregate_is_written_once(spark):
    a = SalesAnalysis(spark.createDataFrame([("A", 1.5), ("B", 2.0), ("A", 3.0)], "client string, chiffre_affaires double"))
    plain = sorted(map(str, a.aggregate.collect()))
    assert a.persist_aggregate().inputFiles() and sorted(map(str, a.aggregate.collect())) == plain
    assert "Expand" not in _plan(a.aggregate)


def test_stored_keeps_names_and_types(spark):
    df = spark.createDataFrame([(1, 2, "x")], "a long, b long, `c d` string").toDF("a", "A", "c d")
    assert stored(df, "t").columns == ["a", "A", "c d"] and stored(df, "t").first() == (1, 2, "x")
    assert stored(spark.sql("select 1 as n, null as v"), "t").collect() == [(1, None)] and stored(df.limit(0), "t").count() == 0


def test_methods_stay_compilable(spark):
    assert RUNTIME_CONF["spark.sql.codegen.hugeMethodLimit"] == spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_strip_and_cast_on_odd_texts(spark):
    texts = ["  a ", "\xa0a", "a　", " \ta b\t ", "", "   ", "a", " \x1c a", "\xe9 ", " \xe9\xa0", "~", "! ", "\t", "a\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(unicode_strip("t").alias("s")).collect()] == [t.strip() for t in texts]
    numbers = {" 1.5\t": 1.5, "\x0b1\x0c": 1.0, "+inf": float("inf"), "\t-INF\n": float("-inf"), " Infinity ": float("inf"), "x": None, "": None}
    df = spark.createDataFrame([(t,) for t in numbers], "t string")
    assert [r.n for r in df.select(cast_text(df.t, "double").alias("n")).collect()] == [*numbers.values()]
