"""Plan-shape checks: the properties the design relies on at scale."""
import re

import pytest

import __spark_entry__ as E
from caisse.operators.stats import exact_medians
from tests.conftest import SF001


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return E.queries()


def test_dashboard_shuffles_fact_rows_once(spark, qs):
    plan = physical(qs["k20_dashboard"](spark, SF001))
    assert plan.count("Expand") == 1
    # the grouping-sets exchange appears once: one shuffle of the fact projection
    assert len(re.findall(r"Exchange hashpartitioning\(k_client", plan)) == 1
    assert "Window" not in plan


def test_top_k_has_partial_group_limit(spark, qs):
    plan = physical(qs["k13_k17_top5"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_reach_the_scans(spark, qs):
    plan = physical(qs["f_filtered_dashboard"](spark, SF001))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(n_name,NATION_7\)", plan)


def test_scans_read_only_needed_columns(spark, qs):
    plan = physical(qs["k12_monthly_revenue"](spark, SF001))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    # the monthly series reads no customer / part / supplier table at all
    assert not any("c_name" in s or "p_brand" in s or "s_name" in s for s in scans)
    assert any(s.startswith("l_orderkey") and "l_quantity" not in s for s in scans)


def test_no_window_over_the_fact_table_in_forecast_and_answers(spark, qs):
    for name in ["m5_forecast", "m_model_summary", "n_answer_table", "a2_alerts"]:
        plan = optimized(qs[name](spark, SF001))
        assert "Window [" not in plan or name == "n_answer_table" and "row_number" in plan, name


def test_medians_do_not_use_exact_percentile_aggregates(spark, monkeypatch):
    from pyspark.sql import DataFrame

    seen = []
    orig = DataFrame.agg

    def spy(self, *exprs):
        seen.extend(str(e) for e in exprs)
        return orig(self, *exprs)

    monkeypatch.setattr(DataFrame, "agg", spy)
    df = spark.range(10_000).selectExpr("cast(id % 997 as double) as x")
    import numpy as np

    expected = float(np.median([float(i % 997) for i in range(10_000)]))
    assert exact_medians(df, ["x"])["x"] == expected
    # The sketch only brackets; no aggregate buffers the values of a column in one task.
    assert not any(re.search(r"\b(percentile|median)\(", s) for s in seen)


def executed(df) -> str:
    """The final adaptive plan of a frame that has run; a reused exchange stands there without its subtree."""
    df.collect()
    plan = physical(df)
    assert "isFinalPlan=true" in plan
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["n_answers", "n_answer_table", "k20_full_dashboard", "s10_resume", "s11_kpi_lines", "s11_text_lines", "x_text_formats", "a1_insights"])
def test_one_line_item_scan_and_one_expand(spark, qs, name):
    plan = executed(qs[name](spark, SF001))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert len(re.findall(r"\bExpand \[", plan)) == 1


def test_report_tables_come_from_one_written_row(spark, monkeypatch):
    from caisse.plans import report
    from caisse.sources.starschema import sales_view

    built = []
    monkeypatch.setattr(report, "dashboard_fold", lambda m, agg, f=report.dashboard_fold: built.append(1) or f(m, agg))
    tables = report.Report(sales_view(spark, SF001), {"ville": "NATION_7"}).tables()
    assert built == [1]
    for name in ("resume", "top_clients", "top_produits", "alertes"):
        assert "FileScan" not in physical(tables[name]), name
