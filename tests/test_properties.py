"""Property checks on small random sales files."""
import datetime as dt
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caisse.operators import filters as flt
from caisse.operators.cleaning import clean
from caisse.plans.sales import SalesAnalysis
from caisse.sources.files import read_sales
from tests.helpers import write_csv

cities = st.sampled_from(["Paris", "Lyon", "  Lille ", "", "None"])
amounts = st.one_of(st.floats(min_value=0, max_value=1e5, allow_nan=False).map(lambda x: f"{x:.2f}"), st.just("n/d"))
dates = st.one_of(
    st.dates(min_value=dt.date(2023, 1, 1), max_value=dt.date(2024, 12, 31)).map(lambda d: d.isoformat()), st.just("")
)
rows = st.lists(st.tuples(dates, amounts, cities, st.sampled_from(["Payé", "Impayé", "", "1"])), min_size=3, max_size=40)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(rows)
def test_cleaning_and_kpi_properties(spark, data):
    path = write_csv(["date_vente", "montant", "ville", "statut"], [list(r) for r in data])
    cleaned, _ = clean(read_sales(spark, path))
    # no null remains in the kept columns
    nulls = cleaned.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cleaned.columns]).first()
    assert all(v == 0 for v in nulls)
    a = SalesAnalysis(cleaned.drop("_row_id"))
    d = a.dashboard().first()
    monthly = [r.value for r in a.monthly().collect()]
    if "date_vente" in cleaned.columns and "montant" in cleaned.columns:
        # after filling, every row has a date and an amount: the months add up to the total
        assert math.isclose(sum(monthly), d.revenue_total, abs_tol=0.01 * max(1, len(monthly)))
    tops = a.tops().collect()
    for t in tops:
        assert t.value <= d.revenue_total + 0.01
    assert d.paid_order_count + d.unpaid_order_count + d.unknown_payment_count in (0, cleaned.count())
    for r in a.forecast().collect():
        assert r.low <= r.value <= r.high
    n = cleaned.count()
    for f in [{"ville": "Paris"}, {"start_date": "2024-01-01"}, {"end_date": "2023-06-30", "ville": "Lyon"}]:
        assert flt.apply_filters(cleaned, f).count() <= n
