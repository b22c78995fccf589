"""Registered queries on missing values, medians, option lists, sorted pages and stored answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.operators import filters as flt
from caisse.operators import profile as prof
from caisse.operators.cleaning import clean
from caisse.operators.measures import as_text
from caisse.operators.stats import exact_medians
from caisse.plans.sales import SalesAnalysis, stored_answers
from caisse.session import scratch_folder
from caisse.sources.dirty import coded_orders
from caisse.sources.files import ROW_ID, read_sales
from caisse.sources.gaps import gappy_orders
from caisse.sources.starschema import sales_view, table


def c8_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of line items, and of amounts with infinities, NaN and a value on a third of the rows."""
    found = exact_medians(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"])
    found |= exact_medians(gappy_orders(spark, sf_dir), ["montant", "remise", "vide"])
    return spark.createDataFrame(sorted(found.items()), "column string, median double")


def _read_parquet_and_json(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'gaps')}/commandes.{fmt}"
    rows = gappy_orders(spark, sf_dir)
    if fmt == "json":
        rows = rows.select("id_commande", "actif", "remise", "libelle")
    rows.write.format(fmt).save(path)
    return read_sales(spark, path, fmt)


def c9_nan_bool_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + C7-C9 over a Parquet file: NaN counts as missing, truth values take their mode, a column of NaN goes."""
    return clean(_read_parquet_and_json(spark, sf_dir, "parquet"))[0].drop(ROW_ID)


def s2_json_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + C8, C9 over a JSON file."""
    return clean(_read_parquet_and_json(spark, sf_dir, "json"))[0].drop(ROW_ID)


def q13_numeric_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13 + F1: the offered texts of a numeric client code, and the rows that choosing each selects."""
    rows = coded_orders(spark, sf_dir)
    options = prof.filter_options(rows, {"clients": "client"})
    selected = rows.groupBy(as_text(rows, "client").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return options.join(selected, "value", "left").select("option", "position", "value", F.coalesce("rows", F.lit(0)).alias("rows"))


def f8_text_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: a page in the middle of the orders sorted by an accented label with numbers."""
    rows = gappy_orders(spark, sf_dir).select("id_commande", "libelle")
    ordered = flt.sorted_table(rows, "libelle", tie_break=["id_commande"])
    return ordered.page(max(1, flt.page_count(ordered.rows) // 2), flt.PAGE_SIZE).select(*ordered.columns)


def f9_far_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page two thirds down the sales, largest first, and the page after its last row."""
    rows = sales_view(spark, sf_dir)
    ordered = flt.sorted_table(rows, "chiffre_affaires", ascending=False, tie_break=list(rows.columns))
    far = ordered.page(max(1, flt.page_count(ordered.rows) * 2 // 3), flt.PAGE_SIZE)
    out, last = far.withColumn("page", F.lit("far")), far.tail(1)
    if last:
        out = out.unionByName(ordered.after(last[0], flt.PAGE_SIZE).withColumn("page", F.lit("next")))
    return out.select("page", "id_commande", F.col("chiffre_affaires").cast("double").alias("chiffre_affaires"), "client", "produit", "vendeur")


def n_stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 + N2-N6: the stored dashboard answers; rankings come afresh from rows that lack the city and the seller."""
    rows = sales_view(spark, sf_dir)
    return stored_answers(SalesAnalysis(rows).dashboard_record(), rows.drop("ville", "vendeur"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (c8_medians, c9_nan_bool_fill, s2_json_fill, q13_numeric_options, f8_text_sort, f9_far_page, n_stored_answers)
}
