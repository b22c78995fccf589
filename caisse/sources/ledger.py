"""A sparse ledger of all orders: mostly empty columns, small amounts, a margin of its own.

It is the input on which the rules fire that the sales view never reaches:
direct margin, many missing values, little active clients, forecasts without
enough history. Every order is one row; the key arithmetic only decides which
value it carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.sources.starschema import table

COLUMNS = ["id_commande", "montant", "marge", "client", "canal", "vendeur", "commentaire"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id_commande"), (k % 2).alias("montant"), (k % 3).alias("marge"),
        F.col("o_custkey").cast("string").alias("client"),
        F.when(k % 10 == 0, F.col("o_orderstatus")).alias("canal"),
        F.when(k % 20 == 0, F.col("o_orderpriority")).alias("vendeur"),
        F.lit(None).cast("string").alias("commentaire"),
    )


def dated_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts with a date in one of two months."""
    month = F.when(F.col("id_commande") % 2 == 0, F.lit("2024-01-15")).otherwise(F.lit("2024-02-15"))
    return ledger(spark, sf_dir).select("id_commande", "montant", month.cast("date").alias("date_vente"))


LEDGER_SQL = """ledger AS (
    SELECT o_orderkey AS id_commande, o_orderkey % 2 AS montant, o_orderkey % 3 AS marge,
           CAST(o_custkey AS VARCHAR) AS client,
           CASE WHEN o_orderkey % 10 = 0 THEN o_orderstatus END AS canal,
           CASE WHEN o_orderkey % 20 = 0 THEN o_orderpriority END AS vendeur,
           CAST(NULL AS VARCHAR) AS commentaire
    FROM orders)"""
