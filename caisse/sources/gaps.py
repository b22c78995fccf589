"""Orders with gaps: NaN, null and infinite amounts, truth values, decimals and accented labels.

It is the input of the rules for missing values and of text sorting. Every
order is one row; the key arithmetic only decides which value it carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.sources.starschema import table

#: Value of every third amount.
HOT = 42.5
#: Words of the labels, before a number that is not padded.
WORDS = ["ete", "été", "Ete", "etage", "étage", "a", "zone", "Zone"]


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    amount = (F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(None)).when(k % 97 == 0, F.lit(float("inf")))
              .when(k % 89 == 0, F.lit(float("-inf"))).when(k % 3 == 0, F.lit(HOT)).otherwise(price.cast("double")))
    return table(spark, sf_dir, "orders").select(
        k.alias("id_commande"),
        amount.alias("montant"),
        F.when(k % 7 != 0, k % 5 < 3).alias("actif"),
        F.when(k % 17 != 0, F.round(price.cast("double"), 2).cast("decimal(14,2)")).alias("remise"),
        F.lit(float("nan")).alias("vide"),
        F.concat(F.element_at(F.array(*[F.lit(w) for w in WORDS]), (k % 8 + 1).cast("int")), (k % 30).cast("string")).alias("libelle"),
    )


_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"

GAPS_SQL = f"""gaps AS (
    SELECT o_orderkey AS id_commande,
           CASE WHEN o_orderkey % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN NULL
                WHEN o_orderkey % 97 = 0 THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 89 = 0 THEN CAST('-inf' AS DOUBLE)
                WHEN o_orderkey % 3 = 0 THEN {HOT} ELSE CAST(o_totalprice AS DOUBLE) END AS montant,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 < 3 END AS actif,
           CASE WHEN o_orderkey % 17 <> 0 THEN CAST(round(CAST(o_totalprice AS DOUBLE), 2) AS DECIMAL(14, 2)) END AS remise,
           {_WORDS_SQL}[o_orderkey % 8 + 1] || (o_orderkey % 30) AS libelle
    FROM orders)"""
