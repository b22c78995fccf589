"""A sales table assembled from the TPC-H-like star schema.

One row per order line. Money is kept in exact decimals (prices carry two
decimals), so sums are exact and do not depend on the order Spark adds rows in.

Join plan, chosen for a fact table far larger than any dimension:

* ``orders`` is enriched first (``orders ⋈ customer ⋈ nation``): those joins
  run on the order grain, four times smaller than the line grain.
* ``lineitem`` then joins the enriched orders on ``orderkey`` (both sides are
  hash-partitioned on that key; with AQE the smaller side becomes a broadcast
  only when its runtime size is under the threshold).
* ``part`` / ``supplier`` are looked up on the line grain. They are left
  joins on unique keys, so a dimension nobody reads is left out of the plan
  altogether (``columns=`` below) without changing the row set.

No explicit broadcast hint is given for tables that grow with the scale factor;
Spark's size statistics and AQE decide. Only ``nation`` (25 rows by definition
of the schema) is hinted.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SALES_COLUMNS = [
    "id_commande",
    "date_vente",
    "chiffre_affaires",
    "cout_total",
    "client",
    "produit",
    "ville",
    "canal",
    "vendeur",
    "statut_paiement",
    "quantite",
]

# ---------------------------------------------------------------------------
# Order status -> payment status text.
# ---------------------------------------------------------------------------
PAYMENT_BY_STATUS = {"F": "Payé", "O": "En attente", "P": "À vérifier"}

# Decimal types: prices have two decimals; revenue = price * (1 - discount).
PRICE = "decimal(12,2)"
RATE = "decimal(4,2)"
COST_FACTOR = "0.6"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (read-only); the handle is kept per session so its file
    listing and footer reading happen once, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    handles = spark.__dict__.setdefault("_caisse_tables", {})
    if path not in handles:
        handles[path] = spark.read.parquet(path)
    return handles[path]


def payment_status(status: F.Column) -> F.Column:
    expr = F.lit(None).cast("string")
    out = None
    for code, text in PAYMENT_BY_STATUS.items():
        out = (F.when(status == code, F.lit(text)) if out is None else out.when(status == code, F.lit(text)))
    return out.otherwise(expr) if out is not None else expr


def sales_view(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The sales table; ``columns`` limits the output (and the joins) to what is read."""
    wanted = list(SALES_COLUMNS if columns is None else columns)
    unknown = set(wanted) - set(SALES_COLUMNS)
    if unknown:
        raise ValueError(f"unknown sales columns: {sorted(unknown)}")
    need = set(wanted)

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    )
    if need & {"client", "canal", "ville"}:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
        if "ville" in need:
            nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
            customer = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    df = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "inner")
    if "produit" in need:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        df = df.join(part, df.l_partkey == part.p_partkey, "left")
    if "vendeur" in need:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey, "left")

    price = F.col("l_extendedprice").cast(PRICE)
    exprs = {
        "id_commande": F.col("o_orderkey"),
        "date_vente": F.col("o_orderdate"),
        "chiffre_affaires": price * (F.lit(1) - F.col("l_discount").cast(RATE)),
        "cout_total": F.lit(COST_FACTOR).cast("decimal(2,1)") * price,
        "client": F.col("c_name") if "client" in need else None,
        "produit": F.col("p_brand") if "produit" in need else None,
        "ville": F.col("n_name") if "ville" in need else None,
        "canal": F.col("c_mktsegment") if "canal" in need else None,
        "vendeur": F.col("s_name") if "vendeur" in need else None,
        "statut_paiement": payment_status(F.col("o_orderstatus")),
        "quantite": F.col("l_quantity"),
    }
    return df.select(*[exprs[c].alias(c) for c in wanted])


# DuckDB text of the same view, used by the oracle SQL of the registered queries.
SALES_VIEW_SQL = """
SELECT o.o_orderkey AS id_commande,
       o.o_orderdate AS date_vente,
       CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS chiffre_affaires,
       CAST(0.6 AS DECIMAL(2,1)) * CAST(l.l_extendedprice AS DECIMAL(12,2)) AS cout_total,
       c.c_name AS client,
       p.p_brand AS produit,
       n.n_name AS ville,
       c.c_mktsegment AS canal,
       s.s_name AS vendeur,
       CASE o.o_orderstatus WHEN 'F' THEN 'Payé' WHEN 'O' THEN 'En attente' WHEN 'P' THEN 'À vérifier' END
           AS statut_paiement,
       l.l_quantity AS quantite
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""
