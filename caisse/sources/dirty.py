"""A dirty sales extract derived from the driver tables (cleaning fixture).

Every line of ``lineitem ⋈ orders ⋈ customer ⋈ part`` becomes one text row,
as a CSV export would present it, with deterministic dirt: an unparsable date
on some orders, a non-numeric amount on others, padded / missing client names,
mixed payment words, an empty column, and a second copy of the lines of some
orders (exact duplicates). ``_row_id`` is derived from the keys, so "file
order" (first value, keep-first) is the same in Spark and in the SQL oracle.
The whole table is used; the key arithmetic only decides *which* value a row
carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.sources.files import ROW_ID, apply_read_types, null_tokens
from caisse.sources.starschema import table

# ---------------------------------------------------------------------------
# Header of the extract and the payment words cycled through.
# ---------------------------------------------------------------------------
HEADER = ["ID Commande", "Date Vente", "Montant", "Client", "Produit", "Statut paiement", "Vide", "Quantité"]
PAYMENT_CYCLE = ["Payé", "Impayé", "En attente", "réglé", "", "1"]
DATE_DIRT_EVERY, AMOUNT_DIRT_EVERY, CLIENT_DIRT_EVERY, COPY_EVERY = 19, 7, 11, 23
COPY_OFFSET = 1_000_000_000_000


def dirty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract as text columns (before any reading rule)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(p, li.l_partkey == p.p_partkey)
    )
    pay = F.element_at(F.array(*[F.lit(w) for w in PAYMENT_CYCLE]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 6 + 1).cast("int"))
    rows = j.select(
        F.col("o_orderkey").cast("string").alias(HEADER[0]),
        F.when(F.col("l_orderkey") % DATE_DIRT_EVERY == 0, F.lit("x"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias(HEADER[1]),
        F.when(F.col("l_orderkey") % AMOUNT_DIRT_EVERY == 0, F.lit("n/d"))
        .otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias(HEADER[2]),
        F.when(F.col("c_custkey") % CLIENT_DIRT_EVERY == 0,
               F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.lit("None")))
        .otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).alias(HEADER[3]),
        F.col("p_brand").alias(HEADER[4]),
        pay.alias(HEADER[5]),
        F.lit(None).cast("string").alias(HEADER[6]),
        F.col("l_quantity").cast("string").alias(HEADER[7]),
        # Lines of every COPY_EVERY-th order appear twice: the copy comes after
        # all original rows in file order. One pass, no second join.
        F.explode(
            F.when(F.col("l_orderkey") % COPY_EVERY == 0, F.array(F.lit(0), F.lit(COPY_OFFSET))).otherwise(F.array(F.lit(0)))
        ).alias("_copy"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("_base"),
    )
    return rows.withColumn(ROW_ID, F.col("_base") + F.col("_copy")).drop("_copy", "_base")


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extract as a default reader returns it: NA tokens null, then typed."""
    text = dirty_text(spark, sf_dir)
    nulled = text.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if c != ROW_ID else F.col(c) for c in text.columns])
    return apply_read_types(nulled)


#: Rows whose mixed date is junk, and the codes of ``coded_orders``.
JUNK_EVERY, CODE_OFFSET, CLIENT_TEXT = 19, 10_000_000.25, "10000007.25"


def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its date in four text columns; file order begins with days above 12 and junk in the last column."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    junk, late = k % JUNK_EVERY == 0, F.dayofmonth(d) > 12
    mixed = F.when(junk, F.lit("x")).when(k % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 3 == 1, F.date_format(d, "d MMM yyyy"))
    return table(spark, sf_dir, "orders").select(
        k.alias("id_commande"),
        F.concat(F.date_format(d, "dd/MM/yyyy "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0")).alias("date_heure"),
        F.date_format(d, "dd/MM/yy").alias("date_courte"),
        F.date_format(d, "d MMM yyyy").alias("date_mois"),
        mixed.otherwise(F.date_format(d, "yyyy/M/d")).alias("date_mixte"),
        (F.when(junk & late, 0).when(late, 1).otherwise(2) * COPY_OFFSET + k).alias(ROW_ID),
    )


def coded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose client is a number above 1e7."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id_commande"), (F.col("o_custkey") + F.lit(CODE_OFFSET)).alias("client"))


DATE_SHAPES_SQL = f"""WITH o AS (
    SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders),
m AS (
    SELECT k, d, CASE WHEN k % {JUNK_EVERY} = 0 THEN NULL
                      WHEN k % 3 = 0 AND day(d) <= 12 THEN make_timestamp(year(d), day(d), month(d), 0, 0, 0.0)
                      ELSE d END AS x FROM o),
fill AS (SELECT x FROM m WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)
SELECT k AS id_commande,
       strftime(d + to_hours(CAST(k % 24 AS INTEGER)) + to_minutes(CAST(k % 60 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS date_heure,
       strftime(d, '%Y-%m-%dT%H:%M:%S') AS date_courte,
       strftime(d, '%Y-%m-%dT%H:%M:%S') AS date_mois,
       strftime(coalesce(x, (SELECT x FROM fill)), '%Y-%m-%dT%H:%M:%S') AS date_mixte
FROM m"""
CODED_SQL = f"SELECT o_orderkey AS id_commande, o_custkey + CAST({CODE_OFFSET} AS DOUBLE) AS client FROM orders WHERE o_custkey = 7"


def _sql_text() -> str:
    cycle = ", ".join("'" + w + "'" for w in PAYMENT_CYCLE)
    return f"""
    SELECT CAST(o.o_orderkey AS VARCHAR) AS id_commande,
           CASE WHEN l.l_orderkey % {DATE_DIRT_EVERY} = 0 THEN 'x' ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS date_vente,
           CASE WHEN l.l_orderkey % {AMOUNT_DIRT_EVERY} = 0 THEN 'n/d'
                ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END AS montant,
           CASE WHEN c.c_custkey % {CLIENT_DIRT_EVERY} = 0 THEN (CASE WHEN l.l_linenumber % 2 = 0 THEN '' ELSE 'None' END)
                ELSE '  ' || c.c_name || ' ' END AS client,
           p.p_brand AS produit,
           ([{cycle}])[CAST((l.l_orderkey + l.l_linenumber) % 6 + 1 AS INTEGER)] AS statut_paiement,
           CAST(NULL AS VARCHAR) AS vide,
           CAST(l.l_quantity AS VARCHAR) AS quantit,
           l.l_orderkey * 100 + l.l_linenumber AS row_id,
           l.l_orderkey AS okey
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN part p ON l.l_partkey = p.p_partkey"""


# DuckDB text of the extract after the reading rules, with normalised names:
# NA tokens ('' and 'None' occur) -> NULL; id and quantity typed as numbers.
DIRTY_SQL = f"""raw_text AS ({_sql_text()}),
raw_rows AS (
    SELECT * EXCLUDE (okey) FROM raw_text
    UNION ALL
    SELECT * EXCLUDE (okey, row_id), row_id + {COPY_OFFSET} AS row_id FROM raw_text WHERE okey % {COPY_EVERY} = 0),
raw AS (
    SELECT CAST(id_commande AS BIGINT) AS id_commande,
           date_vente, montant,
           CASE WHEN client IN ('', 'None') THEN NULL ELSE client END AS client,
           produit,
           CASE WHEN statut_paiement = '' THEN NULL ELSE statut_paiement END AS statut_paiement,
           CAST(NULL AS DOUBLE) AS vide,
           CAST(quantit AS DOUBLE) AS quantit,
           row_id
    FROM raw_rows)"""
