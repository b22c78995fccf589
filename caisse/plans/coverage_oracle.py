"""DuckDB SQL equivalents of the queries in ``coverage``; texts are written out, not imported."""

from __future__ import annotations

from caisse.plans import oracle as o
from caisse.sources.ledger import COLUMNS, LEDGER_SQL

_SCALARS = [
    "revenue_total", "margin_total", "margin_rate", "client_count", "product_count", "order_count", "average_basket",
    "paid_order_count", "unpaid_order_count", "unknown_payment_count",
]
_LISTS = {"top_clients": "client", "top_products": "product", "top_cities": "city", "top_channels": "channel",
          "top_sellers": "seller", "city_breakdown": "city", "channel_breakdown": "channel"}
_NULL = "CAST(NULL AS VARCHAR)"

ORACLE_SQL: dict[str, str] = {}

_parts = [f"SELECT '{k}' AS key, 0 AS position, {_NULL} AS name, CAST({k} AS DOUBLE) AS value, {_NULL} AS previous FROM dash" for k in _SCALARS]
_parts.append(f"SELECT 'monthly_evolution', CAST(position AS INTEGER), month, value, {_NULL} FROM deltas")
_parts.append("SELECT 'best_monthly_growth', 0, best_growth_month, best_growth_value, best_growth_previous_month FROM dash")
_parts += [
    f"SELECT '{key}', CAST(rank - 1 AS INTEGER), name, CAST(round(s, 2) AS DOUBLE), {_NULL} FROM ranked WHERE rank <= 5 AND dimension = '{dim}'"
    for key, dim in _LISTS.items()
]
_parts += [f"SELECT 'best_{d}', 0, best_{d}, best_{d}_value, {_NULL} FROM dash" for d in ("city", "channel", "seller")]
ORACLE_SQL["k20_full_dashboard"] = o.dashboard_with(o.WITH_BASE) + "\n" + "\nUNION ALL\n".join(_parts)

ORACLE_SQL["s1_csv_scan"] = f"""WITH {o.DIRTY_SQL}
SELECT id_commande AS "ID Commande", date_vente AS "Date Vente", montant AS "Montant", client AS "Client", produit AS "Produit",
       statut_paiement AS "Statut paiement", vide AS "Vide", quantit AS "Quantité"
FROM raw"""

ORACLE_SQL["s3_registry"] = o.dashboard_with(f"WITH {o.CLEAN_CTES},\n{o.CLEAN_MEASURES}") + """
SELECT CAST(7 AS BIGINT) AS company_id, 2 AS version, 'extrait.csv' AS original_name, nrows AS row_count, 7 AS column_count,
       revenue_total, order_count, n_months AS months, CAST(22 AS BIGINT) AS "keys", CAST(0 AS BIGINT) AS seen_by_others
FROM dash"""

ORACLE_SQL["s8_csv_export"] = f"""{o.WITH_FILTERED}
SELECT CAST(id_commande AS VARCHAR) AS id_commande, strftime(date_vente, '%Y-%m-%d') AS date_vente,
       CAST(chiffre_affaires AS VARCHAR) AS chiffre_affaires, CAST(cout_total AS VARCHAR) AS cout_total, client, produit, ville,
       canal, vendeur, statut_paiement, CAST(quantite AS VARCHAR) AS quantite
FROM sales_f"""

_FIGURES = {
    "lignes_filtrees": "nrows", "lignes_totales": "(SELECT count(*) FROM sales)", "colonnes": "11", "chiffre_affaires": "revenue_total",
    "marge": "margin_total", "taux_marge": "margin_rate", "clients": "client_count", "produits": "product_count",
}
_tables = ["""SELECT 'donnees_filtrees' AS "table", 'lignes' AS name, CAST(nrows AS DOUBLE) AS value FROM dash"""]
_tables += [f"SELECT 'resume', '{k}', CAST({v} AS DOUBLE) FROM dash" for k, v in _FIGURES.items()]
_tables += [
    f"SELECT '{t}', name, CAST(round(s, 2) AS DOUBLE) FROM ranked WHERE rank <= 5 AND dimension = '{d}'"
    for t, d in (("top_clients", "client"), ("top_produits", "product"))
]
_tables.append("SELECT 'alertes', type || ' | ' || severity || ' | nouveau | ' || message, CAST(NULL AS DOUBLE) FROM items")
ORACLE_SQL["s9_report_tables"] = o.dashboard_with(o.WITH_FILTERED) + f""",
{o._F_STATS},
{o.ALERT_ITEMS}
""" + "\nUNION ALL\n".join(_tables)

ORACLE_SQL["s13_empty_export"] = f"""WITH {o.SALES}
SELECT c.selection, CASE WHEN (SELECT count(*) FROM sales WHERE ville = c.ville) > 0 THEN 'ok'
       ELSE 'Aucune donnée à exporter avec les filtres sélectionnés' END AS answer
FROM (VALUES ('vide', 'nulle part'), ('pleine', 'NATION_7')) AS c(selection, ville)"""

ORACLE_SQL["f4_filter_counts"] = f"""WITH {o.SALES},
n AS (SELECT count_if(ville = 'NATION_7' AND date_vente >= DATE '1996-01-01') AS k, count(*) AS total FROM sales)
SELECT k AS row_count, total AS total_row_count, k > 0 AND k <= greatest(3, total * 0.02) AS low_data FROM n"""

_MEASURES = o.measures_cte("ledger", "montant", margin="marge", client="client", channel="canal", seller="vendeur", order="id_commande")
_LEDGER = f"WITH {LEDGER_SQL},\n{_MEASURES}"
_STATS = o._stats("ledger", COLUMNS, "st")
_ALERTS = o.dashboard_with(_LEDGER) + f""",
{_STATS},
{o.ALERT_ITEMS},
alerts AS (
    SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, type, severity, message,
           CASE severity WHEN 'critical' THEN 'élevé' WHEN 'warning' THEN 'moyen' ELSE 'faible' END AS level FROM items),
seen AS (
    SELECT a.position, a.type, a.severity, coalesce(r.status, 'nouveau') AS status, a.message, a.level
    FROM alerts a LEFT JOIN (
        SELECT r_regionkey * 2 AS position, (['nouveau', 'lu', 'résolu'])[CAST(r_regionkey % 3 + 1 AS INTEGER)] AS status FROM region) r
    ON a.position = r.position)"""

# Without a payment column nothing is classified: the three counts are 0.
_COUNTS = ["paid_order_count", "unpaid_order_count", "unknown_payment_count"]
_PUBLIC = [f"coalesce({c}, 0) AS {c}" if c in _COUNTS else c for c in o.DASH_PUBLIC]
ORACLE_SQL["k2_direct_margin"] = o.dashboard_with(_LEDGER) + "\nSELECT " + ", ".join(_PUBLIC) + " FROM dash"
ORACLE_SQL["a1_sparse_insights"] = o.dashboard_with(_LEDGER) + f""",
{_STATS},
{o.INSIGHT_ITEMS}
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, text FROM ins"""
ORACLE_SQL["a3_a5_sparse_alerts"] = _ALERTS + "\nSELECT position, type, severity, 'nouveau' AS status, message, level FROM alerts"
ORACLE_SQL["j3_alert_status"] = _ALERTS + "\nSELECT position, type, severity, status, message, level FROM seen"
ORACLE_SQL["a7_mixed_status_counts"] = _ALERTS + """
SELECT s.status, count(seen.position) AS count
FROM (VALUES ('nouveau'), ('lu'), ('résolu')) AS s(status) LEFT JOIN seen ON s.status = seen.status
GROUP BY s.status"""

ORACLE_SQL["j1_company"] = """SELECT o_orderkey AS id, o_custkey AS company_id, c_name AS company_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

_NO_ROLES = "Données insuffisantes : une colonne date et une colonne chiffre d''affaires sont nécessaires."
ORACLE_SQL["m7_gates"] = f"""WITH n AS (
    SELECT 'sans date' AS input, 0 AS n_months, count(*) AS n FROM orders
    UNION ALL SELECT 'deux mois', count(DISTINCT o_orderkey % 2), count(*) FROM orders)
SELECT input, CAST(n_months AS INTEGER) AS n_months, 'insufficient_data' AS trend,
       CASE WHEN input = 'sans date' OR n < 2 THEN 0 ELSE 25 END AS confidence_score,
       CASE WHEN input = 'sans date' OR n < 2 THEN '{_NO_ROLES}'
            ELSE 'Données insuffisantes : au moins 3 mois d''historique sont recommandés pour une prévision fiable.' END AS message,
       CAST(NULL AS VARCHAR) AS model
FROM n"""

ORACLE_SQL["c12_forecast_revenue"] = f"""WITH {o.SALES}
SELECT CAST(round(sum(chiffre_affaires), 2) AS DOUBLE) AS revenue_total, 'insufficient_data' AS trend, 0 AS confidence_score,
       '{_NO_ROLES}' AS message
FROM sales"""
