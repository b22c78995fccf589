"""DuckDB SQL equivalents of the registered queries (correctness oracle).

Each string runs on DuckDB against the driver tables registered as views.
They restate the semantics independently of the Spark plans: plain GROUP BY
per dimension, window functions, ``regr_slope`` for the fit.
"""

from __future__ import annotations

from caisse.functions.payment import PAID_WORDS, UNPAID_WORDS
from caisse.sources.dirty import CODED_SQL, DATE_SHAPES_SQL, DIRTY_SQL
from caisse.sources.files import FLOAT_PATTERN
from caisse.sources.starschema import SALES_VIEW_SQL

def pay_class(col: str | None) -> str:
    if not col:
        return "CAST(NULL AS VARCHAR)"
    norm = f"lower(trim(strip_accents(coalesce(CAST({col} AS VARCHAR), ''))))"
    return (
        f"CASE WHEN regexp_matches({norm}, '{'|'.join(UNPAID_WORDS)}') THEN 'unpaid' "
        f"WHEN regexp_matches({norm}, '{'|'.join(PAID_WORDS)}') THEN 'paid' ELSE 'unknown' END"
    )


def measures_cte(source: str, rev: str | None, cost: str | None = None, margin: str | None = None,
                 client: str | None = None, product: str | None = None, city: str | None = None,
                 channel: str | None = None, seller: str | None = None, order: str | None = None,
                 date: str | None = None, payment: str | None = None) -> str:
    """``m`` CTE with the standard measure names over ``source``."""
    def c(x: str | None, t: str = "VARCHAR") -> str:
        return f"CAST({x} AS {t})" if x else f"CAST(NULL AS {t})"
    if margin:
        margin_expr = f"coalesce({margin}, 0)"
    elif cost and rev:
        margin_expr = f"coalesce({rev}, 0) - coalesce({cost}, 0)"
    else:
        margin_expr = "0"
    month = f"CASE WHEN {rev} IS NOT NULL THEN strftime({date}, '%Y-%m') END" if rev and date else "CAST(NULL AS VARCHAR)"
    return f"""m AS (
    SELECT {c(client)} AS client, {c(product)} AS produit, {c(city)} AS ville, {c(channel)} AS canal,
           {c(seller)} AS vendeur, {order if order else 'CAST(NULL AS BIGINT)'} AS id_commande,
           {rev if rev else 'CAST(NULL AS DOUBLE)'} AS rev, {margin_expr} AS margin_part,
           {month} AS month,
           {pay_class(payment)} AS pay
    FROM {source})"""


SALES = f"sales AS ({SALES_VIEW_SQL})"
MEASURES = measures_cte("sales", "chiffre_affaires", cost="cout_total", client="client", product="produit",
                        city="ville", channel="canal", seller="vendeur", order="id_commande", date="date_vente",
                        payment="statut_paiement")
DIM_SUMS = """dims AS (
    SELECT 'client' AS dimension, client AS name, sum(rev) AS s FROM m WHERE client IS NOT NULL AND rev IS NOT NULL GROUP BY client
    UNION ALL SELECT 'product', produit, sum(rev) FROM m WHERE produit IS NOT NULL AND rev IS NOT NULL GROUP BY produit
    UNION ALL SELECT 'city', ville, sum(rev) FROM m WHERE ville IS NOT NULL AND rev IS NOT NULL GROUP BY ville
    UNION ALL SELECT 'channel', canal, sum(rev) FROM m WHERE canal IS NOT NULL AND rev IS NOT NULL GROUP BY canal
    UNION ALL SELECT 'seller', vendeur, sum(rev) FROM m WHERE vendeur IS NOT NULL AND rev IS NOT NULL GROUP BY vendeur)"""
RANKED = """ranked AS (
    SELECT dimension, name, s, row_number() OVER (PARTITION BY dimension ORDER BY s DESC, name ASC) AS rank FROM dims)"""
MONTHS = """months AS (
    SELECT month, sum(rev) AS s FROM m WHERE month IS NOT NULL AND rev IS NOT NULL GROUP BY month)"""
DELTAS = """deltas AS (
    SELECT month, CAST(round(s, 2) AS DOUBLE) AS value,
           row_number() OVER (ORDER BY month) - 1 AS position,
           lag(month) OVER (ORDER BY month) AS previous_month,
           round(CAST(round(s, 2) AS DOUBLE) - lag(CAST(round(s, 2) AS DOUBLE)) OVER (ORDER BY month), 2) AS delta
    FROM months)"""
FIT = """pts AS (
    SELECT month, CAST(s AS DOUBLE) AS y, CAST(round(s, 2) AS DOUBLE) AS value,
           row_number() OVER (ORDER BY month) - 1 AS pos FROM months),
fit0 AS (
    SELECT count(*) AS n, regr_slope(y, pos) AS slope, regr_intercept(y, pos) AS intercept,
           avg(y) AS ybar, stddev_pop(y) AS std, max(month) AS last_month FROM pts),
fit AS (
    SELECT fit0.*, CASE WHEN ybar = 0 THEN 1.0 ELSE ybar END AS mean,
           (SELECT avg(abs(pts.y - (fit0.intercept + fit0.slope * pts.pos))) FROM pts) AS mae,
           (SELECT count(*) FROM m) AS src_rows
    FROM fit0),
model AS (
    SELECT *, greatest(mae, mean * 0.08) AS band FROM fit WHERE n >= 3 AND src_rows >= 2)"""

WITH_BASE = f"WITH {SALES},\n{MEASURES}"

ORACLE_SQL: dict[str, str] = {}

DASH_PUBLIC = [
    "revenue_total", "margin_total", "margin_rate", "client_count", "product_count", "order_count",
    "average_basket", "paid_order_count", "unpaid_order_count", "unknown_payment_count",
    "best_city", "best_city_value", "best_channel", "best_channel_value", "best_seller", "best_seller_value",
    "best_growth_month", "best_growth_value", "best_growth_previous_month",
]


def dashboard_with(with_base: str, has_order: bool = True) -> str:
    """CTEs ending with ``dash``: one row with the dashboard and helper fields."""
    orders = "count(DISTINCT id_commande)" if has_order else "count(*)"
    best_cols = ",\n           ".join(
        f"max(CASE WHEN dimension = '{d}' THEN name END) AS best_{d},\n"
        f"           max(CASE WHEN dimension = '{d}' THEN CAST(round(s, 2) AS DOUBLE) END) AS best_{d}_value"
        for d in ("city", "channel", "seller", "client", "product")
    )
    return f"""{with_base},
{DIM_SUMS},
{RANKED},
{MONTHS},
{DELTAS},
tot AS (
    SELECT coalesce(sum(rev), 0) AS revenue,
           coalesce(sum(margin_part), 0) AS margin,
           count(DISTINCT client) AS clients, count(DISTINCT produit) AS products,
           {orders} AS orders, count(*) AS nrows,
           count_if(pay = 'paid') AS paid, count_if(pay = 'unpaid') AS unpaid, count_if(pay = 'unknown') AS unknown
    FROM m),
best AS (
    SELECT {best_cols}
    FROM ranked WHERE rank = 1),
listed AS (
    SELECT count(*) AS clients_listed, count_if(round(s, 2) >= 100) AS clients_listed_over
    FROM ranked WHERE dimension = 'client' AND rank <= 5),
growth AS (
    SELECT month, delta, previous_month FROM deltas WHERE delta IS NOT NULL
    ORDER BY delta DESC, position ASC LIMIT 1),
lastm AS (
    SELECT max(CASE WHEN rk = 1 THEN value END) AS last_value, max(CASE WHEN rk = 2 THEN value END) AS prev_value,
           max(CASE WHEN rk = 1 THEN month END) AS last_month, max(CASE WHEN rk = 2 THEN month END) AS prev_month,
           count(*) AS n_months
    FROM (SELECT month, value, row_number() OVER (ORDER BY month DESC) AS rk FROM deltas)),
bestm AS (
    SELECT month AS best_month, value AS best_month_value FROM deltas ORDER BY value DESC, month ASC LIMIT 1),
dash AS (
    SELECT CAST(round(revenue, 2) AS DOUBLE) AS revenue_total,
           CAST(round(margin, 2) AS DOUBLE) AS margin_total,
           CASE WHEN revenue <> 0 THEN round(CAST(margin AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 1) ELSE 0.0 END
               AS margin_rate,
           clients AS client_count, products AS product_count, orders AS order_count,
           CASE WHEN revenue <> 0 THEN round(CAST(revenue AS DOUBLE) / CAST(greatest(1, orders) AS DOUBLE), 2) ELSE 0.0 END
               AS average_basket,
           paid AS paid_order_count, unpaid AS unpaid_order_count, unknown AS unknown_payment_count,
           best.*,
           growth.month AS best_growth_month, growth.delta AS best_growth_value,
           growth.previous_month AS best_growth_previous_month,
           listed.*, lastm.*, bestm.*, nrows
    FROM tot CROSS JOIN best CROSS JOIN listed CROSS JOIN lastm LEFT JOIN growth ON TRUE LEFT JOIN bestm ON TRUE)"""


def dashboard_sql(with_base: str, has_order: bool = True) -> str:
    return dashboard_with(with_base, has_order) + "\nSELECT " + ", ".join(DASH_PUBLIC) + " FROM dash"


ORACLE_SQL["k20_dashboard"] = dashboard_sql(WITH_BASE)

ORACLE_SQL["k13_k17_top5"] = f"""{WITH_BASE},
{DIM_SUMS},
{RANKED}
SELECT dimension, CAST(rank AS INTEGER) AS rank, name, CAST(round(s, 2) AS DOUBLE) AS value
FROM ranked WHERE rank <= 5"""

ORACLE_SQL["k12_monthly_revenue"] = f"""{WITH_BASE},
{MONTHS}
SELECT month, CAST(round(s, 2) AS DOUBLE) AS value FROM months"""

ORACLE_SQL["w1_month_deltas"] = f"""{WITH_BASE},
{MONTHS},
{DELTAS}
SELECT month, value, CAST(position AS INTEGER) AS position, previous_month, delta FROM deltas"""

ORACLE_SQL["m5_forecast"] = f"""{WITH_BASE},
{MONTHS},
{FIT}
SELECT strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS month,
       round(greatest(0, intercept + slope * (n + h - 1)), 2) AS value,
       round(greatest(0, greatest(0, intercept + slope * (n + h - 1)) - band), 2) AS low,
       round(greatest(0, intercept + slope * (n + h - 1)) + band, 2) AS high,
       'forecast' AS kind
FROM model CROSS JOIN range(1, 4) AS t(h)"""

ORACLE_SQL["m_model_summary"] = f"""{WITH_BASE},
{MONTHS},
{FIT}
SELECT n AS n_months,
       CASE WHEN n >= 3 THEN round(slope, 2) END AS slope,
       CASE WHEN n >= 3 THEN round(intercept, 2) END AS intercept,
       CASE WHEN n >= 3 THEN round(mae, 2) END AS mae,
       CASE WHEN n >= 3 THEN round(mean, 2) END AS mean,
       CASE WHEN n >= 3 THEN round(greatest(mae, mean * 0.08), 2) END AS "interval",
       last_month,
       CASE WHEN n < 3 THEN 'insufficient_data'
            WHEN slope > mean * 0.03 THEN 'hausse' WHEN slope < -mean * 0.03 THEN 'baisse' ELSE 'stable' END AS trend,
       CAST(CASE WHEN n < 3 THEN 25 ELSE greatest(35, least(95, round(100 - mae / mean * 100, 0))) END AS INTEGER)
           AS confidence_score,
       CASE WHEN n < 3 THEN 'Données insuffisantes : au moins 3 mois d''historique sont recommandés pour une prévision fiable.'
            ELSE 'Prévision calculée à partir de l''historique mensuel disponible.' END AS message,
       CASE WHEN n >= 3 THEN 'linear_regression' END AS model
FROM fit"""

ORACLE_SQL["m6_anomalies"] = f"""{WITH_BASE},
{MONTHS},
{FIT}
SELECT p.month, p.value, round(abs(p.y - model.mean) / model.std, 2) AS z_score,
       CASE WHEN p.y > model.mean
            THEN 'Ce mois est au-dessus de la moyenne mensuelle avec un écart statistique élevé.'
            ELSE 'Ce mois est en dessous de la moyenne mensuelle avec un écart statistique élevé.' END AS reason
FROM pts p CROSS JOIN model
WHERE model.std > 0 AND abs(p.y - model.mean) / model.std >= 1.5"""

ORACLE_SQL["j2_chart_series"] = f"""{WITH_BASE},
{MONTHS},
{FIT}
SELECT month, 'historical' AS kind, value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM pts
UNION ALL
SELECT strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m'),
       'forecast',
       round(greatest(0, intercept + slope * (n + h - 1)), 2),
       round(greatest(0, greatest(0, intercept + slope * (n + h - 1)) - band), 2),
       round(greatest(0, intercept + slope * (n + h - 1)) + band, 2)
FROM model CROSS JOIN range(1, 4) AS t(h)"""

ORACLE_SQL["m9_chart_summary"] = f"""{WITH_BASE},
{MONTHS},
{FIT}
SELECT round(greatest(0, intercept + slope * n), 2) AS next_month_value,
       (SELECT count(*) FROM pts WHERE std > 0 AND abs(pts.y - model.mean) / model.std >= 1.5) AS anomaly_count,
       CASE WHEN slope > mean * 0.03 THEN 'Hausse' WHEN slope < -mean * 0.03 THEN 'Baisse' ELSE 'Stable' END
           AS trend_label,
       CASE WHEN slope > mean * 0.03 THEN 'hausse' WHEN slope < -mean * 0.03 THEN 'baisse' ELSE 'stable' END AS trend,
       CAST(greatest(35, least(95, round(100 - mae / mean * 100, 0))) AS INTEGER) AS confidence_score
FROM model"""


# ---------------------------------------------------------------------------
# Cleaning of the dirty extract
# ---------------------------------------------------------------------------
def _trimmed(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('nan', 'None', '') THEN NULL ELSE trim({c}) END AS {c}"


def _mode(c: str) -> str:
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS k FROM conv WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY k DESC, v ASC LIMIT 1)")


CLEAN_CTES = f"""{DIRTY_SQL},
dedup AS (
    SELECT id_commande, date_vente, montant, client, produit, statut_paiement, vide, quantit, min(row_id) AS row_id
    FROM raw GROUP BY ALL),
trimmed AS (
    SELECT id_commande, {_trimmed('date_vente')}, {_trimmed('montant')}, {_trimmed('client')}, {_trimmed('produit')},
           {_trimmed('statut_paiement')}, quantit, row_id
    FROM dedup),
conv AS (
    SELECT id_commande, try_strptime(date_vente, '%Y-%m-%d') AS date_vente,
           CASE WHEN regexp_matches(montant, '{FLOAT_PATTERN}') THEN CAST(montant AS DOUBLE) END AS montant,
           client, produit, statut_paiement, quantit, row_id
    FROM trimmed),
med AS (
    SELECT avg(montant) AS v FROM (
        SELECT montant, row_number() OVER (ORDER BY montant) AS r, count(*) OVER () AS n
        FROM conv WHERE montant IS NOT NULL)
    WHERE r = (n + 1) // 2 OR r = n // 2 + 1),
cleaned AS (
    SELECT id_commande,
           coalesce(date_vente, {_mode('date_vente')}) AS date_vente,
           coalesce(montant, (SELECT v FROM med)) AS montant,
           coalesce(client, {_mode('client')}) AS client,
           coalesce(produit, {_mode('produit')}) AS produit,
           coalesce(statut_paiement, {_mode('statut_paiement')}) AS statut_paiement,
           quantit, row_id
    FROM conv)"""

CLEAN_COLS = ["id_commande", "date_vente", "montant", "client", "produit", "statut_paiement", "quantit"]
RAW_COLS = ["id_commande", "date_vente", "montant", "client", "produit", "statut_paiement", "vide", "quantit"]

ORACLE_SQL["c10_clean_rows"] = f"""WITH {CLEAN_CTES}
SELECT id_commande, strftime(date_vente, '%Y-%m-%dT%H:%M:%S') AS date_vente, montant, client, produit,
       statut_paiement, quantit
FROM cleaned"""


ORACLE_SQL["c5_date_shapes"] = DATE_SHAPES_SQL
ORACLE_SQL["f1_numeric_client"] = CODED_SQL
ORACLE_SQL["f7_numeric_search"] = CODED_SQL


def _stats(src: str, cols: list[str], prefix: str) -> str:
    nulls = " + ".join(f"count_if({c} IS NULL)" for c in cols)
    ratio = " + ".join(f"count_if({c} IS NULL) / count(*)" for c in cols)
    col_list = ", ".join(cols)
    return f"""{prefix} AS (
    SELECT count(*) AS n, {nulls} AS missing_total, ({ratio}) / {len(cols)} AS missing_ratio,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT {col_list} FROM {src})) AS dups
    FROM {src})"""


ORACLE_SQL["q9_quality"] = f"""WITH {CLEAN_CTES},
{_stats('raw', RAW_COLS, 'b')},
{_stats('cleaned', CLEAN_COLS, 'a')}
SELECT b.n AS rows_before, {len(RAW_COLS)} AS columns_before, b.missing_total AS missing_total_before,
       b.dups AS duplicate_count_before,
       greatest(0.0, least(100.0, round(100 - b.missing_ratio * 55 - b.dups / greatest(1, b.n) * 35, 1))) AS quality_score_before,
       a.n AS row_count, {len(CLEAN_COLS)} AS column_count, a.missing_total AS missing_total, a.dups AS duplicate_count,
       greatest(0.0, least(100.0, round(100 - a.missing_ratio * 55 - a.dups / greatest(1, a.n) * 35, 1))) AS quality_score_after
FROM b CROSS JOIN a"""


def profile_sql(with_clause: str, src: str, cols: list[tuple[str, str, str]]) -> str:
    """Column profile: one SELECT per column (name, dtype string, label)."""
    parts = []
    for i, (c, dtype, label) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, '{dtype}' AS type, '{label}' AS type_label, "
            f"count_if({c} IS NULL) AS missing, round(count_if({c} IS NULL) / count(*) * 100, 1) AS missing_rate, "
            f"count(DISTINCT {c}) AS \"unique\" FROM {src}"
        )
    return f"{with_clause}\n" + "\nUNION ALL\n".join(parts)


_CLEAN_TYPES = [
    ("id_commande", "int64", "Nombre entier"), ("date_vente", "datetime64[ns]", "Date"),
    ("montant", "float64", "Nombre décimal"), ("client", "object", "Texte"), ("produit", "object", "Texte"),
    ("statut_paiement", "object", "Texte"), ("quantit", "float64", "Nombre décimal"),
]
ORACLE_SQL["q15_column_profile"] = profile_sql(f"WITH {CLEAN_CTES}", "cleaned", _CLEAN_TYPES)

_SALES_TYPES = [
    ("id_commande", "int64", "Nombre entier"), ("date_vente", "datetime64[ns]", "Date"),
    ("chiffre_affaires", "float64", "Nombre décimal"), ("cout_total", "float64", "Nombre décimal"),
    ("client", "object", "Texte"), ("produit", "object", "Texte"), ("ville", "object", "Texte"),
    ("canal", "object", "Texte"), ("vendeur", "object", "Texte"), ("statut_paiement", "object", "Texte"),
    ("quantite", "float64", "Nombre décimal"),
]
ORACLE_SQL["q15_sales_profile"] = profile_sql(f"WITH {SALES}", "sales", _SALES_TYPES)

_SALES_COLS = [c for c, _t, _l in _SALES_TYPES]
ORACLE_SQL["q7_sales_table_stats"] = f"""WITH {SALES},
{_stats('sales', _SALES_COLS, 's')}
SELECT n AS "rows", {len(_SALES_COLS)} AS "columns", missing_total, missing_ratio, dups AS duplicate_count,
       dups / greatest(1, n) AS duplicate_ratio
FROM s"""

ORACLE_SQL["q13_filter_options"] = f"""WITH {SALES},
opts AS (
    SELECT DISTINCT 'villes' AS option, CAST(ville AS VARCHAR) AS value FROM sales WHERE ville IS NOT NULL
    UNION SELECT DISTINCT 'canaux', CAST(canal AS VARCHAR) FROM sales WHERE canal IS NOT NULL
    UNION SELECT DISTINCT 'clients', CAST(client AS VARCHAR) FROM sales WHERE client IS NOT NULL
    UNION SELECT DISTINCT 'produits', CAST(produit AS VARCHAR) FROM sales WHERE produit IS NOT NULL
    UNION SELECT DISTINCT 'vendeurs', CAST(vendeur AS VARCHAR) FROM sales WHERE vendeur IS NOT NULL)
SELECT option, CAST(position AS INTEGER) AS position, value FROM (
    SELECT option, value, row_number() OVER (PARTITION BY option ORDER BY value) AS position FROM opts)
WHERE position <= 150"""

ORACLE_SQL["q14_date_range"] = f"""WITH {SALES}
SELECT strftime(min(date_vente), '%Y-%m-%d') AS date_min, strftime(max(date_vente), '%Y-%m-%d') AS date_max FROM sales"""

CLEAN_MEASURES = measures_cte("cleaned", "montant", client="client", product="produit", order="id_commande",
                              date="date_vente", payment="statut_paiement")
ORACLE_SQL["c_clean_dashboard"] = dashboard_sql(f"WITH {CLEAN_CTES},\n{CLEAN_MEASURES}")


# ---------------------------------------------------------------------------
# Insights, alerts, questions
# ---------------------------------------------------------------------------
def money_sql(x: str) -> str:
    return f"(translate(format('{{:,.2f}}', CAST(coalesce({x}, 0) AS DOUBLE)), ',.', ' ,') || ' €')"


def pct_sql(x: str) -> str:
    return f"(translate(format('{{:,.1f}}', CAST(coalesce({x}, 0) AS DOUBLE)), '.,', ',') || ' %')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SALES_STATS = _stats("sales", _SALES_COLS, "st")

INSIGHT_ITEMS = f"""ins AS (
    SELECT 1 AS k, {q("Le chiffre d'affaires total est de ")} || {money_sql('revenue_total')} || '.' AS text FROM dash WHERE revenue_total <> 0
    UNION ALL SELECT 2, {q('La marge totale est de ')} || {money_sql('margin_total')} || ', soit un taux de marge de '
        || format('{{:.1f}}', margin_rate) || ' %.' FROM dash WHERE margin_total <> 0
    UNION ALL SELECT 3, 'Vous avez ' || client_count || ' clients distincts dans la base actuelle.' FROM dash WHERE client_count <> 0
    UNION ALL SELECT 4, 'Le client le plus important est ' || best_client || ' avec ' || {money_sql('best_client_value')}
        || {q(" de chiffre d'affaires.")} FROM dash WHERE best_client IS NOT NULL
    UNION ALL SELECT 5, 'Le produit le plus performant est ' || best_product || ' avec ' || {money_sql('best_product_value')}
        || {q(" de chiffre d'affaires.")} FROM dash WHERE best_product IS NOT NULL
    UNION ALL SELECT 6, 'Le canal le plus performant est ' || best_channel || ' avec ' || {money_sql('best_channel_value')} || '.'
        FROM dash WHERE best_channel IS NOT NULL
    UNION ALL SELECT 7, 'La qualite des donnees merite une attention particuliere a cause des valeurs manquantes.'
        FROM st WHERE n > 0 AND missing_ratio > 0.1)"""

ORACLE_SQL["a1_insights"] = dashboard_with(WITH_BASE) + f""",
{SALES_STATS},
{INSIGHT_ITEMS}
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, text FROM ins"""

ALERT_ITEMS = """items AS (
    SELECT 1 AS k, 'baisse_ca' AS type, 'warning' AS severity,
           'Le chiffre d''affaires a baisse par rapport au mois precedent.' AS message
    FROM dash WHERE n_months >= 2 AND last_value < prev_value * 0.9
    UNION ALL SELECT 2, 'mauvaise_qualite', 'critical', 'Le jeu de donnees presente trop de valeurs manquantes.'
    FROM st WHERE missing_ratio > 0.2
    UNION ALL SELECT 3, 'paiements', 'warning', unpaid_order_count || ' commandes semblent non payees ou en attente.'
    FROM dash WHERE unpaid_order_count > 0
    UNION ALL SELECT 4, 'client_inactif', 'info', 'Un ou plusieurs clients semblent peu actifs sur cette periode.'
    FROM dash WHERE clients_listed >= 2 AND clients_listed_over < clients_listed)"""

ORACLE_SQL["a2_alerts"] = dashboard_with(WITH_BASE) + f""",
{SALES_STATS},
{ALERT_ITEMS}
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, type, severity, 'nouveau' AS status, message,
       CASE severity WHEN 'critical' THEN 'élevé' WHEN 'warning' THEN 'moyen' ELSE 'faible' END AS level
FROM items"""

ORACLE_SQL["a7_alert_status_counts"] = dashboard_with(WITH_BASE) + f""",
{SALES_STATS},
{ALERT_ITEMS}
SELECT s.status, CAST(count(items.k) AS BIGINT) AS count
FROM (VALUES ('nouveau'), ('lu'), ('résolu')) AS s(status) LEFT JOIN items ON s.status = 'nouveau'
GROUP BY s.status"""


def _route_sql(text: str) -> str:
    from caisse.operators.assistant import FALLBACK, ROUTES, _strip_literal

    norm = f"lower(strip_accents({text}))"
    whens = []
    for intent, words in ROUTES:
        cond = " OR ".join(f"contains({norm}, {q(_strip_literal(w))})" for w in words)
        whens.append(f"WHEN {cond} THEN '{intent}'")
    return "CASE " + " ".join(whens) + f" ELSE '{FALLBACK}' END"


ORACLE_SQL["n1_intents"] = f"""SELECT conv_id, turn, {_route_sql('text')} AS intent
FROM conversations WHERE role = 'user'"""


def _answers_sql() -> str:
    from caisse.operators import assistant as A

    nl = "chr(10)"
    ent = []
    for intent, (dim, plural, singular) in A.ENTITIES.items():
        adjective = "meilleures" if singular == "ville" else "meilleurs"
        leader = "La première ville" if singular == "ville" else f"Le premier {singular}"
        ent.append(f"""SELECT '{intent}' AS intent,
        CASE WHEN count(*) > 0 THEN
            {q(A.TXT_TOP_HEAD.format(adjective, plural))} || {nl} || {nl}
            || string_agg(rank || '. ' || name || ' : ' || {money_sql('s')}, {nl} ORDER BY rank) || {nl} || {nl}
            || {q(leader)} || ' représente environ '
            || {pct_sql("max(CASE WHEN rank = 1 THEN s END) / CASE WHEN (SELECT revenue_total FROM dash) <> 0 THEN (SELECT revenue_total FROM dash) ELSE sum(s) END * 100")}
            || {q(" du chiffre d'affaires analysé.")} || {nl} || {q(A.TXT_TOP_ADVICE)}
        ELSE {q(A.TXT_NO_COLUMNS.format(plural, singular))} END AS answer
    FROM (SELECT rank, name, CAST(s AS DOUBLE) AS s FROM ranked WHERE dimension = '{dim}' AND rank <= 5)""")

    def best(dim: str, field: str) -> str:
        return f"(SELECT {field} FROM ranked WHERE dimension = '{dim}' AND rank = 1)"

    def named(label: str, dim: str) -> str:
        return (f"{q(label)} || coalesce({best(dim, 'name')}, 'Non disponible') || ' (' || "
                f"{money_sql(best(dim, 'CAST(s AS DOUBLE)'))} || ')'")

    summary = f"""SELECT 'summary' AS intent,
        {q(A.TXT_SUMMARY_HEAD)} || {nl} || {nl}
        || {q("- Chiffre d'affaires total : ")} || {money_sql('revenue_total')} || {nl}
        || '- Nombre de clients : ' || client_count || {nl}
        || '- Nombre de produits : ' || product_count || {nl}
        || '- Panier moyen : ' || {money_sql('average_basket')} || {nl}
        || {named('- Meilleur client : ', 'client')} || {nl}
        || {named('- Meilleur produit : ', 'product')} || {nl}
        || {named('- Ville la plus performante : ', 'city')} || {nl}
        || {named('- Canal le plus performant : ', 'channel')} || {nl}
        || CASE WHEN best_month IS NOT NULL THEN '- Meilleur mois : ' || best_month || ' avec ' || {money_sql('best_month_value')} || {nl} ELSE '' END
        || {nl} || {q(A.TXT_SUMMARY_END)} AS answer
    FROM dash"""
    variation = "((last_value - prev_value) / prev_value * 100)"
    decline = f"""SELECT 'decline' AS intent,
        CASE WHEN n_months < 2 THEN {q(A.TXT_DECLINE_SHORT)}
             WHEN prev_value <= 0 THEN {q(A.TXT_DECLINE_ZERO)}
             ELSE {q("Le chiffre d'affaires du dernier mois est en ")}
                  || CASE WHEN {variation} < 0 THEN 'baisse' ELSE 'hausse' END || ' de ' || {pct_sql(f'abs({variation})')}
                  || ' par rapport au mois precedent.' || {nl}
                  || '- Mois precedent (' || prev_month || ') : ' || {money_sql('prev_value')} || {nl}
                  || '- Dernier mois (' || last_month || ') : ' || {money_sql('last_value')} || {nl}
                  || {q(A.TXT_DECLINE_LINES[3])} END AS answer
    FROM dash"""
    a = A.TXT_ACTIONS
    actions = f"""SELECT 'actions' AS intent,
        {q(a[0])} || {nl} || {nl}
        || '1. Fidéliser vos meilleurs clients, en priorité ' || coalesce({best('client', 'name')}, {q(A.TXT_ACTION_DEFAULTS[0])})
        || ', avec une offre dédiée ou un suivi personnalisé.' || {nl}
        || {q(a[3])} || {nl}
        || '3. Renforcer ce qui marche déjà : poussez davantage ' || coalesce({best('product', 'name')}, {q(A.TXT_ACTION_DEFAULTS[1])})
        || ' sur ' || coalesce({best('channel', 'name')}, {q(A.TXT_ACTION_DEFAULTS[2])}) || '.' AS answer"""
    simple = f"""SELECT 'revenue' AS intent, {q("Le chiffre d'affaires total est de ")} || {money_sql('revenue_total')} || '.' AS answer FROM dash
    UNION ALL SELECT 'client_count', 'La base contient ' || client_count || {q(A.TXT_CLIENT_COUNT.split('{}')[1])} FROM dash
    UNION ALL SELECT 'product_count', 'La base contient ' || product_count || {q(A.TXT_PRODUCT_COUNT.split('{}')[1])} FROM dash
    UNION ALL SELECT 'help', {q(A.TXT_HELP)}"""
    return "answers AS (\n    " + "\n    UNION ALL ".join([actions, summary, decline, *ent, simple]) + ")"


ANSWERS_CTE = _answers_sql()
ORACLE_SQL["n_answer_table"] = dashboard_with(WITH_BASE) + f""",
{ANSWERS_CTE}
SELECT intent, answer FROM answers"""

ORACLE_SQL["n_answers"] = dashboard_with(WITH_BASE) + f""",
{ANSWERS_CTE},
questions AS (SELECT conv_id, turn, {_route_sql('text')} AS intent FROM conversations WHERE role = 'user')
SELECT q.conv_id, q.turn, q.intent, a.answer FROM questions q LEFT JOIN answers a ON q.intent = a.intent"""



# ---------------------------------------------------------------------------
# Filters and report tables (city NATION_7, 1996-01-01 .. 1999-06-30)
# ---------------------------------------------------------------------------
FILTERED = ("sales_f AS (SELECT * FROM sales WHERE CAST(ville AS VARCHAR) = 'NATION_7' "
            "AND date_vente >= TIMESTAMP '1996-01-01' AND date_vente <= TIMESTAMP '1999-06-30')")
F_MEASURES = measures_cte("sales_f", "chiffre_affaires", cost="cout_total", client="client", product="produit",
                          city="ville", channel="canal", seller="vendeur", order="id_commande", date="date_vente",
                          payment="statut_paiement")
WITH_FILTERED = f"WITH {SALES},\n{FILTERED},\n{F_MEASURES}"

ORACLE_SQL["f_filtered_dashboard"] = dashboard_sql(WITH_FILTERED)

ORACLE_SQL["f5_filter_counts"] = f"""WITH {SALES},
{FILTERED}
SELECT (SELECT count(*) FROM sales_f) AS row_count, (SELECT count(*) FROM sales) AS total_row_count,
       (SELECT count(*) FROM sales_f) > 0
       AND (SELECT count(*) FROM sales_f) <= greatest(3.0, (SELECT count(*) FROM sales) * 0.02) AS low_data"""


def _display(c: str, kind: str) -> str:
    if kind == "ts":
        return f"coalesce(strftime({c}, '%d/%m/%Y'), '-')"
    if kind == "num":
        d = f"CAST({c} AS DOUBLE)"
        return (f"coalesce(CASE WHEN {d} = floor({d}) AND abs({d}) < 1e15 THEN CAST(CAST({d} AS BIGINT) AS VARCHAR) "
                f"ELSE CAST({d} AS VARCHAR) END, '-')")
    return f"coalesce(CAST({c} AS VARCHAR), '-')"


_KINDS = {"id_commande": "num", "date_vente": "ts", "chiffre_affaires": "num", "cout_total": "num", "quantite": "num"}
_DISPLAY = {c: _display(c, _KINDS.get(c, "text")) for c in _SALES_COLS}
ORACLE_SQL["f7_search"] = f"""WITH {SALES}
SELECT {", ".join(f"{_DISPLAY[c]} AS {c}" for c in _SALES_COLS)}
FROM sales
WHERE {" OR ".join(f"contains(lower({_DISPLAY[c]}), 'supplier#000000042')" for c in _SALES_COLS)}"""

ORACLE_SQL["f9_sorted_page"] = f"""WITH {SALES}
SELECT id_commande, CAST(chiffre_affaires AS DOUBLE) AS chiffre_affaires, client, produit, vendeur FROM sales
ORDER BY chiffre_affaires DESC NULLS LAST, {", ".join(f"{c} ASC NULLS FIRST" for c in _SALES_COLS if c != "chiffre_affaires")}
LIMIT 10 OFFSET 20"""

ORACLE_SQL["s10_resume"] = dashboard_with(WITH_FILTERED) + """
SELECT nrows AS lignes_filtrees, (SELECT count(*) FROM sales) AS lignes_totales, 11 AS colonnes,
       revenue_total AS chiffre_affaires, margin_total AS marge, margin_rate AS taux_marge,
       client_count AS clients, product_count AS produits
FROM dash"""


def eur_sql(x: str) -> str:
    return f"(translate(format('{{:,.2f}}', CAST(coalesce({x}, 0) AS DOUBLE)), ',.', ' ,') || ' EUR')"


ORACLE_SQL["s11_kpi_lines"] = dashboard_with(WITH_FILTERED) + f"""
SELECT 1 AS position, {q("Chiffre d'affaires")} AS label, {eur_sql('revenue_total')} AS value FROM dash
UNION ALL SELECT 2, 'Marge', {eur_sql('margin_total')} FROM dash
UNION ALL SELECT 3, 'Taux de marge', format('{{:.1f}}', margin_rate) || ' %' FROM dash
UNION ALL SELECT 4, 'Panier moyen', {eur_sql('average_basket')} FROM dash
UNION ALL SELECT 5, 'Clients', CAST(client_count AS VARCHAR) FROM dash
UNION ALL SELECT 6, 'Produits', CAST(product_count AS VARCHAR) FROM dash"""

_F_STATS = _stats("sales_f", _SALES_COLS, "st")
ORACLE_SQL["s11_text_lines"] = dashboard_with(WITH_FILTERED) + f""",
{_F_STATS},
{ALERT_ITEMS},
{INSIGHT_ITEMS}
SELECT 'insights' AS section, CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, text FROM ins
UNION ALL
SELECT 'alertes', CAST(row_number() OVER (ORDER BY k) AS INTEGER), '[' || severity || '] ' || message FROM items"""

ORACLE_SQL["s12_bars"] = f"""{WITH_FILTERED},
{DIM_SUMS},
{RANKED},
top AS (SELECT dimension, CAST(rank AS INTEGER) AS rank, name, CAST(round(s, 2) AS DOUBLE) AS value
        FROM ranked WHERE rank <= 5 AND dimension IN ('client', 'product'))
SELECT dimension, rank, substr(coalesce(CASE WHEN name <> '' THEN name END, 'Non renseigne'), 1, 34) AS label, value,
       greatest(4.0, value / CASE WHEN coalesce(max(value) OVER (PARTITION BY dimension), 0) = 0 THEN 1.0
                                  ELSE max(value) OVER (PARTITION BY dimension) END * 150) AS width,
       {eur_sql('value')} AS value_text
FROM top"""



ORACLE_SQL["k10_k11_payments"] = f"""{WITH_BASE}
SELECT count_if(pay = 'paid') AS paid_order_count, count_if(pay = 'unpaid') AS unpaid_order_count,
       count_if(pay = 'unknown') AS unknown_payment_count,
       CASE WHEN count(*) > 0 THEN round(count_if(pay = 'paid') / count(*) * 100, 1) ELSE 0.0 END AS payment_rate
FROM m"""

ORACLE_SQL["k19_best_month"] = f"""{WITH_BASE},
{MONTHS}
SELECT month, CAST(round(s, 2) AS DOUBLE) AS value FROM months
ORDER BY CAST(round(s, 2) AS DOUBLE) DESC, month ASC LIMIT 1"""

ORACLE_SQL["q12_head_sample"] = f"""WITH {CLEAN_CTES}
SELECT id_commande, strftime(date_vente, '%Y-%m-%dT%H:%M:%S') AS date_vente, montant, client, produit,
       statut_paiement, quantit
FROM cleaned ORDER BY row_id LIMIT 20"""


def _short(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 1}) || '…' ELSE {x} END"


def _axis(x: str) -> str:
    def grouped(v: str) -> str:
        return f"replace(format('{{:,}}', CAST({v} AS BIGINT)), ',', chr(8239))"
    return (f"CASE WHEN abs({x}) >= 10000 THEN {grouped(f'floor({x} / 1000 + 0.5)')} || ' k€' "
            f"ELSE {grouped(f'floor({x} + 0.5)')} || ' €' END")


ORACLE_SQL["x_text_formats"] = dashboard_with(WITH_BASE) + f"""
SELECT dimension, CAST(rank AS INTEGER) AS rank, name,
       {money_sql('v')} AS money, {eur_sql('v')} AS money_eur,
       {pct_sql('v / (SELECT revenue_total FROM dash) * 100')} AS share,
       {_axis('v')} AS axis, {_short('name', 18)} AS short_name, {_short('name', 8)} AS shorter_name
FROM (SELECT dimension, rank, name, CAST(round(s, 2) AS DOUBLE) AS v FROM ranked WHERE rank <= 5)"""
