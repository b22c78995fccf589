"""DuckDB SQL equivalents of the queries in ``values``."""

from __future__ import annotations

from caisse.plans import oracle as o
from caisse.sources.gaps import GAPS_SQL

_ITEMS = ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]

_FILLS = """known AS (
    SELECT median(montant) FILTER (montant IS NOT NULL AND NOT isnan(montant)) AS montant, median(CAST(remise AS DOUBLE)) AS remise,
           count(*) FILTER (actif) > count(*) FILTER (NOT actif) AS actif FROM gaps)"""

_TEXT_SORT = """
    lower(strip_accents(regexp_replace(libelle, '[0-9]+', ''))) || lpad(regexp_extract(libelle, '[0-9]+'), 40, '0'),
    CASE WHEN strip_accents(libelle) = libelle THEN 0 ELSE 1 END,
    CASE WHEN lower(libelle) = libelle THEN 0 ELSE 1 END, id_commande"""

_SALES_ORDER = "chiffre_affaires DESC NULLS LAST, " + ", ".join(f"{c} ASC NULLS FIRST" for c in o._SALES_COLS if c != "chiffre_affaires")

ORACLE_SQL: dict[str, str] = {
    "c8_medians": f"WITH {GAPS_SQL}\n" + "\nUNION ALL\n".join(
        [f"SELECT '{c}' AS \"column\", CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) AS median FROM lineitem" for c in _ITEMS]
        + ["SELECT 'montant', median(montant) FROM gaps WHERE NOT isnan(montant)", "SELECT 'remise', median(CAST(remise AS DOUBLE)) FROM gaps",
           "SELECT 'vide', CAST(NULL AS DOUBLE)"]),
    "c9_nan_bool_fill": f"""WITH {GAPS_SQL},
{_FILLS}
SELECT id_commande, CASE WHEN gaps.montant IS NULL OR isnan(gaps.montant) THEN known.montant ELSE gaps.montant END AS montant,
       coalesce(gaps.actif, known.actif) AS actif, coalesce(CAST(gaps.remise AS DOUBLE), known.remise) AS remise, libelle
FROM gaps, known""",
    "s2_json_fill": f"""WITH {GAPS_SQL},
{_FILLS}
SELECT id_commande, coalesce(gaps.actif, known.actif) AS actif, coalesce(CAST(gaps.remise AS DOUBLE), known.remise) AS remise, libelle
FROM gaps, known""",
    "q13_numeric_options": """WITH t AS (SELECT CAST(o_custkey + CAST(10000000.25 AS DOUBLE) AS VARCHAR) AS value, count(*) AS rows FROM orders GROUP BY 1)
SELECT 'clients' AS option, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS position, value, rows FROM t ORDER BY value LIMIT 150""",
    "f8_text_sort": f"""WITH {GAPS_SQL},
placed AS (SELECT id_commande, libelle, row_number() OVER (ORDER BY {_TEXT_SORT}) AS r, count(*) OVER () AS n FROM gaps)
SELECT id_commande, libelle FROM placed WHERE (r - 1) // 10 + 1 = greatest(1, greatest(1, (n + 9) // 10) // 2)""",
    "f9_far_page": f"""WITH {o.SALES},
placed AS (SELECT *, row_number() OVER (ORDER BY {_SALES_ORDER}) AS r, count(*) OVER () AS n FROM sales),
paged AS (SELECT *, (r - 1) // 10 + 1 - greatest(1, greatest(1, (n + 9) // 10) * 2 // 3) AS ahead FROM placed)
SELECT CASE ahead WHEN 0 THEN 'far' ELSE 'next' END AS page, id_commande, CAST(chiffre_affaires AS DOUBLE) AS chiffre_affaires, client, produit, vendeur
FROM paged WHERE ahead IN (0, 1)""",
    "n_stored_answers": o.ORACLE_SQL["n_answer_table"],
}
