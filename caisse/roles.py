"""Column names and business roles (driver-side metadata, no Spark job).

A sales file has no fixed schema: which column holds the revenue, the client,
the date... is guessed from the column *names*. These helpers only look at
``df.columns``; they never touch the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

# ---------------------------------------------------------------------------
# Role candidate lists. They must stay exactly as below (same
# words, same order) for the role guesses to agree with the source behaviour.
# ---------------------------------------------------------------------------
ROLE_CANDIDATES: dict[str, list[str]] = {
    "revenue": ["ca", "chiffre_affaires", "chiffre_d_affaires", "revenu", "amount", "sales", "montant", "total"],
    "cost": ["cout_total", "cout", "cost", "charges", "depense"],
    "margin": ["marge", "margin", "profit", "benefice", "marge_brute"],
    "client": ["client", "client_name", "customer", "customer_name", "client_id"],
    "product": ["produit", "product", "article", "sku", "item"],
    "city": ["ville", "city", "localite", "commune"],
    "channel": ["canal", "channel", "source", "mode_vente", "origine"],
    "seller": ["vendeur", "commercial", "sales_rep", "seller", "agent"],
    "date": ["date", "date_facture", "date_vente", "created_at", "dt"],
    "order": ["id_commande", "commande", "order_id", "numero_commande", "invoice", "facture"],
    "payment": ["statut_paiement", "paiement", "payment_status", "status", "statut", "paid", "regle"],
}
# The forecast looks for revenue without the generic word "total".
FORECAST_REVENUE_CANDIDATES: list[str] = ["ca", "chiffre_affaires", "chiffre_d_affaires", "revenu", "amount", "sales", "montant"]
# The question answering works with six roles under French keys.
ASSISTANT_ROLE_KEYS: dict[str, str] = {
    "revenue": "revenue",
    "client": "client",
    "produit": "product",
    "ville": "city",
    "canal": "channel",
    "vendeur": "seller",
}
# Dimensions used by the dashboard top lists, in output order.
TOP_DIMENSIONS: list[str] = ["client", "product", "city", "channel", "seller"]

_NON_ALNUM_RUN = re.compile(r"[^a-z0-9]+")


def normalize_name(name: object) -> str:
    """C1 for one name: strip, lower, runs of non ``[a-z0-9]`` -> ``_``, trim ``_``.

    Accented letters are not ``[a-z]``, so ``Coût total`` becomes ``co_t_total``.
    """
    value = str(name).strip().lower()
    return _NON_ALNUM_RUN.sub("_", value).strip("_")


def normalize_columns(columns: Iterable[object]) -> list[str]:
    """C1 for a header. Empty names become ``col_<i>``; repeated names get ``_2``, ``_3``...

    (The source keeps duplicate names and then fails on them; suffixing is a
    deliberate difference so that Spark can address every column.)
    """
    out: list[str] = []
    used: set[str] = set()
    for index, col in enumerate(columns):
        base = normalize_name(col) or f"col_{index}"
        name, suffix = base, 2
        while name in used:
            name, suffix = f"{base}_{suffix}", suffix + 1
        used.add(name)
        out.append(name)
    return out


def _key(text: object) -> str:
    return _NON_ALNUM_RUN.sub("", str(text).lower())


def infer_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Pick the column playing a role.

    Pass 1: first candidate whose key equals a column key (when two columns
    share a key, the later column wins). Pass 2: first candidate longer than
    three characters contained in a column key (first column wins).
    """
    by_key: dict[str, str] = {}
    for col in columns:
        by_key[_key(col)] = col
    for candidate in candidates:
        hit = by_key.get(_key(candidate))
        if hit is not None:
            return hit
    for candidate in candidates:
        ckey = _key(candidate)
        if len(ckey) <= 3:
            continue
        for col in columns:
            if ckey in _key(col):
                return col
    return None


def role_map(columns: Sequence[str]) -> dict[str, str | None]:
    """C11: the eleven roles of a table."""
    return {role: infer_column(columns, cands) for role, cands in ROLE_CANDIDATES.items()}


def forecast_roles(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """(revenue, date) as the forecast sees them."""
    return infer_column(columns, FORECAST_REVENUE_CANDIDATES), infer_column(columns, ROLE_CANDIDATES["date"])


def assistant_roles(columns: Sequence[str]) -> dict[str, str | None]:
    """The six assistant roles under their French keys."""
    return {key: infer_column(columns, ROLE_CANDIDATES[role]) for key, role in ASSISTANT_ROLE_KEYS.items()}
