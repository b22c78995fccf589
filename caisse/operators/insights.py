"""Insights (A1), alerts (A2-A6) and alert status counters.

Inputs are one-row frames (the dashboard fold and the table statistics);
they are merged by a union + ``max`` fold rather than a join, then the
ordered sentence list is built with ``array`` + ``filter`` and exploded with
its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.functions.arrays import at
from caisse.functions.cache import jvm_cached
from caisse.functions.text import format_dot1, format_money

# ---------------------------------------------------------------------------
# Insight and alert texts, thresholds, severities and levels.
# ---------------------------------------------------------------------------
TXT_REVENUE = "Le chiffre d'affaires total est de {}."
TXT_MARGIN = "La marge totale est de {}, soit un taux de marge de {} %."
TXT_CLIENTS = "Vous avez {} clients distincts dans la base actuelle."
TXT_TOP_CLIENT = "Le client le plus important est {} avec {} de chiffre d'affaires."
TXT_TOP_PRODUCT = "Le produit le plus performant est {} avec {} de chiffre d'affaires."
TXT_TOP_CHANNEL = "Le canal le plus performant est {} avec {}."
TXT_QUALITY = "La qualite des donnees merite une attention particuliere a cause des valeurs manquantes."
INSIGHT_MISSING_RATIO = 0.1

ALERT_DROP = ("baisse_ca", "warning", "Le chiffre d'affaires a baisse par rapport au mois precedent.")
ALERT_QUALITY = ("mauvaise_qualite", "critical", "Le jeu de donnees presente trop de valeurs manquantes.")
ALERT_PAYMENTS = ("paiements", "warning", "{} commandes semblent non payees ou en attente.")
ALERT_INACTIVE = ("client_inactif", "info", "Un ou plusieurs clients semblent peu actifs sur cette periode.")
ALERT_MISSING_RATIO = 0.2
DROP_FACTOR = 0.9
STATUS_NEW = "nouveau"
STATUS_VALUES = ["nouveau", "lu", "résolu"]
LEVELS = {"critical": "élevé", "warning": "moyen"}
LEVEL_DEFAULT = "faible"


def _fmt(template: str, *parts: Column) -> Column:
    """Fill ``{}`` slots of a fixed template with Column values."""
    pieces = template.split("{}")
    out: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append(F.lit(piece))
        if i < len(parts):
            out.append(parts[i])
    return F.concat(*out)


def merge_rows(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row (union + max, no join)."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    cols = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    simple = [c for c in cols if not c.startswith("months")]
    aggs = [F.max(c).alias(c) for c in simple] + [F.max_by(c, F.size(c)).alias(c) for c in cols if c.startswith("months")]
    return merged.agg(*aggs)


def severity_level(severity: Column) -> Column:
    """Severity -> level word."""
    out = F.lit(LEVEL_DEFAULT)
    for sev, level in reversed(LEVELS.items()):
        out = F.when(severity == sev, F.lit(level)).otherwise(out)
    return out


@jvm_cached
def _insight_items() -> Column:
    items = F.array(
        F.when(F.col("revenue_total") != 0, _fmt(TXT_REVENUE, format_money("revenue_total"))),
        F.when(
            F.col("margin_total") != 0,
            _fmt(TXT_MARGIN, format_money("margin_total"), format_dot1("margin_rate")),
        ),
        F.when(F.col("client_count") != 0, _fmt(TXT_CLIENTS, F.col("client_count").cast("string"))),
        F.when(F.col("best_client").isNotNull(), _fmt(TXT_TOP_CLIENT, F.col("best_client"), format_money("best_client_value"))),
        F.when(
            F.col("best_product").isNotNull(), _fmt(TXT_TOP_PRODUCT, F.col("best_product"), format_money("best_product_value"))
        ),
        F.when(F.col("best_channel").isNotNull(), _fmt(TXT_TOP_CHANNEL, F.col("best_channel"), format_money("best_channel_value"))),
        F.when((F.col("rows") > 0) & (F.col("missing_ratio") > INSIGHT_MISSING_RATIO), F.lit(TXT_QUALITY)),
    )
    return F.filter(items, lambda x: x.isNotNull())


def insights(summary: DataFrame) -> DataFrame:
    """A1: ``(position, text)``; ``summary`` = dashboard fold merged with ``missing_ratio``/``rows``."""
    return summary.select(F.posexplode(_insight_items()).alias("pos", "text")).select(
        (F.col("pos") + 1).cast("int").alias("position"), "text"
    )


@jvm_cached
def _alert_items() -> Column:
    months = F.col("months")
    n_months = F.size(months)
    drop = (n_months >= 2) & (
        at(months, -1)["value"] < at(months, -2)["value"] * DROP_FACTOR
    )
    quality = F.coalesce(F.col("missing_ratio") > ALERT_MISSING_RATIO, F.lit(False))
    payments = F.col("unpaid_order_count") > 0
    inactive = (F.col("clients_listed") >= 2) & (F.col("clients_listed_over") < F.col("clients_listed"))

    def alert(cond: Column, spec: tuple[str, str, str], message: Column | None = None) -> Column:
        kind, severity, text = spec
        return F.when(
            cond,
            F.struct(
                F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(STATUS_NEW).alias("status"),
                (message if message is not None else F.lit(text)).alias("message"),
            ),
        )

    items = F.array(
        alert(drop, ALERT_DROP),
        alert(quality, ALERT_QUALITY),
        alert(payments, ALERT_PAYMENTS, _fmt(ALERT_PAYMENTS[2], F.col("unpaid_order_count").cast("string"))),
        alert(inactive, ALERT_INACTIVE),
    )
    return F.filter(items, lambda x: x.isNotNull())


def alerts(summary: DataFrame) -> DataFrame:
    """``(position, type, severity, status, message, level)``."""
    return summary.select(F.posexplode(_alert_items()).alias("pos", "a")).select(
        (F.col("pos") + 1).cast("int").alias("position"), "a.type", "a.severity", "a.status", "a.message",
        severity_level(F.col("a.severity")).alias("level"),
    )


def alerts_with_status(alert_rows: DataFrame, status: DataFrame | None) -> DataFrame:
    """Alerts left-joined to a ``(position, status)`` table; missing status -> ``nouveau``.

    The status table comes from the caller, so its size is not bounded here:
    no broadcast hint; Spark's size statistics choose the join.
    """
    if status is None:
        return alert_rows
    s = status.select("position", F.col("status").alias("_st"))
    return alert_rows.join(s, "position", "left").select(
        "position", "type", "severity", F.coalesce(F.col("_st"), F.col("status")).alias("status"), "message", "level"
    )


def status_counts(alert_rows: DataFrame) -> DataFrame:
    """``(status, count)`` for the three statuses (zeros included)."""
    counted = alert_rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    wide = counted.agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"s{i}") for i, s in enumerate(STATUS_VALUES)])
    stack = ", ".join(f"'{s}', s{i}" for i, s in enumerate(STATUS_VALUES))
    return wide.selectExpr(f"stack({len(STATUS_VALUES)}, {stack}) AS (status, count)").select(
        "status", F.col("count").cast("long").alias("count")
    )
