"""Question answering without a language model.

Questions are a DataFrame. Each is routed to an intent by ordered keyword
rules on its accent-free lower-case text (N1, a ``CASE`` chain of ``LIKE``
tests that stays in codegen). Answers depend only on the dataset, so they
are built once per intent — a table of 12 rows — and attached to the
questions by a broadcast equi-join on the intent: the broadcast side is
bounded by the number of rules, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.functions.arrays import at
from caisse.functions.cache import jvm_cached
from caisse.functions.text import format_money, format_percent, normalize_question

# ---------------------------------------------------------------------------
# Routing rules (first hit wins) and answer texts.
# ---------------------------------------------------------------------------
ROUTES: list[tuple[str, list[str]]] = [
    ("actions", ["action", "recommand", "conseil", "commercial"]),
    ("summary", ["resume", "résumé", "synthese", "global", "mois", "bilan"]),
    ("decline", ["baisse", "diminue", "chute", "recul"]),
    ("top_client", ["meilleur client", "meilleurs clients", "top client", "top clients", "client important", "clients importants"]),
    ("top_product", ["meilleur produit", "meilleurs produits", "top produit", "top produits", "produit important"]),
    ("top_channel", ["canal", "channel"]),
    ("top_city", ["ville", "localite", "zone"]),
    ("top_seller", ["vendeur", "commercial"]),
    ("revenue", ["chiffre", "ca", "revenu", "vente", "ventes"]),
    ("client_count", ["client"]),
    ("product_count", ["produit"]),
]
FALLBACK = "help"

# entity intent -> (dimension, plural label, singular label)
ENTITIES = {
    "top_client": ("client", "clients", "client"),
    "top_product": ("product", "produits", "produit"),
    "top_channel": ("channel", "canaux", "canal"),
    "top_city": ("city", "villes", "ville"),
    "top_seller": ("seller", "vendeurs", "vendeur"),
}

TXT_HELP = (
    "Je peux analyser vos meilleurs clients, produits, canaux, villes, vendeurs, le chiffre d'affaires, "
    "les baisses de performance et proposer des actions commerciales."
)
TXT_REVENUE = "Le chiffre d'affaires total est de {}."
TXT_CLIENT_COUNT = (
    "La base contient {} clients distincts. Pour obtenir un classement, demandez par exemple : "
    "Quels sont mes meilleurs clients ?"
)
TXT_PRODUCT_COUNT = (
    "La base contient {} produits distincts. Pour obtenir un classement, demandez par exemple : "
    "Quels sont mes meilleurs produits ?"
)
TXT_NO_COLUMNS = (
    "Je n'ai pas trouvé les colonnes nécessaires pour classer les {}. "
    "Il faut au minimum une colonne {} et une colonne chiffre d'affaires."
)
TXT_TOP_HEAD = "Voici vos 5 {} {} par chiffre d'affaires :"
TXT_TOP_LINE = "{}. {} : {}"
TXT_TOP_SHARE = "{} représente environ {} du chiffre d'affaires analysé."
TXT_TOP_ADVICE = (
    "C'est un point d'appui commercial important : fidélisez ce segment et cherchez à reproduire "
    "ce qui fonctionne sur les autres comptes."
)
TXT_SUMMARY_HEAD = "Voici le résumé de votre activité :"
TXT_SUMMARY_LINES = [
    "- Chiffre d'affaires total : {}",
    "- Nombre de clients : {}",
    "- Nombre de produits : {}",
    "- Panier moyen : {}",
    "- Meilleur client : {} ({})",
    "- Meilleur produit : {} ({})",
    "- Ville la plus performante : {} ({})",
    "- Canal le plus performant : {} ({})",
]
TXT_SUMMARY_MONTH = "- Meilleur mois : {} avec {}"
TXT_SUMMARY_END = (
    "Globalement, vos priorités sont de sécuriser les meilleurs contributeurs et de renforcer les canaux "
    "qui génèrent le plus de chiffre d'affaires."
)
TXT_NOT_AVAILABLE = "Non disponible"
TXT_DECLINE_SHORT = "Je n'ai pas assez d'historique mensuel pour mesurer une baisse du chiffre d'affaires."
TXT_DECLINE_ZERO = "Le mois precedent est nul ou non exploitable, je ne peux pas calculer une evolution fiable."
TXT_DECLINE_LINES = [
    "Le chiffre d'affaires du dernier mois est en {} de {} par rapport au mois precedent.",
    "- Mois precedent ({}) : {}",
    "- Dernier mois ({}) : {}",
    "Analysez les clients, produits ou canaux en recul pour prioriser les actions commerciales.",
]
TXT_ACTIONS = [
    "Voici 3 actions commerciales recommandées :",
    "",
    "1. Fidéliser vos meilleurs clients, en priorité {}, avec une offre dédiée ou un suivi personnalisé.",
    "2. Relancer les clients faibles ou inactifs avec une campagne courte : remise limitee, appel commercial "
    "ou email de réactivation.",
    "3. Renforcer ce qui marche déjà : poussez davantage {} sur {}.",
]
TXT_ACTION_DEFAULTS = ["vos clients principaux", "vos produits les plus performants", "vos canaux les plus rentables"]


def _fmt(template: str, *parts: Column) -> Column:
    pieces = template.split("{}")
    out: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append(F.lit(piece))
        if i < len(parts):
            out.append(parts[i])
    return F.concat(*out) if len(out) > 1 else (out[0] if out else F.lit(""))


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def route(question: Column) -> Column:
    """Intent of a question (first rule with a keyword contained in the normalised text)."""
    norm = normalize_question(question)
    out = F.lit(FALLBACK)
    for intent, words in reversed(ROUTES):
        hit = F.lit(False)
        for w in words:
            hit = hit | norm.contains(_strip_literal(w))
        out = F.when(hit, F.lit(intent)).otherwise(out)
    return out


def _strip_literal(word: str) -> str:
    import unicodedata

    return "".join(ch for ch in unicodedata.normalize("NFKD", word) if not unicodedata.combining(ch)).lower()


def answers(summary: DataFrame) -> DataFrame:
    """``(intent, answer)`` for every intent, from one merged summary row.

    ``summary`` carries the dashboard fold (``revenue_total``, counts,
    ``average_basket``, ``months``) and ``tops``: ``array<struct<dimension,
    rank, name, value>>`` with the top-5 of each dimension (unrounded values).
    """
    return summary.select(F.explode(_answer_pairs()).alias("p")).select("p.intent", "p.answer")


@jvm_cached
def route_column(text_col: str) -> Column:
    return route(F.col(text_col))


@jvm_cached
def _answer_pairs() -> Column:
    tops = F.col("tops")

    def top_list(dim: str) -> Column:
        return F.array_sort(F.filter(tops, lambda t: t["dimension"] == dim))

    def first(dim: str) -> Column:
        lst = top_list(dim)
        return at(lst, 1)

    def entity_answer(intent: str) -> Column:
        dim, plural, singular = ENTITIES[intent]
        lst = top_list(dim)
        adjective = "meilleures" if singular == "ville" else "meilleurs"
        leader = "La première ville" if singular == "ville" else f"Le premier {singular}"
        listed_total = F.aggregate(lst, F.lit(0.0), lambda acc, t: acc + F.coalesce(t["value"], F.lit(0.0)))
        total = F.when(F.coalesce(F.col("revenue_total"), F.lit(0.0)) != 0, F.col("revenue_total")).otherwise(listed_total)
        share = F.when(total != 0, at(lst, 1)["value"] / total * 100).otherwise(F.lit(0.0))
        body = F.array_join(
            F.transform(lst, lambda t: _fmt(TXT_TOP_LINE, t["rank"].cast("string"), t["name"], format_money(t["value"]))),
            "\n",
        )
        full = _lines(
            F.lit(TXT_TOP_HEAD.format(adjective, plural)), F.lit(""), body, F.lit(""),
            _fmt(TXT_TOP_SHARE, F.lit(leader), format_percent(share)), F.lit(TXT_TOP_ADVICE),
        )
        return F.when(F.size(lst) > 0, full).otherwise(F.lit(TXT_NO_COLUMNS.format(plural, singular)))

    def named(dim: str) -> tuple[Column, Column]:
        item = first(dim)
        return F.coalesce(item["name"], F.lit(TXT_NOT_AVAILABLE)), format_money(F.coalesce(item["value"], F.lit(0.0)))

    months = F.col("months")
    best_month = at(
        F.array_sort(F.transform(months, lambda mth, i: F.struct((-mth["value"]).alias("k"), i.alias("i"), mth.alias("m")))),
        1,
    )["m"]
    summary_lines = [
        F.lit(TXT_SUMMARY_HEAD), F.lit(""),
        _fmt(TXT_SUMMARY_LINES[0], format_money("revenue_total")),
        _fmt(TXT_SUMMARY_LINES[1], F.col("client_count").cast("string")),
        _fmt(TXT_SUMMARY_LINES[2], F.col("product_count").cast("string")),
        _fmt(TXT_SUMMARY_LINES[3], format_money("average_basket")),
        _fmt(TXT_SUMMARY_LINES[4], *named("client")),
        _fmt(TXT_SUMMARY_LINES[5], *named("product")),
        _fmt(TXT_SUMMARY_LINES[6], *named("city")),
        _fmt(TXT_SUMMARY_LINES[7], *named("channel")),
        F.when(best_month.isNotNull(), _fmt(TXT_SUMMARY_MONTH, best_month["month"], format_money(best_month["value"]))),
        F.lit(""), F.lit(TXT_SUMMARY_END),
    ]
    summary_text = _lines(*summary_lines)  # concat_ws skips the null best-month line

    prev = at(months, -2)
    cur = at(months, -1)
    variation = (cur["value"] - prev["value"]) / prev["value"] * 100
    decline = (
        F.when(F.size(months) < 2, F.lit(TXT_DECLINE_SHORT))
        .when(prev["value"] <= 0, F.lit(TXT_DECLINE_ZERO))
        .otherwise(
            _lines(
                _fmt(TXT_DECLINE_LINES[0], F.when(variation < 0, F.lit("baisse")).otherwise(F.lit("hausse")),
                     format_percent(F.abs(variation))),
                _fmt(TXT_DECLINE_LINES[1], prev["month"], format_money(prev["value"])),
                _fmt(TXT_DECLINE_LINES[2], cur["month"], format_money(cur["value"])),
                F.lit(TXT_DECLINE_LINES[3]),
            )
        )
    )
    actions = _lines(
        F.lit(TXT_ACTIONS[0]), F.lit(TXT_ACTIONS[1]),
        _fmt(TXT_ACTIONS[2], F.coalesce(first("client")["name"], F.lit(TXT_ACTION_DEFAULTS[0]))),
        F.lit(TXT_ACTIONS[3]),
        _fmt(TXT_ACTIONS[4], F.coalesce(first("product")["name"], F.lit(TXT_ACTION_DEFAULTS[1])),
             F.coalesce(first("channel")["name"], F.lit(TXT_ACTION_DEFAULTS[2]))),
    )
    by_intent = [
        ("actions", actions),
        ("summary", summary_text),
        ("decline", decline),
        *[(intent, entity_answer(intent)) for intent in ENTITIES],
        ("revenue", _fmt(TXT_REVENUE, format_money("revenue_total"))),
        ("client_count", _fmt(TXT_CLIENT_COUNT, F.col("client_count").cast("string"))),
        ("product_count", _fmt(TXT_PRODUCT_COUNT, F.col("product_count").cast("string"))),
        (FALLBACK, F.lit(TXT_HELP)),
    ]
    return F.array(*[F.struct(F.lit(k).alias("intent"), v.alias("answer")) for k, v in by_intent])


def answer_questions(questions: DataFrame, text_col: str, answer_table: DataFrame) -> DataFrame:
    """N1 + join: every question with its intent and answer (answers broadcast: one row per intent)."""
    routed = questions.withColumn("intent", route_column(text_col))
    return routed.join(F.broadcast(answer_table), "intent", "left")
