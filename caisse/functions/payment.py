"""K9: payment status classifier as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.functions.text import normalize_text

# ---------------------------------------------------------------------------
# Payment words, tested as substrings of the normalised value,
# unpaid words first.
# ---------------------------------------------------------------------------
UNPAID_WORDS = ["impaye", "non paye", "unpaid", "pending", "attente", "false", "no", "non"]
PAID_WORDS = ["paye", "paid", "regle", "true", "yes", "oui", "1"]

PAID, UNPAID, UNKNOWN = "paid", "unpaid", "unknown"


def _alternation(words: list[str]) -> str:
    return "|".join(words)


def payment_text(col: str, dtype: T.DataType) -> Column:
    """The text the classifier sees: ``str(value or "")``.

    Falsy values (null, 0, False) become the empty string; true booleans print
    as ``True``.
    """
    c = F.col(col)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    if isinstance(dtype, T.NumericType):
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def classify_payment(text: Column) -> Column:
    """'paid' / 'unpaid' / 'unknown' from the raw text."""
    norm = normalize_text(text)
    return (
        F.when(norm.rlike(_alternation(UNPAID_WORDS)), F.lit(UNPAID))
        .when(norm.rlike(_alternation(PAID_WORDS)), F.lit(PAID))
        .otherwise(F.lit(UNKNOWN))
    )
