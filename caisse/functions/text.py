"""Scalar text functions (X1-X8, X11) as JVM-side Column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Code point blocks scanned to build the accent table: Latin-1 Supplement,
# Latin Extended-A/B and Latin Extended Additional.
_LATIN_BLOCKS = [(0x00C0, 0x024F), (0x1E00, 0x1EFF)]


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(accented, plain) character strings for ``translate``.

    Built by rule: every Latin letter whose NFKD form minus combining marks is
    a single different character maps to that character.
    """
    src, dst = [], []
    for lo, hi in _LATIN_BLOCKS:
        for code in range(lo, hi + 1):
            ch = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c: ColumnOrName) -> Column:
    """Drop diacritics (NFKD without combining marks) for Latin letters."""
    src, dst = accent_table()
    # Combining marks that are already decomposed in the input are removed too.
    return F.regexp_replace(F.translate(_col(c), src, dst), r"\p{M}+", "")


# White space removed by ``str.strip()``: the characters for which Python's
# ``str.isspace()`` is true, built by rule over the Basic Multilingual Plane.
WHITESPACE = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())


def unicode_strip(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space (no regex).

    Most texts need spaces removed at most: what then begins and ends with
    visible ASCII is not searched for the other kinds of white space.
    """
    text = F.trim(_col(c))
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.btrim(_col(c), F.lit(WHITESPACE)))


def normalize_text(c: ColumnOrName) -> Column:
    """X2 (data values): accents removed, lower case, stripped."""
    return unicode_strip(F.lower(strip_accents(c)))


def normalize_question(c: ColumnOrName) -> Column:
    """X2 (questions): accents removed and lower case, not stripped."""
    return F.lower(strip_accents(c))


def format_money(c: ColumnOrName, suffix: str = " €") -> Column:
    """``1 234,50 €`` (space thousands, comma decimals, 2 digits)."""
    number = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return F.concat(F.translate(F.format_number(number, 2), ",.", " ,"), F.lit(suffix))


def format_eur(c: ColumnOrName) -> Column:
    """Report variant with the ``EUR`` suffix."""
    return format_money(c, " EUR")


def format_percent(c: ColumnOrName) -> Column:
    """``12,3 %`` (one decimal, comma, no thousands separator)."""
    number = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return F.concat(F.translate(F.format_number(number, 1), ".,", ","), F.lit(" %"))


def format_dot1(c: ColumnOrName) -> Column:
    """One decimal with a dot and no grouping (``{x:.1f}``)."""
    return F.translate(F.format_number(_col(c).cast("double"), 1), ",", "")


def _group_fr(n: Column) -> Column:
    """Integer with the fr-FR thousands separator (narrow no-break space)."""
    return F.translate(F.format_number(n, 0), ",", "\u202f")


def axis_label(c: ColumnOrName) -> Column:
    """``12 k€`` from 10 000 up (rounded thousands), else ``950 €``; rounding half up."""
    v = F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return F.when(F.abs(v) >= 10000, F.concat(_group_fr(F.floor(v / 1000 + 0.5)), F.lit(" k€"))).otherwise(
        F.concat(_group_fr(F.floor(v + 0.5)), F.lit(" €"))
    )


def short_label(c: ColumnOrName, max_len: int = 18) -> Column:
    """Longer than ``max_len`` -> first ``max_len - 1`` characters + ``…``."""
    s = _col(c).cast("string")
    return F.when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len - 1), F.lit("…"))).otherwise(s)


def date_display(c: ColumnOrName) -> Column:
    """``dd/MM/yyyy``; missing or unparsable -> ``-``."""
    return F.coalesce(F.date_format(_col(c), "dd/MM/yyyy"), F.lit("-"))


def month_key(c: ColumnOrName) -> Column:
    """X11: month period label ``yyyy-MM``."""
    return F.date_format(_col(c), "yyyy-MM")


def number_text(c: Column) -> Column:
    """A double in plain notation from 0.0001 up to 1e16 (Spark prints an exponent from 1e7 and below 0.001)."""
    text = c.cast("string")
    size = F.abs(c)
    exponent = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    # Through the printed digits, so that the shortest form is kept.
    plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    return F.when(exponent, F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)).otherwise(text)


#: Digits of a number in ``natural_key``.
KEY_DIGITS = 40


def natural_key(c: Column) -> Column:
    """Text whose digit runs are padded with zeros, so that they sort as numbers."""
    padded = F.regexp_replace(c, r"(\d+)", "0" * KEY_DIGITS + "$1")
    return F.regexp_replace(padded, r"0*(\d{%d,})" % KEY_DIGITS, "$1")
