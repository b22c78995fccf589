"""Quality rules with cross-document line frequency.

Lines are normalised (case, white space, digits) and hashed. Per host, the
distinct documents of each line are counted; lines above the limit are
boilerplate and go; a document left with too little is rejected.

A copy of a text is no document of its own: equal texts of a host count once,
for a line's documents as for the host's. Texts that differ anywhere, near
copies too, are different documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import WordHashes, cut, map_texts, require, windows_hash

#: A line is boilerplate on its host if it stands in more distinct texts than both of these allow: a number, and a share of the host's distinct texts.
MIN_DOCS = 10
HOST_SHARE = 0.05
#: A document is depleted when fewer words or a smaller share of its words remain.
MIN_WORDS = 5
MIN_SHARE = 0.2

_DIGITS = re.compile(rb"[0-9]+")
_SPACES = str.maketrans("", "", " \t\n\r\x0b\x0c")
_NO_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"


def line_key(words: list[bytes]) -> int:
    """Hash of a normalised line as a signed long: lower-cased words, single spaces, digit runs as one 0."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(words).lower()))
    return h - (1 << 64) if h >> 63 else h


def _repeated(word_hashes) -> int:
    """Words inside a 5-word window that occurs at least twice in the text."""
    import numpy as np

    w = windows_hash(word_hashes)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w) + 5, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + 5, -1)
    return int((np.cumsum(cover) > 0).sum())


def _lines(text: str) -> tuple[int, list[dict]]:
    """Number of repeated lines, and the distinct normalised lines with their words."""
    seen, dup, words = set(), 0, {}
    for raw in text.encode("utf-8", "surrogatepass").split(b"\n"):
        w = raw.split()
        if not w:
            continue
        if raw in seen:
            dup += 1
        seen.add(raw)
        k = line_key(w)
        words[k] = words.get(k, 0) + len(w)
    return dup, [{"line": k, "words": n} for k, n in words.items()]


def _measure(texts: list[str | None]) -> list[list]:
    hashes = WordHashes(lower=False)
    out = [[], [], [], [], [], []]
    for text, h in zip(texts, hashes(texts)):
        text = text or ""
        dup, lines = _lines(text)
        for column, v in zip(out, (len(h), len(text.translate(_SPACES)), len(text) - len(text.translate(_NO_SYMBOLS)), dup, _repeated(h), lines)):
            column.append(v)
    return out


def _host(col: str) -> Column:
    """A null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("none"))


def _key(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def line_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: rid, id, host, text_key, the base counts and its distinct lines; written to the shared folder."""
    require(docs, id_col, text_col, host_col)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), _host(host_col).alias("host"), _key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return cut(map_texts(rows, "text", _measure, _FIELDS))


def frequent_lines(stats: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, line, n_docs) of the lines above the limits, from the rows of ``line_stats``; both counts are of distinct texts."""
    distinct = stats.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counts = distinct.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = counts.filter(F.col("n_docs") > min_docs)
    return counts.join(hosts, "host").filter(F.col("n_docs") > host_share * F.col("host_docs")).select("host", "line", "n_docs")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One verdict per row of ``docs``.

    Returns doc_id, host, text_key (md5 of the text), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, removed_words, removed (hashes of
    the lines above the limits), base_failed, depleted, kept. A null text has
    no words and fails the base rules; a null host is a host of its own; equal
    rows get equal verdicts, each its own row; other columns are ignored.
    """
    stats = line_stats(docs, id_col, text_col, host_col)
    often = frequent_lines(stats, min_docs, host_share)
    lines = stats.select("rid", "host", F.explode("lines").alias("l")).select("rid", "host", "l.line", "l.words")
    gone = lines.join(often, ["host", "line"]).groupBy("rid").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))
    base = stats.drop("lines").join(gone, "rid", "left").drop("rid")
    base = base.withColumns({"removed_words": F.coalesce("removed_words", F.lit(0).cast("long")), "removed": F.coalesce("removed", F.array().cast("array<bigint>"))})
    base = base.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    left = F.col("n_words") - F.col("removed_words")
    base = base.withColumn("depleted", (F.col("removed_words") > 0) & ((left < min_words) | (left < min_share * F.col("n_words"))))
    return base.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """``docs`` without the rejected documents, the frequent lines taken out of the others' texts; the columns stay.

    n_chars, where it is there, follows the new text.
    """
    verdicts = quality_rules(docs, id_col, text_col, host_col, **limits).filter("kept").groupBy("host", "text_key").agg(F.first("removed").alias("removed"))

    def clean(texts, removed):
        import pandas as pd

        out = []
        for text, gone in zip(texts, removed):
            gone = set(gone) if gone is not None else ()
            if text and gone:
                text = "\n".join(x for x in text.split("\n") if not (w := x.encode("utf-8", "surrogatepass").split()) or line_key(w) not in gone)
            out.append(text)
        return pd.Series(out, dtype=object)

    clean_udf = F.pandas_udf(clean, "string")
    d, v = docs.alias("d"), verdicts.alias("v")
    same = (_host(f"d.{host_col}") == F.col("v.host")) & (_key(f"d.{text_col}") == F.col("v.text_key"))
    new = F.when(F.size("v.removed") > 0, clean_udf(F.col(f"d.{text_col}"), F.col("v.removed"))).otherwise(F.col(f"d.{text_col}"))
    kept = d.join(v, same).select(*[new.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
    return kept.withColumn("n_chars", F.length(text_col).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept
