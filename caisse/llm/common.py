"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.session import ensure_checkpoint_dir

#: Bytes of one Arrow batch sent to a Python worker: very long texts then make small batches.
BATCH_BYTES = 2 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def prepare(spark: SparkSession) -> None:
    """Session settings of the Python stages: batches bounded in bytes, shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them back: a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder, as a URI."""
    import re
    import uuid

    base = re.sub(r"^file:/+", "file:///", ensure_checkpoint_dir(spark).rstrip("/"))
    return f"{base if ':' in base else 'file://' + base}/{kind}-{uuid.uuid4().hex}"


def id_crc(col: str) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (bytes.split() splits at just these characters)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once: bounds the 64-bit work arrays to some 32 MB.
_BLOCK = 1 << 20
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class WordHashes:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of whole texts, computed with array operations.

    A word's hash is a polynomial of its UTF-8 bytes, finalised together with
    its length; it does not depend on the word's place.
    """

    def __init__(self, lower: bool):
        self.lower = lower
        self._size(1 << 16)

    def _size(self, n: int) -> None:
        base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))

    def _hash(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word; raw ends with white space."""
        buf = np.frombuffer(raw, dtype=np.uint8)
        n = len(buf)
        if n >= len(self.power):
            self._size(2 * n)
        space = _SPACE[buf]
        before = np.concatenate([[True], space[:-1]])
        start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        return start, mix64(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _long(self, raw: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(raw):
            to = min(len(raw), at + _BLOCK)
            while to < len(raw) and not _SPACE[raw[to - 1]]:
                to += 1
            out.append(self._hash(raw[at:to] + b"\n")[1])
            at = to
        return np.concatenate(out)

    def __call__(self, texts: list[str | None]):
        """One array of word hashes for each text, in order; none for a null text."""
        raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        if self.lower:
            raws = [r.lower() for r in raws]  # of bytes: A-Z only
        i = 0
        while i < len(raws):
            if len(raws[i]) > _BLOCK:
                yield self._long(raws[i])
                i += 1
                continue
            j, size = i, 0
            while j < len(raws) and (j == i or size + len(raws[j]) < _BLOCK):
                size += len(raws[j]) + 1
                j += 1
            start, h = self._hash(b"\n".join(raws[i:j]) + b"\n")
            at = np.cumsum([0] + [len(r) + 1 for r in raws[i:j]])
            cuts = np.searchsorted(start, at)
            for k in range(j - i):
                yield h[cuts[k] : cuts[k + 1]]
            i = j


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


def windows_hash(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each window of ``size`` words (64 bits, order-sensitive), in text order."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ word_hashes[k : k + n]) * _STEP[k % len(_STEP)]
        out ^= out >> np.uint64(29)
    return mix64(out)


def shingle_set(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than ``size`` make one shingle; no words make none."""
    if len(word_hashes) < size:
        return windows_hash(word_hashes, len(word_hashes)) if len(word_hashes) else word_hashes
    return np.unique(windows_hash(word_hashes, size))


def require(df: DataFrame, *names: str) -> None:
    """Fail early, naming the columns that an operator needs and the input lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def map_texts(df: DataFrame, text: str, fn, fields: str, keep_text: bool = False) -> DataFrame:
    """Replace the column ``text`` by the columns ``fields`` (a DDL string) that ``fn(texts)`` returns per Arrow batch.

    ``fn`` gets a list of texts (None for null) and returns one list per
    field; the other columns pass unchanged, and with ``keep_text`` the text
    does too. ``fn`` may keep state between batches of a task.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    added = T.StructType.fromDDL(fields)
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in kept] + list(added))
    types = [to_arrow_type(f.dataType) for f in added]
    names = kept + [f.name for f in added]

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            new = fn(b.column(b.schema.get_field_index(text)).to_pylist())
            cols = [b.column(b.schema.get_field_index(c)) for c in kept] + [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, schema)
