"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule.

A document longer than a sequence is cut; all its pieces but the first fill a
sequence each. The partial pieces are packed in shards of a bounded number of
documents: longest first, each goes into the open bin whose choice makes the
sum over residual gaps of (open bins with that gap) squared smallest; a new bin
is opened when none has room.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import cut, map_texts, require

CAPACITY = 1024
END_ID = 2
#: Documents packed together by one task. Each shard leaves a few bins unfilled, whatever its size.
SHARD = 60_000
#: Words whose ids a task remembers.
MEMO = 400_000

#: Splits of a text before its merges, as the vocabulary's own pre-tokenizer makes them (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ODD = re.compile(r" (?:\s|$)")
_SPACE = re.compile(r" (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(vocabulary: str, added_tokens: bool = True):
    """Function from a list of texts to their id lists, for a byte-level BPE file of the tokenizers library.

    Where the file's merges stand in the order of the ids they make, the
    faster tiktoken merges by rank, with the same result; else the tokenizers
    library itself encodes. Special tokens' strings are ordinary text, unless
    the library encodes with ``added_tokens``.
    """
    letters = _byte_letters()
    model = json.loads(vocabulary)["model"]
    special = {t["content"] for t in json.loads(vocabulary).get("added_tokens", [])}
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    if model.get("type", "BPE") == "BPE" and None not in made and all(a < b for a, b in zip(made, made[1:])):
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [encode(t) for t in texts]
    return _library(vocabulary, added_tokens)


def _library(vocabulary: str, added_tokens: bool):
    """As ``load_vocabulary``, by the tokenizers library, without threads of its own: Spark runs a task per core."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    t = Tokenizer.from_str(vocabulary)
    t.encode_special_tokens = not added_tokens
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    No token of the vocabulary's pre-tokenizer crosses a space before a
    non-space character, so the words between such spaces are encoded apart
    and remembered. Unless ``added_tokens`` is off, texts are first cut at the file's
    added tokens, the longest at the leftmost place, as the tokenizers library
    does; files whose added tokens take in more than their own string are left
    to the library.
    """

    def __init__(self, vocabulary: str, added_tokens: bool = True):
        self.memo, self.added, self.whole = {}, None, False
        file = json.loads(vocabulary)
        tokens = file.get("added_tokens", []) if added_tokens else []
        if tokens:
            self.whole = bool(file.get("normalizer")) or len({t["normalized"] for t in tokens}) > 1 or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens)
            self.added = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(tokens, key=lambda t: -len(t["content"]))) + ")")
            self.token = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in tokens}
        self.encode = _library(vocabulary, added_tokens) if self.whole else load_vocabulary(vocabulary, added_tokens)
        # Bytes that each id stands for: a letter of the file is a byte.
        vocab = file["model"]["vocab"]
        self.size = np.zeros(max(vocab.values(), default=-1) + 1, dtype=np.int64)
        self.size[list(vocab.values())] = [len(t) for t in vocab]

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.encode(texts)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space: encoded in a row and parted by the bytes that the ids stand for."""
        ids = np.array(self.encode([" " + " ".join(words)])[0], dtype="<u4")
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends[:-1] * 4).tolist()], (ends * 4).tolist())]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.whole:
            return self._bytes([t or "" for t in texts])
        if self.added is None:
            return self._ordinary(texts)
        parts = [self.added.split(t) if t else [""] for t in texts]
        ids = iter(self._ordinary([x for p in parts for x in p[::2]]))
        return [b"".join(self.token[x] if k % 2 else next(ids) for k, x in enumerate(p)) for p in parts]

    def _ordinary(self, texts: list[str | None]) -> list[bytes]:
        parts = [(_SPACE.split(t) if _ODD.search(t) else t.split(" ")) if t else [""] for t in texts]
        heads = self._bytes([p[0] for p in parts])
        out = []
        for head, p in zip(heads, parts):
            memo = self.memo
            ids = list(map(memo.get, p[1:]))
            if None in ids:
                if len(memo) > MEMO:
                    memo.clear()
                new = list({w for w, i in zip(p[1:], ids) if i is None})
                memo.update(zip(new, self._words(new)))
                ids = [i if i is not None else memo[w] for w, i in zip(p[1:], ids)]
            out.append(head + b"".join(ids))
        return out


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, added_tokens: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids) of each document's ids and the end id; ids: little-endian unsigned 32-bit.

    ``vocabulary`` is the content of the tokenizer's JSON file. Its added
    tokens' strings get their own ids, as from the tokenizers library by
    default; without ``added_tokens`` they are ordinary text. A null text is
    empty: one piece that holds the end id. Only the first piece may be
    shorter than ``capacity``.
    """
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    state = {}

    def pieces(texts):
        if "e" not in state:
            state["e"] = Encoder(shared.value, added_tokens)
        out = []
        end = np.array([end_id], dtype="<u4").tobytes()
        for ids in state["e"](texts):
            ids += end
            n = len(ids) // 4
            first = n - capacity * (math.ceil(n / capacity) - 1)
            bounds = [0, *range(first, n + 1, capacity)]
            out.append([{"piece": i, "start": a, "length": b - a, "ids": ids[4 * a : 4 * b]} for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])
        return [out]

    rows = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", pieces, "p array<struct<piece:int,start:long,length:long,ids:binary>>")
    return rows.select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the order given."""
    n = np.zeros(capacity + 1)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # Half of what the sum of squares grows by when a bin of gap g becomes one of gap g - s (a full bin counts no more).
        here = n[s:]
        change = n[: len(here)] - here + 1
        change[0] = 0.5 - here[0]
        change[here == 0] = np.inf
        j = int(change.argmin())
        if change[j] < np.inf:
            gap = s + j
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            n[gap - s] += 1
            open_bins[gap - s].append(b)
    return where, offset


def pack(pieces: DataFrame, n_docs: int, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length and any other columns) with sequence_id and offset.

    Sequences are gapless from offset 0. Ties of length go by doc_id, nulls
    first; repeated rows are packed each. ``n_docs`` sets the number of shards.
    """
    shards = max(1, math.ceil(n_docs / shard))
    numbered = cut(pieces.withColumn("sequence_id", F.monotonically_increasing_id()))
    full = numbered.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("sequence_id"), "offset": F.lit(0).cast("long")})
    columns = full.columns

    def place(pdf):
        pdf = pdf.sort_values(["length", "sequence_id"], ascending=[False, True], kind="stable")
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = pdf["__shard"].astype("int64") * (1 << 40) + where
        pdf["offset"] = offset
        return pdf[columns]

    part = numbered.filter(F.col("length") < capacity).withColumn("__shard", F.pmod(F.xxhash64("sequence_id"), F.lit(shards)).cast("int"))
    return full.union(part.groupBy("__shard").applyInPandas(place, full.schema))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty table gives no rows."""
    pieces = token_pieces(docs, vocabulary, id_col, text_col, added_tokens=added_tokens)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests, docs.count())
