"""Byte-level BPE by merge replay.

All new words of a block of texts are laid out in one array of tokens, and each
word's merges are replayed in rank order. Words do not act on each other, so
the short ones (nearly all) advance together: one wave of array operations
finds and applies the next merge of every word, without an index.

The few words longer than SHORT bytes go through a queue of ranks over an
inverted index: for each token pair that a merge rank knows, the positions
where it stands. A merge touches only its neighbours, whose new pairs enter the
index, so the work does not grow with the square of a word. Words are gathered
per block and task, not for the corpus.
"""

from __future__ import annotations

import base64
import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import map_texts, require

#: Words whose ids a task remembers.
MEMO = 300_000
#: Token pairs whose rank a task remembers.
PAIRS = 1_000_000
#: Characters of texts split into words at once; a longer text goes alone.
PIECE = 1 << 20
#: Words up to so many bytes are replayed in waves, which are fewer than that.
SHORT = 64
#: Rank of a pair that does not merge.
NONE = np.iinfo(np.int64).max


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


class Pairs(dict):
    """Rank of the token that two tokens make, by ``left << 32 | right``; None where there is none. Filled as pairs come up."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}

    def __missing__(self, pair: int):
        rank = self[pair] = self.ranks.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF])
        return rank


def replay_merges(words: list[bytes], ranks: dict[bytes, int], pairs: Pairs | None = None) -> list[list[int]]:
    """Ids of each word: always the adjacent pair of the lowest rank merges first, the leftmost of equals."""
    pairs = Pairs(ranks) if pairs is None else pairs
    out: list[list[int]] = [[]] * len(words)
    short, long = [], []
    for i, w in enumerate(words):
        whole = ranks.get(w)
        if whole is not None:
            out[i] = [whole]
        elif w:
            (short if len(w) <= SHORT else long).append(i)
    alphabet = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
    for todo, replay in ((short, _replay_waves), (long, _replay_queue)):
        if not todo:
            continue
        # One array of byte tokens for all words.
        sizes = np.array([len(words[i]) for i in todo])
        byte = alphabet[np.frombuffer(b"".join([words[i] for i in todo]), dtype=np.uint8)]
        if (byte < 0).any():
            raise ValueError("a byte of the texts has no rank")
        for at, ids, ends in replay(byte, sizes, pairs):
            start = 0
            for i, end in zip(at, ends):
                out[todo[i]] = ids[start:end]
                start = end
    return out


def _index(left: np.ndarray, right: np.ndarray, pairs: Pairs) -> np.ndarray:
    """Rank of each pair, looked up once per distinct pair; NONE where it does not merge."""
    keys, inverse = np.unique((left << 32) | right, return_inverse=True)
    found = np.array([NONE if (r := pairs[k]) is None else r for k in keys.tolist()], dtype=np.int64)
    return found[inverse]


def _replay_waves(token: np.ndarray, sizes: np.ndarray, pairs: Pairs):
    """(word numbers, ids, ends of the words' ids) of the words that each wave finds settled.

    ``rank`` holds for each position the rank of the pair that begins there;
    in a wave every word that has one merges its leftmost pair of lowest rank.
    """
    word = np.arange(len(sizes))
    ends = np.cumsum(sizes)
    rank = np.full(len(token), NONE)
    inner = np.ones(len(token), dtype=bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    rank[at] = _index(token[at], token[at + 1], pairs)
    while len(word):
        low = np.minimum.reduceat(rank, ends - sizes)
        settled = low == NONE
        if settled.any():
            rows = np.repeat(settled, sizes)
            yield word[settled].tolist(), token[rows].tolist(), np.cumsum(sizes[settled]).tolist()
            token, rank, word, sizes, low = token[~rows], rank[~rows], word[~settled], sizes[~settled], low[~settled]
            if not len(word):
                return
        ends = np.cumsum(sizes)
        hit = np.flatnonzero(rank == np.repeat(low, sizes))
        of = np.searchsorted(ends, hit, side="right")
        hit = hit[np.r_[True, of[1:] != of[:-1]]]
        token[hit] = low
        rest = np.ones(len(token), dtype=bool)
        rest[hit + 1] = False
        # The pair of the token that goes is gone; each word is one token shorter.
        token, rank = token[rest], rank[rest]
        hit = hit - np.arange(len(hit))
        sizes = sizes - 1
        ends = np.cumsum(sizes)
        rank[hit] = NONE
        right = hit[hit + 1 < ends]
        left = hit[hit > ends - sizes] - 1
        touched = np.concatenate([right, left])
        if len(touched):
            rank[touched] = _index(token[touched], token[touched + 1], pairs)


def _replay_queue(byte: np.ndarray, sizes: np.ndarray, pairs: Pairs):
    """As _replay_waves, all words at once: a queue of ranks, each with the positions where its pair begins."""
    starts = np.cumsum(sizes) - sizes
    n = len(byte)
    # Links between neighbours; a word's last token has no next one.
    nxt = np.arange(1, n + 1)
    nxt[starts + sizes - 1] = -1
    prev = np.arange(-1, n - 1)
    prev[starts] = -1
    # The inverted index: rank of a pair to the positions where the pair begins.
    at = np.flatnonzero(nxt >= 0)
    keys, inverse = np.unique((byte[at] << 32) | byte[nxt[at]], return_inverse=True)
    rank_of = np.array([-1 if (r := pairs[k]) is None else r for k in keys.tolist()], dtype=np.int64)[inverse] if len(keys) else np.zeros(0, dtype=np.int64)
    order = np.argsort(rank_of, kind="stable")
    order = order[np.searchsorted(rank_of[order], 0) :]
    first = np.flatnonzero(np.r_[True, np.diff(rank_of[order]) > 0]) if len(order) else np.zeros(0, dtype=np.int64)
    index = {int(r): p.tolist() for r, p in zip(rank_of[order][first], np.split(at[order], first[1:]))} if len(order) else {}
    word_of = np.repeat(np.arange(len(sizes)), sizes)
    token, after, before = byte.tolist(), nxt.tolist(), prev.tolist()
    queue = list(index)
    heapq.heapify(queue)
    push = heapq.heappush
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        if len(places) > 1:
            places.sort()
        waiting = None
        for p in places:
            left = token[p]
            q = after[p]
            if left < 0 or q < 0 or pairs[left << 32 | token[q]] != rank:
                continue  # the pair here has changed since
            if waiting and word_of[p] in waiting:
                # A lower rank has come up in this word; it goes first.
                if rank not in index:
                    index[rank] = []
                    push(queue, rank)
                index[rank].append(p)
                continue
            token[p] = rank
            token[q] = -1
            q = after[p] = after[q]
            if q >= 0:
                before[q] = p
                r = pairs[rank << 32 | token[q]]
                if r is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        push(queue, r)
                    if r < rank:
                        waiting = (waiting or set()) | {word_of[p]}
            q = before[p]
            if q >= 0:
                r = pairs[token[q] << 32 | rank]
                if r is not None:
                    if r in index:
                        index[r].append(q)
                    else:
                        index[r] = [q]
                        push(queue, r)
                    if r < rank:
                        waiting = (waiting or set()) | {word_of[p]}
    left = np.array(token)
    yield list(range(len(sizes))), left[left >= 0].tolist(), np.cumsum(np.add.reduceat((left >= 0).astype(np.int64), starts)).tolist()


class Encoder:
    """Ids (little-endian int32 bytes) of whole texts; each match of the pattern is a word."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split, self.memo, self.pairs = ranks, regex.compile(pattern).findall, {}, Pairs(ranks)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        memo = self.memo
        words = [self.split(t) if t else [] for t in texts]
        if len(memo) > MEMO:
            memo.clear()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        new = list({w for ws in words for w in ws if w not in memo})
        for w, ids in zip(new, replay_merges([w.encode("utf-8", "surrogatepass") for w in new], self.ranks, self.pairs)):
            memo[w] = struct.pack(f"<{len(ids)}i", *ids)
        return [b"".join(map(memo.__getitem__, ws)) for ws in words]


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row of ``docs``; a null text has no ids. Special tokens are ordinary text.

    The merges are replayed per PIECE characters of texts over their words that
    the task does not remember.
    """
    require(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)
    state = {}

    def ids(texts):
        import pyarrow as pa

        if "e" not in state:
            state["e"] = Encoder(read_ranks(shared.value), pattern)
        raw, a = [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= PIECE):
                size += len(texts[b] or "")
                b += 1
            raw += state["e"](texts[a:b])
            a = b
        ends = np.cumsum([0] + [len(r) // 4 for r in raw]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))]

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ids, "ids array<int>")


def decode(encoded: DataFrame, ranks_file: bytes, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with the bytes of their ids as the column ``decoded``, in place of nothing."""
    from pyspark.sql import types as T

    shared = encoded.sparkSession.sparkContext.broadcast(ranks_file)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        ranks = read_ranks(shared.value)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        for b in batches:
            col = b.column(b.schema.get_field_index(ids_col))
            out = []
            for i in range(len(col)):
                one = col[i].values
                out.append(b"".join(map(tokens.__getitem__, one.to_numpy(zero_copy_only=False).tolist())) if one is not None else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, ranks_file: bytes, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (bytes decoded from the ids)."""
    back = decode(encode(docs, ranks_file, pattern), ranks_file)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
