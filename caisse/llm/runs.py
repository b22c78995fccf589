"""Periodic runs of words, by suffix trees and Lyndon roots.

A run is a stretch of words with a smallest period q that no neighbouring word
extends. Every run holds a Lyndon word of length q, under an order of the words
or its reverse, that is the longest Lyndon word starting where it starts. So
each position gives one candidate per order; its period is extended to the
right and to the left by longest common extensions (LCE):

* Ukkonen's algorithm builds the suffix trees of the word sequence and of its
  reversal;
* an Euler tour of a tree and a table of minima over powers of two answer the
  lowest common ancestor of two leaves in constant time, for all candidates
  together; its depth is the LCE;
* the leaves' order in the forward tree ranks the suffixes, and the next
  smaller suffix of each position ends its longest Lyndon word.

Only long runs are asked for (at least MIN_WORDS words and MIN_PERIODS
periods), and in those every window of WINDOW words occurs at least twice. A
document is therefore first reduced, without losing a run, to its stretches of
repeated windows; each stretch gets its trees.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import WordHashes, map_texts, require, windows_hash, words_of

MIN_WORDS = 6
MIN_PERIODS = 4
#: Every window of so many words inside a run of MIN_WORDS words and MIN_PERIODS periods occurs in it twice.
WINDOW = 5


class SuffixTree:
    """Suffix tree of a sequence of symbols >= 1, ended by the symbol 0; built from left to right in linear time."""

    def __init__(self, symbols: list[int]):
        s = self.s = [*symbols, 0]
        n = self.n = len(s)
        width = self.width = max(s) + 1
        # Edges by ``parent * width + first symbol``; an edge bears s[begin[child]:end[child]].
        edge, begin, end, link = {}, [0], [0], [0]
        leaves = []
        node = at = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    at = i
                key = node * width + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(begin)
                    leaves.append(len(begin))
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    size = end[child] - begin[child]
                    if length >= size:
                        node = child
                        at += size
                        length -= size
                        continue
                    here = begin[child] + length
                    if s[here] == c:
                        length += 1
                        if made:
                            link[made] = node
                        break
                    mid = len(begin)
                    leaf = mid + 1
                    edge[key] = mid
                    begin += (begin[child], i)
                    end += (here, n)
                    link += (0, 0)
                    begin[child] = here
                    edge[mid * width + c] = leaf
                    edge[mid * width + s[here]] = child
                    leaves.append(leaf)
                    if made:
                        link[made] = mid
                    made = mid
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        self.leaves = np.array(leaves)
        self.size = np.array(end) - np.array(begin)
        parent_symbol = np.fromiter(edge.keys(), dtype=np.int64, count=len(edge))
        self.parent, self.symbol = parent_symbol // width, parent_symbol % width
        self.child = np.fromiter(edge.values(), dtype=np.int64, count=len(edge))

    def _walk(self, descending: bool) -> tuple[list[int], list[int], np.ndarray]:
        """Euler tour (depths), place of each node's first visit, order of the leaves; the end symbol always comes first."""
        symbol = np.where(self.symbol > 0, self.width - self.symbol, 0) if descending else self.symbol
        order = np.lexsort((symbol, self.parent))
        kids = self.child[order].tolist()
        nodes = len(self.size)
        bounds = np.searchsorted(self.parent[order], np.arange(nodes + 1)).tolist()
        at, stop = bounds[:-1], bounds[1:]
        size, depth, first = self.size.tolist(), [0] * nodes, [0] * nodes
        tour, seen, path = [0], [], [0]
        while path:
            v = path[-1]
            k = at[v]
            if k == stop[v]:
                path.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            at[v] = k + 1
            child = kids[k]
            d = depth[child] = depth[v] + size[child]
            first[child] = len(tour)
            tour.append(d)
            if at[child] == stop[child]:
                seen.append(child)
                tour.append(depth[v])
            else:
                path.append(child)
        return tour, first, np.array(seen)

    def ranks(self, descending: bool = False) -> np.ndarray:
        """Rank of each suffix among all, by the symbols' order or its reverse; a prefix comes before its extensions."""
        return self._ranks(self._walk(descending)[2])

    def _ranks(self, seen: np.ndarray) -> np.ndarray:
        number = np.zeros(len(self.size), dtype=np.int64)
        number[seen] = np.arange(len(seen))
        return number[self.leaves]

    def index(self) -> np.ndarray:
        """Prepare ``lce``; returns the ranks of the suffixes."""
        tour, first, seen = self._walk(False)
        self.place = np.array(first, dtype=np.int64)[self.leaves]
        self.table = [np.array(tour, dtype=np.int32)]
        while 1 << len(self.table) <= len(tour):
            low, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(low[:-half], low[half:]))
        return self._ranks(seen)

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (a != b), each in constant time."""
        x, y = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(x), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][x[at]], self.table[k][y[at] + 1 - (1 << k)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position: the distance to the next smaller suffix."""
    r = rank.tolist()
    n = len(r)
    smaller = [n] * n
    for i in range(n - 1, -1, -1):
        j = i + 1
        mine = r[i]
        while j < n and r[j] > mine:
            j = smaller[j]
        smaller[i] = j
    return np.array(smaller) - np.arange(n)


def stretch_runs(symbols: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least ``min_words`` symbols and ``min_periods`` (two or more) periods."""
    n = len(symbols)
    if n < min_words:
        return []
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    up = ahead.index()[:n]
    back.index()
    start = np.tile(np.arange(n), 2)
    period = np.concatenate([lyndon_lengths(up), lyndon_lengths(ahead.ranks(descending=True)[:n])])
    # A longer period cannot fill enough of the stretch.
    fits = min_periods * period <= n
    start, period = start[fits], period[fits]
    right = ahead.lce(start, start + period)
    left = np.zeros(len(start), dtype=np.int64)
    inner = start > 0
    left[inner] = back.lce(n - start[inner], n - start[inner] - period[inner])
    length = left + period + right
    ok = (length >= min_words) & (length >= min_periods * period)
    return sorted(set(zip((start - left)[ok].tolist(), length[ok].tolist(), period[ok].tolist())))


def stretches(word_hashes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which each window of words occurs twice; equal words have equal hashes.

    Windows that occur once are taken out, and again inside each part that is
    left, until nothing goes. Equal hashes of unlike windows only leave more.
    """
    out, todo = [], [(0, windows_hash(word_hashes, window))]
    while todo:
        first, h = todo.pop()
        if len(h) < 2:
            continue
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.all():
            out.append((first, first + len(h) + window - 1))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]])))
        todo += [(first + a, h[a:b]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a > 1]
    return sorted(out)


def document_runs(words: list[bytes], word_hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document's words, by start, then period."""
    out = []
    for a, b in stretches(word_hashes):
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(w, len(number) + 1) for w in words[a:b]]
        out += [(a + start, length, period) for start, length, period in stretch_runs(symbols)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, runs and collapsed in place of the text.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they stand. runs holds
    (start, length, period) in words, by start, then period, of each stretch
    with smallest period q and at least max(6, 4 * q) words that no neighbouring
    word extends. collapsed is the text of the words that no run holds after
    its first q words, joined by one space. A null or empty text has no words,
    no runs and an empty collapsed text. Rows are independent: repeated rows
    get equal results, an empty table none. Other columns pass unchanged; one
    that is named like a new column is replaced by it.

    A text is held by one task; its trees take some 1.5 kB a word of its
    repeated stretches.
    """
    require(docs, text_col)
    state = {}

    def find(texts):
        if "hashes" not in state:
            state["hashes"] = WordHashes(lower=False)
        sizes, found, kept = [], [], []
        for text, hashes in zip(texts, state["hashes"](texts)):
            words = words_of(text)
            runs = document_runs(words, hashes)
            sizes.append(len(words))
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            kept.append(b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass"))
        return sizes, found, kept

    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in ("n_words", "runs", "collapsed")))
    return map_texts(rows, text_col, find, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first; null without a run."""
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_runs, the best run's start, length, period and exponent_milli, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs.select("doc_id", "text")).withColumn("best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def plant_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one in ten documents the words from a place on repeat with a period, both set by the id's crc32.

    With h = crc32(doc_id), g = h div 10 and n words, if 10 divides h and n > 0
    each word i >= a becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8); words are then joined by one space. A
    null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr("crc32(binary(string(doc_id))) div 10").alias("g"))
    rows = rows.withColumn("a", F.expr("case when size(w) > 0 then g % size(w) end"))
    rows = rows.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, int(a + (i - a) % p) + 1))), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
