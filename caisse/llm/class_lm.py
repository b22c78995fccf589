"""Language-model scores from Brown class-based bigrams.

P(word | previous word) = P(class | previous class) * P(word | class). Exchange
clustering assigns every training word to a class: a word moves to the class
that raises the likelihood of the class bigrams most. It runs in two parts:

* The most frequent words, and the endings of all others, move one after the
  other on the driver, over counts whose number the parameters bound.
* Every other training word moves in tasks. Its neighbours' classes are counted
  into one histogram a word (a table spread by word), and each word moves
  against the matrix of class bigrams, its own counts taken out. Each task keeps
  its copy of the matrix up to date, taking its own moves for a sample of all.

Only words never seen in training have the class of their ending. Words are told
apart by 64-bit hashes there. All counts cover all training documents, and the
number of classes grows with the vocabulary.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import WordHashes, cut, id_crc, require

#: Least number of classes, and classes per fourth root of the number of training words.
CLASSES, CLASSES_PER_ROOT = 32, 2
ROUNDS = 6
#: Words with at least this share of the training tokens move on the driver: at most 1 / HEAD_SHARE.
HEAD_SHARE = 3e-5
#: Words with at least this share have their counts and classes sent to all tasks: at most 1 / SHARE. The others' are joined.
SHARE = 1e-6
#: Groups of word endings (the last three bytes).
ENDINGS = 1024
ADD = 0.1
#: Words a task counts before it sends them on.
CHUNK = 300_000
#: Neighbours a task counts before it sends them on.
CELLS = 6_000_000
#: Cells of word histograms whose gains are computed at once.
STEP = 2_000
#: Key of a text's end among the words; no word holds a line feed.
END = b"\n"
END_CODE = 2**32 - 1
CELL = np.dtype([("cell", "<u2"), ("n", "<u4")])
#: Sums travel in blocks of this many cells.
BLOCK = 1 << 16
SUM = np.dtype([("cell", "<u2"), ("n", "<i8")])
#: A place among a text's rest words travels with its class in one number, its occurrences in another.
CLASS_SPAN, COUNT_SPAN = 1 << 16, 1 << 32


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def _hashes(words: list[bytes]) -> np.ndarray:
    return WordHashes(False)._long(b"\n".join(words) + b"\n") if words else np.zeros(0, dtype=np.uint64)


def _packed(codes: np.ndarray):
    """Codes compressed, the bytes of equal weight together."""
    import pyarrow as pa

    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the column text, each text's end included."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        def send():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
            c.clear()
            return out

        c = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                c.update(_words(t))
                c[END] += 1
                if len(c) > CHUNK:
                    yield send()
        if c:
            yield send()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of a short array as np.unique gives them: values, first places, number of each value, counts."""
    order = np.argsort(h, kind="stable")
    ordered, new = h[order], np.ones(len(h), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(h), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    return ordered[start], order[start], number, np.diff(np.r_[start, len(h)])


def encode_texts(docs: DataFrame, hashes: np.ndarray, counts: np.ndarray, ends: int) -> DataFrame:
    """Per row: the row's other columns, n_tokens, known, log_counts (of the lexicon's words and the end), codes, rest, tf, endings.

    hashes and counts: the lexicon; ends: the number of training texts. codes:
    each word's place in the lexicon, or its size plus the word's place in
    rest, then END_CODE (unsigned 32-bit numbers, ``_packed``). rest, tf, endings: hash,
    occurrences and ending of the text's distinct words outside the lexicon.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    order = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[order], order, np.log10(counts + ADD)))
    end_log, end_known = float(np.log10(ends + ADD)), int(ends > 0)
    kept = [c for c in docs.columns if c != "text"]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("log_counts", T.DoubleType())]
    added += [T.StructField(c, T.BinaryType()) for c in ("codes", "rest", "tf", "endings")]
    types = [pa.int64(), pa.int64(), pa.float64()] + [pa.binary()] * 4

    def run(batches):
        known, place, log = shared.value
        size, hasher = len(known), WordHashes(True)
        for b in batches:
            texts, out = b.column("text").to_pylist(), [[] for _ in added]
            for t, h in zip(texts, hasher(texts)):
                at = np.searchsorted(known, h)
                seen = known[np.minimum(at, size - 1)] == h if size else np.zeros(len(h), dtype=bool)
                code = np.full(len(h) + 1, END_CODE, dtype=np.int64)
                code[:-1][seen] = place[at[seen]]
                new = np.flatnonzero(~seen)
                rest, first, number, tf = _distinct(h[new])
                code[new] = size + number
                ws = _words(t) if len(new) else []
                endings = np.array([crc32(ws[i][-3:]) for i in new[first].tolist()], dtype=np.int64) % ENDINGS
                row = (len(h) + 1, int(seen.sum()) + end_known, float(log[code[:-1][seen]].sum()) + end_log, _packed(code))
                for column, v in zip(out, (*row, rest.astype("<u8").tobytes(), tf.astype("<u4").tobytes(), endings.astype("<u2").tobytes())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(out, types)], names=kept + [f.name for f in added])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + added))


def _joined(batch, name: str, dtype: str) -> np.ndarray:
    """The numbers in a binary column without nulls, row after row."""
    import pyarrow as pa

    column = batch.column(name)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=dtype)
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(dtype)


def _lengths(column, width: int) -> np.ndarray:
    """The numbers of ``width`` bytes in each value of a binary column without nulls."""
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // width


def _codes(batch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch's tokens, and their number in each row: rest words are numbered on through the batch, the end is -1."""
    import pyarrow as pa

    lengths = batch.column("n_tokens").to_numpy(zero_copy_only=False)
    at = np.cumsum(np.r_[0, lengths])
    raw, zstd = np.empty((4, at[-1]), dtype=np.uint8), pa.Codec("zstd")
    for i, j, x in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("codes").to_pylist()):
        raw[:, i:j] = np.frombuffer(zstd.decompress(x, 4 * (j - i)), dtype=np.uint8).reshape(4, -1)
    codes = np.ascontiguousarray(raw.T).view("<u4")[:, 0].astype(np.int64)
    rest = np.cumsum(np.r_[0, _lengths(batch.column("endings"), 2)])
    moved = np.where(codes >= size, codes + np.repeat(rest[:-1], lengths), codes)
    return np.where(codes == END_CODE, -1, moved), lengths


def _blocks(total: np.ndarray):
    """The counts above zero as one row (block, cells) for each BLOCK cells."""
    import pyarrow as pa

    block, cells = [], []
    for i in range(0, len(total), BLOCK):
        at = np.flatnonzero(total[i : i + BLOCK])
        if len(at):
            data = np.zeros(len(at), dtype=SUM)
            data["cell"], data["n"] = at, total[i : i + BLOCK][at]
            block.append(i // BLOCK)
            cells.append(data.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells, pa.binary())], names=["block", "cells"])


def _summed(blocks: DataFrame, size: int) -> np.ndarray:
    """Sums of the tasks' counts as an array; the number of cells is bounded by the parameters."""

    def add(batches):
        sums = {}
        for b in batches:
            for block, cells in zip(b.column("block").to_pylist(), b.column("cells").to_pylist()):
                data = np.frombuffer(cells, dtype=SUM)
                sums.setdefault(block, np.zeros(BLOCK, dtype=np.int64))[data["cell"]] += data["n"]
        for block, total in sums.items():
            yield from _placed(_blocks(total), block)

    out = np.zeros(-(-size // BLOCK) * BLOCK, dtype=np.int64)
    for row in blocks.repartition("block").mapInArrow(add, blocks.schema).collect():
        data = np.frombuffer(row["cells"], dtype=SUM)
        out[row["block"] * BLOCK + data["cell"].astype(np.int64)] += data["n"]
    return out[:size]


def _placed(batch, block: int):
    """The batch's only row under the number of its block."""
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), batch.column("cells")], names=["block", "cells"])


def context_counts(encoded: DataFrame, item_of: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """counts[item, side, class]: how often an item's left (0) and right (1) neighbour has a class.

    item_of: the items of the lexicon's words; other words have their ending's,
    the items before the last, which is the end's.
    """
    items, classes = len(class_of), int(class_of.max()) + 1
    shared = encoded.sparkSession.sparkContext.broadcast((item_of, class_of))

    def run(batches):
        item_of, class_of = shared.value
        total = np.zeros(items * 2 * classes, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                item = np.r_[item_of, items - 1 - ENDINGS + _joined(b, "endings", "<u2").astype(np.int64), items - 1][_codes(b, len(item_of))[0]]
                k = class_of[item]
                left = np.r_[classes - 1, k[:-1]]
                total += np.bincount((item * 2) * classes + left, minlength=len(total))
                total += np.bincount((item[:-1] * 2 + 1) * classes + k[1:], minlength=len(total))
        yield _blocks(total)

    found = encoded.select("n_tokens", "codes", "endings").mapInArrow(run, "block int, cells binary")
    return _summed(found, items * 2 * classes).reshape(items, 2, classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    """One round of exchange: every item in turn moves to its best class; the last class (the end) is fixed."""
    classes = counts.shape[2]
    class_of = class_of.copy()
    big = np.zeros((classes, classes))
    np.add.at(big, class_of, counts[:, 1, :])
    total = counts[:, 0, :].sum(1)
    for w in np.argsort(-total, kind="stable").tolist():
        a = class_of[w]
        if a == classes - 1 or not total[w]:
            continue
        left, right = counts[w, 0].astype(float), counts[w, 1].astype(float)
        n = total[w]
        big[:, a] -= left
        big[a] -= right
        np.maximum(big, 0, out=big)
        into, out = big.sum(0), big.sum(1)
        gain = (_f(big + left[:, None]) - _f(big)).sum(0) + (_f(big + right[None, :]) - _f(big)).sum(1) - _f(into + n) + _f(into) - _f(out + n) + _f(out)
        b = int(gain[: classes - 1].argmax())
        b = a if gain[b] <= gain[a] else b
        class_of[w] = b
        big[:, b] += left
        big[b] += right
    return class_of


def _number(h: np.ndarray) -> np.ndarray:
    """The number of each word in an array in which equal words stand together."""
    return np.cumsum(np.r_[False, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)


def _added(h: np.ndarray, cell: np.ndarray, n: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (h, cell) summed, in that order; ordered: by h already, each word's cells in a few ascending runs."""
    if ordered:
        order = np.argsort((_number(h) << 16) | cell, kind="stable")
    else:
        order = np.lexsort((cell.astype(np.uint16), h))
    h, cell, n = h[order], cell[order], n[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    return h[start], cell[start], np.add.reduceat(n, start, dtype=np.int64) if len(h) else n


def best_classes(h: np.ndarray, cell: np.ndarray, n: np.ndarray, now: np.ndarray, big: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, occurrences, best class) of each word; ``big`` follows the moves.

    h, cell, n: the words' histograms in order of h; a cell is the left
    neighbour's class, or the number of classes plus the right one's. now: the
    present class of each cell's word. big: bigrams of classes (doubles), the
    last of which is the end's. A word stays where no class is better; gains of
    its two sides are added, as if they never met in one cell of big. A few
    words move at once; then big takes what they change, ``weight`` times: the
    words of other tasks, spread by hash, do as much there.
    """
    classes = len(big)
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.add.reduceat(np.where(cell < classes, n, 0), start)
    present, best = now[start], np.zeros(len(start), dtype=np.int64)
    ends = np.r_[start[1:], len(h)]
    table = np.concatenate([big, big.T])
    lone = _f(table + 1) - _f(table)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, start[i] + STEP, side="right")))
        lo, hi = start[i], ends[j - 1]
        part, m, at = cell[lo:hi], n[lo:hi].astype(float), now[lo:hi]
        left, word = part < classes, np.repeat(np.arange(j - i), ends[i:j] - start[i:j])
        # Without the word: its own counts leave its present class on both sides. A lone neighbour of another class
        # changes one cell only; its other gains are those of all lone neighbours.
        gains = lone[part]
        own = part % classes == at
        few = np.flatnonzero((m == 1) & ~own)
        y = np.maximum(table[part[few], at[few]] - 1, 0)
        gains[few, at[few]] = _f(y + 1) - _f(y)
        many = np.flatnonzero((m != 1) | own)
        x, w = table[part[many]], word[many]
        x[np.arange(len(many)), at[many]] -= m[many]
        if own.any():
            counts = np.zeros((j - i, 2 * classes))
            counts[word, part] = m
            for side, other in ((left[many] & own[many], slice(classes, None)), (~left[many] & own[many], slice(None, classes))):
                x[side] -= counts[w[side], other]
        np.maximum(x, 0, out=x)
        gains[many] = _f(x + m[many, None]) - _f(x)
        first, size = start[i:j] - lo, ends[i:j] - start[i:j]
        gain = gains[first]
        for k in range(1, int(size.max())):
            longer = np.flatnonzero(size > k)
            gain[longer] += gains[first[longer] + k]
        total, words = count[i:j].astype(float), np.arange(j - i)
        kinds, of_kind = np.unique(total, return_inverse=True)
        for margin in (big.sum(0), big.sum(1)):
            lost = (_f(margin + kinds[:, None]) - _f(margin))[of_kind]
            y = np.maximum(margin[present[i:j]] - total, 0)
            lost[words, present[i:j]] = _f(y + total) - _f(y)
            gain -= lost
        to = gain[:, : classes - 1].argmax(1)
        best[i:j] = np.where(gain[words, to] > gain[words, present[i:j]] + 1e-9, to, present[i:j])
        if (best[i:j] != present[i:j]).any():
            for of, sign in ((at, -weight), (best[i:j][word], weight)):
                np.add.at(big, (part[left], of[left]), sign * m[left])
                np.add.at(big, (of[~left], part[~left] - classes), sign * m[~left])
            np.maximum(big, 0, out=big)
            table[:classes], table[classes:] = big, big.T
            lone = _f(table + 1) - _f(table)
        i = j
    return h[start], count, best


def move_words(train: DataFrame, lexicon: np.ndarray, class_of: np.ndarray, end_class: np.ndarray, head: int, big: np.ndarray, rest: bool) -> DataFrame:
    """One round in tasks: (h, n, class) of the lexicon's words from head on and, with rest, of all words outside it.

    A task sends one histogram for each word of some million neighbours, so a
    frequent word costs little; a word's histograms meet in one task, which
    holds one word's sum at a time.
    """
    import pyarrow as pa

    size, classes = len(lexicon), len(big)
    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = train.sparkSession.sparkContext.broadcast((lexicon.view(np.int64), class_of, end_class, big))

    def collect(batches):
        lexicon, class_of, end_class, _ = shared.value

        def send():
            h, cell, n = _added(*(np.concatenate(x) for x in zip(*held)))
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            data = np.zeros(len(h), dtype=CELL)
            data["cell"], data["n"] = cell, n
            offsets = (np.r_[start, len(h)] * CELL.itemsize).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(h[start], pa.int64()), column], names=["h", "cells"])

        held, cells = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            codes, _ = _codes(b, size)
            k = np.r_[class_of, end_class[_joined(b, "endings", "<u2")], classes - 1][codes]
            mine = np.flatnonzero((codes >= head) & (rest | (codes < size)))
            h = np.r_[lexicon, _joined(b, "rest", "<i8")][codes[mine]]
            left, right = np.r_[classes - 1, k[:-1]][mine], k[np.minimum(mine + 1, len(k) - 1)]
            cell = np.concatenate([left, classes + right, 2 * classes + k[mine]]).astype(np.uint16)
            held.append((np.tile(h, 3), cell, np.ones(len(cell), dtype=np.uint8)))
            cells += len(cell)
            if cells > CELLS:
                yield send()
                held, cells = [], 0
        if cells:
            yield send()

    def decide(batches):
        big = shared.value[3].astype(float)

        def moved(h, cell, n):
            # Cells from 2 * classes on hold the present class.
            own = cell >= 2 * classes
            number = _number(h)
            now = np.zeros(number[-1] + 1, dtype=np.int64)
            now[number[own]] = cell[own] - 2 * classes
            found = best_classes(h[~own], cell[~own], n[~own], now[number[~own]], big, tasks)
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int32())], names=["h", "n", "class"])

        kept = (np.zeros(0, dtype=np.int64),) * 3
        for b in batches:
            if not b.num_rows:
                continue
            h, data = b.column("h").to_numpy(zero_copy_only=False), _joined(b, "cells", CELL)
            each = _lengths(b.column("cells"), CELL.itemsize)
            new = (np.repeat(h, each), data["cell"].astype(np.int64), data["n"].astype(np.int64))
            whole = _added(*(np.r_[x, y] for x, y in zip(kept, new)), ordered=True)
            last = int(np.searchsorted(whole[0], h[-1]))
            if last:
                yield moved(*(x[:last] for x in whole))
            kept = tuple(x[last:] for x in whole)
        if len(kept[0]):
            yield moved(*kept)

    found = train.select("n_tokens", "codes", "rest", "endings").mapInArrow(collect, "h long, cells binary")
    return found.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(decide, "h long, n long, class int")


def class_bigrams(rows: DataFrame, classes: int, read, columns: list[str]) -> np.ndarray:
    """Counts of (previous class, class), ``read`` giving the classes of a batch's tokens, each text closed by the end's."""
    def run(batches):
        total = np.zeros(classes * classes, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                k = read(b)
                total += np.bincount(np.r_[classes - 1, k[:-1]] * classes + k, minlength=len(total))
        yield _blocks(total)

    return _summed(rows.select(*columns).mapInArrow(run, "block int, cells binary"), classes * classes).reshape(classes, classes)


def _refreshed(class_of: np.ndarray, lexicon: np.ndarray, moved: DataFrame, least: float) -> np.ndarray:
    """The lexicon's classes after a round; words of the lexicon are those with at least this many occurrences."""
    found = moved.filter(F.col("n") >= least).select("h", "class").toPandas()
    order, out = np.argsort(lexicon), class_of.copy()
    if len(found):
        out[order[np.searchsorted(lexicon[order], found["h"].to_numpy(dtype=np.int64).view(np.uint64))]] = found["class"]
    return out


def _kind(classes: int) -> str:
    """The narrowest unsigned numbers that hold the classes, the end's included."""
    return "<u1" if classes < 256 else "<u2"


def _with_classes(encoded: DataFrame, moved: DataFrame, class_of: np.ndarray, end_class: np.ndarray, classes: int) -> DataFrame:
    """Per row of ``encoded``: ``k``, the classes of its tokens (``_kind``), rest_known and rest_log of its rest words.

    Rest words get their class and count from ``moved`` by a join on the hash;
    those without a row there were never seen in training.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    size, kind = len(class_of), _kind(classes)
    shared = encoded.sparkSession.sparkContext.broadcast((class_of, end_class))

    def listed(batches):
        for b in batches:
            sizes = _lengths(b.column("rest"), 8)
            begins = np.cumsum(np.r_[0, sizes])
            rid = np.repeat(b.column("rid").to_numpy(zero_copy_only=False), sizes)
            place = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
            columns = [pa.array(rid, pa.int64()), pa.array(_joined(b, "rest", "<i8"), pa.int64()), pa.array(place * COUNT_SPAN + _joined(b, "tf", "<u4").astype(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "h", "at"])

    rest = encoded.select("rid", "rest", "tf").mapInArrow(listed, "rid long, h long, at long").join(moved, "h", "left")
    rest = rest.withColumns({"place": F.expr(f"`at` div {COUNT_SPAN}"), "tf": F.expr(f"`at` % {COUNT_SPAN}")})
    seen = F.col("n").isNotNull()
    rest = rest.groupBy("rid").agg(
        F.sum(F.when(seen, F.col("tf")).otherwise(0)).alias("rest_known"),
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("rest_log"),
        F.collect_list(F.when(seen, F.col("place") * CLASS_SPAN + F.col("class"))).alias("found"),
    )
    names = ["doc_id", "held_out", "n_tokens", "known", "log_counts", "rest_known", "rest_log"]
    rows = encoded.drop("rest", "tf").join(rest, "rid", "left").select(*names, "codes", "endings", "found")

    def run(batches):
        class_of, end_class = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            rest_class = end_class[_joined(b, "endings", "<u2")]
            begins = np.cumsum(np.r_[0, _lengths(b.column("endings"), 2)])
            found, of = b.column("found"), pc.list_value_length(b.column("found")).fill_null(0).to_numpy(zero_copy_only=False)
            placed = found.flatten().to_numpy(zero_copy_only=False)
            rest_class[np.repeat(begins[:-1], of) + placed // CLASS_SPAN] = placed % CLASS_SPAN
            codes, lengths = _codes(b, size)
            k = np.r_[class_of, rest_class, classes][codes].astype(kind)
            at = np.cumsum(np.r_[0, lengths])
            column = pa.array([k[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [column], names=names + ["k"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names) + ", k binary")


def class_lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Training documents are those whose crc32(id) mod 10 is not 0; a null id
    counts as empty text. A null text is empty: its end only. Scores are sums
    of log10 probabilities: base_score of additive unigrams, score of the class
    bigrams; perplexity is 10^(-score / n_tokens). ``classes`` unset grows with
    the number of training words. Equal rows count and are scored each. Without
    training documents scores are those of an empty model. An empty table gives
    an empty result. Other columns are ignored.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (id_crc(id_col) % 10 == 0).alias("held_out"), F.col(text_col).alias("text"))
    counts = cut(count_words(rows.filter("not held_out")))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("ends")).first()
    total, types, ends = size["n"], size["v"], size["ends"] or 0
    classes = classes or max(CLASSES, round(CLASSES_PER_ROOT * types**0.25))
    often = counts.filter((F.col("n") >= SHARE * total) & (F.col("word") != F.lit(END))).orderBy(F.desc("n"), "word").toPandas()
    words, n = [bytes(w) for w in often["word"]], often["n"].to_numpy(dtype=np.int64)
    lexicon = _hashes(words)
    head = int((n >= HEAD_SHARE * total).sum())
    encoded = cut(encode_texts(rows.withColumn("rid", F.monotonically_increasing_id()), lexicon, n, ends))
    train = encoded.filter("not held_out")

    # Items: the head's words, the endings, the end.
    item_of = np.array([i if i < head else head + _ending(w) for i, w in enumerate(words)], dtype=np.int64)
    items = np.r_[np.arange(head) % classes, np.arange(ENDINGS) % classes, classes]
    for _ in range(rounds):
        new = exchange(context_counts(train, item_of, items), items)
        if (new == items).all():
            break
        items = new
    class_of, end_class = items[item_of], items[head : head + ENDINGS]

    # All other words: those of the lexicon first, then all of them beside the lexicon's new classes.
    for rest in (False, True):
        of = class_of

        def read(b):
            return np.r_[of, end_class[_joined(b, "endings", "<u2")], classes][_codes(b, len(of))[0]]

        big = class_bigrams(train, classes + 1, read, ["n_tokens", "codes", "endings"])
        moved = cut(move_words(train, lexicon, class_of, end_class, head, big, rest))
        class_of = _refreshed(class_of, lexicon, moved, SHARE * total)
    kinds = moved.groupBy("class").count().toPandas()
    class_types = np.bincount(class_of[:head], minlength=classes + 1).astype(float)
    class_types[kinds["class"].to_numpy(dtype=np.int64)] += kinds["count"].to_numpy()
    class_types[classes] += ends > 0

    known = cut(_with_classes(encoded, moved, class_of, end_class, classes))
    kind = _kind(classes)
    pairs = class_bigrams(known.filter("not held_out"), classes + 1, lambda b: _joined(b, "k", kind).astype(np.int64), ["k"])
    class_tokens = pairs.sum(0)
    emit = np.log10(class_tokens + ADD * (class_types + 1))
    share = (class_tokens + 1) / (class_tokens + 1).sum()
    move = np.log10((pairs + classes * share) / (pairs.sum(1, keepdims=True) + classes))
    model = docs.sparkSession.sparkContext.broadcast((move, emit))

    def transitions(batches):
        import pyarrow as pa

        move, emit = model.value
        for b in batches:
            if not b.num_rows:
                continue
            k = _joined(b, "k", kind).astype(np.int64)
            step = move[np.r_[len(emit) - 1, k[:-1]], k] - emit[k]
            at = np.cumsum(np.r_[0, _lengths(b.column("k"), np.dtype(kind).itemsize)])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(np.add.reduceat(step, at[:-1]))], names=names + ["moves"])

    names = [c for c in known.columns if c != "k"]
    kinds_of = dict(known.dtypes)
    scored = known.mapInArrow(transitions, ", ".join(f"{c} {kinds_of[c]}" for c in names) + ", moves double")
    log = F.col("log_counts") + F.coalesce("rest_log", F.lit(0.0))
    base = float(np.log10(total + ADD * (types + 1)))
    out = scored.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (log - F.col("n_tokens") * F.lit(base)).alias("base_score"), (log + F.col("moves")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
