"""Language identification by multilingual mixture inference.

Every language is a smoothed distribution of letter trigrams, counted over all
training documents. A document is a mixture of languages: expectation-
maximisation estimates their proportions from the trigram likelihoods. The set
of languages is then chosen by penalised likelihood: languages leave the
mixture one by one as long as that does not cost more log-likelihood than the
penalty of a free parameter (BIC). The largest proportion names the document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.llm.common import id_crc, map_texts, require

#: Trigrams are hashed into so many cells; the model holds at most this many numbers per language.
CELLS = 1 << 16
#: Rounds of expectation-maximisation for each set of languages.
ROUNDS = 20
ADD = 0.5
#: Characters whose trigrams are worked on at once, which bounds a task's arrays; a single longer text is counted slice by slice.
PIECE = 1 << 18
#: Labels that a task adds up at once in training.
LABELS = 64
UNKNOWN = "und"


def penalty(total: np.ndarray) -> np.ndarray:
    """Log-likelihood that one more language must bring in a text of so many trigrams."""
    return 0.5 * np.log(np.maximum(total, 2)) + 2.0


def _letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Trigrams:
    """Cells of the letter trigrams of texts: one for each letter, with its two neighbours (0 beside a word's end)."""

    def __init__(self):
        self.letter = _letters()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of each trigram of all texts; the work arrays take some 50 bytes a character."""
        return self._cells([(i, t.lower(), 0, 0) for i, t in enumerate(texts) if t])

    def _cells(self, parts: list[tuple[int, str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of parts (row, lowered text, characters of context before it, after it); a context has no trigram of its own."""
        cp = np.frombuffer("\n".join(["", *(t for _, t, _, _ in parts), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cp = np.where(self.letter[cp], cp, 0).astype(np.uint64)
        size = np.array([len(t) + 1 for _, t, _, _ in parts], dtype=np.int64)
        row = np.repeat(np.array([r for r, _, _, _ in parts], dtype=np.int64), size)
        h = cp[:-2] * np.uint64(0x9E3779B97F4A7C15) + cp[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + cp[2:] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        own = cp[1:-1] > 0
        first = np.cumsum(size) - size
        own[first[[k for k, x in enumerate(parts) if x[2]]]] = False
        own[[int(first[k]) + len(x[1]) - 1 for k, x in enumerate(parts) if x[3]]] = False
        mid = np.flatnonzero(own)
        return row[mid], (h[mid] >> np.uint64(48)).astype(np.int64) % CELLS

    def counts(self, texts: list[str | None]):
        """(first row, rows, ``row * CELLS + cell``, n) of runs of whole texts, in order; keys count from the first row.

        A run holds about PIECE characters, or one longer text, which is
        walked in slices with a character of context on both sides.
        """
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= PIECE):
                size += len(texts[b] or "")
                b += 1
            if size <= PIECE:
                row, cell = self(texts[a:b])
                key, n = np.unique(row * CELLS + cell, return_counts=True)
            else:
                low, n = texts[a].lower(), np.zeros(CELLS, dtype=np.int64)
                for at in range(0, len(low), PIECE):
                    before, after = int(at > 0), int(at + PIECE < len(low))
                    n += np.bincount(self._cells([(0, low[at - before : at + PIECE + after], before, after)])[1], minlength=CELLS)
                key = np.flatnonzero(n)
                n = n[key]
            yield a, b - a, key, n
            a = b


def count_trigrams(train: DataFrame) -> DataFrame:
    """(lang, cell, n) over all rows (lang, text); each task adds up its own rows, for up to LABELS labels at a time, before the shuffle."""
    import pyarrow as pa

    def rows(totals):
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "cell", "n"])

    def run(batches):
        grams, totals = Trigrams(), {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for first, _, key, n in grams.counts(texts):
                ends = np.flatnonzero(np.diff(key // CELLS, append=-1)) + 1
                for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    name = langs[first + int(key[lo]) // CELLS]
                    if name not in totals:
                        if len(totals) >= LABELS:
                            yield from rows(totals)
                            totals = {}
                        totals[name] = np.zeros(CELLS, dtype=np.int64)
                    totals[name][key[lo:hi] % CELLS] += n[lo:hi]
        yield from rows(totals)

    return train.select("lang", "text").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Mixture:
    """Proportions of languages in texts under a trigram model (languages x cells log-probabilities)."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.p, self.grams = langs, np.ascontiguousarray(np.exp(logp).T.astype(np.float32)), Trigrams()

    def _em(self, p: np.ndarray, n: np.ndarray, row: np.ndarray, alive: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood per row; p: trigrams x languages, row ascending, alive: rows x languages."""
        w = (alive / alive.sum(1, keepdims=True)).astype(np.float32)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[first, len(row)])
        at = row[first]
        total = np.add.reduceat(n, first)
        for _ in range(rounds):
            joint = p * np.repeat(w[at], size, axis=0)
            joint *= (n / joint.sum(1))[:, None]
            w[at] = np.add.reduceat(joint, first, axis=0) / total[:, None]
        like = np.zeros(len(alive))
        like[at] = np.add.reduceat(n * np.log((p * np.repeat(w[at], size, axis=0)).sum(1)).astype(np.float64), first)
        return w, like

    def _eliminate(self, p, n, row, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, languages left) of documents in which languages leave the mixture one at a time."""
        total = np.bincount(row, n, rows)
        alive = np.ones((rows, p.shape[1]), dtype=np.float32)
        best, like = self._em(p, n, row, alive, ROUNDS)
        going = np.ones(rows, dtype=bool)
        while True:
            going &= alive.sum(1) > 1
            tried = np.flatnonzero(going)
            if not len(tried):
                return best, alive
            trial = alive[tried].copy()
            trial[np.arange(len(tried)), np.where(trial > 0, best[tried], 2).argmin(1)] = 0
            mine, new = going[row], np.zeros(rows, dtype=np.int64)
            new[tried] = np.arange(len(tried))
            # All rows tried have lost as many languages; one that is left alone has all, without any round.
            w, l = self._em(p[mine], n[mine], new[row[mine]], trial, ROUNDS if trial[0].sum() > 1 else 0)
            better = l >= like[tried] - penalty(total[tried])
            ok = tried[better]
            alive[ok], best[ok], like[ok] = trial[better], w[better], l[better]
            going[tried[~better]] = False

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language, its proportion (0 without letters) and the number of languages found, per text."""
        names, score, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if not self.langs:
            return names, score, found
        for first, _, key, n in self.grams.counts(texts):
            if not len(key):
                continue
            given, row = np.unique(key // CELLS, return_inverse=True)
            w, alive = self._eliminate(self.p[key % CELLS], n.astype(np.float32), row, len(given))
            for i, k, x, a in zip((first + given).tolist(), w.argmax(1).tolist(), w.max(1).tolist(), alive.sum(1).tolist()):
                names[i], score[i], found[i] = self.langs[k], min(1.0, x), int(a)
        return names, score, found


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, learned from rows with text and lang whose crc32(id) mod 4 is not 2.

    All those rows are counted; what reaches the driver is one number per
    language and cell, at most languages x CELLS.
    """
    require(docs, id_col, text_col, lang_col)
    train = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (id_crc(id_col) % 4 != 2))
    counts = count_trigrams(train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.full((len(langs), CELLS), ADD)
    for i, lang in enumerate(langs):
        of = counts[counts["lang"] == lang]
        n[i, of["cell"].to_numpy()] += of["n"].to_numpy()
    return langs, np.log(n / n.sum(1, keepdims=True)) if langs else n


def identify_languages(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, score, n_langs for each row; ``text_col`` may be one of ``keep``.

    lang_pred is a learned language or ``und`` (score 0, n_langs 0) for a text
    that is null or has no letter, or if nothing was learned. Ties go to the
    first language in alphabetical order. Only the text is looked at.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast((list(model[0]), model[1].astype(np.float32)))
    state = {}

    def predict(texts):
        if "m" not in state:
            state["m"] = Mixture(*shared.value)
        return state["m"](texts)

    keep = keep or []
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, text_col)
    return map_texts(rows, text_col, predict, "lang_pred string, score double, n_langs int", keep_text=text_col in keep)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32(doc_id) mod 4 is 2), lang_pred, score, n_langs for each row of ``docs``.

    A null id is held in training (its crc32 is that of empty text); repeated
    rows get equal predictions; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "text")
    return identify_languages(rows, train_languages(docs), keep=["doc_id", "held_out"])


def drop_unknown(docs: DataFrame, min_score: float = 0.34) -> DataFrame:
    """``docs`` without the rows whose language is unknown or whose leading language has a smaller proportion.

    A null or empty text, or one without a letter, is unknown and goes;
    repeated rows stay or go together; equal proportions below ``min_score``
    go. Columns named like the prediction's are kept as they are. An empty
    table, or one without a label to learn from, gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.lit(0).alias("__none"), *others).alias("__row"), "text")
    found = identify_languages(rows, train_languages(docs), keep=["__row", "text"])
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))
