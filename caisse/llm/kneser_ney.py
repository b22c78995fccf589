"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a character n-gram model of order 4, learned from documents that
the labels trust. Counts, context sums and query n-grams are tables sharded by
n-gram; probabilities come from joining the query's distinct n-grams with them,
order by order. Documents travel only as compressed blocks that meet the
probabilities of their own n-grams. A document is kept when its perplexity is
at most its language's quantile among trusted documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import cut, require

ORDER = 4
#: Bits of one symbol; code points are folded into them.
BITS = 15
SYMBOLS = (1 << BITS) - 19
#: Characters of one block of documents.
BLOCK = 12 << 20
#: Characters of a block whose n-grams are sorted at once.
PART = 1 << 20
QUANTILE = 0.995
#: One in so many trusted documents sets the thresholds instead of training the model.
HELD_OUT = 5
#: Width of a cell of the quantiles' histogram, in log10 of the perplexity.
CELL = 1e-4
ANY = "*"
#: Bits of the map of trusted documents (8 MB, whatever the input).
MAP_BITS = 1 << 26
#: Compression level of blocks (Zstandard).
LEVEL = 6


def _symbols(text: str) -> np.ndarray:
    """Symbols 1.. of a text after ORDER - 1 zeros; digits are one symbol."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    cp = np.where((cp >= 48) & (cp <= 57), 48, cp) % SYMBOLS + 1
    return np.concatenate([np.zeros(ORDER - 1, dtype=np.int64), cp])


def _grams(symbols: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol of a text, as one long."""
    n = len(symbols) - ORDER + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(ORDER):
        out = (out << BITS) | symbols[k : k + n]
    return out


def _packed(text: str) -> bytes:
    """A text compressed, after the length of its bytes."""
    import pyarrow as pa

    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def _unpacked(data: bytes) -> str:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True).decode("utf-8", "surrogatepass")


def _in_map(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` but most of those whose doc_id is not in ``ids``: others that share both their bits in a map of fixed size stay.

    Ids of types that equal values may tell apart (floats, unlike types) are all left to the join that follows.
    """
    import pyarrow as pa

    kind = dict(docs.dtypes)["doc_id"]
    if kind != dict(ids.dtypes)["doc_id"] or kind not in ("tinyint", "smallint", "int", "bigint", "string"):
        return docs
    places = F.array(*[F.pmod(F.xxhash64(F.col("doc_id"), F.lit(i)), F.lit(MAP_BITS)) for i in (1, 2)])
    words = ids.select(F.explode(places).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("bits")).toPandas()
    bits = np.zeros(-(-MAP_BITS // 64), dtype=np.uint64)
    bits[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            if b.num_rows:
                place = b.column("places").flatten().to_numpy().reshape(-1, 2)
                hit = (shared.value[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)
                yield b.drop_columns(["places"]).filter(pa.array(hit.all(axis=1)))

    return docs.withColumn("places", places).mapInArrow(run, docs.schema)


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, c) over the column text; each task counts its own texts first, some megabytes at a time."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            found = [_grams(_symbols(t)) for t in b.column("text").to_pylist() if t]
            if found:
                g, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c.astype(np.int64))], names=["g", "c"])

    return texts.select("text").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    n = {r["c"]: r["n"] for r in counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.01), k - 0.01) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def train_model(texts: DataFrame) -> list[dict]:
    """Tables of each order, lowest first: grams (g, d: discounted count), contexts (h, total, rest)."""
    counts = cut(count_grams(texts))
    model = []
    for k in range(ORDER, 0, -1):
        d = _discounts(counts)
        cost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        h = F.shiftright("g", BITS) if k > 1 else F.lit(0).cast("long")
        contexts = counts.groupBy(h.alias("h")).agg(F.sum("c").alias("total"), F.sum(cost).alias("rest"))
        model.append({"grams": counts.select("g", (F.col("c") - cost).alias("d")), "contexts": contexts})
        # Lower orders count the different symbols before an n-gram.
        low = F.col("g").bitwiseAND((1 << (BITS * (k - 1))) - 1)
        counts = cut(counts.groupBy(low.alias("g")).agg(F.count(F.lit(1)).alias("c"))) if k > 1 else None
    return model[::-1]


def gram_probabilities(grams: DataFrame, model: list[dict]) -> DataFrame:
    """(g, logp) of distinct n-grams, by joins with the model's tables from the lowest order up."""
    kinds = model[0]["grams"].count() + 1
    out = grams.withColumn("p", F.lit(1.0 / kinds))
    for k, tables in enumerate(model, 1):
        low: Column = F.col("g").bitwiseAND((1 << (BITS * k)) - 1)
        out = out.withColumns({"kg": low, "kh": F.shiftright(low, BITS) if k > 1 else F.lit(0).cast("long")})
        out = out.join(tables["grams"].withColumnRenamed("g", "kg"), "kg", "left").join(tables["contexts"].withColumnRenamed("h", "kh"), "kh", "left")
        better = (F.coalesce("d", F.lit(0.0)) + F.col("rest") * F.col("p")) / F.col("total")
        out = out.select("g", F.when(F.col("total").isNotNull(), better).otherwise(F.col("p")).alias("p"))
    return out.select("g", F.log10("p").alias("logp"))


def _distinct(grams: list[np.ndarray], texts: list[str]) -> np.ndarray:
    """The distinct n-grams of the texts and of ``grams``."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *grams, *(_grams(_symbols(t)) for t in texts)]))


def _blocks(docs: DataFrame, with_grams: bool) -> DataFrame:
    """Blocks of a task's documents: (block, g) of their distinct n-grams, or (block, ids, langs, sizes, raw).

    Two evaluations agree as long as the input's partitions and their order
    do, as those of stored tables; ``score_documents`` notices if they do not.
    """
    import pyarrow as pa

    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "lang", "text", F.spark_partition_id().alias("task"))

    def run(batches):
        number, size, ids, langs, parts, task, grams, held = 0, 0, [], [], [], 0, [], 0

        def send():
            block = pa.array([(task << 24) + number], pa.int64())
            if with_grams:
                g = _distinct(grams, parts)
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), (task << 24) + number)), pa.array(g)], names=["block", "g"])
            sizes = np.array([len(t) for t in parts], dtype=np.int64)
            raw = _packed("".join(parts))
            return pa.RecordBatch.from_arrays([block, pa.array([ids], pa.list_(id_arrow)), pa.array([langs], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64())), pa.array([raw], pa.binary())], names=["block", "ids", "langs", "sizes", "raw"])

        for b in batches:
            id_arrow = b.column("doc_id").type
            for i, lang, text, task in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text", "task"))):
                ids.append(i)
                langs.append(lang)
                parts.append(text or "")
                size += len(parts[-1]) + 64
                held += len(parts[-1])
                if with_grams and held >= PART:
                    grams, parts, held = [_distinct(grams, parts)], [], 0
                if size >= BLOCK:
                    yield send()
                    number, size, ids, langs, parts, grams, held = number + 1, 0, [], [], [], [], 0
        if ids:
            yield send()

    return rows.mapInArrow(run, "block long, g long" if with_grams else f"block long, ids array<{id_type}>, langs array<string>, sizes array<long>, raw binary")


def score_documents(docs: DataFrame, model: list[dict]) -> DataFrame:
    """(doc_id, lang, n_chars_scored, log10_prob) per row of ``docs`` (doc_id, lang, text)."""
    import pandas as pd

    id_type = dict(docs.dtypes)["doc_id"]
    grams = _blocks(docs, True)
    known = cut(gram_probabilities(grams.select("g").distinct(), model))
    probs = grams.join(known, "g").select("block", "g", F.col("logp").cast("float").alias("logp"))

    def score(left, right):
        order = np.argsort(right["g"].to_numpy())
        g, p = right["g"].to_numpy()[order], right["logp"].to_numpy()[order].astype(np.float64)
        ids, langs, sizes, total = [], [], [], []
        for i, lang, size, raw in zip(left["ids"], left["langs"], left["sizes"], left["raw"]):
            text, at = _unpacked(raw), 0
            ids += list(i)
            langs += list(lang)
            sizes += list(size)
            for n in size:
                want = _grams(_symbols(text[at : at + n]))
                at += n
                place = np.searchsorted(g, want)
                if n and (place.max() >= len(g) or (g[place] != want).any()):
                    raise RuntimeError("two readings of the input differ; store it first")
                total.append(float(p[place].sum()))
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object if None in ids else None), "lang": pd.Series(langs, dtype=object), "n_chars_scored": sizes, "log10_prob": total})

    return _blocks(docs, False).groupBy("block").cogroup(probs.groupBy("block")).applyInPandas(score, f"doc_id {id_type}, lang string, n_chars_scored long, log10_prob double")


def language_quantiles(trusted: DataFrame, quantile: float) -> DataFrame:
    """(lang, threshold) of the column log_ppl per language, and for all languages together as ``*``.

    The value below which ``quantile`` of the rows lie, rounded up to CELL; exact for any number of rows.
    """
    from pyspark.sql import Window as W

    cells = trusted.select(F.explode(F.array(F.coalesce("lang", F.lit(ANY)), F.lit(ANY))).alias("lang"), F.ceil(F.col("log_ppl") / CELL).alias("cell"))
    n = cells.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    ranked = n.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy("lang"))})
    return ranked.filter(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg((F.min("cell") * CELL).alias("threshold"))


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, n_chars_scored, log10_prob, perplexity, threshold, trusted, kept.

    ``docs`` has doc_id, lang, text; ``labels`` doc_id, quality, toxic. Trusted
    is a document labelled quality 1 and not toxic by all its labels. Every
    trusted document has its part: one in HELD_OUT sets the thresholds, all
    others train the model. A document is kept when its perplexity per character is at most the
    ``quantile`` of its language's trusted documents that did not train the
    model; a language without such documents, or a null one, uses the quantile
    of all. An empty or
    null text has no perplexity and is not kept; without trusted text nothing
    is rejected but empty texts. Repeated rows are scored each. An empty table
    gives an empty result. Other columns are ignored.
    """
    require(docs, "doc_id", "lang", "text")
    require(labels, "doc_id", "quality", "toxic")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    trusted = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.expr("coalesce(quality, 0) = 1 and coalesce(toxic, 0) = 0")).alias("ok")).filter("ok").select("doc_id")
    trusted = cut(trusted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0))
    # No broadcast hint: the ids grow with the labels, so their size decides.
    # The map keeps most other texts from being moved; the join decides.
    learned = trusted.filter("not held").select("doc_id")
    texts = _in_map(rows.select("doc_id", "text"), learned).join(learned, "doc_id", "left_semi")
    scored = cut(score_documents(rows, train_model(texts)))
    log_ppl = F.when(F.col("n_chars_scored") > 0, -F.col("log10_prob") / F.col("n_chars_scored"))
    scored = scored.withColumn("log_ppl", log_ppl).join(trusted.select("doc_id", F.lit(True).alias("trusted"), "held"), "doc_id", "left")
    limits = cut(language_quantiles(scored.filter("held and log_ppl is not null"), quantile))
    row = limits.filter(F.col("lang") == ANY).first()
    pooled = F.lit(float(row["threshold"]) if row else float("inf"))
    out = scored.join(limits, "lang", "left").withColumn("limit", F.coalesce("threshold", pooled))
    kept = F.coalesce(F.col("log_ppl") <= F.col("limit"), F.lit(False))
    return out.select("doc_id", "lang", "n_chars_scored", "log10_prob", F.pow(F.lit(10.0), "log_ppl").alias("perplexity"), F.pow(F.lit(10.0), "limit").alias("threshold"), F.coalesce("trusted", F.lit(False)).alias("trusted"), kept.alias("kept"))
