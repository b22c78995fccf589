"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on random Gaussian directions, shifted and
quantised; PROJECTIONS such values make a bucket in each of TABLES tables.
Vectors that share a bucket are compared exactly (cosine, double precision)
inside tasks. A pair counts in the first table where it meets, so nothing is
emitted per pair: only counts per vector and edges to the smallest member of
each connected group inside a bucket.

At cosine 0.9 (distance 0.447) one projection of WIDTH 2 agrees with
probability 0.82, a bucket of 12 with 0.095, one of 32 tables with 0.96; at
cosine 0.97 it is above 0.999.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import cut, mix64, require
from caisse.llm.components import connected_components

TABLES = 32
PROJECTIONS = 12
WIDTH = 2.0
SEED = 20_000
#: Buckets with more vectors are compared in blocks of about this size.
BLOCK = 1024
#: Bucket rows of one task.
SHARD = 20_000


class Hasher:
    """Bucket ids (64 bits, rows x tables) of normalised vectors; the directions depend on seed and dimension only."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.tables, self.k, self.width, self.seed, self.made = tables, projections, width, seed, {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        dim = x.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            n = self.tables * self.k
            self.made[dim] = rng.standard_normal((dim, n)), rng.uniform(0, self.width, n), rng.integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1)
        a, b, odd = self.made[dim]
        q = np.floor((x @ a + b) / self.width).astype(np.int64).view(np.uint64) * odd
        h = q.reshape(len(x), self.tables, self.k).sum(2, dtype=np.uint64)
        salt = (np.arange(self.tables, dtype=np.uint64) + np.uint64(1 + 1000 * dim)) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(h + salt)


def _normal(raw: list, dtype) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=dtype).reshape(len(raw), -1).astype(np.float64)
    # Scaled first, so that very small and very large components neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(met: DataFrame, large: DataFrame, total: int) -> DataFrame:
    """The ``total`` rows of ``met`` with lo, hi, mine and g: the group of their bucket or, in a ``large`` one, of each pair of blocks.

    A row of a large bucket of m vectors is there ceil(m / BLOCK) times; the
    groups are as many as all these rows need.
    """
    copies = F.ceil(F.col("m") / BLOCK).cast("int")
    found = large.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("m") * (copies - 1)), F.lit(0)).alias("more")).first()
    small = met.join(large, "bucket", "left_anti") if found["n"] else met
    blocks = small.withColumns({"lo": F.lit(0), "hi": F.lit(0), "mine": F.lit(0)})
    if found["n"]:
        split = met.join(large, "bucket").withColumn("mine", F.pmod(F.xxhash64("cid"), copies).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), copies - 1)))
        blocks = blocks.unionByName(split.withColumns({"lo": F.least("mine", "x"), "hi": F.greatest("mine", "x")}).drop("m", "x"))
    shards = max(8, math.ceil((total + found["more"]) / SHARD))
    return blocks.withColumn("g", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shards)).cast("int"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors link when their cosine is at least ``threshold``; found links only,
    never one below. A vector that is null, empty or zero or holds null or
    non-finite components links with nothing and is its own component; vectors
    of different lengths do not link. A row without an id has no links, no
    component and no verdict. Equal rows are one vector, each row returned.
    Other columns are ignored.
    """
    import pandas as pd
    import pyarrow as pa

    require(vectors, id_col, vector_col)
    kind = dict(vectors.dtypes)[vector_col]
    dtype = np.float32 if kind == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<float>" if dtype is np.float32 else "array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine & F.col("vec_id").isNotNull())
    classes = rows.filter("fine").groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("w"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "v", "rep", "w"))

    def buckets(batches):
        hasher = Hasher(tables, projections, width, seed)
        for b in batches:
            col, size = b.column("v"), None
            vs = [np.asarray(col[i].values, dtype=dtype) for i in range(b.num_rows)]
            raw = [v.tobytes() for v in vs]
            out = np.zeros((len(vs), tables), dtype=np.uint64)
            for size in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == size]
                out[at] = hasher(_normal([raw[i] for i in at], dtype))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("w"), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in out], pa.binary()), pa.array(list(out.view(np.int64)), pa.list_(pa.int64()))], names=["cid", "w", "raw", "own", "buckets"])

    hashed = cut(classes.select("cid", "w", "v").mapInArrow(buckets, "cid long, w long, raw binary, own binary, buckets array<long>"))
    met = hashed.select("cid", "w", "raw", "own", F.posexplode("buckets").alias("t", "bucket"))
    sizes = hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    large = cut(sizes.filter(F.col("m") > BLOCK))
    blocks = _blocks(met, large, classes.count() * tables)

    def compare(pdf):
        out = []
        pdf = pdf.sort_values(["bucket", "lo", "hi"], kind="stable")
        bucket, lo, hi, mine, t, cid, w = (pdf[c].to_numpy() for c in ("bucket", "lo", "hi", "mine", "t", "cid", "w"))
        raw, own = pdf["raw"].to_numpy(), pdf["own"].to_numpy()
        change = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), True])
        for a, z in zip(change[:-1], change[1:]):
            if z - a < 2 or len({len(r) for r in raw[a:z]}) > 1:
                continue
            x = _normal(list(raw[a:z]), dtype)
            link = x @ x.T >= threshold
            np.fill_diagonal(link, False)
            if lo[a] != hi[a]:
                link &= mine[a:z, None] != mine[None, a:z]
            i, j = np.nonzero(link)
            if not len(i):
                continue
            h = np.frombuffer(b"".join(own[a:z]), dtype=np.uint64).reshape(z - a, tables)[:, : t[a]]
            # Pairs that an earlier table has, some at a time.
            new = np.concatenate([~(h[i[k : k + 65536]] == h[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
            count = np.bincount(i[new], w[a:z][j[new]], z - a).astype(np.int64)
            label = np.arange(z - a)
            while True:
                low = label.copy()
                np.minimum.at(low, i, label[j])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            keep = np.flatnonzero((count > 0) | (label != np.arange(z - a)))
            out.append(np.stack([cid[a:z][keep], np.where(label[keep] != keep, cid[a:z][label[keep]], -1), count[keep]], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
        return pd.DataFrame(found, columns=["a", "b", "n"])

    found = cut(blocks.groupBy("g").applyInPandas(compare, "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.filter("b >= 0").select("a", "b"))
    named = classes.join(comp, classes["cid"] == comp["node"]).select("cid", "component", "rep")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("low")), "component").select("cid", "low")
    known = classes.join(counts, "cid", "left").join(named, "cid", "left").select("v", F.lit(True).alias("fine"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("low", "rep").alias("low"))
    out = rows.join(known, ["v", "fine"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("low", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
