"""Similarity join on word n-grams by vertical partitioning.

Documents are sets of distinct n-gram hashes (64 bits). The global n-gram
order is cut into fragments, each pair's overlap is counted fragment by
fragment, and the partial counts are summed per pair.

Only pairs that can reach the threshold are counted:

1. Equal sets become one class, so exact copies cost nothing further.
2. In the order of the hashes, a class must share a certain number of its
   first n-grams with other classes. Tasks combine their own rows before the
   shuffle, so an n-gram that stands everywhere is sent once per task.
   Classes that share too little are done: they link with nothing.
3. The others' n-grams are ordered by document frequency, rarest first (ties
   by hash), and cut into fragments of this order. Two classes that link share
   one of the first ``m - need + 1`` n-grams there.
4. Each posting list first links to its smallest class. Around these leaders
   classes form clusters (similarity of a half), whose members are compared
   block by block inside tasks, without emitting pairs; pairs of one component
   are skipped. Posting lists are paired only across clusters.

No step drops a pair that could link, so the links connect what brute force
connects. Not every link inside a component is made explicit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import WordHashes, cut, map_texts, require, shingle_set
from caisse.llm.components import connected_components, with_component

#: N-grams that a task gathers before it sends them on, and n-grams of one shard.
CHUNK = 2_000_000
#: Bits of the map of documents that are candidates (8 MB, whatever the input).
BITS = 1 << 26
#: Members of one block of a cluster.
BLOCK = 128
#: Fragment bounds in the global order, by document frequency.
BOUNDS = (4, 8, 16)


def _need(n: str, percent: int) -> Column:
    """Overlap that a set of ``n`` needs with any partner."""
    return F.expr(f"({percent} * {n} + 99) div 100")


def _signature(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def _key(sig: bytes) -> int:
    """First half of a signature as a signed long, never 0."""
    return int.from_bytes(sig[:8], "little", signed=True) or 1


def _short(h: np.ndarray) -> bytes:
    """The upper 40 bits of hashes, five bytes each: a shard holds some CHUNK n-grams, of which next to none agree in them."""
    return (h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: bytes) -> np.ndarray:
    """The numbers that ``_short`` wrote."""
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _text_key(text: Column) -> Column:
    """Hash that tells the texts of one id apart; null and empty text differ."""
    return F.xxhash64(text, text.isNull())


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, size: int, text_key: bool = False) -> DataFrame:
    """(doc_id, n, sig, key) per row: size of the n-gram set, its 128-bit signature and half of it (null for the empty set).

    With ``text_key``, the hash of the text stands beside the id.
    """

    def sets(texts):
        hashes = WordHashes(lower=True)
        n, sig, key = [], [], []
        for h in hashes(texts):
            s = shingle_set(h, size)
            n.append(len(s))
            sig.append(_signature(s) if len(s) else None)
            key.append(_key(sig[-1]) if len(s) else None)
        return n, sig, key

    own = [_text_key(F.col(text_col)).alias("text_key")] if text_key else []
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *own), "text", sets, "n long, sig binary, key long")


def _shared_counts(docs: DataFrame, text_col: str, size: int, percent: int, shards: int) -> DataFrame:
    """(key, seen): how many of a class's first n-grams (in hash order) stand in other classes too; never too small.

    key is the first half of the signature.
    """
    import pandas as pd
    import pyarrow as pa

    names = ["shard", "keys", "counts", "hashes"]

    def send(h, c, keys):
        """Rows of one chunk: h n-gram hashes, c local class of each, keys of the classes."""
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size_of = np.diff(np.r_[first, len(h)])
        many = np.repeat(size_of > 1, size_of)
        local = np.bincount(c[many], minlength=len(keys))
        at = np.flatnonzero(local)
        rows = [(int(at[0]) % shards, keys[at].tobytes(), local[at].astype(np.uint32).tobytes(), None)] if len(at) else []
        h, k = h[first], np.where(size_of > 1, np.uint64(0), keys[c[first]])
        shard = (h % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((k, shard))
        h, k, shard = h[order], k[order], shard[order]
        ends = np.flatnonzero(np.r_[shard[1:] != shard[:-1], True]) + 1
        begin = 0
        for end in ends:
            kk = k[begin:end]
            f = np.flatnonzero(np.r_[True, kk[1:] != kk[:-1]])
            rows.append((int(shard[begin]), kk[f].tobytes(), np.diff(np.r_[f, len(kk)]).astype(np.uint32).tobytes(), _short(h[begin:end])))
            begin = end
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)], names=names)

    def gather(batches):
        hashes = WordHashes(lower=True)
        known, hs, cs, total = {}, [], [], 0
        for b in batches:
            for w in hashes(b.column("text").to_pylist()):
                s = shingle_set(w, size)
                if not len(s):
                    continue
                key = _key(_signature(s))
                if key in known:
                    continue
                n = len(s)
                p = min(n, n - (percent * n + 99) // 100 + max(1, n // 10))
                known[key] = len(known)
                hs.append(s[:p])
                cs.append(np.full(p, known[key]))
                total += p
                if total >= CHUNK:
                    yield send(np.concatenate(hs), np.concatenate(cs), np.fromiter(known, dtype=np.int64, count=len(known)).view(np.uint64))
                    known, hs, cs, total = {}, [], [], 0
        if total:
            yield send(np.concatenate(hs), np.concatenate(cs), np.fromiter(known, dtype=np.int64, count=len(known)).view(np.uint64))

    def meet(pdf):
        keys, counts = [], []
        hs, ks, ms = [], [], []
        for m, (k, n, h) in enumerate(zip(pdf["keys"], pdf["counts"], pdf["hashes"])):
            k, n = np.frombuffer(k, dtype=np.uint64), np.frombuffer(n, dtype=np.uint32)
            if h is None:
                keys.append(k)
                counts.append(n.astype(np.int64))
            else:
                hs.append(_long(h))
                ks.append(np.repeat(k, n))
                ms.append(np.full(len(ks[-1]), m))
        if hs:
            h, k, m = np.concatenate(hs), np.concatenate(ks), np.concatenate(ms)
            order = np.argsort(h, kind="stable")
            h, k, m = h[order], k[order], m[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size_of = np.diff(np.r_[first, len(h)])
            low, high = np.minimum.reduceat(k, first), np.maximum.reduceat(k, first)
            both = np.repeat((low != high) | (low == 0), size_of) & (k != 0)
            h, k, m = h[both], k[both], m[both]
            if len(h):
                # A class counts once for an n-gram, however many messages name it; unlike n-grams
                # whose short hashes agree stand in one message, and count each.
                order = np.lexsort((m, h, k))
                h, k, m = h[order], k[order], m[order]
                gram = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
                told = np.flatnonzero(gram | np.r_[True, m[1:] != m[:-1]])
                times = np.diff(np.r_[told, len(h)])
                gram = np.flatnonzero(gram[told])
                most, of = np.maximum.reduceat(times, gram), k[told[gram]]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                keys.append(of[first])
                counts.append(np.add.reduceat(most, first))
        if not keys:
            return pd.DataFrame({"key": np.zeros(0, dtype=np.int64), "seen": np.zeros(0, dtype=np.int64)})
        return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "seen": np.concatenate(counts)})

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, "shard int, keys binary, counts binary, hashes binary")
    return sent.groupBy("shard").applyInPandas(meet, "key long, seen long").groupBy("key").agg(F.sum("seen").alias("seen"))


def _places(col: str) -> Column:
    """Two bits of an id in the bit map."""
    return F.array(*[F.pmod(F.xxhash64(F.col(col), F.lit(i)), F.lit(BITS)) for i in (1, 2)])


def _candidates(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(cid, n, need, frags, prefix) of the classes that are left: n-grams that several of them have, in the global order."""
    wanted = cut(classes.select(F.col("rep").alias("doc_id"), "cid", "n", F.col("sig").alias("want")))
    # A bit map of fixed size keeps other documents from being hashed and moved; it lets some pass, the join decides.
    words = wanted.select(F.explode(_places("doc_id")).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("bits")).toPandas()
    bits = np.zeros(BITS // 64, dtype=np.uint64)
    bits[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col(id_col).alias("doc_id"), _places(id_col).alias("places"), F.col(text_col).alias("text"))

    def tokens(batches):
        import pyarrow as pa

        hashes = WordHashes(lower=True)
        for b in batches:
            place = np.asarray(b.column("places").values if b.num_rows else []).reshape(-1, 2)
            hit = (shared.value[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)
            b = b.filter(pa.array(hit.all(axis=1)))
            if b.num_rows:
                sets = [shingle_set(h, size) for h in hashes(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_signature(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "sig", "tokens"])

    sets = rows.mapInArrow(tokens, f"doc_id {dict(rows.dtypes)['doc_id']}, sig binary, tokens array<long>")
    # A class is told by its doc_id and signature: repeated rows meet where the join has put them, without another exchange.
    sets = sets.join(wanted, "doc_id").filter("sig = want").dropDuplicates(["doc_id", "sig"])
    toks = sets.select("cid", F.explode("tokens").alias("h"))
    df = toks.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = toks.join(df, "h").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    own = own.join(wanted.select("cid", "n"), "cid").withColumn("need", _need("n", percent)).filter("size(t) >= need")
    edges = [0, *BOUNDS, None]
    parts = [F.expr(f"transform(filter(t, x -> x.df >= {lo}" + (f" and x.df < {hi}" if hi else "") + "), x -> x.h)") for lo, hi in zip(edges, edges[1:])]
    # The fragments in a row are the n-grams in the global order; the first of them need not be written twice.
    sets = cut(own.select("cid", "n", F.array(*parts).alias("frags")))
    return sets.withColumn("prefix", F.expr(f"slice(flatten(frags), 1, int(size(flatten(frags)) - ({percent} * n + 99) div 100 + 1))"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, i): overlap of each pair of classes, counted per fragment and summed."""
    frags = sets.select("cid", "n", F.posexplode("frags").alias("f", "seg")).filter("size(seg) > 0")
    left = frags.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"), F.col("seg").alias("sa"))
    right = frags.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("seg").alias("sb"))
    part = pairs.join(left, "a").join(right, (pairs["b"] == right["b"]) & (F.col("fa") == F.col("fb")))
    part = part.select("a", pairs["b"], "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("part"))
    # The sizes come with the fragments: no join brings them afterwards.
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("i"))


def _linked(percent: int) -> Column:
    return F.expr(f"100 * i >= {percent} * (na + nb - i)")


def _compare_blocks(percent: int):
    """Function for one pair of blocks: links that join components which are still apart."""
    import pandas as pd

    def part(a: list, b: list, acc: np.ndarray) -> None:
        """Add the overlaps of the segments a with the segments b."""
        va = np.unique(np.concatenate(a))
        vocab = np.intersect1d(va, np.unique(np.concatenate(b)), assume_unique=True)
        if not len(vocab):
            return

        def places(segs):
            rows = np.repeat(np.arange(len(segs)), [len(s) for s in segs])
            at = np.concatenate(segs)
            pos = np.searchsorted(vocab, at)
            pos[pos == len(vocab)] = 0
            hit = vocab[pos] == at
            return rows[hit], pos[hit]

        (ra, pa_), (rb, pb) = places(a), places(b)
        for lo in range(0, len(vocab), 8192):
            width = min(8192, len(vocab) - lo)
            x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            m = (pa_ >= lo) & (pa_ < lo + width)
            x[ra[m], pa_[m] - lo] = 1
            m = (pb >= lo) & (pb < lo + width)
            y[rb[m], pb[m] - lo] = 1
            acc += (x @ y.T).astype(np.int64)

    def compare(pdf):
        a, b = pdf[pdf["mine"] == pdf["lo"]], pdf[pdf["mine"] == pdf["hi"]]
        out = []
        if len(a) and len(b):
            acc = np.zeros((len(a), len(b)), dtype=np.int64)
            for f in range(len(BOUNDS) + 1):
                part([np.asarray(x[f]) for x in a["frags"]], [np.asarray(x[f]) for x in b["frags"]], acc)
            na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
            ca, cb = a["comp"].to_numpy(), b["comp"].to_numpy()
            ok = (100 * acc >= percent * (na + nb - acc)) & (ca[:, None] != cb[None, :])
            ia, ib = a["cid"].to_numpy(), b["cid"].to_numpy()
            root = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(ok)):
                x, y = find(ca[i]), find(cb[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((ia[i], ib[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between classes that connect what all links connect; those found first stand as stars."""
    prefix = sets.select("cid", F.explode("prefix").alias("h"))
    lead = prefix.groupBy("h").agg(F.min("cid").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    stars = prefix.join(lead, "h").filter("a < cid").select("a", F.col("cid").alias("b")).distinct()
    known = cut(_overlaps(stars, sets).withColumn("linked", _linked(percent)))
    first = known.filter("linked").select("a", "b")
    comp = with_component(sets.select("cid", "n"), "cid", first).withColumnRenamed("component", "comp")
    near = known.filter("2 * i >= na + nb - i").groupBy("b").agg(F.min("a").alias("k1"))
    own = comp.join(near, comp["cid"] == near["b"], "left").select("cid", "n", "comp", F.coalesce("k1", "cid").alias("k1"))
    jump = own.select(F.col("cid").alias("k1"), F.col("k1").alias("k"))
    own = cut(own.join(jump, "k1").select("cid", "n", "comp", "k"))

    # Inside the clusters: blocks of one component where it is large, mixed blocks else.
    groups = own.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("size"))
    clusters = groups.groupBy("k").agg(F.count(F.lit(1)).alias("comps"), F.sum(F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)).alias("small")).filter("comps > 1")
    member = own.drop("n").join(groups, ["k", "comp"]).join(clusters, "k")
    large = F.col("size") >= BLOCK
    slot = F.pmod(F.xxhash64("cid"), F.ceil(F.when(large, F.col("size")).otherwise(F.col("small")) / BLOCK))
    member = member.select("k", "cid", "comp", F.when(large, F.col("comp")).otherwise(-1).alias("of"), slot.cast("long").alias("slot"))
    member = member.withColumn("mine", F.struct("of", "slot"))
    blocks = member.select("k", "of", "mine").distinct().select("k", F.col("of").alias("other_of"), F.col("mine").alias("other"))
    met = member.join(blocks, "k").filter("not (of >= 0 and of = other_of)")
    met = met.select("k", "cid", "comp", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine")
    text = lambda c: F.concat_ws(":", F.col(f"{c}.of"), F.col(f"{c}.slot"))
    met = met.select("k", "cid", "comp", text("lo").alias("lo"), text("hi").alias("hi"), text("mine").alias("mine")).join(sets.select("cid", "n", "frags"), "cid")
    inside = met.groupBy("k", "lo", "hi").applyInPandas(_compare_blocks(percent), "a long, b long")

    # Across clusters: pairs that share one of their rarest n-grams.
    entry = sets.select("cid", "prefix").join(own, "cid").select("cid", "n", "comp", "k", F.explode("prefix").alias("h"))
    mixed = entry.groupBy("h").agg(F.min("k").alias("x"), F.max("k").alias("y")).filter("x < y").select("h")
    entry = entry.join(mixed, "h")
    left = entry.select("h", *[F.col(c).alias(f"a_{c}") for c in ("cid", "comp", "k", "n")])
    right = entry.select("h", *[F.col(c).alias(f"b_{c}") for c in ("cid", "comp", "k", "n")])
    fits = f"a_cid < b_cid and a_k <> b_k and a_comp <> b_comp and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"
    pairs = left.join(right, "h").filter(fits).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()
    across = _overlaps(pairs, sets).filter(_linked(percent)).select("a", "b")
    stars = own.filter("comp < cid").select(F.col("comp").alias("a"), F.col("cid").alias("b"))
    return cut(stars.union(inside).union(across))


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, text_key: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, sig, ... of ``shingle_rows``, cid), classes of equal sets (cid, sig, key, rep, n) and links (a, b) between classes."""
    rows = cut(shingle_rows(docs, id_col, text_col, size, text_key))
    named = rows.filter("sig is not null and doc_id is not null")
    classes = named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("key").alias("key"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "sig", "key", "rep", "n"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    prefix = 1 - percent / 100 + 0.1
    shared = _shared_counts(docs.filter(F.col(id_col).isNotNull()), text_col, size, percent, max(8, math.ceil(total * prefix / CHUNK)))
    # The first n-grams counted, and how many of them any partner has.
    p = F.expr(f"least(n, n - (({percent} * n + 99) div 100) + greatest(1, n div 10))")
    left = classes.join(shared, "key").filter(F.col("seen") >= p - (F.col("n") - _need("n", percent)))
    sets = _candidates(docs, id_col, text_col, left, size, percent)
    links = _links(sets, percent)
    own = rows.drop("key").join(classes.select("sig", "cid", "rep"), "sig", "left")
    return own.withColumn("cid", F.when(F.col("doc_id").isNotNull(), F.col("cid"))), classes, links


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``size``-word shingles (words lower-cased A-Z). A text without
    words, empty or null has the empty set and links with nothing. Rows of one
    doc_id are one document; a row without an id links with nothing and has
    no component. Repeated rows are copies. An empty table gives an empty
    result. Other columns are ignored.
    """
    require(docs, id_col, text_col)
    own, classes, links = _classes(docs, id_col, text_col, size, percent)
    # One id with several texts is one document.
    twice = own.filter("cid is not null").groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a < z").select("doc_id", "a")
    same = own.join(twice, "doc_id").select("a", F.col("cid").alias("b"))
    comp = connected_components(links.union(same))
    found = classes.join(comp, classes["cid"] == comp["node"]).select("cid", "component", "rep")
    lowest = found.groupBy("component").agg(F.min("rep").alias("low"))
    found = found.join(lowest, "component").select("cid", "low")
    out = own.join(found, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "rep", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: one with the smallest id (of its unlike texts that link, the smallest hash).

    Groups are of texts: unlike texts that stand under one id each have their
    own group and stay, rows that repeat id and text are one. Texts without
    words, empty or null link with nothing: one row of each id stays for
    each. Rows without an id stay, all of them.
    """
    require(docs, id_col, text_col)
    own, _, links = _classes(docs, id_col, text_col, size, percent, text_key=True)
    named = with_component(own.filter("doc_id is not null"), "cid", links)
    rows = named.groupBy(F.col("component").alias("group"), "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key", "copies")).alias("r")).select("r.*")
    first = cut(first.union(rows.filter("group is null").select("doc_id", "text_key", "copies")).toDF("__first", "__key", "copies"))
    key = _text_key(docs[text_col])
    kept = docs.join(first.select("__first", "__key"), (docs[id_col] == F.col("__first")) & (key == F.col("__key")), "left_semi")
    if first.filter("copies > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept.union(docs.filter(F.col(id_col).isNull()))
