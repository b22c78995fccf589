"""Merkle manifest, token-id files and periodic runs against brute force, round trips and the libraries they follow."""
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caisse.llm import chat, common, idfiles, merkle, runs, warc
from caisse.llm.catalog import vocabulary_path
from caisse.llm.idfiles import IdReader, IdWriter, pack_ids, read_ids, unpack_ids, with_bases, write_ids
from caisse.llm.merkle import leaf_digest, manifest_check, merkle_proofs
from caisse.llm.runs import SuffixTree, document_runs, lyndon_lengths, periodic_runs, plant_runs, run_digests, stretch_runs


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    common.prepare(spark)


@pytest.fixture(scope="module")
def vocabulary():
    with open(vocabulary_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest


def brute_manifest(rows):
    def f(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(f, (*r[:4], text))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def proof(tree, k):
        out = []
        for n in tree[:-1]:
            run = k // 3 * 3
            out.append((n[run:k], n[k + 1 : run + 3]))
            k //= 3
        return out

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels([leaf(r, r[4]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for i, s in enumerate(names):
        for k, r in enumerate(by[s]):
            steps = proof(trees[s], k) + proof(top, i)
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf(r, r[4].replace("\n", "") if cut else r[4])
            for a, b in steps:
                x = sha("".join(a) + x + "".join(b))
            out.append((r[0], leaf(r, r[4]), trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in steps)), x, x == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,sources,levels", [(1, 1, 2), (7, 3, 1), (400, 40, 2), (60, 60, 1), (900, 3, 6)])
def test_merkle_manifest(spark, n, sources, levels):
    rng = random.Random(n)
    names = [None, "é", "z", "Z", "a\nb", "", *(f"s{k}" for k in range(sources))]
    texts = [None, "", "a\nb", "x\n\ny é", "plain"]
    # Two thirds of one source, repeated rows, repeated and null ids, nulls in every column.
    rows = [(rng.choice([None, 3, i]) if rng.random() < 0.1 else i, rng.choice(names) if rng.random() > 0.66 else "hot", rng.choice([None, "en"]), rng.choice([None, i]), rng.choice(texts), "x", 1) for i in range(n)]
    rows += rows[:3] + rows[:1] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, root string, pos int").repartition(3)
    assert sorted(map(tuple, manifest_check(docs, levels).collect()), key=str) == brute_manifest(rows)


def test_merkle_proofs_carry_columns_and_store_every_few_levels(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"), F.lit("t").alias("tree"), F.lit(5).alias("a.b"), F.lit("r").alias("root"))
    out = merkle_proofs(docs, 2)
    assert out.columns == ["source", "doc_id", "leaf", "tree", "a.b", "subroot", "root", "left", "right"]
    rows = out.collect()
    assert len(rows) == 500 and all((r.tree, r["a.b"], r.subroot, len(r.left), len(r.right)) == ("t", 5, r.root, 6, 6) for r in rows)
    trees = merkle.Trees(spark.range(500).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest")), 2)
    assert [x.count() for x in trees.stored] == [500, 56, 7] and trees.tops.count() == 1
    assert merkle_proofs(docs.filter("doc_id < 0")).count() == 0


def test_merkle_leaf(spark):
    docs = spark.createDataFrame([(None, None, "é", 12, "")], "doc_id long, source string, lang string, n_chars long, text string")
    assert docs.select(leaf_digest(docs).alias("x")).first().x == sha("--2:é2:120:")


def test_numbering_spreads_hot_groups(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.lit(1).alias("doc_id"))
        out = merkle.number_rows(rows, "source", ["doc_id"])
        placed = out.withColumn("part", F.spark_partition_id()).filter("source = 'hot'")
        assert placed.groupBy("part").count().agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = {}
    for r in out.collect():
        got.setdefault((r.source, r.tree), []).append(r.pos)
    assert sorted(got) == [("hot", 0), *((f"s{k}", k + 1) for k in range(7))]
    assert all(sorted(p) == list(range(len(p))) for p in got.values())


# Token-id files


def test_packed_ids():
    rng = np.random.default_rng(1)
    for width in range(1, 33):
        for n in (0, 1, 63, 64, 65, 500):
            ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
            raw = pack_ids(ids, width)
            back = unpack_ids(raw, width)
            assert len(raw) == -(-n // 64) * 8 * width and (back[:n] == ids).all() and not back[n:].any()
    assert [idfiles.width_of(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


class Stream(io.BytesIO):
    def close(self):
        self.content = self.getvalue()
        super().close()


@pytest.mark.parametrize("width,block,n", [(16, 64, 0), (16, 64, 1), (17, 128, 300), (5, 64, 1500)])
def test_file_random_access(monkeypatch, width, block, n):
    monkeypatch.setattr(idfiles, "STEP", 500)
    rng = np.random.default_rng(n)
    docs = [(None if k < 3 else k // 2, rng.integers(0, 1 << width, int(rng.choice([0, 1, 5, 700]))).astype(np.uint32)) for k in range(n)]
    out = Stream()
    writer = IdWriter(out, width, block)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = IdReader(io.BytesIO(out.content), len(out.content))
    assert (reader.n_docs, reader.n_ids) == (n, sum(len(x) for _, x in docs))
    for k in rng.permutation(n)[:200].tolist():
        assert (reader.document(k) == docs[k][1]).all() and reader.null[k] == (docs[k][0] is None)
    assert [k for k, _ in reader.documents(0, n)] == list(range(n)) and all((x == docs[k][1]).all() for k, x in reader.documents(0, n))
    lo, hi = reader.find(20, 40)
    assert [docs[k][0] for k in range(lo, hi)] == [d for d, _ in docs if d is not None and 20 <= d <= 40]
    with pytest.raises(ValueError):
        IdReader(io.BytesIO(b"x" * 100), 100)


def test_token_id_files(spark, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idfiles, "FILE_DOCS", 9)
    tk = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Katze", "  x", "déjà", "日本"]) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "<|endoftext|> a", "long " * 40_000, "a \n\t b"]
    order = rng.sample(range(len(texts)), len(texts))
    rows = [(i, texts[i], "x", 5) for i in order] + [(None, "no id", "x", 5)] + [(7, "again", "x", 5)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, start int").repartition(4)
    folder = common.shared_folder(spark, "t")
    manifest = write_ids(docs, vocabulary, folder)
    want = {}
    for i, t, _, _ in rows:
        want.setdefault(i, []).append(np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
    got = read_ids(manifest).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    # The files follow the ids, nulls first, and the starts have no gap.
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)]).tolist()[:-1]
    assert manifest.count() > 10 and manifest.agg(F.max("n_docs")).first()[0] <= 9
    assert with_bases(manifest).filter("base < 0").count() == 0
    assert sorted(r.doc_id for r in read_ids(manifest, 20, 33).collect()) == list(range(20, 34))
    out = {r.doc_id: r for r in idfiles.id_round_trip(docs.filter("doc_id > 100"), vocabulary, common.shared_folder(spark, "t")).collect()}
    assert all((out[i].n_tokens, out[i].ids_crc32) == (len(want[i][0]) // 4, zlib.crc32(want[i][0])) for i in range(101, len(texts)))
    assert idfiles.id_round_trip(docs.filter("doc_id < 0"), vocabulary, common.shared_folder(spark, "t")).count() == 0


# Periodic runs


def brute_runs(s, min_words=6, min_periods=4):
    n, out = len(s), []
    for p in range(1, n // min_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            size = j + p - i
            t = s[i : j + p]
            if size >= max(min_words, min_periods * p) and not any(t[q:] == t[:-q] for q in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, k):
    s = [rng.randint(1, k) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 10)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


def test_suffix_tree():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        tree = SuffixTree(s)
        suffixes = [[*s[i:], 0] for i in range(len(s) + 1)]
        order = sorted(range(len(suffixes)), key=lambda i: suffixes[i])
        rank = tree.index()
        assert [order[r] for r in rank.tolist()] == list(range(len(order)))
        down = sorted(range(len(suffixes)), key=lambda i: [-x if x else -9 for x in suffixes[i]])
        assert [down[r] for r in tree.ranks(descending=True).tolist()] == list(range(len(down)))
        a = np.array([rng.randrange(len(s)) for _ in range(30)])
        b = np.array([rng.randrange(len(s)) for _ in range(30)])
        a, b = a[a != b], b[a != b]
        want = [next(k for k in range(len(s) + 1) if suffixes[x][k : k + 1] != suffixes[y][k : k + 1]) for x, y in zip(a.tolist(), b.tolist())]
        assert tree.lce(a, b).tolist() == want
        # A Lyndon word is smaller than all its proper suffixes.
        for i, n in enumerate(lyndon_lengths(rank[: len(s)]).tolist()):
            lyndon = [m for m in range(1, len(s) - i + 1) if all(s[i : i + m] < s[i + q : i + m] for q in range(1, m))]
            assert n == max(lyndon)


def test_runs_are_those_of_brute_force():
    rng = random.Random(1)
    hashes = common.WordHashes(lower=False)
    for _ in range(1500):
        s = planted(rng, rng.randint(0, 70), rng.choice([1, 2, 3, 5]))
        assert sorted(stretch_runs(s, 2, 2)) == sorted(brute_runs(s, 2, 2))
        words = [b"w%d" % x for x in s]
        assert document_runs(words, next(hashes([b" ".join(words).decode()]))) == brute_runs(s)
    # Runs beside each other, and apart in ordinary words.
    s = [*range(100, 140), *[1, 2] * 5, *range(200, 240), *[3] * 7, *[4] * 6, *range(100, 140)]
    words = [b"w%d" % x for x in s]
    assert document_runs(words, next(hashes([b" ".join(words).decode()]))) == [(40, 10, 2), (90, 7, 1), (97, 6, 1)] == brute_runs(s)


def brute_digests(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, sha("".join("%d,%d,%d\n" % r for r in found)), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_periodic_runs_query(spark):
    rng = random.Random(6)
    texts = [" ".join("w%d" % x for x in planted(rng, rng.randint(0, 150), rng.choice([2, 50, 400]))) for _ in range(250)]
    texts += [None, "", " \t\n", "é " * 9, "a\x0bb\x0cc\r\n" * 8, "x y " * 7, "ha " * 30_000, "Ha ha " * 6]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "ho " * 8, "x", 1), (None, None, "x", 1)] + [(3, texts[3], "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    got = sorted((tuple(r) for r in run_digests(plant_runs(docs)).collect()), key=str)
    want = sorted((brute_digests(i, t) if len(t or "") < 50_000 else None for i, t, _, _ in rows if len(t or "") < 50_000), key=str)
    long = [r for r in got if r[0] == texts.index("ha " * 30_000)]
    assert [r for r in got if r not in long] == want
    assert long[0][:6] == (long[0][0], 1, 0, 30_000, 1, 30_000_000) and long[0][7] == sha("ha")
    assert sum(r[1] > 0 for r in want) > 30
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and out.schema["runs"].dataType.simpleString().startswith("array<struct")
    assert periodic_runs(docs.filter("doc_id < 0")).count() == 0


def test_stretches_keep_whole_runs():
    # A repeated passage without a run is taken out, the run beside it stays.
    h = np.array([*range(1, 30), *range(1, 30), *[5, 6, 7] * 5], dtype=np.uint64)
    found = runs.stretches(common.mix64(h))
    assert any(a <= 58 and b == len(h) for a, b in found) and all(a >= 50 for a, b in found)


# Chat windows and archive reads


def tokens(text):
    return len(re.findall(r"\w+|[^\w\s]", text, re.A)) + 4


def test_chat_windows_hold_their_budget(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 16)
    rng = random.Random(5)
    rows = [(c, t, "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2], " ".join(["w"] * rng.choice([1, 20, 150, 296, 600, 1500 if c == 5 else 40]))) for c in range(8) for t in range(40)]
    rows += [(9, t, "user", " ".join(["w"] * 596)) for t in range(8)] + [(10, 0, "system", "s " * 2000), (10, 1, "user", "a"), (10, 2, "assistant", "b")]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    seen = {}
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window)):
        turns = [x for x in w.formatted.split("<|end|>\n") if x]
        sizes = [tokens(x.split("\n", 1)[1]) for x in turns]
        fresh = sizes[w.n_repeated :]
        system = sizes[0] if turns[0].startswith("<|turn|>system") else 0
        # At most the budget, unless one turn beside the system turn is above it; then nothing is repeated.
        lone = len(fresh) - (system > 0 and w.window == 0) == 1
        assert sum(sizes) <= 1024 or (lone and w.n_repeated <= (system > 0)), (w.conv_id, w.window, sizes)
        assert sum(sizes[: w.n_repeated]) - (system if w.n_repeated else 0) <= 256
        seen.setdefault(w.conv_id, []).append((fresh, system))
    for c, of in seen.items():
        assert sum(len(f) for f, _ in of) == sum(r[0] == c for r in rows)
        if c < 8 and c != 5:
            # Spans are the longest that fit, but at the ends of chunks.
            short = sum(sum(a[0]) + b[0][0] <= 1024 - 256 - b[1] for a, b in zip(of, of[1:]))
            assert short <= 40 // 16
    assert [len(f) for f, _ in seen[9]] == [1] * 8


def test_archives_are_read_by_tasks_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    monkeypatch.setattr(warc, "READS", 2)
    rng = random.Random(7)
    pages = spark.createDataFrame([(k, f"u{k}", "".join(rng.choice("abcdefghij <>") for _ in range(800))) for k in range(200)], "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, common.shared_folder(spark, "t"))
    records = warc.read_archives(index)
    size = index.agg(F.sum("length")).first()[0]
    assert records.rdd.getNumPartitions() == -(-size // 4000) > 10
    assert {(r.page_id, bytes(r.payload).decode()) for r in records.collect()} == {(r.page_id, r.html) for r in pages.collect()}
    assert warc.read_archives(index.filter("page_id < 0")).count() == 0


def _log_likelihood(pairs):
    f = lambda x: x * np.log(x) if x > 0 else 0.0
    return sum(f(x) for x in pairs.ravel()) - sum(f(x) for x in pairs.sum(0)) - sum(f(x) for x in pairs.sum(1))


def test_words_move_to_the_class_that_raises_the_likelihood_most():
    from caisse.llm.class_lm import best_classes

    rng = np.random.default_rng(5)
    classes = 6
    for _ in range(20):
        # Left and right neighbours of different classes: the two sides then add up.
        left, right = 2 * rng.integers(0, 3, 9), 2 * rng.integers(0, 3, 9) + 1
        now = int(rng.integers(0, classes - 1))
        rest = rng.integers(0, 40, (classes, classes)).astype(float)
        tables = []
        for c in range(classes - 1):
            t = rest.copy()
            np.add.at(t, (left, c), 1)
            np.add.at(t, (c, right), 1)
            tables.append(t)
        best = int(np.argmax([_log_likelihood(t) for t in tables]))
        cell, n = np.unique(np.r_[left, classes + right], return_counts=True)
        moved = tables[now].copy()
        h, count, got = best_classes(np.zeros(len(cell), dtype=np.int64), cell, n, np.full(len(cell), now), moved, 1)
        assert (h.tolist(), count.tolist(), got.tolist()) == ([0], [9], [best])
        assert np.allclose(moved, tables[best])


def test_class_lm_scores_are_those_of_its_classes(spark, monkeypatch):
    """Scores by plain counting from the classes the operator found; words of all three kinds, unknown ones, ties and copies."""
    from caisse.llm import class_lm

    monkeypatch.setattr(class_lm, "HEAD_SHARE", 0.02)
    monkeypatch.setattr(class_lm, "SHARE", 0.004)
    seen, real = [], class_lm._with_classes

    def spy(encoded, moved, class_of, end_class, classes):
        seen.append((moved.collect(), class_of, end_class, classes))
        return real(encoded, moved, class_of, end_class, classes)

    lexicons, encode = [], class_lm.encode_texts
    monkeypatch.setattr(class_lm, "_with_classes", spy)
    monkeypatch.setattr(class_lm, "encode_texts", lambda d, h, n, e: lexicons.append(h) or encode(d, h, n, e))
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(120)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice((4, 20, 120))]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "Neu only here", "w1 w1"]
    texts += [texts[3], "w2 w119 " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid string")
    rows = class_lm.class_lm_scores(df, classes=5, rounds=3).collect()
    moved, class_of, end_class, classes = seen[0]
    by_hash = {int(np.uint64(r.h % 2**64)): r["class"] for r in moved}
    head = dict(zip(lexicons[0].tolist(), class_of.tolist()))

    def class_for(w):
        if w == b"\n":
            return classes
        h = int(class_lm._hashes([w])[0])
        return by_hash.get(h, head.get(h, end_class[class_lm._ending(w)]))

    words = [class_lm._words(t) + [b"\n"] for t in texts]
    train = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 10]
    n, pairs = {}, np.zeros((classes + 1, classes + 1))
    for ws in train:
        for a, b in zip([b"\n"] + ws, ws):
            n[b] = n.get(b, 0) + 1
            pairs[class_for(a), class_for(b)] += 1
    tokens, types = pairs.sum(0), np.zeros(classes + 1)
    for w in n:
        types[class_for(w)] += 1
    assert len(by_hash) + sum(h not in by_hash for h in head) == len(n) - 1
    share = (tokens + 1) / (tokens + 1).sum()
    for r in rows:
        ws = words[r.doc_id]
        want = 0.0
        for a, b in zip([b"\n"] + ws, ws):
            i, k = class_for(a), class_for(b)
            want += math.log10((pairs[i, k] + classes * share[k]) / (pairs[i].sum() + classes)) + math.log10((n.get(b, 0) + 0.1) / (tokens[k] + 0.1 * (types[k] + 1)))
        assert r.score == pytest.approx(want)
        assert r.n_known == sum(b in n for b in ws)
    assert len(rows) == len(texts)


def test_class_lm_codes_take_few_bytes(spark):
    """Codes of known, rest and last tokens come back from their compressed form, which takes less than three bytes a token."""
    from caisse.llm import class_lm

    words = [f"w{k}".encode() for k in range(50)]
    texts = [" ".join(f"w{(i * j) % 60}" for j in range(1, 200)) for i in range(40)] + ["", None, "w1 new w1 new other"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    encoded = class_lm.encode_texts(df, class_lm._hashes(words), np.arange(50, 0, -1), 1)
    b = pa.RecordBatch.from_pylist([r.asDict() for r in encoded.collect()])
    codes, lengths = class_lm._codes(b.slice(2), 50)
    assert lengths.tolist() == [len(class_lm._words(t)) + 1 for t in texts[2:]]
    rest, want, begin = class_lm._joined(b.slice(2), "rest", "<u8"), [], 0
    for t in texts[2:]:
        own = {h: begin + k for k, h in enumerate(sorted({int(class_lm._hashes([w])[0]) for w in class_lm._words(t) if w not in words}))}
        want += [words.index(w) if w in words else 50 + own[int(class_lm._hashes([w])[0])] for w in class_lm._words(t)] + [-1]
        begin += len(own)
    assert codes.tolist() == want and len(rest) == begin
    assert sum(len(x) for x in b.column("codes").to_pylist()) < 3 * sum(b.column("n_tokens").to_pylist())
    assert (class_lm._kind(255), class_lm._kind(256)) == ("<u1", "<u2")


def test_class_lm_sums_of_ordered_words():
    from caisse.llm import class_lm

    rng = np.random.default_rng(2)
    h, cell, n = np.sort(rng.integers(-9, 9, 500)), rng.integers(0, 40, 500), rng.integers(1, 5, 500)
    for a, b in zip(class_lm._added(h, cell, n), class_lm._added(h, cell, n, ordered=True)):
        assert a.tolist() == b.tolist()
    assert class_lm._added(h, cell, np.full(500, 200, dtype=np.uint8))[2].sum() == 100_000


def test_class_lm_distinct_words_are_those_of_numpy():
    from caisse.llm import class_lm

    for n in (0, 1, 7, 200):
        h = np.random.default_rng(n).integers(0, 2**64, 50, dtype=np.uint64)[np.random.default_rng(n + 1).integers(0, 50, n)]
        for a, b in zip(class_lm._distinct(h), np.unique(h, return_index=True, return_inverse=True, return_counts=True)):
            assert a.tolist() == b.tolist()
