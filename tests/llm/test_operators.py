"""The training-data operators against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caisse.llm import common, embeddings
from caisse.llm.bpe import bpe_round_trip, read_ranks, replay_merges
from caisse.llm.catalog import op1_best_fit_packing, op10_quality_classifier, vocabulary_path
from caisse.llm.chat import escape, format_conversations, format_windows, unescape
from caisse.llm.class_lm import class_lm_scores
from caisse.llm.components import connected_components
from caisse.llm.embeddings import near_vectors
from caisse.llm.jaccard import jaccard_components, keep_first
from caisse.llm.kneser_ney import quality_classifier
from caisse.llm.language import CELLS, Mixture, Trigrams, drop_unknown, language_id
from caisse.llm.packing import pack_documents
from caisse.llm.quality import apply_rules, frequent_lines, line_key, line_stats, quality_rules
from caisse.llm.warc import archive_round_trip, read_archives, read_ranges, write_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, score string, lines string"


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    common.prepare(spark)


def make(spark, texts, ids=None, lang=None, source=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang[k] if lang else "en", source[k] if source else "s", len(t or ""), "x", "x", "x", "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 80))] for _ in range(n)]
    out = []
    for words in base:
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((" " if rng.random() < 0.7 else "\n").join(w).upper())
    return out + [None, "", " \t\n", "one two", "ONE\ntwo", "é " * 7, out[0], "long " + "word " * 30_000]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(2000, 2100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_matches_brute_force(spark, seed):
    texts = corpus(seed)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(range(len(sets)), links)
    docs = make(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert sorted(r.doc_id for r in keep_first(docs).collect()) == sorted(set(want.values()))


def test_jaccard_ids(spark):
    t = "a b c d e f g h"
    docs = make(spark, [t, t, t, "x", None, t], ids=[7, 7, None, None, 9, 4])
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(7, 4), (7, 4), (None, None), (None, None), (9, 9), (4, 4)], key=str)
    assert keep_first(docs).columns == docs.columns
    assert sorted((r.doc_id for r in keep_first(docs).collect()), key=str) == sorted([None, None, 9, 4], key=str)


def test_keep_first_keeps_unlike_texts_of_one_id(spark):
    a, b, c = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x"
    rows = [(1, a), (1, b), (2, c), (2, c), (1, a.upper()), (3, b), (4, None), (4, ""), (4, None), (None, a), (None, a)]
    kept = keep_first(make(spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()
    got = [(r.doc_id, (r.text or "").lower() if r.text is not None else None) for r in kept]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (2, c), (4, None), (4, ""), (None, a), (None, a)], key=str)


def test_quality_rules(spark):
    texts = corpus(4) + ["# buy now <b>\n" * 4 + "a b c d e f g h i j k l m"]
    boiler = "Subscribe 12 to our letter today"
    texts += [f"{boiler.replace('12', str(k))}\n" + " ".join("w" + chr(97 + k % 26) + chr(97 + k // 26) + chr(97 + j) for j in range(20)) for k in range(30)] + [f"{boiler}\n{boiler}\n{boiler}\nq{k}" for k in range(3)]
    got = {r.doc_id: r for r in quality_rules(make(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        w = t.encode().split()
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = len({k + j for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for j in range(5)})
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 10 or 100 * rep > 20 * len(w))
    assert all(got[len(texts) - 33 + k].removed_words == 6 and got[len(texts) - 33 + k].kept for k in range(30))
    assert all(not got[len(texts) - 1 - k].kept for k in range(3))
    kept = apply_rules(make(spark, texts))
    assert kept.columns == make(spark, texts).columns
    assert not kept.filter(F.col("text").contains("Subscribe")).count()


def test_quality_counts_distinct_texts(spark):
    own = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(100)]
    shared = [f"line {chr(97 + j)} that many pages of this host share" for j in range(20)]
    texts = ["\n".join([*shared, f"{w} alone"]) for w in own] + [f"plain {w} text of its own, without any of the lines" for w in own]
    often = {r.line: r.n_docs for r in frequent_lines(line_stats(make(spark, texts + texts[:3]))).collect()}
    assert often == {line_key(x.encode().split()): 100 for x in shared}


def test_quality_copies_do_not_raise_the_limit(spark):
    texts = [f"our common footer line\n{chr(97 + k // 26)}{chr(97 + k % 26)} and its own words" for k in range(60)] + ["one text with very many copies"] * 2000
    often = {r.line: r.n_docs for r in frequent_lines(line_stats(make(spark, texts))).collect()}
    assert often == {line_key(b"our common footer line".split()): 60}


def test_language(spark):
    rng = random.Random(5)
    words = {"aa": ["banana", "cabana", "nab"], "bb": ["zyxx", "wyzz", "xyw"], "cc": ["mopol", "lomop", "polmo"]}
    lang = [rng.choice(list(words)) for _ in range(300)]
    texts = [" ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 60))) for x in lang] + [None, "", "12 34 !!", " ".join(words["aa"] * 20 + words["bb"] * 5)]
    docs = make(spark, texts, lang=lang + ["aa", None, "bb", "aa"])
    got = {r.doc_id: r for r in language_id(docs).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(got[i].lang_pred == x for i, x in enumerate(lang))
    assert [got[300 + k].lang_pred for k in range(4)] == ["und", "und", "und", "aa"]
    assert got[303].n_langs == 2 and abs(got[303].score - 0.85) < 0.1
    assert sorted(r.doc_id for r in drop_unknown(docs).collect()) == [*range(300), 303]


def test_language_sets_are_those_of_elimination():
    rng = random.Random(3)
    langs = ["aa", "bb", "cc", "dd", "ee", "ff"]
    letters = dict(zip(langs, ["abcdefgh", "efghijkl", "ijklmnop", "mnopqrst", "qrstuvwx", "uvwxyzab"]))
    words = {x: ["".join(rng.choice(letters[x]) for _ in range(5)) for _ in range(200)] for x in langs}
    n = np.full((6, CELLS), 0.5)
    for k, x in enumerate(langs):
        n[k] += 200 * np.bincount(Trigrams()([" ".join(words[x])])[1], minlength=CELLS)
    mixture = Mixture(langs, np.log(n / n.sum(1, keepdims=True)))
    texts = [" ".join([rng.choice(words["aa"]) for _ in range(100)] + [rng.choice(words["dd"]) for _ in range(k % 4)]) for k in range(80)]
    row, cell = Trigrams()(texts)
    key, n = np.unique(row * CELLS + cell, return_counts=True)
    w, alive = mixture._eliminate(mixture.p[key % CELLS], n.astype(np.float32), key // CELLS, len(texts))
    names, score, found = mixture(texts)
    assert found == alive.sum(1).astype(int).tolist() and score == pytest.approx(w.max(1).tolist(), abs=1e-4)
    assert all(f == 2 for k, f in enumerate(found) if k % 4 > 1) and all(f == 1 for k, f in enumerate(found) if k % 4 == 0)


def test_packing(spark):
    from pathlib import Path

    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    texts = corpus(6) + ["a  b \n c\t d ", " lead", "tail ", "<|endoftext|> x", "日本語 текст 'll 1234"]
    got = pack_documents(make(spark, texts), Path(path).read_text(encoding="utf-8")).toPandas()
    want, total = set(), 0
    for i, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = len(ids) - 1024 * (math.ceil(len(ids) / 1024) - 1)
        b = [0, *range(first, len(ids) + 1, 1024)]
        want |= {(i, k, x, y - x, zlib.crc32(np.array(ids[x:y], dtype="<u4").tobytes())) for k, (x, y) in enumerate(zip(b, b[1:]))}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 1024
    assert got.sequence_id.nunique() <= math.ceil(total / 1024) + 2


def test_packing_queries_cut_at_added_tokens(spark, tmp_dir):
    from tokenizers import Tokenizer

    import corpus_pipeline

    tk = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y ", "<|endoftext| > <|endoftext|", "plain text", "", None]
    make(spark, texts).write.parquet(f"{tmp_dir}/documents.parquet")
    want = {(i, zlib.crc32(np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes())) for i, t in enumerate(texts)}
    assert tk.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for got in (op1_best_fit_packing(spark, tmp_dir), corpus_pipeline.packing(spark, make(spark, texts), tmp_dir)):
        assert {(r.doc_id, r.ids_crc32) for r in got.collect()} == want


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    rng = random.Random(1)
    for _ in range(60):
        ranks, toks = {bytes([b]): b for b in range(256)}, [b"a", b"b", b"c"]
        while len(toks) < 20:
            t = rng.choice(toks) + rng.choice(toks)
            toks += [t] if t not in toks else []
        new = toks[3:]
        rng.shuffle(new)
        ranks |= {t: 256 + i for i, t in enumerate(new)}
        e = tiktoken.Encoding("x", pat_str="[abc]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 5, 20, 30, 64, 65, 150]))) for _ in range(30)]
        assert replay_merges([w.encode() for w in words], ranks) == [e.encode_ordinary(w) for w in words]
    raw = open(vocabulary_path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    e = tiktoken.Encoding("y", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(raw), special_tokens={})
    texts = corpus(7) + ["日本語 текст 'll 1234  \n x", "<|endoftext|>", "a" * 5000, " \u0085 \x1c"]
    for r in bpe_round_trip(make(spark, texts), raw, public_tokenizers.PATTERN).collect():
        ids = e.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 16))
    x[60:] = x[:60] + rng.normal(size=(60, 16)) * rng.uniform(0.05, 0.4, (60, 1))
    x[5], x[6] = x[4], x[4] * 3
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)] + [(200, None, 0, "x"), (201, [0.0] * 16, 0, "x"), (202, [math.nan] + [1.0] * 15, 0, "x"), (203, [], 0, "x"), (204, [1.0, None], 0, "x"), (205, [math.inf] * 16, 0, "x"), (None, x[4].tolist(), 0, "x")]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(120))
    assert all(got[i].n_links <= link[i].sum() for i in range(120)) and found >= 0.9 * link.sum()
    if found == link.sum():
        want = components(range(120), zip(*np.nonzero(link)))
        assert {i: got[i].component_id for i in range(120)} == want
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(200, 206))
    assert got[None].component_id is None


def test_groups_of_large_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 10)
    monkeypatch.setattr(embeddings, "SHARD", 100)
    met = spark.range(400).select(F.col("id").alias("cid"), F.lit(7).cast("long").alias("bucket"))
    large = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    blocks = embeddings._blocks(met, large, 400)
    assert blocks.count() == 400 * 40
    assert blocks.groupBy("g").count().agg(F.max("count")).first()[0] <= 4 * embeddings.SHARD


def test_large_buckets_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.02
    got = near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 150 and all((r.n_links, r.component_id) == (149, 0) for r in got)


def test_class_lm(spark):
    texts = corpus(8)
    c, words = Counter(), [(t or "").encode().lower().split() for t in texts]
    for i, w in enumerate(words):
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
            c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    rows = class_lm_scores(make(spark, texts), classes=4, rounds=2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = words[r.doc_id] + [b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_warc(spark):
    pages = spark.createDataFrame([(5, "u", "x" * 200, "a"), (2, None, "x" * 200, "a"), (None, "q", "x" * 200, "a"), (3, "e", None, "a"), (4, "k\r\nz: y", "short", "a"), (6, "k", "short", "a"), (7, "k", "é" * 60, "a")], "page_id long, url string, html string, digest string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_round_trip(pages, common.shared_folder(spark, "t")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    x = (200, sha("x" * 200))
    assert got == {2: (*x, "response", None), 5: (*x, "revisit", 2), None: (*x, "revisit", 2), 3: (0, sha(""), "response", None), 4: (5, sha("short"), "response", None), 6: (5, sha("short"), "response", None), 7: (120, sha("é" * 60), "response", None)}
    index = write_archives(pages, common.shared_folder(spark, "t"))
    assert [bytes(r.payload) for r in read_archives(index.filter("page_id = 4")).collect()] == [b"short"]
    assert read_ranges(index.filter("page_id in (4, 6)"), gap=0).count() >= 1


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "back\\slash \\| <\\|", None, "", "<s><<SYS>> a <</SYS>>", "w " * 5000, "é ü"]
    rows = [(c, t, ["system", "user", "assistant", None][(c + t) % 4] if t else ["system", "user"][c % 2], texts[(c * 3 + t) % 8], "x") for c in range(6) for t in range(1 + 7 * c)] + [(None, 0, "assistant", "n", "x"), (9, None, "user", "q", "x"), (9, 1, "assistant", "r", "x"), (9, 1, "assistant", "r", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    assert df.filter(~unescape(escape(F.col("text"))).eqNullSafe(F.col("text"))).count() == 0
    said = defaultdict(list)
    for c, t, r, x, _ in rows:
        said[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert set(got) == set(said)
    for c, turns in said.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = format_windows(df.filter("conv_id = 4")).orderBy("window").collect()
    assert len(windows) > 1 and all(w.formatted.startswith("<|turn|>system\n") for w in windows)


def test_classifier(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "cat", "sat", "mat", "hat"]) for _ in range(30)) for _ in range(120)]
    bad = ["".join(rng.choice("!#$%&XYZQ |") for _ in range(100)) for _ in range(20)]
    docs = make(spark, good + bad + [None, ""], lang=[rng.choice(["en", "fr", None]) for _ in range(142)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(121, 0, 0), (122, None, 1), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier(docs, labels).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    assert len(got) == 142
    # The threshold is the quantile of the held-out trusted alone: with so few, their largest perplexity.
    assert all(r.kept for r in got.values() if r.held and r.trusted)
    assert all(got[i].kept == (got[i].perplexity <= got[i].threshold) for i in range(140))
    assert sum(got[i].kept for i in range(120)) >= 100 and not any(got[i].kept for i in range(120, 142))
    assert got[140].perplexity is None and got[0].perplexity < got[120].perplexity


def test_classifier_query_uses_the_quantile_itself(spark, tmp_dir):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "cat", "sat", "mat", "hat"]) for _ in range(rng.randint(5, 40))) for _ in range(200)]
    make(spark, good, lang=["en" if k % 4 else "fr" for k in range(200)]).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    rows = op10_quality_classifier(spark, tmp_dir).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()
    for lang in ("en", "fr"):
        # So few held-out documents: the quantile is the largest of them.
        top = max(math.log10(r.perplexity) for r in rows if r.held and r.lang == lang)
        assert all(top - 1e-9 <= math.log10(r.threshold) <= top + 1.01e-4 for r in rows if r.lang == lang)


def test_empty_tables(spark):
    from pathlib import Path

    import public_tokenizers

    docs = make(spark, ["x"]).filter("doc_id > 5")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vocabulary = Path(vocabulary_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    ranks = Path(vocabulary_path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    results = [pack_documents(docs, vocabulary), bpe_round_trip(docs, ranks, public_tokenizers.PATTERN), near_vectors(vectors), class_lm_scores(docs), archive_round_trip(pages, common.shared_folder(spark, "e")), format_conversations(turns), quality_rules(docs), apply_rules(docs), jaccard_components(docs), keep_first(docs), language_id(docs), drop_unknown(docs), quality_classifier(docs, labels)]
    assert [r.count() for r in results] == [0] * len(results)


def test_language_counts_long_texts_in_slices(monkeypatch):
    from caisse.llm import language

    rng = random.Random(11)
    texts = [None, "".join(rng.choice("abÉİß ,\n") for _ in range(700)), "", "kurz", "y" * 333, "Σας " * 40, "x"]
    row, cell = Trigrams()(texts)
    want = Counter((row * CELLS + cell).tolist())
    monkeypatch.setattr(language, "PIECE", 50)
    got, seen = Counter(), 0
    for first, rows, key, n in Trigrams().counts(texts):
        assert first == seen and len(set(key.tolist())) == len(key)
        seen += rows
        got.update(dict(zip((key + first * CELLS).tolist(), n.tolist())))
    assert got == want and seen == len(texts)


def test_language_many_labels_and_clashing_columns(spark, monkeypatch):
    from caisse.llm import language

    monkeypatch.setattr(language, "LABELS", 3)
    texts = [f"{chr(97 + k % 20) * 6} {chr(98 + k % 20) * 6}" for k in range(60)]
    docs = make(spark, texts + [None], lang=[f"l{k % 20:02d}" for k in range(60)] + ["l00"])
    got = {(r.lang, r.cell): r.n for r in language.count_trigrams(docs.filter("text is not null")).collect()}
    row, cell = Trigrams()(texts)
    assert got == Counter((f"l{r % 20:02d}", c) for r, c in zip(row.tolist(), cell.tolist()))
    odd = docs.withColumns({"lang_pred": F.lit("mine"), "n_langs": F.lit(7), "__row.x": F.lit(1)})
    kept = drop_unknown(odd)
    assert kept.columns == odd.columns and {(r.doc_id, r.text, r.lang_pred, r.n_langs) for r in kept.collect()} == {(i, t, "mine", 7) for i, t in enumerate(texts)}


def test_classifier_learns_from_every_trusted_document(spark, monkeypatch):
    from caisse.llm import kneser_ney

    class Seen(Exception):
        pass

    def seen(texts):
        raise Seen(texts.count())

    monkeypatch.setattr(kneser_ney, "train_model", seen)
    ids = spark.range(64_000).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.lit("en").alias("lang"), F.col("doc_id").cast("string").alias("text"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    with pytest.raises(Seen) as found:
        quality_classifier(docs, labels)
    trained = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0).count()
    assert trained > 50_000 and found.value.args == (trained,)


def test_classifier_moves_few_texts_it_does_not_learn_from(spark, monkeypatch):
    """Texts without trust are left out before the join that moves texts; those the map lets pass are left out by the join."""
    from caisse.llm import kneser_ney

    docs = spark.range(2_000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    ids = spark.range(0, 2_000, 7).withColumnRenamed("id", "doc_id")
    want = {7 * k for k in range(286) if 7 * k % 100}
    left = {r.doc_id for r in kneser_ney._in_map(docs, ids).collect()}
    assert want <= left and len(left) < len(want) + 10
    # Ids of unlike types are left to the join.
    assert kneser_ney._in_map(docs, ids.select(F.col("doc_id").cast("string"))) is docs
    # A map so small that most rows pass: the model's texts stay the same.
    monkeypatch.setattr(kneser_ney, "MAP_BITS", 1_000)
    assert want < {r.doc_id for r in kneser_ney._in_map(docs, ids).collect()}
    found = []
    monkeypatch.setattr(kneser_ney, "train_model", lambda texts: found.append(texts.collect()) or [])
    monkeypatch.setattr(kneser_ney, "score_documents", lambda rows, model: rows.select("doc_id", "lang", F.lit(1).alias("n_chars_scored"), F.lit(-1.0).alias("log10_prob")))
    quality_classifier(docs.withColumn("lang", F.lit("en")), ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    held = {r.doc_id for r in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    assert sorted(r.text for r in found[0]) == sorted(str(i) for i in want - held)


def test_classifier_blocks_keep_every_text():
    from caisse.llm import kneser_ney

    for text in ("", "a", "é\ud800\x00 \U0001f600" * 999):
        assert kneser_ney._unpacked(kneser_ney._packed(text)) == text


def test_classifier_blocks_sort_few_characters_at_once(spark, monkeypatch):
    from caisse.llm import kneser_ney

    docs = make(spark, [t or "" for t in corpus(3)] + ["", None, "z" * 500]).coalesce(1)
    whole = {tuple(r) for r in kneser_ney._blocks(docs, True).collect()}
    monkeypatch.setattr(kneser_ney, "PART", 100)
    assert {tuple(r) for r in kneser_ney._blocks(docs, True).collect()} == whole
    texts = []
    monkeypatch.setattr(kneser_ney, "_distinct", lambda grams, parts, real=kneser_ney._distinct: texts.append(sum(map(len, parts))) or real(grams, parts))
    rows = pa.RecordBatch.from_pylist([{"doc_id": i, "lang": "en", "text": "ab " * 20, "task": 0} for i in range(90)])

    class Rows:
        dtypes = [("doc_id", "bigint")]
        select = lambda self, *a: self
        mapInArrow = lambda self, run, schema: list(run(iter([rows])))

    assert sum(b.num_rows for b in kneser_ney._blocks(Rows(), True)) and max(texts) <= 160 and len(texts) > 40
