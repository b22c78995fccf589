"""The queries of this package, one for each operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caisse.llm.bpe import bpe_round_trip
from caisse.llm.chat import format_conversations
from caisse.llm.class_lm import class_lm_scores
from caisse.llm.common import prepare, shared_folder, table
from caisse.llm.embeddings import near_vectors
from caisse.llm.idfiles import id_round_trip
from caisse.llm.jaccard import jaccard_components
from caisse.llm.kneser_ney import quality_classifier
from caisse.llm.language import language_id
from caisse.llm.merkle import manifest_check
from caisse.llm.packing import pack_documents
from caisse.llm.quality import quality_rules
from caisse.llm.runs import plant_runs, run_digests
from caisse.llm.warc import archive_round_trip


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on the driver; its content is sent to the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    prepare(spark)
    vocabulary = Path(vocabulary_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the multilingual rank file."""
    import public_tokenizers

    prepare(spark)
    ranks = Path(vocabulary_path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    return bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    prepare(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based language-model scores of every document."""
    prepare(spark)
    return class_lm_scores(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    prepare(spark)
    return archive_round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    prepare(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(extra))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    prepare(spark)
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    prepare(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    prepare(spark)
    return language_id(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document under a model of the trusted ones; the threshold is the language's quantile."""
    prepare(spark)
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, and whether each, half of them tampered with, still leads to the root."""
    prepare(spark)
    return manifest_check(table(spark, sf_dir, "documents"))


def op12_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as bit-packed token-id files and read back."""
    prepare(spark)
    vocabulary = Path(vocabulary_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return id_round_trip(table(spark, sf_dir, "documents"), vocabulary, shared_folder(spark, "ids"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, one in ten documents with planted ones, and the collapsed texts."""
    prepare(spark)
    return run_digests(plant_runs(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_byte_bpe, op3_embedding_near_dedup, op4_class_lm, op5_warc, op6_chat_formatting, op7_quality_rules, op8_jaccard_join, op9_language_id, op10_quality_classifier, op11_merkle_manifest, op12_token_id_files, op13_periodic_runs)}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             f AS (SELECT h, min(page_id) AS lowest FROM p WHERE strlen(h) >= 100 GROUP BY h)
        SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
               CASE WHEN f.lowest IS NOT NULL AND p.page_id IS DISTINCT FROM f.lowest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.lowest IS NOT NULL AND p.page_id IS DISTINCT FROM f.lowest THEN f.lowest END AS refers_to
        FROM p LEFT JOIN f ON p.h = f.h
    """,
    "op11_merkle_manifest": """
        WITH RECURSIVE
        -- The lowest bit of the crc32 of the decimal id, bit by bit.
        ids AS (
            SELECT doc_id, source, lang, n_chars, text,
                   list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS digits
            FROM documents),
        tampered AS (
            SELECT *, CASE WHEN list_reduce(list_prepend(CAST(4294967295 AS BIGINT), digits),
                            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) & 1 = 1
                      THEN replace(text, chr(10), '') ELSE text END AS changed
            FROM ids),
        head AS (
            SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS h
            FROM tampered),
        leaves AS (
            SELECT doc_id, source, sha256(h || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(h || coalesce(strlen(changed) || ':' || changed, '-')) AS claimed
            FROM head),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY source) AS n,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
            FROM leaves),
        nodes AS (
            SELECT tree, CAST(0 AS BIGINT) AS lvl, pos, n, leaf AS node FROM placed
            UNION ALL
            SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
        subroots AS (SELECT tree, node FROM nodes WHERE n = 1),
        tops AS (
            SELECT CAST(0 AS BIGINT) AS lvl, tree AS pos, (SELECT count(*) FROM subroots) AS n, node FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
        near AS (
            SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
            FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.pos),
        near_top AS (
            SELECT a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
            FROM tops a JOIN tops b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
        steps AS (
            SELECT p.tree, p.pos, 0 AS part, s.lvl, s.before, s.after FROM placed p JOIN near s ON s.tree = p.tree AND s.pos = p.pos // CAST(pow(3, s.lvl) AS BIGINT)
            UNION ALL
            SELECT p.tree, p.pos, 1, s.lvl, s.before, s.after FROM placed p JOIN near_top s ON s.pos = p.tree // CAST(pow(3, s.lvl) AS BIGINT)),
        proofs AS (
            SELECT tree, pos, list(before || '|' || after ORDER BY part, lvl) AS way, string_agg(before || after, '' ORDER BY part, lvl) AS proof FROM steps GROUP BY tree, pos),
        folded AS (
            SELECT p.doc_id, p.leaf, s.node AS subroot, (SELECT node FROM tops WHERE n = 1) AS root, sha256(coalesce(w.proof, '')) AS proof_sha256,
                   list_reduce(list_prepend(p.claimed, coalesce(w.way, [])), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
            FROM placed p JOIN subroots s USING (tree) LEFT JOIN proofs w ON w.tree = p.tree AND w.pos = p.pos)
        SELECT *, folded_root = root AS verified FROM folded
    """,
}
