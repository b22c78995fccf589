"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

Leaves are digests of rows, in the order of their ids. A node is the digest of
up to ARITY consecutive nodes below it; a level ends where one node is left.

Checkpoint and recompute: only every LEVELS-th level of a tree is stored, so a
stored level holds one node for each aligned subtree of ARITY ** LEVELS nodes
of the stored level below. To extract proofs, each aligned subtree regenerates
its missing interior levels from those stored nodes, emits the siblings on the
way from each of them to the subtree's top, and drops the levels again. The
siblings above the top come from the same step one stored level higher.

No group is larger than an aligned subtree: a source that holds most of the
rows is many subtrees. Rows are numbered by a range-partitioned sort and a
prefix sum over one summary per partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.llm.common import cut, require

ARITY = 3
#: Levels from one stored level to the next: subtrees of 729 nodes.
LEVELS = 6

_PATH = "array<string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(col: Column) -> Column:
    """A value as the leaf digests it: ``-`` for null, else its UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column | None = None) -> Column:
    """Leaf of a row of ``docs`` (doc_id, source, lang, n_chars, text), with ``text`` in place of its own if given."""
    return digest(*(field(docs[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(docs["text"] if text is None else text))


def parent(nodes: list[str]) -> str:
    """The node above consecutive nodes (hex)."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def grow(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels of the subtree over ``nodes``, lowest first: ``levels`` of them above, or up to a single node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([parent(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """(left, right) per level: the other nodes of the run of node ``at``, concatenated, before and after it."""
    left, right = [], []
    for nodes in levels[:-1]:
        run = at - at % ARITY
        left.append("".join(nodes[run:at]))
        right.append("".join(nodes[at + 1 : run + ARITY]))
        at //= ARITY
    return left, right


def fold(node: Column, left: Column, right: Column) -> Column:
    """The root that a node and its siblings, level by level, lead to."""
    steps = F.arrays_zip(left.alias("left"), right.alias("right"))
    return F.aggregate(steps, node, lambda h, s: digest(s["left"], h, s["right"]))


def _runs(b):
    """Number of the run of equal (tree, block) of each row of a sorted batch, from 0."""
    tree, block = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "block"))
    return np.cumsum(np.r_[False, (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])]) if len(tree) else np.zeros(0, dtype=np.int64)


def _whole_subtrees(batches):
    """Batches re-cut so that each holds whole runs of equal (tree, block); no more than one subtree waits."""
    import pyarrow as pa

    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if rest is None else pa.concat_batches([rest, b])
        run = _runs(b)
        last = int(np.searchsorted(run, run[-1]))
        if last:
            yield b.slice(0, last)
        rest = b.slice(last)
    if rest is not None:
        yield rest


def _by_subtree(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}")


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, full, lone) of each aligned subtree: the node ``levels`` above, and the first single node."""

    def run(batches):
        import pyarrow as pa

        for b in _whole_subtrees(batches):
            at, nodes = _runs(b), b.column("digest").to_pylist()
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            full, lone = [], []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(nodes)]):
                up = grow(nodes[lo:hi], levels)
                full.append(up[-1][0])
                lone.append(next(x[0] for x in up if len(x) == 1))
            yield pa.RecordBatch.from_arrays([b.column("tree").take(pa.array(first)), b.column("block").take(pa.array(first)), pa.array(full, pa.string()), pa.array(lone, pa.string())], names=["tree", "pos", "full", "lone"])

    rows = nodes.select("tree", _block(levels).alias("block"), "pos", "digest")
    return _by_subtree(rows).mapInArrow(run, "tree long, pos long, full string, lone string")


def number_rows(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """``rows`` with tree, the number of their group in its order (nulls first), and pos, their place in it by ``keys``.

    One range-partitioned sort; its partitions are numbered from one summary
    each, which is all that reaches the driver. A group or key that holds most
    of the rows is spread over many partitions.
    """
    spark = rows.sparkSession
    rows = cut(rows.withColumn("__uid", F.monotonically_increasing_id()))
    order = [F.col(c).asc_nulls_first() for c in (group, *keys, "__uid")]
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("__part int, __run long, __at long")])

    def walk(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, run, at = TaskContext.get().partitionId(), None, -1, 0
        for b in batches:
            runs, ats = [], []
            for name in b.column(group).to_pylist():
                if run < 0 or name != last:
                    last, run, at = name, run + 1, 0
                runs.append(run)
                ats.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(ats, pa.int64())], names=[*b.schema.names, "__part", "__run", "__at"])

    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, schema))
    name = F.struct(F.col(group).alias("name"))
    parts = placed.groupBy("__part").agg(F.min_by(name, "__run").alias("first"), F.max_by(name, "__run").alias("last"), F.max(F.struct("__run", "__at")).alias("end"))
    bases, number, pos, before = [], -1, 0, None
    for p in sorted(parts.collect(), key=lambda p: p["__part"]):
        if before is None or before != p["first"]:
            number, pos = number + 1, 0
        bases.append((p["__part"], number, pos))
        number += p["end"]["__run"]
        pos = p["end"]["__at"] + 1 + (pos if p["end"]["__run"] == 0 else 0)
        before = p["last"]
    base = F.broadcast(spark.createDataFrame(bases, "__part int, __tree long, __pos long"))
    numbered = placed.join(base, "__part").withColumn("tree", F.col("__tree") + F.col("__run")).withColumn("pos", F.col("__at") + F.when(F.col("__run") == 0, F.col("__pos")).otherwise(0))
    return numbered.drop("__uid", "__part", "__run", "__at", "__tree", "__pos")


class Trees:
    """Trees over nodes (tree, pos, digest, ...), of which every ``levels``-th level is stored.

    ``stored`` holds these levels from the leaves up, ``tops`` the single node
    of each tree (tree, digest) and the number of the stored level below it.
    """

    def __init__(self, nodes: DataFrame, levels: int = LEVELS):
        self.levels, self.stored, self.tops = levels, [nodes], None
        while True:
            up = cut(_tops(self.stored[-1], levels))
            # A subtree is a tree's only one where there is no later one; this takes one row a tree, not a join.
            first = cut(up.groupBy("tree").agg(F.max("pos").alias("last"), F.min_by("full", "pos").alias("full"), F.min_by("lone", "pos").alias("lone")))
            ends = first.filter("last = 0").select("tree", F.col("lone").alias("digest"), F.lit(len(self.stored) - 1).alias("level"))
            self.tops = ends if self.tops is None else self.tops.union(ends)
            if first.filter("last > 0").limit(1).count() == 0:
                return
            self.stored.append(up.filter("pos > 0").select("tree", "pos", F.col("full").alias("digest")).union(first.filter("last > 0").select("tree", F.lit(0).cast("long"), "full")))

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with left and right: arrays of their siblings, level by level, then those ``above`` their tree.

        ``above`` has tree, left, right and any more columns, which the leaves get too.
        """
        more = [f for f in above.schema if f.name not in ("tree", "left", "right")]
        found = None
        for level in range(len(self.stored) - 1, -1, -1):
            heads = self.tops.filter(F.col("level") == level).select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), F.lit(True).alias("sole"), "left", "right", *(f.name for f in more))
            if found is not None:
                heads = heads.union(found.select("tree", F.col("pos").alias("block"), F.lit(False).alias("sole"), "left", "right", *(f.name for f in more)))
            found = self._extract(self.stored[level], heads, more)
        return found

    def _extract(self, nodes: DataFrame, heads: DataFrame, more: list) -> DataFrame:
        """``nodes`` with their siblings up to their subtree's top and those of the subtree's row in ``heads``."""
        own = [f for f in nodes.schema if f.name not in ("tree", "pos")]
        levels, names = self.levels, [f.name for f in (*own, *more)]
        rows = nodes.select("tree", _block(levels).alias("block"), "pos", *(f.name for f in own)).unionByName(heads.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True)

        def run(batches):
            import pyarrow as pa

            for b in _whole_subtrees(batches):
                at, node = _runs(b), b.column("digest").to_pylist()
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                size = np.diff(np.r_[first, len(node)])
                sole, up, down = (b.column(c).take(pa.array(first)).to_pylist() for c in ("sole", "left", "right"))
                left, right, steps = [], [], []
                for k, (lo, n) in enumerate(zip(first.tolist(), size.tolist())):
                    # The first row of a subtree is its head; the levels between are grown here and dropped.
                    grown = grow(node[lo + 1 : lo + n], None if sole[k] else levels)
                    for i in range(n - 1):
                        l, r = siblings(grown, i)
                        left += l + up[k]
                        right += r + down[k]
                        steps.append(len(l) + len(up[k]))
                leaf = np.ones(len(node), dtype=bool)
                leaf[first] = False
                leaf = np.flatnonzero(leaf)
                head = np.repeat(first, size)[leaf]
                ends = pa.array(np.cumsum([0, *steps]), pa.int32())
                cols = [b.column(c).take(pa.array(leaf)) for c in ("tree", "pos", *(f.name for f in own))] + [b.column(f.name).take(pa.array(head)) for f in more]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.string())) for x in (left, right)]
                yield pa.RecordBatch.from_arrays([*cols, *lists], names=["tree", "pos", *names, "left", "right"])

        schema = T.StructType([*T.StructType.fromDDL("tree long, pos long"), *own, *more, *T.StructType.fromDDL(f"left {_PATH}, right {_PATH}")])
        return _by_subtree(rows).mapInArrow(run, schema)


def merkle_proofs(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of ``leaves`` (source, doc_id, leaf) with subroot, root, and their proof: arrays left and right of siblings.

    Per source, leaves ascend by doc_id (nulls first, ties by leaf; equal
    leaves are each a leaf). A null source is a source, the first of all;
    sources ascend by their UTF-8 bytes. Each entry of left and right holds
    the concatenated siblings before and after the node at one level, from the
    leaf to the root; both are empty where a node stands alone. An empty table
    gives no rows. Other columns pass unchanged; one that is named like a new
    column is replaced by it.
    """
    require(leaves, "source", "doc_id", "leaf")
    others = [c for c in leaves.columns if c not in ("source", "doc_id", "leaf", "subroot", "root", "left", "right")]
    carried = F.struct(F.lit(0).alias("__none"), *(F.col(f"`{c}`") for c in others)).alias("__row")
    rows = number_rows(leaves.select("source", "doc_id", F.col("leaf").alias("digest"), carried), "source", ["doc_id", "digest"])
    sources = Trees(rows, levels)
    subroots = cut(sources.tops.select("tree", "digest"))
    whole = Trees(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest"), levels)
    top = whole.tops.first()
    none = F.array().cast(_PATH)
    above = whole.tops.select("tree", none.alias("left"), none.alias("right"))
    paths = whole.proofs(above).select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "left", "right")
    found = sources.proofs(cut(paths))
    root = F.lit(top["digest"] if top else None).cast("string").alias("root")
    return found.select("source", "doc_id", F.col("digest").alias("leaf"), *(F.col("__row")[c].alias(c) for c in others), "subroot", root, "left", "right")


def tampered_text(docs: DataFrame) -> Column:
    """The text, without its line ends where 2 divides the crc32 of the id; a null text or id changes nothing."""
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def manifest_check(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, and whether the tampered row still leads to the root.

    The manifest and the proofs are of ``docs``; folded_root is folded from the
    leaf of the row as ``tampered_text`` leaves it and the row's own proof.
    """
    require(docs, "doc_id", "source", "lang", "n_chars", "text")
    leaf = leaf_digest(docs)
    changed = tampered_text(docs)
    claimed = F.when(changed.eqNullSafe(docs["text"]), leaf).otherwise(leaf_digest(docs, changed))
    rows = docs.select("source", "doc_id", leaf.alias("leaf"), claimed.alias("claimed"))
    out = merkle_proofs(rows, levels).withColumn("folded_root", fold(F.col("claimed"), F.col("left"), F.col("right")))
    proof = F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), "")
    return out.select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
