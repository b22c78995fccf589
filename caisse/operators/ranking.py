"""Rows by rank in a total order, without sorting them in one task.

A table is cut into range partitions of its order. Their sizes, one number
each, are the rank index: it tells which partition holds a rank and how many
rows stand before it. Only those partitions are then read and sorted.

``ranked_values`` reads single ranks of counted values (medians);
``SortedTable`` reads pages, near or far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caisse.session import ensure_checkpoint_dir, scratch_folder

PART = "_part"


def ranked_values(counted: DataFrame, ranks: dict[int, list[int]]) -> dict[int, dict[int, float]]:
    """``{cid: {rank: value}}`` of the 1-based ``ranks`` per ``cid`` in ``counted`` (cid, v, n): n copies of the value v, nulls first.

    ``counted`` is cut into ranges of (cid, v) and written, so that both jobs
    see the same ranges. A rank beyond the copies of its cid has no entry.
    """
    if not ranks:
        return {}
    ensure_checkpoint_dir(counted.sparkSession)
    ranged = counted.repartitionByRange("cid", "v").withColumn(PART, F.spark_partition_id()).checkpoint()
    sizes = sorted((r["cid"], r[PART], r["n"]) for r in ranged.groupBy("cid", PART).agg(F.sum("n").alias("n")).collect())
    before, wanted = {}, []
    for cid, part, n in sizes:
        first = before.get(cid, 0)
        before[cid] = first + n
        wanted += [(cid, part, rank, rank - first) for rank in ranks.get(cid, []) if first < rank <= first + n]
    if not wanted:
        return {}
    places = F.broadcast(counted.sparkSession.createDataFrame(wanted, f"cid int, {PART} int, rank long, place long"))
    upto = F.sum("n").over(W.partitionBy("cid", PART).orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    held = ranged.join(F.broadcast(counted.sparkSession.createDataFrame(sorted({w[:2] for w in wanted}), f"cid int, {PART} int")), ["cid", PART])
    hits = held.withColumn("upto", upto).join(places, ["cid", PART]).filter("place <= upto and place > upto - n")
    out: dict[int, dict[int, float]] = {}
    for r in hits.select("cid", "rank", "v").collect():
        out.setdefault(r["cid"], {})[r["rank"]] = r["v"]
    return out


class SortedTable:
    """A table in a total order, written in range partitions, from which pages are read by rank or after a row.

    ``keys`` are (column, ascending) pairs; nulls come first in ascending and
    last in descending order. Rows that agree in all keys may come in any
    order: end with a key that tells them apart. The folder of the written
    table belongs to the caller; ``open`` finds it again.
    """

    def __init__(self, table: DataFrame, keys: list[tuple[Column, bool]]):
        self.names = [f"_key{i}" for i in range(len(keys))]
        self.ascending = [up for _, up in keys]
        self.table = table
        sizes = {r[PART]: r["n"] for r in table.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}
        #: (partition, rows before it, rows), in order: the rank index.
        self.index, self.rows = [], 0
        for part in sorted(sizes):
            self.index.append((part, self.rows, sizes[part]))
            self.rows += sizes[part]

    @classmethod
    def write(cls, df: DataFrame, keys: list[tuple[Column, bool]], path: str | None = None) -> SortedTable:
        """Sort ``df`` into range partitions below ``path`` (a new folder of the shared checkpoint folder by default)."""
        path = path or scratch_folder(df.sparkSession, "sorted")
        keyed = df.select("*", *[k.alias(f"_key{i}") for i, (k, _) in enumerate(keys)])
        order = _order([f"_key{i}" for i in range(len(keys))], [up for _, up in keys])
        keyed.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()).write.partitionBy(PART).parquet(path)
        schema = T.StructType([*keyed.schema, T.StructField(PART, T.IntegerType())])
        return cls(df.sparkSession.read.schema(schema).parquet(path), keys)

    @classmethod
    def open(cls, spark, path: str, keys: list[tuple[Column, bool]]) -> SortedTable:
        return cls(spark.read.parquet(path), keys)

    def _held(self, parts: list[int], size: int, skip: int = 0, condition: Column | None = None) -> DataFrame:
        rows = self.table.filter(F.col(PART).isin(parts))
        rows = rows if condition is None else rows.filter(condition)
        return rows.orderBy(*_order(self.names, self.ascending)).offset(skip).limit(size)

    def rank_range(self, first: int, size: int) -> DataFrame:
        """``size`` rows from the 0-based rank ``first``; only the partitions that hold them are read."""
        parts = [(p, before) for p, before, n in self.index if before < first + size and before + n > first]
        return self._held([p for p, _ in parts], size, first - parts[0][1] if parts else 0)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1); a page beyond the last has no rows."""
        return self.rank_range((max(1, int(number)) - 1) * size, size)

    def after(self, row: Row, size: int) -> DataFrame:
        """The ``size`` rows that follow ``row`` (of an earlier page, with its keys), read from its partition on."""
        parts, rest = [], size
        for part, _, n in self.index:
            if part >= row[PART] and rest > 0:
                parts.append(part)
                rest -= n if part > row[PART] else 0
        tests, same = [], F.lit(True)
        for name, up in zip(self.names, self.ascending):
            key, last = F.col(name), F.lit(row[name])
            if row[name] is None:
                later = key.isNotNull() if up else F.lit(False)
            else:
                later = key > last if up else (key < last) | key.isNull()
            tests.append(same & later)
            same = same & key.eqNullSafe(last)
        return self._held(parts, size, condition=reduce(lambda a, b: a | b, tests))

    @property
    def columns(self) -> list[str]:
        """The columns of the table that was sorted."""
        return [c for c in self.table.columns if c not in self.names and c != PART]


def _order(names: list[str], ascending: list[bool]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in zip(names, ascending)]
