"""Token-id files: fixed-width bit packing with block offsets.

Each id takes the fewest bits that hold every id of the vocabulary. Ids stand
in blocks of BLOCK ids; 64 ids fill exactly ``width`` 64-bit words, so a block
is packed and unpacked by one array operation per lane, and starts at a byte.

A file (little-endian) holds, in this order:

* the blocks, back to back; the last one is filled up to 64 ids with zeros;
* the byte offset of each block, and their end (uint64);
* the number of the first id of each document in the file, and the end (uint64);
* the documents' ids (int64), then one byte each: 1 where the id is null;
* a footer: MAGIC, bits per id, ids per block (uint32), ids, documents, place of the tables (uint64).

A reader takes the footer and the tables, then any document by the blocks it
lies in. Files are reached through Arrow's file systems, so their folder may
lie in any store that both can open; a manifest names those of the attempts
that succeeded, in the documents' order.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import require
from caisse.llm.packing import Encoder

MAGIC = b"IDPACK01"
#: Ids per block, a multiple of 64: what a random access unpacks at least.
BLOCK = 4096
#: Bytes of packed ids, and documents, after which a task begins a new file.
FILE_BYTES = 64 << 20
FILE_DOCS = 1 << 20
#: Ids that a reader unpacks at once; a longer document goes alone.
STEP = 1 << 18
END_ID = 0

_FOOTER = "<8sIIQQQ"
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, first_id long, last_id long"
DOCUMENT = "doc_id long, start long, ids binary"


def width_of(vocabulary_size: int) -> int:
    """Bits that hold every id below ``vocabulary_size``."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_ids(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, filled up to a multiple of 64 ids with zeros."""
    rows = -(-len(ids) // 64)
    padded = np.zeros(rows * 64, dtype=np.uint64)
    padded[: len(ids)] = ids
    lanes = np.ascontiguousarray(padded.reshape(rows, 64).T)
    words = np.zeros((width, rows), dtype="<u8")
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return words.T.tobytes()


def unpack_ids(raw: bytes, width: int) -> np.ndarray:
    """The ids (uint32) of whole rows of 64, fill included."""
    words = np.ascontiguousarray(np.frombuffer(raw, dtype="<u8").reshape(-1, width).T)
    lanes = np.empty((64, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        lanes[i] = x & mask
    return lanes.T.reshape(-1)


class IdWriter:
    """Writes one file to an open stream; holds at most a few blocks of ids and the documents' tables."""

    def __init__(self, stream, width: int, block: int = BLOCK):
        self.stream, self.width, self.block = stream, width, block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.offsets, self.starts, self.docs = [0], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block * 16:
            self._write(self.n_waiting // self.block * self.block)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for a in range(0, n, self.block):
            self.at += -(-min(self.block, n - a) // 64) * self.width * 8
            self.offsets.append(self.at)
        self.stream.write(pack_ids(ids[:n], self.width))
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_waiting:
            self._write(self.n_waiting)
        known = [x for x in self.docs if x is not None]
        self.first, self.last = (known[0], known[-1]) if known else (None, None)
        for values, dtype in ((self.offsets, "<u8"), (self.starts, "<u8"), ([x or 0 for x in self.docs], "<i8"), ([x is None for x in self.docs], "u1")):
            self.stream.write(np.array(values, dtype=dtype).tobytes())
        self.stream.write(struct.pack(_FOOTER, MAGIC, self.width, self.block, self.n_ids, len(self.docs), self.at))
        self.stream.close()


class IdReader:
    """Random access to the documents of one file, given as a seekable binary stream and its size."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - struct.calcsize(_FOOTER))
        magic, self.width, self.block, self.n_ids, self.n_docs, at = struct.unpack(_FOOTER, stream.read(struct.calcsize(_FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        stream.seek(at)
        blocks = -(-self.n_ids // self.block)
        read = lambda n, dtype: np.frombuffer(stream.read(n * np.dtype(dtype).itemsize), dtype=dtype)
        self.offsets, self.starts = read(blocks + 1, "<u8").astype(np.int64), read(self.n_docs + 1, "<u8").astype(np.int64)
        self.doc_ids, self.null = read(self.n_docs, "<i8"), read(self.n_docs, "u1").astype(bool)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids with the numbers first to last - 1 in the file, by one read of the blocks they lie in."""
        if first >= last:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // self.block, -(-last // self.block)
        self.stream.seek(int(self.offsets[a]))
        found = unpack_ids(self.stream.read(int(self.offsets[b] - self.offsets[a])), self.width)
        return found[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def find(self, lo: int | None, hi: int | None) -> tuple[int, int]:
        """Numbers (first, end) of the documents whose id is between lo and hi; all, those without an id too, without bounds."""
        nulls = int(self.null.sum())
        known = self.doc_ids[nulls:]
        first = 0 if lo is None and hi is None else nulls + (0 if lo is None else int(np.searchsorted(known, lo)))
        return first, self.n_docs if hi is None else nulls + int(np.searchsorted(known, hi, side="right"))

    def documents(self, first: int, end: int):
        """(k, ids) of the documents first to end - 1; about STEP ids are held at once."""
        while first < end:
            last = min(end, max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + STEP, side="right")) - 1))
            at = int(self.starts[first])
            ids = self.ids(at, int(self.starts[last]))
            for k in range(first, last):
                yield k, ids[int(self.starts[k]) - at : int(self.starts[k + 1]) - at]
            first = last


def write_ids(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode each text, append ``end_id``, write the ids below ``folder`` in ascending order of the id; returns the manifest.

    ``vocabulary`` is the content of a file of the tokenizers library; its added
    tokens get their own ids. A null text is empty: the end id alone. Null ids
    come first; equal ids, a third of all rows too, are spread over several
    files in any order. Tasks sort a range of ids each and write files of
    about FILE_BYTES; a task that runs again writes files of its own. Other
    columns are ignored; an empty table gives no files.
    """
    import json

    require(docs, id_col, text_col)
    spark = docs.sparkSession
    file = json.loads(vocabulary)
    size = 1 + max([end_id, *file["model"]["vocab"].values(), *(t["id"] for t in file.get("added_tokens", []))])
    width, shared = width_of(size), spark.sparkContext.broadcast(vocabulary)

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, base = FileSystem.from_uri(folder)
        part, encode, out, made = TaskContext.get().partitionId(), None, None, []
        end = np.array([end_id], dtype=np.uint32)

        def close():
            out.close()
            made.append((part, len(made), path, len(out.docs), out.n_ids, out.first, out.last))

        for b in batches:
            encode = encode or Encoder(shared.value)
            texts = b.column("text").to_pylist()
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(texts)):
                if out is not None and (out.at >= FILE_BYTES or len(out.docs) >= FILE_DOCS):
                    close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.ids"
                    path = f"{folder}/{name}"
                    out = IdWriter(fs.open_output_stream(f"{base}/{name}", compression=None), width)
                out.add(doc_id, np.concatenate([np.frombuffer(ids, dtype="<u4"), end]))
        if out is not None:
            close()
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["part", "seq", "file", "n_docs", "n_ids", "first_id", "last_id"]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], type=t) for i, t in enumerate(types)], names=names)

    # The folder is made through Spark before any task opens a file in it.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("salt"))
    order = [F.asc_nulls_first("doc_id"), F.asc("salt")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """``manifest`` with base: how many ids stand in all files before each file. One number a task of the writer reaches the driver."""
    from pyspark.sql import Window as W

    spark = manifest.sparkSession
    totals = sorted(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.cumsum([0, *(r["n"] for r in totals)]).tolist()
    parts = spark.createDataFrame([(r["part"], at) for r, at in zip(totals, before)], "part int, before long")
    earlier = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("earlier", earlier).join(parts, "part").withColumn("base", F.col("before") + F.col("earlier")).drop("before", "earlier")


def read_ids(manifest: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """DOCUMENT rows of the files in ``manifest``: doc_id, start (ids of all documents before it), ids (little-endian uint32).

    With ``lo`` or ``hi``, only documents whose id lies between them: files are
    chosen by the manifest, blocks by the files' tables.
    """
    manifest = with_bases(manifest)
    if lo is not None:
        manifest = manifest.filter(F.col("last_id") >= lo)
    if hi is not None:
        manifest = manifest.filter(F.col("first_id") <= hi)

    def read(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        names, types = ["doc_id", "start", "ids"], (pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                fs, path = FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    r = IdReader(f, f.size())
                    rows, size = [], 0
                    for k, ids in r.documents(*r.find(lo, hi)):
                        rows.append((None if r.null[k] else int(r.doc_ids[k]), base + int(r.starts[k]), ids.astype("<u4").tobytes()))
                        size += len(ids)
                        if size >= STEP:
                            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), types)], names=names)

    files = manifest.count()
    return manifest.select("part", "seq", "file", "base").repartitionByRange(max(1, files), "part", "seq").mapInArrow(read, DOCUMENT)


def id_round_trip(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Writes ``docs`` as token-id files below ``folder`` and reads them back: doc_id, start, n_tokens, ids_crc32."""
    found = read_ids(write_ids(docs, vocabulary, folder))
    return found.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
