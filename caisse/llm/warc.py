"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes gzip members, one per record, to archive files of bounded
size below a shared folder, and returns an index row per record: file, offset,
length, URL and digest. Selected records are read through the index: their
ranges are sorted per file, close ones are joined, and each joined range is one
read. Files are reached through Arrow's file systems, so the folder may lie in
any store that both can open.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caisse.llm.common import require

#: Bytes after which a task begins a new archive file.
FILE_BYTES = 64 << 20
#: Ranges closer than GAP are read together, in reads of about READ_BYTES.
GAP = 64 << 10
READ_BYTES = 4 << 20
#: Reads that one task makes, about.
READS = 16
#: Smallest payload that is stored as a revisit of an equal one.
MIN_REVISIT = 100

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, offset long, length long, url string, digest string"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _line(text: str | None) -> str:
    """A header value: control characters and percent signs percent-coded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in text or "")


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, refers_url) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit holds no payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_line(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_line(refers_url)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of RECORD from one gzip member; digest and size of a response come from its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    kind = fields["WARC-Type"]
    told = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != told:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": told,
        "refers_to": number(fields.get("WARC-Refers-To")),
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``; returns the index.

    Of equal payloads of at least MIN_REVISIT bytes, the smallest page_id is
    the response and the others revisit it. A null html is empty, a null url
    an empty one. A row without an id is stored; among equal payloads it
    revisits the smallest id, if there is one. Rows that repeat the smallest
    id are responses. Other columns are ignored. The index is written to
    ``folder``/index; a task that runs again writes files of its own, and the
    index names those of the attempt that succeeded.
    """
    require(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    first = rows.filter((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first", "first_url")
    rows = rows.join(first, "digest", "left")

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        out, at, path = None, 0, ""
        try:
            for b in batches:
                index = []
                for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "first_url"))):
                    page, url, payload, digest, of, of_url = r
                    revisit = of is not None and page != of
                    member = record(page, url, payload, digest, "revisit" if revisit else "response", of, of_url)
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, at = f"{folder}/{name}", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    index.append((page, path, at, len(member), url, digest))
                    at += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*index), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["page_id", "file", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    # The folder is made by the first writer that needs it, through Spark, before any task opens a file in it.
    spark = pages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_ranges(selected: DataFrame, gap: int = GAP, read_bytes: int = READ_BYTES) -> DataFrame:
    """(file, start, end, offsets, lengths): byte ranges that cover the selected index rows, close ones joined."""
    part = F.expr(f"offset div {read_bytes}")
    rows = selected.select("file", "offset", "length", part.alias("part")).distinct()
    from pyspark.sql import Window as W

    order = W.partitionBy("file", "part").orderBy("offset")
    far = F.coalesce((F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap).cast("int"), F.lit(1))
    rows = rows.withColumn("far", far).withColumn("run", F.sum("far").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy("file", "part", "run").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at"))
    return runs.select("file", F.col("at.offset")[0].alias("start"), F.expr("element_at(at, -1).offset + element_at(at, -1).length").alias("end"), "at")


def read_archives(selected: DataFrame) -> DataFrame:
    """The records (columns of RECORD) that the index rows ``selected`` point to, each once however often it is selected.

    Any number of tasks may read one archive. No index rows give no records;
    a record that does not match its digest stops the job.
    """

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def read(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem
        for b in batches:
            for file, start, end, at in zip(*(b.column(c).to_pylist() for c in ("file", "start", "end", "at"))):
                fs, path = FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    raw = f.read(end - start)
                yield pa.RecordBatch.from_pylist([parse(raw[x["offset"] - start : x["offset"] - start + x["length"]]) for x in at], schema=schema)

    # An index row is small and its record is not: tasks are counted by the bytes they read.
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    ranges = read_ranges(selected).repartition(max(1, -(-size // (READ_BYTES * READS))), "file", "start")
    return ranges.mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` and reads every record back, without the payloads."""
    return read_archives(write_archives(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
