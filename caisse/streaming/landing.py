"""Continuous import of sales files dropped in a landing folder.

The upload -> clean -> analyse -> register pipeline as a Structured Streaming
query: the ``binaryFile`` source lists new files (only their path is
selected, so file contents are not loaded by the stream itself), at most
``max_files`` per micro-batch, and ``foreachBatch`` runs the import of each
new file as ordinary Spark jobs. The stream's progress lives beside the
registry, in a folder of its own per company and landing folder, so a
restarted query resumes after the last committed batch and an executor loss
only retries tasks.

Each import writes its cleaned dataset and registry row; the dataset id is
derived from the company, the file and its modification time, so a batch
replayed after a failure finds what it has already imported.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caisse.sources.files import FORMATS
from caisse.sources.registry import Registry

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, landing_dir: str, max_files: int = 10) -> DataFrame:
    """New sales files of the landing folder (path and modification time)."""
    glob = "{" + ",".join(f"*{ext}" for ext in FORMATS) + "}"
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .load(landing_dir)
        .select("path", "modificationTime")
    )


def start_import(spark: SparkSession, landing_dir: str, registry: Registry, user_id: int, company_id: int,
                 checkpoint: str | None = None, max_files: int = 10, once: bool = False) -> StreamingQuery:
    """Start the continuous import; ``once=True`` processes what is there and stops."""
    folder = hashlib.sha256(landing_dir.rstrip("/").encode()).hexdigest()[:16]
    checkpoint = checkpoint or f"{registry.root}/offsets/company_id={company_id}/{folder}"

    def import_batch(batch: DataFrame, batch_id: int) -> None:
        # The batch is a bounded list of file paths (maxFilesPerTrigger).
        # The id follows from the company, the file and its time: a replayed
        # batch makes the same ids, other streams and files make others.
        key = F.xxhash64(F.lit(company_id), "path", "modificationTime").bitwiseAND((1 << 62) - 1)
        for r in batch.select("path", key.alias("id")).orderBy("path").collect():
            registry.import_file(r["path"].removeprefix("file:"), user_id, company_id, dataset_id=r["id"])

    writer = landing_stream(spark, landing_dir, max_files).writeStream.foreachBatch(import_batch).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()
