"""Spark session helpers.

The engine never hard-codes cluster paths: the checkpoint folder comes from
``spark.checkpoint.dir`` when the cluster sets it; a private temporary folder
is only created when the setting is missing (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "caisse") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


# Runtime SQL settings the plans rely on: adaptive re-planning (runtime join
# strategy, partition coalescing) and splitting of skewed join partitions, so
# a key holding a large share of the rows does not land in one task. The JVM
# never compiles a method above 8000 bytes of code but interprets it, some
# times slower; above that limit Spark is to generate smaller methods.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the engine relies on (idempotent, runtime-settable only)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows written once as Parquet under the shared checkpoint folder, so that each reader takes only its columns.

    Columns are written under plain names: those of the frame may agree or
    have any characters. A column type that Parquet lacks leaves a checkpoint.
    """
    if any(lacking in t for _, t in df.dtypes for lacking in ("void", "interval")):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    path = scratch_folder(df.sparkSession, kind)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = tempfile.mkdtemp(prefix="caisse-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
