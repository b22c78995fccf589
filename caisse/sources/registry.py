"""Dataset registry and import pipeline.

Layout under a shared root folder (never a machine-local path on a cluster):

* ``<root>/datasets/company_id=<c>/dataset_id=<d>/`` — each cleaned dataset,
  written once as Parquet. Later analyses and filters read it with predicate
  pushdown instead of re-reading and re-cleaning the source file; writing it
  also cuts the lineage of the cleaning jobs.
* ``<root>/registry/company_id=<c>/`` — one row per (dataset, version) with
  counts and JSON snapshots of preview, dashboard, insights, alerts and
  predictions. Appends only; the current state of a dataset is its latest
  version (``row_number() over (partition by id order by version desc) = 1``).
  Partitioning by company makes the tenant filter a partition pruning.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from caisse.operators import insights as ins
from caisse.operators import profile as prof
from caisse.operators.cleaning import clean
from caisse.operators.kpis import dashboard_fold
from caisse.plans.sales import SalesAnalysis
from caisse.sources.files import ROW_ID, detect_format, read_sales

REGISTRY_DDL = (
    "id long, version int, filename string, original_name string, file_type string, storage_path string, "
    "dataset_path string, row_count long, column_count int, summary string, dashboard string, insights string, "
    "alerts string, predictions string, user_id long, company_id long, created_at timestamp"
)
HISTORY_COLUMNS = ["id", "filename", "original_name", "row_count", "column_count", "created_at"]
NOT_FOUND = "Fichier introuvable"


def default_root(spark: SparkSession) -> str:
    """A folder under the cluster's ``spark.checkpoint.dir``, the same for every application.

    Not under the context's own checkpoint folder: that one is new in each
    application, and a registry there would begin empty after a restart.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("the registry needs a root folder: spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/caisse-registry"


def snapshot_row(cleaned: DataFrame, preview_rows: int = prof.HEAD_DEFAULT,
                 analysis: SalesAnalysis | None = None) -> DataFrame:
    """One row of JSON snapshots for a cleaned dataset (five analysis outputs).

    Several outputs read the same grouping-sets aggregate; pass an
    ``analysis`` whose aggregate is persisted to compute it once.
    """
    data = cleaned.drop(ROW_ID) if ROW_ID in cleaned.columns else cleaned
    a = analysis or SalesAnalysis(data)
    fold = dashboard_fold(a.measures, a.aggregate)
    stats = prof.table_stats(data)
    summary = fold
    record = a.dashboard_record().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_record"))
    insight_list = ins.insights(summary).agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("_insights"))
    alert_list = ins.alerts(summary).agg(F.sort_array(F.collect_list(F.struct(
        "position", "type", "severity", "status", "message"))).alias("_alerts"))
    model = a.forecast_summary()
    fc = a.forecast().agg(F.sort_array(F.collect_list(F.struct("month", "value", "low", "high", "kind"))).alias("_forecast"))
    an = a.anomalies().agg(F.sort_array(F.collect_list(F.struct("month", "value", "z_score", "reason"))).alias("_anomalies"))
    hist = a.historical().agg(F.sort_array(F.collect_list(F.struct("month", "value", "kind"))).alias("_historical"))
    types = F.to_json(F.struct(*[F.lit(prof.dtype_name(f.dataType)).alias(f.name) for f in data.schema.fields]))
    head = prof.head_sample(cleaned, preview_rows)
    sample = head.agg(F.collect_list(F.struct(
        ROW_ID, *[F.col(f"`{c}`") for c in data.columns])).alias("_sample")) if ROW_ID in cleaned.columns else \
        head.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in data.columns])).alias("_sample"))
    missing = data.agg(F.to_json(F.struct(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in data.columns])).alias("_missing"))
    parts = [fold.select("row_count"), stats.select(F.col("duplicate_count").alias("_dups")),
             record, insight_list, alert_list, model.select("trend", "confidence_score", "message", "method", "model"),
             fc, an, hist, sample, missing]
    merged = ins.merge_rows(*parts)
    sample_rows = F.transform(F.array_sort(F.col("_sample")), lambda r: r.dropFields(ROW_ID)) if ROW_ID in cleaned.columns \
        else F.col("_sample")
    return merged.select(
        F.col("row_count").cast("long").alias("row_count"),
        F.lit(len(data.columns)).alias("column_count"),
        F.to_json(F.struct(
            F.col("row_count").alias("rows"), F.array(*[F.lit(c) for c in data.columns]).alias("columns"),
            F.from_json(types, "map<string,string>").alias("types"),
            F.from_json(F.col("_missing"), "map<string,long>").alias("missing_values"),
            F.col("_dups").alias("duplication_count"), sample_rows.alias("sample_rows"),
        )).alias("summary"),
        F.col("_record").alias("dashboard"),
        F.to_json(F.transform(F.col("_insights"), lambda x: x["text"])).alias("insights"),
        F.to_json(F.transform(F.col("_alerts"), lambda x: x.dropFields("position"))).alias("alerts"),
        F.to_json(F.struct(
            F.col("_forecast").alias("forecast"), F.col("_historical").alias("historical"),
            F.col("_anomalies").alias("anomalies"), "trend", "confidence_score", "method", "message", "model",
        )).alias("predictions"),
    )


class Registry:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or default_root(spark)).rstrip("/")

    @property
    def registry_path(self) -> str:
        return f"{self.root}/registry"

    def dataset_path(self, company_id: int, dataset_id: int) -> str:
        return f"{self.root}/datasets/company_id={company_id}/dataset_id={dataset_id}"

    def table(self) -> DataFrame:
        """All versions (empty with the registry schema when nothing was written yet)."""
        try:
            return self.spark.read.schema(REGISTRY_DDL).parquet(self.registry_path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            return self.spark.createDataFrame([], REGISTRY_DDL)

    def latest(self, company_id: int | None = None) -> DataFrame:
        """The latest version of every dataset (of one company when given).

        The company filter is applied before the window — a dataset belongs to
        one company — so it prunes the registry's ``company_id`` partitions.
        """
        table = self.table()
        if company_id is not None:
            table = table.filter(F.col("company_id") == company_id)
        w = W.partitionBy("company_id", "id").orderBy(F.desc("version"), F.desc("created_at"))
        return table.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

    def history(self, company_id: int) -> DataFrame:
        """Datasets of one company, newest first (partition-pruned on ``company_id``)."""
        return self.latest(company_id).orderBy(F.desc("created_at")).select(*HISTORY_COLUMNS)

    def record(self, dataset_id: int, company_id: int) -> DataFrame:
        """One dataset, visible only to its company (another tenant's id reads as not found)."""
        return self.latest(company_id).filter(F.col("id") == dataset_id)

    def snapshot(self, dataset_id: int, company_id: int, field: str = "summary") -> str:
        """A stored snapshot; raises when the record is not visible."""
        row = self.record(dataset_id, company_id).select(field).first()
        if row is None:
            raise LookupError(NOT_FOUND)
        return row[0]

    def cleaned(self, dataset_id: int, company_id: int) -> DataFrame:
        """The stored cleaned rows of a visible dataset."""
        row = self.record(dataset_id, company_id).select("dataset_path").first()
        if row is None:
            raise LookupError(NOT_FOUND)
        return self.spark.read.parquet(row[0])

    def next_id(self) -> int:
        """A random id: imports that run at the same time do not meet."""
        return uuid.uuid4().int >> 66 or 1

    def _append(self, row: DataFrame) -> None:
        row.select(*[c.split()[0] for c in REGISTRY_DDL.split(", ")]).write.mode("append").partitionBy(
            "company_id").parquet(self.registry_path)

    def import_file(self, path: str, user_id: int, company_id: int, original_name: str | None = None,
                    dataset_id: int | None = None) -> int:
        """S3: read -> clean -> write cleaned Parquet -> analyse -> append version 1.

        With a ``dataset_id`` that the company already has, nothing is done:
        the file was imported before (a replayed batch).
        """
        fmt = detect_format(original_name or path)
        if dataset_id is not None and self.record(dataset_id, company_id).limit(1).count():
            return dataset_id
        # A folder that is there although the registry has no such record is left from an import that failed.
        mode = "errorifexists" if dataset_id is None else "overwrite"
        dataset_id = dataset_id or self.next_id()
        cleaned, report = clean(read_sales(self.spark, path, fmt))
        out = self.dataset_path(company_id, dataset_id)
        try:
            cleaned.write.mode(mode).parquet(out)
        finally:
            report.raw_groups.unpersist()
        stored = self.spark.read.parquet(out)
        self._write_version(stored, dataset_id, 1, path, original_name or Path(path).name, fmt, out, user_id, company_id)
        return dataset_id

    def _write_version(self, cleaned: DataFrame, *meta) -> None:
        data = cleaned.drop(ROW_ID) if ROW_ID in cleaned.columns else cleaned
        analysis = SalesAnalysis(data)
        analysis.persist_aggregate()
        try:
            self._append(self._row(cleaned, *meta, analysis=analysis))
        finally:
            analysis.aggregate.unpersist()

    def reanalyse(self, dataset_id: int, company_id: int, user_id: int, filters: dict[str, str] | None = None) -> DataFrame:
        """Recompute the snapshots of a dataset; a new version is stored only without filters."""
        from caisse.operators.filters import apply_filters

        current = self.record(dataset_id, company_id).first()
        if current is None:
            raise LookupError(NOT_FOUND)
        stored = self.spark.read.parquet(current["dataset_path"])
        subset = apply_filters(stored, filters)
        meta = (dataset_id, current["version"] + 1, current["storage_path"], current["original_name"],
                current["file_type"], current["dataset_path"], user_id, company_id)
        if not filters:
            self._write_version(subset, *meta)
        return self._row(subset, *meta)

    def _row(self, cleaned: DataFrame, dataset_id: int, version: int, path: str, original: str, fmt: str,
             dataset_path: str, user_id: int, company_id: int, analysis: SalesAnalysis | None = None) -> DataFrame:
        snap = snapshot_row(cleaned, analysis=analysis)
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        return snap.select(
            F.lit(dataset_id).cast("long").alias("id"), F.lit(version).cast("int").alias("version"),
            F.lit(Path(path).name).alias("filename"), F.lit(original).alias("original_name"),
            F.lit(fmt).alias("file_type"), F.lit(path).alias("storage_path"), F.lit(dataset_path).alias("dataset_path"),
            "row_count", F.col("column_count").cast("int").alias("column_count"),
            "summary", "dashboard", "insights", "alerts", "predictions",
            F.lit(user_id).cast("long").alias("user_id"), F.lit(company_id).cast("long").alias("company_id"),
            F.lit(now).cast("timestamp").alias("created_at"),
        )


def with_company(records: DataFrame, companies: DataFrame, name_col: str = "name") -> DataFrame:
    """Registry rows with their company's name (left equi-join on ``company_id``).

    No broadcast hint: the number of tenants is not bounded by construction, so
    Spark's size statistics / AQE choose between broadcast and shuffle join.
    """
    comp = companies.select(F.col("id").alias("company_id"), F.col(name_col).alias("company_name"))
    return records.join(comp, "company_id", "left")
