"""Exports (S8-S13): filtered rows and report tables.

The source app renders a workbook and a PDF; here the same content is a set
of plain tables, each a DataFrame that can be written anywhere Spark writes:

* ``donnees_filtrees`` — the filtered cleaned rows (S8 writes them as CSV);
* ``resume`` — one row of counts and KPIs (S10);
* ``top_clients`` / ``top_produits`` — ``(name, value)`` (S9);
* ``alertes`` — ``(type, severity, status, message)`` (S9);
* ``kpi_lines`` — six ``(label, value)`` rows (S11);
* ``bars`` — chart bar widths for the two top lists (S12);
* ``text_lines`` — insights and ``[severity] message`` alerts, eight each (S11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caisse.functions.text import format_eur
from caisse.operators import insights as ins
from caisse.operators import profile as prof
from caisse.operators.filters import EMPTY_EXPORT, apply_filters, ensure_not_empty, filter_predicate
from caisse.operators.kpis import TOP_LISTS, dashboard_fold, top_k, top_lists
from caisse.plans.sales import SalesAnalysis
from caisse.session import ensure_checkpoint_dir
from caisse.sources.files import ROW_ID

# ---------------------------------------------------------------------------
# Report labels and bar geometry.
# ---------------------------------------------------------------------------
KPI_LABELS = ["Chiffre d'affaires", "Marge", "Taux de marge", "Panier moyen", "Clients", "Produits"]
BAR_WIDTH = 150
BAR_MIN = 4
BAR_ITEMS = 5
NAME_MAX = 34
NAME_MISSING = "Non renseigne"
TEXT_LINES_MAX = 8


def export_rows(df: DataFrame, refuse_empty: bool = False) -> DataFrame:
    """Rows as a CSV export shows them: dates ``yyyy-MM-dd`` when every time is midnight.

    One aggregate over the timestamp columns looks for a time of day; with
    ``refuse_empty`` it also is the empty-export guard (S13).
    """
    ts_cols = [c for c, t in df.dtypes if t.startswith("timestamp")]
    date_only: dict[str, bool] = {}
    if ts_cols:
        row = df.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(F.date_format(F.col(f"`{c}`"), "HH:mm:ss.SSSSSS") != "00:00:00.000000").alias(f"t{i}") for i, c in enumerate(ts_cols)]
        ).first()
        date_only = {c: row[f"t{i}"] == 0 for i, c in enumerate(ts_cols)}
        if refuse_empty and not row["_n"]:
            raise ValueError(EMPTY_EXPORT)
    elif refuse_empty:
        ensure_not_empty(df)
    exprs = []
    for c in df.columns:
        if c == ROW_ID:
            continue
        if c in date_only:
            fmt = "yyyy-MM-dd" if date_only[c] else "yyyy-MM-dd HH:mm:ss"
            exprs.append(F.date_format(F.col(c), fmt).alias(c))
        else:
            exprs.append(F.col(f"`{c}`"))
    return df.select(*exprs)


def write_csv(df: DataFrame, path: str) -> None:
    """The filtered rows as CSV with a header (one folder of part files)."""
    export_rows(df, refuse_empty=True).write.mode("overwrite").option("header", True).csv(path)


class Report:
    """All report tables of one cleaned dataset under a filter map.

    The tables that are written together (``tables``) come from one row,
    ``record``: it is computed by one aggregate over the cleaned rows, which
    also counts the rows outside the selection, and written once.
    """

    def __init__(self, cleaned: DataFrame, filters: dict[str, str] | None = None):
        self.cleaned = cleaned
        self.filtered = apply_filters(cleaned, filters)
        self.analysis = SalesAnalysis(self.filtered.drop(ROW_ID) if ROW_ID in self.filtered.columns else self.filtered)
        everything = cleaned.drop(ROW_ID) if ROW_ID in cleaned.columns else cleaned
        self.counted = SalesAnalysis(everything, selected=filter_predicate(everything, filters or {}))

    def summary(self) -> DataFrame:
        a = self.analysis
        return dashboard_fold(a.measures, a.aggregate)

    def _resume(self, fold: DataFrame) -> DataFrame:
        cols = len([c for c in self.filtered.columns if c != ROW_ID])
        return fold.select(
            F.col("row_count").alias("lignes_filtrees"),
            F.col("total_row_count").alias("lignes_totales"),
            F.lit(cols).cast("int").alias("colonnes"),
            F.col("revenue_total").alias("chiffre_affaires"),
            F.col("margin_total").alias("marge"),
            F.col("margin_rate").alias("taux_marge"),
            F.col("client_count").alias("clients"),
            F.col("product_count").alias("produits"),
        )

    def resume(self) -> DataFrame:
        """One row of counts and KPIs, from one pass over the table."""
        return self._resume(dashboard_fold(self.counted.measures, self.counted.aggregate))

    def record(self) -> DataFrame:
        """The fold and the top lists of the selection, and ``total_row_count`` of the table, in one row."""
        a = self.counted
        return ins.merge_rows(dashboard_fold(a.measures, a.aggregate), top_lists(a.aggregate, BAR_ITEMS))

    def top(self, dimension: str) -> DataFrame:
        """``(name, value)`` top-5 of a dimension, in rank order column ``rank``."""
        return top_k(self.analysis.aggregate, BAR_ITEMS, [dimension]).select("rank", "name", "value")

    def alerts(self) -> DataFrame:
        return ins.alerts(self.summary()).select("position", "type", "severity", "status", "message")

    def kpi_lines(self) -> DataFrame:
        """The six ``(position, label, value)`` KPI lines."""
        d = dashboard_fold(self.analysis.measures, self.analysis.aggregate)
        rate = F.concat(_py_float_text(F.col("margin_rate")), F.lit(" %"))
        values = [
            format_eur("revenue_total"), format_eur("margin_total"), rate, format_eur("average_basket"),
            F.col("client_count").cast("string"), F.col("product_count").cast("string"),
        ]
        pairs = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(lbl).alias("label"), v.alias("value"))
                          for i, (lbl, v) in enumerate(zip(KPI_LABELS, values))])
        return d.select(F.explode(pairs).alias("k")).select("k.position", "k.label", "k.value")

    def text_lines(self) -> DataFrame:
        """``(section, position, text)`` — first 8 insights, first 8 alerts as ``[severity] message``."""
        i = ins.insights(self.summary()).filter(F.col("position") <= TEXT_LINES_MAX).select(
            F.lit("insights").alias("section"), "position", "text"
        )
        a = ins.alerts(self.summary()).filter(F.col("position") <= TEXT_LINES_MAX).select(
            F.lit("alertes").alias("section"), "position",
            F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("message")).alias("text"),
        )
        return i.unionByName(a)

    def bars(self) -> DataFrame:
        """``(section, rank, label, value, width, value_text)`` for the two bar charts."""
        both = top_k(self.analysis.aggregate, BAR_ITEMS, ["client", "product"])
        return bar_widths(both)

    def tables(self) -> dict[str, DataFrame]:
        """The named report tables; all but the rows themselves are read from the one written record."""
        ensure_checkpoint_dir(self.cleaned.sparkSession)
        record = self.record().checkpoint()
        if record.filter("row_count > 0").isEmpty():
            raise ValueError(EMPTY_EXPORT)

        def top(dimension: str) -> DataFrame:
            return record.select(F.explode(TOP_LISTS[dimension]).alias("t")).select("t.name", "t.value")

        return {
            "donnees_filtrees": export_rows(self.filtered),
            "resume": self._resume(record),
            "top_clients": top("client"),
            "top_produits": top("product"),
            "alertes": ins.alerts(record).select("type", "severity", "status", "message"),
        }

    def write(self, out_dir: str, fmt: str = "parquet") -> dict[str, str]:
        """Write every table to ``out_dir/<name>/``."""
        paths = {}
        for name, df in self.tables().items():
            path = f"{out_dir.rstrip('/')}/{name}"
            writer = df.write.mode("overwrite")
            (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
            paths[name] = path
        return paths


def bar_widths(tops: DataFrame) -> DataFrame:
    """S12 on a ``(dimension, rank, name, value)`` frame of at most five rows per dimension."""
    w = W.partitionBy("dimension")
    top_value = F.max("value").over(w)
    scale = F.when(F.coalesce(top_value, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(top_value)
    label = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit(NAME_MISSING))
    return tops.filter(F.col("rank") <= BAR_ITEMS).select(
        F.col("dimension"), "rank",
        F.substring(label, 1, NAME_MAX).alias("label"),
        "value",
        F.greatest(F.lit(float(BAR_MIN)), F.col("value") / scale * BAR_WIDTH).alias("width"),
        format_eur(F.col("value")).alias("value_text"),
    )


def _py_float_text(c: Column) -> Column:
    """``str(x)`` of a float that has at most one decimal (``36.8``, ``0.0``, ``100.0``)."""
    return F.format_string("%.1f", c.cast("double"))
