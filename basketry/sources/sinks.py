"""Sinks: CSV exports (S22-S25) and published derived tables.

Spark cannot overwrite a path it is reading, so a rebuild writes every table
to a fresh run folder and readers switch to it only after the run completes
(the newest folder under ``_PUBLISHED`` names the current run).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV, written in parallel (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def safe_name(c: str | Column) -> Column:
    """File-safe supplier name: odd characters become ``_``, and a hash of the raw name keeps names apart.

    Letters, digits, space, ``-``, ``_`` and ``.`` of any script stay, at any
    length; two names that differ anywhere get two files.
    """
    raw = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("NO_SUPPLIER"))
    return F.concat(F.trim(F.regexp_replace(raw, r"[^\p{L}\p{N} _.\-]", "_")), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 8))


def write_supplier_sheets(sheet: DataFrame, path: str, supplier_col: str = "supplier_name") -> None:
    """One order sheet per supplier with blank physical-stock / order-qty columns."""
    (sheet.withColumn("physical_stock", F.lit("")).withColumn("order_qty", F.lit(""))
     .withColumn("safe_supplier", safe_name(supplier_col))
     .repartition("safe_supplier")
     .write.mode("overwrite").partitionBy("safe_supplier").option("header", True).csv(path))


def write_conversion_sheet(sheet: DataFrame, path: str) -> None:
    """The conversion-attention sheet with the two blank columns."""
    export_csv(sheet.withColumn("physical_stock", F.lit("")).withColumn("order_qty", F.lit("")), path)
