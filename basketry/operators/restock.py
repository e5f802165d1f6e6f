"""Restock recommendations and order sheets (step 06, sheets, purchase sheet).

All of these read only the latest grid day, so they are built on the
latest-day fast path (``product.latest_state``): one aggregation per product
over the sparse facts instead of a window over the dense grid. Dimension
joins are on product_id / supplier_name; their sizes are bounded by the
catalog, not by sales volume, and the planner/AQE picks broadcast or
sort-merge from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from .dims import lead_time


def _div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def first_supplier(mapping: DataFrame) -> DataFrame:
    """One supplier per product -- the smallest name (deterministic)."""
    return mapping.groupBy("product_id").agg(F.min("supplier_name").alias("supplier_name"))


def restock_recommendations(latest: DataFrame, mapping: DataFrame, location: DataFrame,
                            dimension: DataFrame) -> DataFrame:
    """Cover, min/max stock and required quantity on the last day."""
    sup = first_supplier(mapping)
    pred, stock = F.col("predicted_daily_demand"), F.col("pseudo_stock")
    return (
        latest.join(sup, "product_id", "left")
        .join(location, "supplier_name", "left")
        .join(dimension.select("product_id", "product_name"), "product_id", "left")
        .select(
            "date", "product_id", "product_name", "supplier_name",
            stock.alias("current_stock"),
            pred.alias("predicted_daily_demand"),
            _div(stock, pred).alias("days_of_cover"),
            F.when(F.col("supplier_name").isNull(), F.lit(2.0) * pred).otherwise(F.lit(7.0) * pred)
            .alias("min_stock"),
            (F.lit(30.0) * pred).alias("max_stock"),
            F.greatest(F.lit(30.0) * pred - stock, F.lit(0.0)).alias("required_quantity"),
            lead_time(F.col("supplier_region")).alias("lead_time_days"),
        )
    )


def replenishment_sheet(latest: DataFrame, dimension: DataFrame, mapping: DataFrame,
                        location: DataFrame, item_latest: DataFrame) -> DataFrame:
    """One row per (product, supplier) with region-based min/max."""
    pred = F.col("predicted_daily_demand")
    local = F.col("supplier_region") == "BELLARY"
    return (
        latest.select("product_id", "predicted_daily_demand")
        .join(dimension.select("product_id", "product_name"), "product_id", "left")
        .join(mapping, "product_id", "left")
        .join(location, "supplier_name", "left")
        .join(item_latest.select("product_id", "current_stock"), "product_id", "left")
        .select(
            F.col("product_id").alias("barcode"), "product_name", "supplier_name",
            F.col("current_stock").alias("system_stock"),
            round_half_up(pred, 2).alias("predicted_daily_demand"),
            round_half_up(pred * F.when(local, F.lit(7.0)).otherwise(F.lit(15.0)), 0).alias("min_stock"),
            round_half_up(pred * F.when(local, F.lit(15.0)).otherwise(F.lit(30.0)), 0).alias("max_stock"),
        )
    )


def conversion_attention_sheet(latest: DataFrame, dimension: DataFrame, mapping: DataFrame,
                               item_latest: DataFrame, floor: float = 0.02) -> DataFrame:
    """Demanded products with no supplier (left anti join)."""
    pred = F.col("predicted_daily_demand")
    return (
        latest.select("product_id", "predicted_daily_demand")
        .filter(pred > floor)
        .join(mapping.select("product_id"), "product_id", "left_anti")
        .join(dimension.select("product_id", "product_name"), "product_id", "left")
        .join(item_latest.select("product_id", "current_stock"), "product_id", "left")
        .select(
            F.col("product_id").alias("barcode"), "product_name", "current_stock",
            round_half_up(pred, 2).alias("predicted_daily_demand"),
            round_half_up(F.greatest(pred * F.lit(7.0), F.lit(5.0)), 0).alias("min_stock"),
            round_half_up(F.greatest(pred * F.lit(15.0), F.lit(5.0)), 0).alias("max_stock"),
        )
    )


def supplier_purchase_sheet(restock: DataFrame, latest: DataFrame, dimension: DataFrame,
                            item_latest: DataFrame, mapping: DataFrame, location: DataFrame,
                            safety_days: int = 3, review_days: int = 7) -> DataFrame:
    """Effective stock, target, required quantity and urgency per supplier row."""
    eff = F.greatest(F.col("system_stock"), F.col("pseudo_stock"), F.lit(0.0))
    pred = F.col("predicted_daily_demand")
    lead = F.col("lead_time_days")
    cover = _div(eff, pred)
    return (
        restock.select(F.col("product_id"), F.col("supplier_name"), "predicted_daily_demand")
        .join(dimension.select("product_id", "product_name"), "product_id", "left")
        .join(item_latest.select("product_id", F.col("current_stock").alias("system_stock")),
              "product_id", "left")
        .join(latest.select("product_id", "pseudo_stock"), "product_id", "left")
        .join(mapping.select("product_id", F.col("supplier_name").alias("_msup")), "product_id", "left")
        .join(location.select(F.col("supplier_name").alias("_msup"), "supplier_region"), "_msup", "left")
        .withColumn("lead_time_days", lead_time(F.col("supplier_region")))
        .select(
            F.col("product_id").alias("barcode"), "product_name", "supplier_name",
            "system_stock", "pseudo_stock", eff.alias("effective_stock"),
            pred.alias("predicted_daily_demand"), "lead_time_days",
            cover.alias("days_of_cover"),
            (pred * (lead + review_days).cast("double")).alias("target_stock"),
            F.greatest(pred * (lead + review_days).cast("double") + pred * F.lit(float(safety_days)) - eff,
                       F.lit(0.0)).alias("required_quantity"),
            (lead.cast("double") - cover).alias("urgency_score"),
        )
    )
