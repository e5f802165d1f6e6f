"""Dimension views (reference step 05).

"Latest row per key" is ``max_by`` over an ordering struct, pre-aggregated per
task before the shuffle, so a key holding a third of all rows is reduced there.
Spark sorts the rows of such an aggregate; sales lines are first brought to
their distinct names by a hash aggregate.
Ties on ``imported_at`` are broken by ``import_batch_id`` and then the value
itself, so the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .product import remap

LOCAL_REGION = "BELLARY"
OUTSIDE_REGION = "OUTSIDE"


def latest_by(df: DataFrame, key: Column | str, order: list[str], cols: list[str],
              key_name: str) -> DataFrame:
    """For each key, the columns of the row with the greatest ``order``."""
    key = F.col(key) if isinstance(key, str) else key
    payload = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(key.alias(key_name))
            .agg(F.max_by(payload, rank).alias("_v"))
            .select(key_name, *[F.col(f"_v.{c}").alias(c) for c in cols]))


def _batch_id(df: DataFrame) -> DataFrame:
    return df if "import_batch_id" in df.columns else df.withColumn("import_batch_id", F.lit(0).cast("long"))


def latest_item_combinations(items_master: DataFrame) -> DataFrame:
    """Newest item-master row per barcode."""
    cols = ["purchase_price", "rate", "mrp", "expiry_date_raw", "hsn_code", "system_stock_snapshot"]
    latest = latest_by(_batch_id(items_master), "barcode", ["imported_at", "import_batch_id"], cols, "product_id")
    return latest.select(
        "product_id",
        F.col("purchase_price").cast("double").alias("purchase_price"),
        F.col("rate").cast("double").alias("rate"),
        F.col("mrp").cast("double").alias("mrp"),
        "expiry_date_raw", "hsn_code",
        F.col("system_stock_snapshot").cast("double").alias("current_stock"),
    )


def supplier_location(supplier_master: DataFrame, local_city: str = "Bellary") -> DataFrame:
    """Newest city per supplier name -> local region or OUTSIDE."""
    latest = latest_by(_batch_id(supplier_master), "supplier_name_raw",
                       ["imported_at", "import_batch_id", "city_raw"], ["city_raw"], "supplier_name")
    return latest.select(
        "supplier_name",
        F.when(F.col("city_raw") == local_city, F.lit(LOCAL_REGION)).otherwise(F.lit(OUTSIDE_REGION))
        .alias("supplier_region"),
    )


def lead_time(region: Column, local_days: int = 7, outside_days: int = 15) -> Column:
    """Supplier lead time from its region."""
    return F.when(region == LOCAL_REGION, F.lit(local_days)).otherwise(F.lit(outside_days))


def product_supplier_mapping(pitems: DataFrame) -> DataFrame:
    """Distinct (product, supplier) pairs seen on purchase lines."""
    return pitems.select(F.col("barcode").alias("product_id"),
                         F.col("supplier_name_raw").alias("supplier_name")).distinct()


def distinct_names(named: DataFrame) -> DataFrame:
    """The last import of each (barcode, item_name_raw, import_batch_id): all that the newest name depends on."""
    return named.groupBy("barcode", "item_name_raw", "import_batch_id").agg(F.max("imported_at").alias("imported_at"))


def _latest_names(df: DataFrame, aliases: DataFrame) -> DataFrame:
    named = _batch_id(df).filter(F.col("item_name_raw").isNotNull() & (F.col("item_name_raw") != ""))
    # a line's name counts once a barcode and batch: a hash aggregate, where the latest by struct sorts its rows
    named = distinct_names(named)
    named = remap(named, "barcode", aliases, out="_canon")
    return latest_by(named, "_canon", ["imported_at", "import_batch_id", "item_name_raw"],
                     ["item_name_raw"], "barcode")


def product_dimension(items_master: DataFrame, sales_items: DataFrame, aliases: DataFrame,
                      products: DataFrame) -> DataFrame:
    """One row per canonical barcode with its display name.

    Name precedence: staff override (products) > newest item-master name >
    newest sales name > the barcode itself.
    """
    im = _latest_names(items_master, aliases).withColumnRenamed("item_name_raw", "_im")
    sn = _latest_names(sales_items, aliases).withColumnRenamed("item_name_raw", "_sn")
    ab = im.select("barcode").union(sn.select("barcode")).distinct()
    ap = products.select(F.col("barcode"), "canonical_name", "brand", "hsn_code", "category",
                         "product_type", "is_reviewed")
    return (
        ab.join(ap, "barcode", "left").join(im, "barcode", "left").join(sn, "barcode", "left")
        .select(
            F.col("barcode").alias("product_id"),
            F.coalesce("canonical_name", "_im", "_sn", "barcode").alias("product_name"),
            "brand", "hsn_code", "category", "product_type", "is_reviewed",
        )
    )
