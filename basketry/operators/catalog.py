"""Canonical product seeding (D6 P26-P28 P30 S27) and bulk categorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import blank_to_null
from .dims import latest_by

# ---------------------------------------------------------------------------
# Fixed values (must equal the source behaviour).
# HSN prefix -> category; 4-digit prefixes are checked before 2-digit ones.
HSN_CATEGORY = {
    "2009": "Juices", "1902": "Processed Grains", "1905": "Bakery", "3004": "Pharmaceuticals",
    "3401": "Soap & Detergent", "3402": "Soap & Detergent",
    "07": "Vegetables", "08": "Fruits & Nuts", "09": "Spices", "10": "Grains & Pulses",
    "15": "Oils & Fats", "16": "Preserved Foods", "17": "Sugar & Confectionery",
    "18": "Cocoa & Chocolate", "19": "Processed Grains", "20": "Canned & Preserved",
    "21": "Condiments & Sauces", "22": "Beverages", "24": "Tobacco", "30": "Pharmaceuticals",
    "33": "Personal Care", "34": "Soap & Detergent", "39": "Plastics & Packaging",
    "48": "Paper & Stationery", "61": "Clothing", "62": "Clothing", "63": "Textiles",
    "64": "Footwear", "85": "Electronics", "94": "Furniture & Fixtures",
}
# Title-case artifacts put back in lower case (unless right after a hyphen).
SMALL_WORDS = ["And", "Or", "Of", "The", "A", "An", "In", "On", "At", "To", "For"]
# Name keywords that mark a service line.
SERVICE_KEYWORDS = ["labour", "labor", "service", "charge", "fee", "delivery", "installation"]
# ---------------------------------------------------------------------------


def title_case(c) -> Column:
    """Collapse spaces, title-case on letter runs, lower small words."""
    s = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"\s+", " ")
    pieces = F.split(s, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    s = F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")
    for w in SMALL_WORDS:
        s = F.regexp_replace(s, r"(?<!-)\b" + w + r"\b", w.lower())
    return F.when(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) != "", s)


def hsn_category(hsn) -> Column:
    """Category from the 4-digit HSN prefix, else the 2-digit one."""
    m = F.create_map(*[F.lit(x) for kv in HSN_CATEGORY.items() for x in kv])
    h = F.trim(F.col(hsn) if isinstance(hsn, str) else hsn)
    return F.when(h != "", F.coalesce(F.try_element_at(m, F.substring(h, 1, 4)),
                                      F.try_element_at(m, F.substring(h, 1, 2))))


def product_type(hsn, name, word_boundary: bool = False) -> Column:
    """Service by keyword, misc without HSN, else retail.

    By decision the default equals the source, which matches keywords as
    substrings ("fee" inside "coffee"); ``word_boundary=True`` asks for whole
    words.
    """
    n = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    alt = "|".join(SERVICE_KEYWORDS)
    pat = rf"\b({alt})\b" if word_boundary else f"({alt})"
    h = F.col(hsn) if isinstance(hsn, str) else hsn
    return (F.when(n.rlike(pat), "service").when(h.isNull() | (h == ""), "misc").otherwise("retail"))


def canonical_products(items_master: DataFrame, products: DataFrame) -> DataFrame:
    """Seed one product per master barcode, keeping existing rows untouched."""
    m = items_master.filter(F.col("barcode").isNotNull() & (F.col("barcode") != ""))
    if "import_batch_id" not in m.columns:
        m = m.withColumn("import_batch_id", F.lit(0).cast("long"))
    latest = latest_by(m, "barcode", ["imported_at", "import_batch_id"],
                       ["item_name_raw", "brand_raw", "hsn_code", "size_raw", "colour_raw"], "barcode")
    seeded = latest.select(
        "barcode",
        F.coalesce(title_case("item_name_raw"), F.col("barcode")).alias("canonical_name"),
        blank_to_null("brand_raw").alias("brand"),
        blank_to_null("hsn_code").alias("hsn_code"),
        blank_to_null("size_raw").alias("size"),
        blank_to_null("colour_raw").alias("colour"),
        hsn_category("hsn_code").alias("category"),
        product_type("hsn_code", "item_name_raw").alias("product_type"),
        F.lit(False).alias("is_reviewed"),
        F.lit(True).alias("is_active"),
    )
    cols = seeded.columns
    existing = products.select(*cols)
    return existing.unionByName(seeded.join(existing.select("barcode"), "barcode", "left_anti"))


def bulk_categorize(products: DataFrame, barcodes: DataFrame, category: str | None = None,
                    ptype: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products with category / type set on the listed barcodes and marked reviewed, counts).

    Counts is one row: ``updated`` listed barcodes that are products, and
    ``skipped`` ones that are not. A barcode listed twice counts once.
    """
    listed = barcodes.select("barcode").where(F.col("barcode").isNotNull()).distinct()
    p = products.join(listed.withColumn("_hit", F.lit(True)), "barcode", "left")
    h = F.coalesce(F.col("_hit"), F.lit(False))
    out = p
    if category is not None:
        out = out.withColumn("category", F.when(h, F.lit(category)).otherwise(F.col("category")))
    if ptype is not None:
        out = out.withColumn("product_type", F.when(h, F.lit(ptype)).otherwise(F.col("product_type")))
    known = products.select("barcode", F.lit(True).alias("_known")).distinct()
    counts = listed.join(known, "barcode", "left").agg(
        F.count_if(F.col("_known").isNotNull()).alias("updated"), F.count_if(F.col("_known").isNull()).alias("skipped"))
    return out.withColumn("is_reviewed", F.when(h, F.lit(True)).otherwise(F.col("is_reviewed"))).drop("_hit"), counts
