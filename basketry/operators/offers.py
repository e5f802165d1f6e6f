"""Offer pricing from a promotion sheet (P29) and the generic filter spec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed header aliases of the promotion sheet, in lookup order.
NAME_HEADERS = ["name", "product_name", "item"]
TYPE_HEADERS = ["discount_type", "discount"]
VALUE_HEADERS = ["discount_value", "discount_amount"]
IMAGE_HEADERS = ["image", "image_url"]


def normalize_header(h: str) -> str:
    """'Discount Type' -> 'discount_type', 'Sl no.' -> 'sl_no' (driver-side, on names only)."""
    return h.strip().lower().replace(" ", "_").rstrip(".")


def _first(df: DataFrame, names: list[str]) -> Column:
    cols = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def offer_pricing(sheet: DataFrame, order_col: str = "_row") -> DataFrame:
    """Offer price and highlight text per sheet row; blank names are skipped."""
    df = sheet.toDF(*[normalize_header(c) for c in sheet.columns])
    name = _first(df, NAME_HEADERS)
    mrp = F.nullif(_first(df, ["mrp"]).try_cast("double"), F.lit(0.0))
    dtype = F.lower(F.trim(F.coalesce(_first(df, TYPE_HEADERS), F.lit(""))))
    draw = _first(df, VALUE_HEADERS)
    dval = draw.try_cast("double")
    ok = mrp.isNotNull() & dval.isNotNull() & (dval != 0)
    r2 = lambda x: F.round(x.cast("decimal(28,10)"), 2).cast("double")
    offer = (F.when((dtype == "percent") & ok, r2(mrp * (F.lit(1.0) - dval / F.lit(100.0))))
             .when((dtype == "amount") & ok, r2(mrp - dval)))
    highlight = (F.when((dtype == "percent") & ok, F.concat(dval.cast("int").cast("string"), F.lit("% OFF")))
                 .when((dtype == "amount") & ok, F.concat(F.lit("Save ₹"), dval.cast("int").cast("string")))
                 .when(dtype.isin("combo", "text") & draw.isNotNull(), draw))
    return df.filter(name.isNotNull()).select(
        name.alias("display_name"), mrp.alias("original_price"), offer.alias("offer_price"),
        highlight.alias("highlight_text"), _first(df, IMAGE_HEADERS).alias("image_url"),
        F.col(order_col).alias("sort_order") if order_col in df.columns else F.lit(None).alias("sort_order"))


OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v),
    "in": lambda c, v: c.isin(v if isinstance(v, list) else [v]),
}


def filter_query(df: DataFrame, spec: dict) -> DataFrame:
    """``{filters:[{field, operator, value}], condition, sort, limit}`` over any table."""
    conds = []
    for f in spec.get("filters", []):
        field, op = f.get("field"), f.get("operator", "eq")
        if field not in df.columns:
            raise ValueError(f"'{field}' is not a valid column")
        if op not in OPERATORS:
            raise ValueError(f"Unsupported operator '{op}'")
        conds.append(OPERATORS[op](F.col(field), f.get("value")))
    if conds:
        cond = conds[0]
        for c in conds[1:]:
            cond = (cond | c) if spec.get("condition", "and").lower() == "or" else (cond & c)
        df = df.filter(cond)
    sort = spec.get("sort") or {}
    order = []
    for field, direction in sort.items():
        if field not in df.columns:
            raise ValueError(f"Invalid sort field '{field}'")
        order.append(F.col(field).desc() if direction == -1 else F.col(field).asc())
    if order:
        df = df.orderBy(*order)
    if spec.get("limit"):
        df = df.limit(int(spec["limit"]))
    return df
