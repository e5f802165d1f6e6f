"""Reconciliation views: bills vs their lines, purchases vs lines, daily flow.

Line totals are aggregated to the bill identity first (partial aggregation),
so the join sees at most one row per bill on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import export_date, plain_date, z


def _d(c):
    return F.col(c).cast("double")


def recon_sales_bill_vs_item(bills: DataFrame, items: DataFrame, only_discrepancies: bool = False) -> DataFrame:
    """A23 J16 (P31 L11): bill totals against summed lines, with deltas."""
    keys = ["bill_no", "bill_datetime_raw", "operator_name", "location_name"]
    ia = (
        items.select("bill_no", F.col("sale_datetime_raw").alias("bill_datetime_raw"), "operator_name",
                     F.col("sale_location").alias("location_name"), "sale_qty", "taxable_amount", "net_total")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("item_line_count"), F.sum("sale_qty").alias("_iq"),
             F.sum(z("taxable_amount")).alias("_it"), F.sum(z("net_total")).alias("_in"))
    )
    b = bills.select(*keys, "total_qty", "taxable_amount", "net_total", "round_off")
    cond = [b[k] == ia[k] for k in keys]  # SQL equality: NULL never matches
    out = b.join(ia, cond, "left").select(
        *[b[k] for k in keys],
        _d("total_qty").alias("bill_total_qty"),
        b["taxable_amount"].cast("double").alias("bill_taxable_amount"),
        b["net_total"].cast("double").alias("bill_net_total"),
        _d("round_off").alias("bill_round_off"),
        "item_line_count",
        _d("_iq").alias("total_item_qty"),
        _d("_it").alias("item_taxable_amount"),
        _d("_in").alias("item_net_total"),
        (b["taxable_amount"] - F.col("_it")).cast("double").alias("delta_taxable_amount"),
        (b["net_total"] - F.col("_in")).cast("double").alias("delta_net_total"),
    )
    if only_discrepancies:
        out = out.filter(F.abs(F.col("delta_net_total")) != 0).orderBy(F.abs(F.col("delta_net_total")).desc())
    return out


def recon_purchase_bill_vs_item(pbills: DataFrame, pitems: DataFrame) -> DataFrame:
    """Purchase bill totals against summed purchase lines."""
    ia = pitems.groupBy("purchase_id", "invoice_no").agg(
        F.count(F.lit(1)).alias("item_line_count"),
        F.sum(z("total_qty")).alias("_iq"),
        F.sum(z("taxable_value")).alias("_it"),
    )
    b = pbills.select("purchase_id", "invoice_no", "purchase_date_raw", "supplier_name_raw",
                      "total_qty", "taxable_value")
    cond = [b.purchase_id == ia.purchase_id, b.invoice_no == ia.invoice_no]
    return b.join(ia, cond, "left").select(
        b.purchase_id, b.invoice_no, "purchase_date_raw", "supplier_name_raw",
        _d("total_qty").alias("bill_total_qty"),
        _d("taxable_value").alias("bill_taxable_value"),
        "item_line_count",
        _d("_iq").alias("item_total_qty"),
        _d("_it").alias("item_taxable_value"),
        (F.col("total_qty") - F.col("_iq")).cast("double").alias("delta_qty"),
        (F.col("taxable_value") - F.col("_it")).cast("double").alias("delta_taxable_value"),
    )


def recon_daily_quantity_flow(pitems: DataFrame, items: DataFrame) -> DataFrame:
    """Purchased vs sold quantity per day (full outer on the day)."""
    p = (pitems.select(plain_date("purchase_date_raw").alias("day"), z("total_qty").alias("q"))
         .filter(F.col("day").isNotNull()).groupBy("day").agg(F.sum("q").alias("_p")))
    s = (items.select(export_date("sale_datetime_raw").alias("day"), z("sale_qty").alias("q"))
         .filter(F.col("day").isNotNull()).groupBy("day").agg(F.sum("q").alias("_s")))
    return p.join(s, "day", "full").select(
        "day", _d("_p").alias("purchased_qty"), _d("_s").alias("sold_qty"),
        (F.col("_p") - F.col("_s")).cast("double").alias("net_flow"))
