"""Day-grain facts: sales, purchases, payments (reference steps 00 and 07).

Each is one partial+final hash aggregation keyed by the calendar day; the
bill and item sides are aggregated separately and then full-outer joined on
the day, so the join input is at most one row per day per side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import (
    cash_amount, export_date, plain_date, upi_amount, within_payment_cap, z, PAYMENT_CAP,
)
from ..functions.numeric import ratio, zsum


def daily_sales_summary(bills: DataFrame, items: DataFrame) -> DataFrame:
    """Bills, revenue, avg bill and items sold per day."""
    b = (
        bills.select(export_date("bill_datetime_raw").alias("sale_date"), "net_total")
        .filter(F.col("sale_date").isNotNull())
        .groupBy("sale_date")
        .agg(F.count(F.lit(1)).alias("total_bills"), F.sum("net_total").alias("_rev"))
    )
    i = (
        items.select(export_date("sale_datetime_raw").alias("sale_date"), "sale_qty")
        .filter(F.col("sale_date").isNotNull())
        .groupBy("sale_date")
        .agg(F.sum("sale_qty").alias("_qty"))
    )
    return b.join(i, "sale_date", "full").select(
        "sale_date",
        "total_bills",
        F.col("_qty").cast("double").alias("total_items_sold"),
        F.col("_rev").cast("double").alias("total_revenue"),
        F.when(F.coalesce(F.col("total_bills"), F.lit(0)) > 0, ratio("_rev", "total_bills"))
        .alias("avg_bill_value"),
    )


def daily_purchase_summary(pbills: DataFrame, pitems: DataFrame) -> DataFrame:
    """Purchase bills and amounts per day, quantity from the lines."""
    b = (
        pbills.filter(F.col("purchase_date_raw").isNotNull())
        .select(plain_date("purchase_date_raw").alias("purchase_date"),
                "taxable_value", "settled_amount", "due_amount")
        .filter(F.col("purchase_date").isNotNull())
        .groupBy("purchase_date")
        .agg(
            F.count(F.lit(1)).alias("total_purchase_bills"),
            F.sum("taxable_value").cast("double").alias("total_taxable_value"),
            F.sum("settled_amount").cast("double").alias("total_settled_amount"),
            F.sum("due_amount").cast("double").alias("total_due_amount"),
        )
    )
    i = (
        pitems.filter(F.col("purchase_date_raw").isNotNull())
        .select(plain_date("purchase_date_raw").alias("purchase_date"), "total_qty")
        .filter(F.col("purchase_date").isNotNull())
        .groupBy("purchase_date")
        .agg(F.sum("total_qty").cast("double").alias("total_quantity_purchased"))
    )
    return b.join(i, "purchase_date", "full").select(
        "purchase_date", "total_purchase_bills", "total_quantity_purchased",
        "total_taxable_value", "total_settled_amount", "total_due_amount",
    )


PAYMENT_COLUMNS = [
    "sale_date", "total_bills", "cash_total", "card_total", "google_pay_total", "phonepe_total",
    "paytm_total", "upi_total", "credit_total", "cn_redeemed_total", "total_discount",
    "membercard_discount_total",
]


def daily_payment_breakdown(bills: DataFrame, cap: int = PAYMENT_CAP) -> DataFrame:
    """Ten payment totals per day, journal entries above ``cap`` dropped."""
    return (
        bills.filter(within_payment_cap(cap))
        .select(
            export_date("bill_datetime_raw").alias("sale_date"),
            cash_amount().alias("_cash"),
            z("card_amount").alias("_card"), z("google_pay_amount").alias("_gpay"),
            z("phonepe_amount").alias("_phonepe"), z("paytm_amount").alias("_paytm"),
            upi_amount().alias("_upi"), z("credit_amount").alias("_credit"),
            z("cn_amount").alias("_cn"), z("total_discount").alias("_disc"),
            z("membercard_discount").alias("_member"),
        )
        .filter(F.col("sale_date").isNotNull())
        .groupBy("sale_date")
        .agg(
            F.count(F.lit(1)).alias("total_bills"),
            zsum("_cash").alias("cash_total"), zsum("_card").alias("card_total"),
            zsum("_gpay").alias("google_pay_total"), zsum("_phonepe").alias("phonepe_total"),
            zsum("_paytm").alias("paytm_total"), zsum("_upi").alias("upi_total"),
            zsum("_credit").alias("credit_total"), zsum("_cn").alias("cn_redeemed_total"),
            zsum("_disc").alias("total_discount"), zsum("_member").alias("membercard_discount_total"),
        )
    )


def daily_payments_no_outliers(payments: DataFrame, factor: float = 100.0,
                               fallback: float = 5_000_000.0) -> DataFrame:
    """Drop days where any method exceeds ``factor`` x the median daily cash.

    The median and the day count are scalar subqueries (computed once, no
    join); fewer than two days skips the filter.
    """
    methods = ["cash_total", "card_total", "upi_total", "credit_total"]
    median = payments.agg(F.percentile(F.col("cash_total"), F.lit(0.5))).scalar()
    n_days = payments.agg(F.count(F.lit(1))).scalar()
    limit = F.when(median > 0, median * F.lit(factor)).otherwise(F.lit(fallback))
    ok = F.lit(True)
    for m in methods:
        ok = ok & (F.coalesce(F.col(m), F.lit(0.0)) <= limit)
    return payments.filter((n_days < 2) | ok).select(*PAYMENT_COLUMNS)


def date_range(daily: DataFrame, date_col: str, from_date: dt.date | None = None,
               to_date: dt.date | None = None, as_of: dt.date | None = None,
               days: int = 90) -> DataFrame:
    """Rows of a day table between ``from_date`` and ``to_date``.

    Defaults: ``to`` = the table's max date (else ``as_of`` - 1), ``from`` =
    ``to`` - (days-1). The default bound is a scalar subquery.
    """
    d = F.col(date_col)
    if to_date is None:
        fallback = F.date_sub(F.lit(as_of or dt.date.today()), 1)
        hi = daily.agg(F.coalesce(F.max(d), fallback)).scalar()
    else:
        hi = F.lit(to_date)
    lo = F.date_sub(hi, days - 1) if from_date is None else F.lit(from_date)
    return daily.filter(d.between(lo, hi))
