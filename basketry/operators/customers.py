"""Customer dimension and metrics (reference steps 08-09).

Customers are keyed by the cleaned 10-digit mobile. All walk-in bills fold
into one synthetic key; it is computed as a *global* aggregate (partial per
task, one tiny final merge), so the hot walk-in key never lands whole in a
single reducer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import (
    WALK_IN_DISPLAY, WALK_IN_KEY, cash_amount, clean_mobile, export_date, is_walk_in, upi_amount, z,
)
from ..functions.numeric import ratio


def classified_bills(bills: DataFrame) -> DataFrame:
    """One row per valid-dated bill with its customer key and payments."""
    return (
        bills.select(
            "bill_no",
            export_date("bill_datetime_raw").alias("bill_date"),
            F.col("customer_name_raw"),
            clean_mobile("customer_mobile_raw").alias("mobile_clean"),
            z("membercard_discount").alias("membercard_discount"),
            z("net_total").alias("net_total"),
            z("total_discount").alias("total_discount"),
            cash_amount().alias("cash_amt"),
            z("card_amount").alias("card_amt"),
            upi_amount().alias("upi_amt"),
            z("credit_amount").alias("credit_amt"),
        )
        .filter(F.col("bill_date").isNotNull())
        .withColumn("is_walk_in", is_walk_in(F.col("mobile_clean"), F.col("customer_name_raw")))
    )


def customer_dimension(bills: DataFrame) -> DataFrame:
    """Identified customers plus one synthetic walk-in row.

    The display name is a customer's commonest name, the smallest of equally
    common ones, null if none is given: bills are counted by (customer, name)
    first, so no task holds all names of a customer.
    """
    c = classified_bills(bills)
    named = (
        c.filter(~F.col("is_walk_in"))
        .groupBy("mobile_clean", F.trim(F.col("customer_name_raw")).alias("_name"))
        .agg(
            F.bool_or(F.col("membercard_discount") > 0).alias("_member"),
            F.min("bill_date").alias("_first"),
            F.max("bill_date").alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    commonest = F.when(F.col("_name").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_name").alias("name")))
    ident = (
        named.groupBy("mobile_clean")
        .agg(
            F.min_by("_name", commonest).alias("display_name"),
            F.bool_or("_member").alias("is_member"),
            F.min("_first").alias("first_seen_date"),
            F.max("_last").alias("last_seen_date"),
            F.sum("_n").alias("total_bills"),
        )
        .select("mobile_clean", "display_name", F.lit(False).alias("is_walk_in"), "is_member",
                "first_seen_date", "last_seen_date", "total_bills")
    )
    walk = (
        c.filter(F.col("is_walk_in"))
        .agg(
            F.bool_or(F.col("membercard_discount") > 0).alias("is_member"),
            F.min("bill_date").alias("first_seen_date"),
            F.max("bill_date").alias("last_seen_date"),
            F.count(F.lit(1)).alias("total_bills"),
        )
        .select(F.lit(WALK_IN_KEY).alias("mobile_clean"), F.lit(WALK_IN_DISPLAY).alias("display_name"),
                F.lit(True).alias("is_walk_in"), "is_member", "first_seen_date", "last_seen_date",
                "total_bills")
    )
    return ident.unionByName(walk)


def customer_metrics(bills: DataFrame, as_of: dt.date) -> DataFrame:
    """Spend, visit cadence and preferred payment per customer key."""
    c = classified_bills(bills).withColumn(
        "customer_key", F.when(F.col("is_walk_in"), F.lit(WALK_IN_KEY)).otherwise(F.col("mobile_clean")))
    n = F.count(F.lit(1))
    agg = c.groupBy("customer_key").agg(
        F.sum("net_total").alias("_rev"),
        n.alias("total_bills"),
        F.sum("total_discount").alias("_disc"),
        F.min("bill_date").alias("first_purchase_date"),
        F.max("bill_date").alias("last_purchase_date"),
        F.sum("cash_amt").alias("_cash"), F.sum("card_amt").alias("_card"),
        F.sum("upi_amt").alias("_upi"), F.sum("credit_amt").alias("_credit"),
    )
    best = F.greatest("_cash", "_card", "_upi", "_credit")
    pref = (F.when(best == F.col("_cash"), "cash").when(best == F.col("_card"), "card")
            .when(best == F.col("_upi"), "upi").when(best == F.col("_credit"), "credit").otherwise("cash"))
    bills_n = F.col("total_bills")
    return agg.select(
        F.col("customer_key").alias("mobile_clean"),
        F.col("_rev").cast("double").alias("total_revenue"),
        "total_bills",
        ratio("_rev", "total_bills").alias("avg_bill_value"),
        F.col("_disc").cast("double").alias("total_discount_received"),
        "first_purchase_date", "last_purchase_date",
        F.datediff(F.lit(as_of), F.col("last_purchase_date")).cast("bigint").alias("days_since_last_visit"),
        F.when(bills_n > 1, F.datediff("last_purchase_date", "first_purchase_date").cast("double")
               / (bills_n - 1).cast("double")).alias("avg_days_between_visits"),
        (bills_n > 1).alias("is_repeat"),
        pref.alias("preferred_payment"),
    )
