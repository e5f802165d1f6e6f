"""Cash closure totals (A28) and denomination counts (A29) with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Note denominations counted at closing.
DENOMINATIONS = [500, 200, 100, 50, 20, 10, 5, 2, 1]

LINE_ITEM = "array<struct<description:string,amount:double>>"


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _items(c: str) -> Column:
    return F.aggregate(F.coalesce(F.col(c), F.array().cast(LINE_ITEM)), F.lit(0.0),
                       lambda acc, x: acc + F.coalesce(x["amount"], F.lit(0.0)))


def denomination_total(m: Column) -> Column:
    """Sum of denomination x count over a map<string,int>."""
    return F.aggregate(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,int>"))), F.lit(0.0),
                       lambda acc, e: acc + e["key"].cast("double") * F.coalesce(e["value"], F.lit(0)).cast("double"))


def cash_closure_totals(closures: DataFrame) -> DataFrame:
    """Inside / outside counter, expected cash and the counted difference per closure."""
    inside = (_n("opening_cash") + _n("net_sales") + _n("sodexo_collection") + _items("manual_billings")
              + _items("old_balance_collections") + _n("distributor_expiry") + _n("oil_crush") + _n("other_income"))
    outside = (_n("pluxee_amount") + _n("paytm_amount") + _n("phonepe_amount") + _n("card_amount")
               + _items("credits_given") + _n("returns_amount") + _items("expenses"))
    merged = F.map_zip_with(
        F.coalesce(F.col("denominations_opening"), F.create_map().cast("map<string,int>")),
        F.coalesce(F.col("denominations_sales"), F.create_map().cast("map<string,int>")),
        lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    r2 = lambda x: F.round(x.cast("decimal(28,10)"), 2).cast("double")
    return closures.select(
        "closure_date",
        r2(inside).alias("total_inside_counter"),
        r2(outside).alias("total_outside_counter"),
        r2(inside - outside).alias("expected_cash"),
        F.col("physical_cash_counted"),
        F.when(F.col("physical_cash_counted").isNotNull(),
               r2(F.col("physical_cash_counted") - (inside - outside))).alias("difference_amount"),
        denomination_total(merged).alias("denomination_cash"),
    )
