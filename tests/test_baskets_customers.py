"""Baskets against brute force with bills dealt into parts; display names against a count of all names."""

import datetime as dt
import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from basketry.operators import baskets, customers, parts
from basketry.operators.parts import pair_parts
from basketry.session import discard, saved


def test_giant_bill_gives_the_pairs_of_brute_force(spark):
    """A bill of 700 items in sub-groups of 50, beside small ones with repeats and nulls."""
    rnd = random.Random(1)
    lines = [("big", f"i{i:03d}") for i in range(700)] + [(f"b{b}", f"i{rnd.randint(0, 60):03d}") for b in range(80) for _ in range(6)]
    lines += [(None, "i000"), ("b1", None), ("one", "i001")]
    items = spark.createDataFrame(lines, "bill_no string, barcode string")
    bills = {}
    for bill, item in lines:
        if bill and item:
            bills.setdefault(bill, set()).add(item)
    want = Counter(p for held in bills.values() for p in combinations(sorted(held), 2))
    pairs = lambda limit: Counter((r.barcode_a, r.barcode_b) for r in baskets.bill_pairs(
        baskets.bill_items(items, None), limit).collect())
    assert pairs(50) == pairs(10_000) == want
    got = {(r.barcode_a, r.barcode_b): r.co_occurrences for r in baskets.product_associations(items, None, 3, part_items=20).collect()}
    assert got == {p: n for p, n in want.items() if n >= 3} != {}


def test_bill_of_20000_items_lies_in_many_parts(spark):
    bi = spark.range(20_000).select(F.lit("big").alias("bill_no"), F.col("id").cast("string").alias("item"))
    parts = pair_parts(bi, "bill_no", "item", baskets.PART_ITEMS)
    sizes = [r["count"] for r in parts.groupBy("bill_no", "_p", "_q").count().collect()]
    assert len(sizes) == 20 * 21 // 2 and max(sizes) < 3 * baskets.PART_ITEMS


def test_pairs_of_a_task_follow_from_counts(spark, monkeypatch):
    """4,000 short rows make 18,000 pairs; before, tasks were dealt by bytes and held 4,500 and more."""
    monkeypatch.setattr(parts, "TASK_ROWS", 1000, raising=False)
    bi = spark.range(4000).selectExpr("string(id div 10) AS bill_no", "string(id) AS item")
    sizes = [r["count"] for r in baskets.bill_pairs(bi).groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 18_000 and max(sizes) < 3000


def test_rare_items_and_bills_without_items(spark):
    """Bills whose lines have no item count in the support, rare items do not pair, aliases fold, lines repeat."""
    lines = [("b1", "x"), ("b1", "x"), ("b1", "y"), ("b1", "rare"), ("b2", "alias"), ("b2", "y"), ("b3", "x"),
             ("b4", None), (None, "x"), (None, None)]
    items = spark.createDataFrame(lines, "bill_no string, barcode string")
    aliases = spark.createDataFrame([("alias", "x")], "alias_barcode string, canonical_barcode string")
    got = baskets.product_associations(items, aliases, 2).collect()
    assert [(r.barcode_a, r.barcode_b, r.co_occurrences) for r in got] == [("x", "y", 2)]
    assert (got[0].support, got[0].confidence_a_to_b, got[0].confidence_b_to_a, got[0].lift) == (0.5, 0.6667, 1.0, 1.3333)
    assert baskets.product_associations(items.limit(0), aliases, 2).collect() == []


def test_saved_files_hold_few_rows(spark):
    kept = saved(spark.range(100).coalesce(1), "few", file_rows=30)
    assert max(r["count"] for r in kept.groupBy(F.input_file_name().alias("file")).count().collect()) <= 30
    discard(kept)


def test_display_name_is_the_commonest_then_the_smallest(spark):
    """Ties, blanks around names, a customer without any name, and one with 5,000 names."""
    rows = [("9000000001", " Asha "), ("9000000001", "Asha"), ("9000000001", "Ravi"),
            ("9000000002", "Zoya"), ("9000000002", "Bina"),
            ("9000000003", None), ("9000000003", None)]
    rows += [("9000000004", f"N{i:04d}") for i in range(5000)] + [("9000000004", "N4321")]
    zero = F.lit(0).cast("decimal(18,4)")
    bills = spark.createDataFrame(rows, "customer_mobile_raw string, customer_name_raw string").select(
        "*", F.monotonically_increasing_id().cast("string").alias("bill_no"), F.lit("05-01-2024 10:00:00").alias("bill_datetime_raw"),
        *[zero.alias(c) for c in ("membercard_discount", "net_total", "total_discount", "actual_cash", "cash_amount", "card_amount",
                                  "google_pay_amount", "phonepe_amount", "paytm_amount", "credit_amount")])
    dim = {r.mobile_clean: r for r in customers.customer_dimension(bills).collect()}
    assert {m: dim[m].display_name for m in ("9000000001", "9000000002", "9000000004")} == {
        "9000000001": "Asha", "9000000002": "Bina", "9000000004": "N4321"}
    assert dim["9000000001"].total_bills == 3 and dim["9000000004"].total_bills == 5001
    assert dim["9000000001"].first_seen_date == dt.date(2024, 1, 5)
