"""Market-basket associations (reference step 10) and bought-together lists.

Plan: stage the lines' (bill, item), deduplicate them, drop items that
appear in fewer than ``min_co`` bills (a pair can never co-occur more often
than its rarer item -- exact pruning), then self-join on bill with
``a < b`` so each unordered pair is produced once. The pair counts are
pre-aggregated per task before the shuffle on (a, b). A very large bill's
items are dealt into pairs of sub-groups, each a join key of its own, so no
key holds a whole bill. The numbers of tasks follow from counted rows and
pairs, so a task's hash tables do not grow with the input: a few bytes of
lines make many pairs. Item bill counts are joined back by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..session import discard, saved
from .parts import FILE_ROWS, pair_parts, tasks
from .product import remap

#: Items of one sub-group of a bill; a larger bill is dealt into pairs of sub-groups.
PART_ITEMS = 1000


def _bill_lines(items: DataFrame, aliases: DataFrame | None, item_col: str) -> DataFrame:
    """(bill_no, item) of every line with a bill, alias barcodes folded into canonicals."""
    df = items.select("bill_no", F.col(item_col).alias("_item"))
    if item_col == "barcode" and aliases is not None:
        df = remap(df, "_item", aliases, out="item").drop("_item")
    else:
        df = df.withColumnRenamed("_item", "item")
    return df.filter(F.col("bill_no").isNotNull())


def bill_items(items: DataFrame, aliases: DataFrame | None, item_col: str = "barcode") -> DataFrame:
    """Distinct (bill_no, item) of the lines that have both."""
    return _bill_lines(items, aliases, item_col).filter(F.col("item").isNotNull()).distinct()


def bill_pairs(bi: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """(barcode_a, barcode_b) once for every bill that holds both, from distinct (bill_no, item).

    Reads ``bi`` several times: once for its rows, once for the sizes of the
    bills, which give the number of pairs, and then for the pairs.
    """
    rows, seen, n = bi.count(), Observation(), F.col("_n")
    sizes = bi.select("bill_no").repartition(tasks(rows), "bill_no").groupBy("bill_no").agg(F.count(F.lit(1)).alias("_n"))
    hot = saved(sizes.observe(seen, F.sum(F.expr("_n * (_n - 1) div 2")).alias("pairs")).where(n > part_items), "hot_bills")
    dealt, part = pair_parts(bi, "bill_no", "item", part_items, hot), ["bill_no", "_p", "_q"]
    dealt = dealt.repartition(tasks(rows + (seen.get["pairs"] or 0)), *part)
    a = dealt.where("_sub = _p").select(*part, F.col("item").alias("_a"))
    b = dealt.where("_sub = _q").select(*part, F.col("item").alias("_b"))
    return (a.join(b, part).where((F.col("_p") < F.col("_q")) | (F.col("_a") < F.col("_b")))
            .select(F.least("_a", "_b").alias("barcode_a"), F.greatest("_a", "_b").alias("barcode_b")))


def product_associations(items: DataFrame, aliases: DataFrame | None, min_co: int = 5,
                         item_col: str = "barcode", part_items: int = PART_ITEMS) -> DataFrame:
    """Pairs with >= ``min_co`` shared bills, support/confidence/lift."""
    lines = saved(_bill_lines(items, aliases, item_col), "bill_lines", "zstd", FILE_ROWS)
    n_tasks = tasks(lines.count())
    n_bills = lines.select("bill_no").repartition(n_tasks, "bill_no").distinct().count()
    bi = lines.filter(F.col("item").isNotNull()).repartition(n_tasks, "bill_no", "item").distinct()
    item_bills = saved(bi.groupBy("item").agg(F.count(F.lit(1)).alias("bill_count")), "item_bills")
    rare = saved(item_bills.filter(F.col("bill_count") < min_co).select("item"), "rare_items")
    cand = saved(bi.join(rare, "item", "left_anti").select("bill_no", "item"), "baskets", "zstd", FILE_ROWS)
    discard(lines, rare)
    pairs = (
        bill_pairs(cand, part_items)
        .groupBy("barcode_a", "barcode_b").agg(F.count(F.lit(1)).alias("co_occurrences"))
        .filter(F.col("co_occurrences") >= min_co)
    )
    ca = item_bills.select(F.col("item").alias("barcode_a"), F.col("bill_count").alias("_ca"))
    cb = item_bills.select(F.col("item").alias("barcode_b"), F.col("bill_count").alias("_cb"))
    co = F.col("co_occurrences").cast("double")
    n = F.lit(n_bills).cast("double")
    return (
        pairs.join(ca, "barcode_a").join(cb, "barcode_b")
        .select(
            "barcode_a", "barcode_b", "co_occurrences",
            round_half_up(co / n, 6).alias("support"),
            round_half_up(co / F.col("_ca").cast("double"), 4).alias("confidence_a_to_b"),
            round_half_up(co / F.col("_cb").cast("double"), 4).alias("confidence_b_to_a"),
            round_half_up((co / n) / ((F.col("_ca").cast("double") / n) * (F.col("_cb").cast("double") / n)), 4)
            .alias("lift"),
        )
    )


def bought_together(assoc: DataFrame, dimension: DataFrame, products: DataFrame,
                    item_latest: DataFrame, k: int = 5) -> DataFrame:
    """For every product, its top-k partners by co-occurrence then lift.

    Both orientations of each pair are emitted (a union, not an OR join), then
    ranked per product; ties are broken by the partner barcode.
    """
    fwd = assoc.select(F.col("barcode_a").alias("barcode"), F.col("barcode_b").alias("other_barcode"),
                       "co_occurrences", "lift", F.col("confidence_a_to_b").alias("confidence"))
    bwd = assoc.select(F.col("barcode_b").alias("barcode"), F.col("barcode_a").alias("other_barcode"),
                       "co_occurrences", "lift", F.col("confidence_b_to_a").alias("confidence"))
    w = Window.partitionBy("barcode").orderBy(F.col("co_occurrences").desc(), F.col("lift").desc(),
                                              F.col("other_barcode"))
    top = fwd.unionByName(bwd).withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k)
    d = dimension.select(F.col("product_id").alias("other_barcode"), "product_name")
    p = products.select(F.col("barcode").alias("other_barcode"), "canonical_name", "category")
    ic = item_latest.select(F.col("product_id").alias("other_barcode"), "mrp")
    return (
        top.join(d, "other_barcode", "inner").join(p, "other_barcode", "left").join(ic, "other_barcode", "left")
        .select("barcode", "other_barcode",
                F.coalesce("canonical_name", "product_name").alias("canonical_name"),
                "category", "mrp", "co_occurrences", "lift", "confidence", F.col("_rk").cast("bigint").alias("rank"))
    )
