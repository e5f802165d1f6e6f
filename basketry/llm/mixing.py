"""Mixing sources to target weights with hash-threshold histograms.

Documents with the same id and text are one unit with a fixed 60-bit hash. A
source's budget is met by a threshold on it: words are summed by source and
hash bucket, the bucket in which the budget ends is found, and only that
bucket's rows are looked at again with finer buckets. Of the unit on which the
threshold falls, as many copies are taken as fit, and what is then left of the
budget goes to one more row of the source, the one whose size comes nearest. A
document's copies follow from its own hash and its source's threshold, by a
filter; no rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common as C

#: 60 bits of hash, refined 12 bits at a time.
BITS, STEP = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(C.WORD)), F.lit(0)).cast("long")


def mix_hash(ident: Column, text: Column) -> Column:
    """The first 60 bits of md5('mix:', id, ':', text); a null id and a null text read ``null`` and nothing."""
    whole = F.concat(F.lit("mix:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], share: float, repeat: int) -> DataFrame:
    """Adds ``target`` to (key, source, source_size).

    Sources by code point, null last, get the weights in turn. A source stops
    at ``repeat`` times its size and the excess is shared again by weight, which
    ends at one level ``water``: target = least(cap, weight * water). With the
    sources in order of cap / weight, the level is the largest of
    (budget - caps before) / (weights from here on). One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = (totals.withColumn("_at", F.row_number().over(by_name))
           .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_at") - 1, F.lit(len(weights))) + 1).cast("int")))
           .withColumn("_cap", F.col("source_size").cast("double") * repeat))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_at")
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum(F.col("source_size").cast("double")).over(everything) * share
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    return (one.withColumn("_level", level).withColumn("_water", F.max("_level").over(everything))
            .withColumn("target", F.least("_cap", F.col("_w") * F.col("_water")))
            .select("_key", "source", "source_size", "target"))


def boundary(hist: DataFrame) -> DataFrame:
    """Of a histogram (_key, _budget, _bucket, _words), the bucket in which the budget ends, the words before it and in it.

    A budget that no bucket exceeds ends in the last one. The window runs over
    at most 2^STEP buckets of a source.
    """
    w = Window.partitionBy("_key").orderBy("_bucket")
    run = hist.withColumn("_upto", F.sum("_words").over(w)).withColumn("_before", F.col("_upto") - F.col("_words"))
    last = Window.partitionBy("_key")
    return (run.withColumn("_last", F.max("_bucket").over(last))
            .where((F.col("_before") <= F.col("_budget")) & ((F.col("_upto") > F.col("_budget")) | (F.col("_bucket") == F.col("_last"))))
            .groupBy("_key").agg(F.min(F.struct("_bucket", "_before", "_words")).alias("_b"))
            .select("_key", F.col("_b._bucket").alias("_edge"), F.col("_b._before").alias("_done"), F.col("_b._words").alias("_here")))


def thresholds(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """One row per source: _key, source, source_size, target, _whole, _tau, _fit, _more.

    ``sizes``: _key (see source_key), source, size and _h. A row is taken
    ``_whole`` times, and once more if its hash is below ``_tau``; so are
    ``_fit`` of the rows at ``_tau``, and one row at ``_more``.
    """
    totals = sizes.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = (targets(totals, weights, share, repeat)
            .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
            .withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size").cast("double")))
    plan = C.materialise(plan, "mix-plan")
    coarse = BITS - STEP
    hist = (sizes.groupBy("_key", F.shiftright("_h", coarse).alias("_bucket")).agg(F.sum("size").alias("_words"))
            .join(plan.select("_key", "_budget"), "_key"))
    found = C.materialise(boundary(hist), "mix-edge")
    # the rows of the boundary buckets alone: about one in 2^STEP
    rows = (sizes.withColumn("_edge", F.shiftright("_h", coarse)).join(found.drop("_here"), ["_key", "_edge"])
            .join(plan.select("_key", "_budget"), "_key")
            .select("_key", "size", F.col("_h").bitwiseAND((1 << coarse) - 1).alias("_rest"), (F.col("_budget") - F.col("_done")).alias("_budget")))
    rows = C.materialise(rows, "mix-rows")
    edge = (found.join(plan.select("_key", "_budget"), "_key")
            .select("_key", F.shiftleft("_edge", coarse).alias("_tau"), (F.col("_budget") - F.col("_done")).alias("_left")))
    for shift in range(coarse - STEP, -1, -STEP):
        hist = rows.groupBy("_key", "_budget", F.shiftright("_rest", shift).alias("_bucket")).agg(F.sum("size").alias("_words"))
        at = C.materialise(boundary(hist), "mix-at")
        edge = edge.join(at, "_key").select("_key", (F.col("_tau") + F.shiftleft("_edge", shift)).alias("_tau"), "_left", "_done")
        edge = C.materialise(edge.select("_key", "_tau", (F.col("_left") - F.col("_done")).alias("_left")), "mix-edge")
        rows = (rows.withColumn("_edge", F.shiftright("_rest", shift)).join(at.select("_key", "_edge", "_done"), ["_key", "_edge"])
                .select("_key", "size", F.col("_rest").bitwiseAND((1 << shift) - 1).alias("_rest"), (F.col("_budget") - F.col("_done")).alias("_budget")))
    # every unit below _tau fits, and of the one at _tau so many copies; one more row may bring the sum nearer to the budget
    edge = plan.join(edge.select("_key", "_tau", "_left"), "_key", "left").select(
        *plan.columns, F.coalesce("_tau", F.lit(0)).alias("_tau"), F.coalesce("_left", F.lit(0.0)).alias("_left"))
    edge = C.materialise(edge, "mix-edge")
    at = (sizes.join(edge.select("_key", F.col("_tau").alias("_h")), ["_key", "_h"]).groupBy("_key").agg(F.max("size").alias("_each")))
    fit = F.when(F.col("_each") > 0, F.floor(F.col("_left") / F.col("_each"))).otherwise(F.lit(0)).cast("long")
    edge = (edge.join(at, "_key", "left").withColumn("_fit", F.coalesce(fit, F.lit(0)))
            .withColumn("_left", F.col("_left") - F.col("_fit") * F.coalesce("_each", F.lit(0))).drop("_each"))
    edge = C.materialise(edge, "mix-edge")
    off = F.abs(F.col("size") - F.col("_left"))
    more = (sizes.join(edge.select("_key", "_tau", "_left"), "_key").where((F.col("_h") >= F.col("_tau")) & (off < F.col("_left")))
            .groupBy("_key").agg(F.min(F.struct(off.alias("off"), "_h")).alias("_m")).select("_key", F.col("_m._h").alias("_more")))
    return (edge.join(more, "_key", "left")
            .select("_key", "source", "source_size", "target", "_whole", "_tau", "_fit", F.coalesce("_more", F.lit(-1)).alias("_more")))


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _sizes(docs: DataFrame, *more: Column) -> DataFrame:
    return C.materialise(docs.select(
        *more, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        mix_hash(F.col("doc_id"), F.col("text")).alias("_h"), F.monotonically_increasing_id().alias("_row"))
        .withColumn("_key", source_key(F.col("source"))), "mix-sizes")


def _extra(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with _key, _h and the plan's columns) whose units are taken alike, and the others, with ``_taken``: how often each row is taken.

    The others are one or two units a source; their rows are alike and get numbers.
    """
    split = (F.col("_h") == F.col("_tau")) | (F.col("_h") == F.col("_more"))
    alike = rows.where(~split).withColumn("_taken", F.col("_whole") + (F.col("_h") < F.col("_tau")).cast("int"))
    some = F.when(F.col("_h") == F.col("_tau"), F.col("_fit")).otherwise(0) + (F.col("_h") == F.col("_more")).cast("int")
    part = rows.where(split).withColumn("_some", some)
    return alike, part


def _numbered(part: DataFrame) -> DataFrame:
    return (C.numbered(C.materialise(part, "mix-part"), ["_key", "_h"], [])
            .withColumn("_taken", F.col("_whole") + (F.col("_nth") <= F.col("_some")).cast("int")).drop("_nth"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """Words of each document, of its source, the source's target, and the words that the mix takes.

    Rows: doc_id, source, size, source_size, target, taken, one for each row of
    ``docs``. A null text has size 0; null is a source of its own, last in
    order. Rows with the same id and text have the same hash; the target
    falls among them row by row. An empty table gives an empty one.
    """
    sizes = _sizes(docs, C.take_id())
    plan = C.materialise(thresholds(sizes, weights, share, repeat), "mix-taus")
    alike, part = _extra(sizes.join(plan.drop("source"), "_key"))
    rows = alike.unionByName(_numbered(part).drop("_some"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("_taken")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it; columns unchanged.

    The text is not shuffled where the table of thresholds (one row per source)
    is small enough to broadcast, but for the one or two units a source on
    which its threshold falls. An empty table gives an empty one.
    """
    plan = C.materialise(thresholds(_sizes(docs), weights, share, repeat), "mix-taus")
    whole = F.struct(*docs.columns).alias("_doc")
    rows = (docs.select(whole, source_key(F.col("source")).alias("_key"), mix_hash(F.col("doc_id"), F.col("text")).alias("_h"))
            .join(plan.select("_key", "_whole", "_tau", "_fit", "_more"), "_key"))
    alike, part = _extra(rows)
    part = _numbered(part.withColumn("_row", F.monotonically_increasing_id()))
    return (alike.select("_doc", "_taken").unionAll(part.select("_doc", "_taken")).where("_taken > 0")
            .select("_doc", F.explode(F.sequence(F.lit(1), F.col("_taken").cast("int")))).select("_doc.*"))
