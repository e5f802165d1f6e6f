"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation once for each turn it had so far. Every
turn prefix has a rolling hash; a conversation whose whole hash is an inner
prefix of another one is a snapshot of it, and an anti-join removes it. Of
conversations with the same turns the smallest conv_id stays. What is left is
rendered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common as C

KEY = ["_pos", "_h1", "_h2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``_own``: the turn itself where the id is null, so that such a turn is a conversation of its own."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    known = turns.where("conv_id is not null")
    return (known.unionAll(turns.where("conv_id is null").distinct())
            .withColumn("_own", F.when(F.col("conv_id").isNull(), F.struct("turn", "role", "text"))))


def _ordered() -> Window:
    return Window.partitionBy("conv_id", "_own").orderBy("turn", "role", "text")


def _without_repeats(turns: DataFrame) -> DataFrame:
    """Turns without repeated rows, which stand side by side in order."""
    w = _ordered()
    before = F.lag(F.struct(F.lit(1).alias("here"), "turn", "role", "text")).over(w)
    return turns.withColumn("_before", before).where(
        ~(F.col("_before").isNotNull() & F.col("_before.turn").eqNullSafe(F.col("turn"))
          & F.col("_before.role").eqNullSafe(F.col("role")) & F.col("_before.text").eqNullSafe(F.col("text")))).drop("_before")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, _own, _pos, _h1, _h2, _last: the rolling hash of each turn prefix.

    The hash of a prefix is the sum, over its turns, of a 64-bit hash of
    (position, role, text), for two seeds; so one running sum per conversation
    gives all of them, and a long conversation needs no list in memory.
    """
    w = _ordered()
    turn = F.struct(F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    rows = (_without_repeats(_turns(conversations)).withColumn("_pos", F.row_number().over(w))
            .withColumn("_a", F.xxhash64(F.lit(1), "_pos", turn)).withColumn("_b", F.xxhash64(F.lit(2), turn, "_pos")))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("conv_id", "_own", "_pos", F.sum(F.col("_a").cast("decimal(20,0)")).over(run).alias("_h1"),
                       F.sum(F.col("_b").cast("decimal(20,0)")).over(run).alias("_h2"),
                       F.lead(F.lit(1)).over(w).isNull().alias("_last"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, _own, n_turns, n_copies of the conversations to keep: one of each content, none a prefix of a longer one."""
    p = C.materialise(prefixes(conversations), "chat-prefixes")
    whole = (p.where("_last").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("_own").alias("_own"), F.count(F.lit(1)).alias("n_copies"))
             .withColumn("_own", F.when(F.col("conv_id").isNull(), F.col("_own"))))
    inner = p.where("not _last").select(*KEY).distinct()
    return whole.join(inner, KEY, "left_anti").select("conv_id", "_own", F.col("_pos").cast("long").alias("n_turns"), "n_copies")


def line(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: maximal conversations, turns in order as ``<|role|>`` blocks.

    Turns are ordered by turn, then role, then text; repeated rows count once.
    A null role reads ``unknown``, a null text is empty, and both differ from
    such strings when conversations are compared. A turn with a null conv_id is
    a conversation of its own (turns that repeat wholly count once). An empty
    table gives an empty one.
    """
    keep = maximal(conversations).select(F.col("conv_id").alias("_id"), F.col("_own").alias("_self"), "n_turns", "n_copies")
    turns = _turns(conversations).join(keep, F.col("conv_id").eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_self"))).drop("_id", "_self")
    one = F.struct("turn", "role", "text")
    parts = F.transform(F.array_sort(F.collect_set(one)), lambda t: line(t["role"], t["text"]))
    return (turns.groupBy("conv_id", "_own").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"),
                                                 F.array_join(parts, "").alias("text")).drop("_own"))
