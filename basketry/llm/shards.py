"""Sharding by a k-d tree over document metadata.

A node is split along its widest metadata dimension at the weighted median of
the bytes, until every leaf holds its target. Medians come from byte
histograms: 4,096 buckets a node, then finer ones inside the bucket where the
median lies. All dimensions are measures of the text, so equal texts are one
point; a median that falls on a point too heavy for either side goes on among
its copies. The driver sees one row per node. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C
from basketry.llm.mixing import boundary

#: A median is good enough when its bucket holds this share of its node.
FINE = 0.002
COORD, TIE, STEP = 20, 40, 12
BITS = COORD + TIE


def _dims(text: Column, size: Column) -> list[Column]:
    """Size on a log scale, bytes a character, share of blanks: each in 0..1, alike for equal texts."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    blanks = F.char_length(text) - F.char_length(F.translate(text, " \t\n\r", ""))
    return [F.least(F.log2(size.cast("double")) / 48, F.lit(1.0)), F.coalesce((size - 1) / chars / 4, F.lit(0.0)), F.coalesce(blanks / chars, F.lit(0.0))]


def _key(dim: Column, tie: Column) -> Column:
    """One number for (coordinate, tie): the coordinate's 20 bits above the tie's 40."""
    return F.shiftleft(F.floor(dim * ((1 << COORD) - 1)).cast("long"), TIE).bitwiseOR(tie)


def _pick(values: list, default, at: Column) -> Column:
    """values[node] for node = at, as an expression."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in values]), at + 1), F.lit(default))


def _refine(rows: DataFrame, column: str, budgets: dict[int, float], totals: dict[int, float]) -> tuple[dict[int, int], dict[int, float]]:
    """For each node the value of ``column`` below which its rows hold about its budget.

    A value that alone holds more than FINE of its node is not judged here:
    the second map has what of the budget is left inside it.
    """
    width = max(budgets) + 1
    low: dict[int, int] = {}
    left = rows.withColumn("_budget", _pick([float(budgets.get(i, 0)) for i in range(width)], 0.0, F.col("_node"))).withColumn("_key", F.col("_node"))
    shift = BITS
    while True:
        shift -= STEP
        hist = left.groupBy("_key", "_budget", F.shiftright(column, shift).alias("_bucket")).agg(F.sum("size").alias("_words"))
        found = {r["_key"]: r for r in boundary(hist).collect()}
        goals = {i: budgets[i] - r["_done"] for i, r in found.items()}
        heavy = {i for i, r in found.items() if r["_here"] > FINE * totals[i]}
        for i, r in found.items():
            # the median's bucket goes to the side that brings the left part nearer to its budget
            low[i] = (r["_edge"] + (2 * goals[i] > r["_here"])) << shift
        if not heavy:
            return low, {}
        if shift == 0:
            return {i: found[i]["_edge"] if i in heavy else v for i, v in low.items()}, {i: goals[i] for i in heavy}
        budgets = goals
        left = left.where(F.shiftright(column, shift) == _pick([found[i]["_edge"] if i in found else -1 for i in range(width)], -1, F.col("_key")))
        left = C.materialise(left.withColumn("_budget", _pick([float(goals.get(i, 0)) for i in range(width)], 0.0, F.col("_key"))), "shard-edge")


def _medians(rows: DataFrame, budgets: dict[int, float], totals: dict[int, float]) -> dict[int, tuple[int, int]]:
    """For each node the (_k, _copy) below which its rows hold about its budget. rows: _node, _k, _copy, size."""
    low, open_ = _refine(rows, "_k", budgets, totals)
    cut = {i: (k, 0) for i, k in low.items()}
    if open_:
        width = max(open_) + 1
        inside = rows.where(F.col("_k") == _pick([low[i] if i in open_ else -1 for i in range(width)], -1, F.col("_node")))
        copies, _ = _refine(inside, "_copy", open_, totals)
        cut |= {i: (low[i], c) for i, c in copies.items()}
    return cut


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """_row, doc_id, size, text_crc32, shard of every row."""
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    row = F.monotonically_increasing_id()
    # copies of a text in order of doc_id's hash; those of one doc_id by their row in this table
    half = (1 << BITS // 2) - 1
    copy = F.shiftleft(F.xxhash64(F.col("doc_id"), F.lit(9)).bitwiseAND(half), BITS // 2).bitwiseOR(F.xxhash64("_row").bitwiseAND(half))
    rows = C.materialise(docs.select(
        C.take_id(), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), F.array(*_dims(text, size)).alias("_dims"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(5)), 64 - TIE).alias("_tie"), row.alias("_row")).withColumn("_copy", copy), "shard-rows")
    columns = rows.columns
    node = F.lit(0)
    leaves = {0: shards}  # node: shards below it
    first = {0: 0}  # node: its first shard
    spread = [F.struct(F.min(F.col("_dims")[i]).alias("a"), F.max(F.col("_dims")[i]).alias("b")) for i in range(3)]
    while any(k > 1 for k in leaves.values()):
        now = rows.withColumn("_node", node)
        stats = {r["_node"]: r for r in now.groupBy("_node").agg(F.sum("size").alias("w"), *[s.alias(f"d{i}") for i, s in enumerate(spread)]).collect()}
        split = {i: k for i, k in leaves.items() if k > 1 and i in stats}
        if not split:
            break
        totals = {i: float(stats[i]["w"]) for i in split}
        budgets = {i: totals[i] * (k // 2) / k for i, k in split.items()}
        dim = {i: max(range(3), key=lambda d: (stats[i][f"d{d}"]["b"] - stats[i][f"d{d}"]["a"], -d)) for i in split}
        width = max(split) + 1
        along = _pick([dim.get(i, 0) for i in range(width)], 0, node)
        key = _key(F.element_at("_dims", along + 1), F.col("_tie"))
        active = _pick([i in split for i in range(width)], False, node)
        cut = _medians(rows.where(active).select(node.alias("_node"), key.alias("_k"), "_copy", "size"), budgets, totals)
        at, among = (_pick([cut.get(i, (0, 0))[j] for i in range(width)], 0, node) for j in (0, 1))
        right = active & ((key > at) | ((key == at) & (F.col("_copy") >= among)))
        # children of node i: 2i + 1 and 2i + 2; a leaf moves on as its own left child
        node = (node * 2 + 1 + right.cast("int"))
        grown, begin = {}, {}
        for i, k in leaves.items():
            a = k // 2 if i in split else k
            grown[2 * i + 1], begin[2 * i + 1] = a, first[i]
            if i in split:
                grown[2 * i + 2], begin[2 * i + 2] = k - a, first[i] + a
        leaves, first = grown, begin
        nxt = C.materialise(rows.select(*columns, node.alias("_at")), "shard-rows")
        C.release(rows)
        rows, node = nxt, F.col("_at")
    base = min(first)
    shard = F.element_at(F.array(*[F.lit(first.get(i, 0)) for i in range(base, max(first) + 1)]), (node - base + 1).cast("int"))
    return rows.select("_row", "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``; law ``bytes``.

    Shards hold nearly equal bytes (UTF-8 bytes of the text plus 1; a null text
    has none and a crc32 of 0, and is one text with the empty one). Equal texts
    share a shard, whatever their other columns. Only a text that a cut of the
    tree falls on, and whose copies would tip a side by more than FINE of its
    node, is split there, among its rows: by doc_id, repeated and null ids by
    row. So shards differ by about FINE a level and one row. Slots number a
    shard's rows from 0. An empty table gives an empty one.
    """
    rows = C.numbered(C.materialise(assign(docs, shards), "shard-leaf"), ["shard"], ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_nth") - 1).alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


def target_shards(docs: DataFrame, target_bytes: int) -> int:
    """Leaves needed for at most about ``target_bytes`` each."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1)).first()[0] or 0
    return max(1, -(-total // target_bytes))
