"""Shared helpers: tables in the cluster's shared folder, bucket splitting, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir

#: ASCII white space of the word rule ``[^\\x20\\x09-\\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    It cuts the lineage at a table every executor can read, so a lost
    executor costs a re-read, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` once nothing reads it any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving back a task's memory when it ends.

    Python workers live on from task to task; without this each keeps the
    largest task's freed memory.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return task


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Shuffle width for a step over ``rows`` rows: grows with the rows, never below the cores."""
    return max(spark.sparkContext.defaultParallelism * 2, -(-rows // per_task))


def split_buckets(members: DataFrame, keys: Sequence[str], ident: str, limit: int) -> DataFrame:
    """Deal the members of each bucket into parts that hold at most about ``2 * limit`` rows.

    A bucket of n rows becomes ``s = ceil(n / limit)`` sub-blocks by the hash of
    ``ident`` and ``s (s + 1) / 2`` parts (_p, _q), one for each pair of
    sub-blocks, so all pairs of the bucket meet in exactly one part and no
    task holds a whole hot bucket. ``_sub`` tells a member's own sub-block.
    """
    hot = (members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
           .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    hot = materialise(hot, "hot")
    parts = F.coalesce("_parts", F.lit(1))
    other = F.col("_other")
    return (members.join(hot, list(keys), "left")
            .withColumn("_sub", F.pmod(F.xxhash64(ident, F.lit(7)), parts).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
            .withColumn("_p", F.least("_sub", other).cast("int"))
            .withColumn("_q", F.greatest("_sub", other).cast("int"))
            .drop("_parts", "_other"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], per_task: int = 20_000) -> DataFrame:
    """Adds ``_nth``: 1, 2, 3 ... in each group of ``keys`` (never null).

    ``rows`` is a written table with a ``_row`` of its own for every row. Rows
    are numbered in buckets of about ``per_task`` by the hash of ``_row``, and a
    bucket starts where those before it in its group end, so that no task
    numbers a whole group.
    """
    n = max(16, -(-rows.count() // per_task))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = (rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
             .select(*keys, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_from")))
    own = Window.partitionBy(*keys, "_b").orderBy(*order, "_row")
    return (rows.join(start, [*keys, "_b"]).withColumn("_nth", (F.col("_from") + F.row_number().over(own)).cast("long"))
            .drop("_b", "_from"))


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups out of batches sorted by integer ``keys``: (table, start of each group).

    The last group of a batch is held back until its end is seen, so memory
    is one batch plus one group.
    """
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        change = np.zeros(t.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        cut = int(starts[-1])
        if cut:
            yield t.slice(0, cut), starts[:-1]
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the links a[i]-b[i]."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if np.array_equal(before, label):
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _checked(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    out = materialise(edges, name)
    row = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return out, (row[0], row[1])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (long columns a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star steps; both take a minimum per node
    (pre-aggregated) and join it back, so a hub is never gathered. The number
    of rounds grows with the logarithm of the longest chain; each round is a
    table in the shared folder, and the one before it is deleted. Nodes
    without an edge do not appear.
    """
    e = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e, mark = _checked(e, "edges")
    while mark[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        nxt, seen = _checked(small, "edges")
        release(e)
        e, done, mark = nxt, seen == mark, seen
        if done:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def take_id(column: str = "doc_id") -> Column:
    return F.col(column).cast("long").alias(column)
