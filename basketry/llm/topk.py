"""Exact top-k inner products with an impact-ordered score-at-a-time index.

The index holds blocks of vectors as posting segments: the positions and
values of one dimension at one quantised impact. A block of queries takes the
segments in order of falling impact and adds them to its scores. What is left
of a vector can add no more than |query| * |rest of the vector| (Cauchy and
Schwarz), so after each impact level the rows whose best possible score is
below the query's threshold are out, by proof. When few are left, they alone
are scored exactly. Thresholds start from a bounded sample of vectors and rise
as a task meets more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm import common as C

BLOCK, QUERY_BLOCK = 1024, 64
#: Vectors of the first threshold, the same for all queries (the bound of what is collected).
SEED_ROWS = 2048
SCALE = 1024
#: Above this size of a component, scores are computed with unbounded integers.
NARROW = 1 << 24
#: Rescore when at most this share of a block's (vector, query) scores is open.
FEW = 0.02
#: Query blocks whose thresholds a task remembers.
REMEMBERED = 2000
LONG_MAX = (1 << 63) - 1


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch while a step with large rows runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def usable(vec: Column) -> Column:
    """Not null and without a null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as floor(1024 * x); shorter vectors are filled with zeros."""
    column = column.cast(pa.list_(pa.float64())) if not pa.types.is_large_list(column.type) else column
    at = column.offsets.to_numpy()
    lens = np.diff(at)
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), int(lens.max(initial=0))))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(at[0], at[-1]) - np.repeat(at[:-1], lens)] = flat[at[0]:at[-1]]
    return np.floor(out * SCALE)


def impact(values: np.ndarray) -> np.ndarray:
    """Quantised impact: half octaves of |value|, 0 for 0."""
    a = np.abs(values).astype(float)
    return np.where(a > 0, np.floor(2 * np.log2(np.maximum(a, 1))).astype(np.int64) + 1, 0)


class Segments:
    """The postings of a block, by falling impact."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.dims = x.shape
        row, dim = np.nonzero(x)
        value = x[row, dim].astype(np.int64)
        level = impact(value)
        order = np.lexsort((row, dim, -level))
        self.row, self.dim, self.value, self.level = (v[order] for v in (row, dim, value, level))

    @classmethod
    def read(cls, raw: dict) -> "Segments":
        s = cls.__new__(cls)
        s.n, s.dims = raw["n"], raw["dims"]
        s.row = np.frombuffer(raw["row"], np.int16).astype(np.int64)
        s.dim = np.frombuffer(raw["dim"], np.int32).astype(np.int64)
        s.value = np.frombuffer(raw["value"], np.int32).astype(np.int64)
        s.level = impact(s.value)
        return s

    def dense(self) -> np.ndarray:
        x = np.zeros((self.n, self.dims), np.int64)
        x[self.row, self.dim] = self.value
        return x


def search(seg: Segments, q: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, query, score) of a block's rows that may reach their query's threshold; the rest is proven below it."""
    queries = np.zeros((len(q), max(seg.dims, q.shape[1])), np.int64)
    queries[:, :q.shape[1]] = q
    queries = queries[:, :seg.dims]
    norm = np.sqrt((queries.astype(float) ** 2).sum(1)) * (1 + 1e-9)
    acc = np.zeros((seg.n, len(q)), np.int64)
    rest = np.bincount(seg.row, weights=seg.value.astype(float) ** 2, minlength=seg.n)
    change = np.flatnonzero((np.diff(seg.level) != 0) | (np.diff(seg.dim) != 0)) + 1
    starts = np.concatenate([[0], change]) if len(seg.row) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(seg.row))
    open_ = None
    for i, (s, e) in enumerate(zip(starts, ends)):
        rows, value = seg.row[s:e], seg.value[s:e]
        acc[rows] += value[:, None] * queries[:, seg.dim[s]][None, :]
        rest[rows] -= value.astype(float) ** 2
        if i + 1 < len(starts) and seg.level[e] != seg.level[s]:
            best = acc + np.sqrt(np.maximum(rest, 0) + 1)[:, None] * norm[None, :]
            open_ = best >= threshold[None, :]
            if open_.mean() <= FEW:
                v, k = np.nonzero(open_)
                x = seg.dense()
                return v, k, np.einsum("ij,ij->i", x[v], queries[k])
    v, k = np.nonzero(acc >= threshold[None, :])
    return v, k, acc[v, k]


def exact_wide(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of components too large for 64-bit sums, with Python's integers, held to the range of a long."""
    d = min(x.shape[1], q.shape[1])
    a = [[int(c) for c in r[:d]] for r in x]
    b = [[int(c) for c in r[:d]] for r in q]
    return np.array([[max(-LONG_MAX, min(LONG_MAX, sum(i * j for i, j in zip(r, s)))) for s in b] for r in a], np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _blocks(vectors: DataFrame) -> DataFrame:
    """The index: one row per block, ``wide`` ones with plain components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                cut = b.slice(lo, BLOCK)
                ids, x = cut.column(0).to_numpy(), matrix(cut.column(1))
                large = np.abs(x).max(axis=1, initial=0) >= NARROW
                rows = []
                for wide in (False, True):
                    pick = large == wide
                    if not pick.any():
                        continue
                    made += 1
                    row = {"block": (part << 32) + made, "n": int(pick.sum()), "dims": x.shape[1], "wide": wide, "ids": ids[pick].astype(np.int64).tobytes()}
                    if wide:
                        row |= {"row": b"", "dim": b"", "value": x[pick].tobytes()}
                    else:
                        s = Segments(x[pick].astype(np.int64))
                        row |= {"row": s.row.astype(np.int16).tobytes(), "dim": s.dim.astype(np.int32).tobytes(), "value": s.value.astype(np.int32).tobytes()}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX)
    return vectors.mapInArrow(run, "block long, n int, dims int, wide boolean, ids binary, row binary, dim binary, value binary")


INDEX = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("wide", pa.bool_()),
                   ("ids", pa.binary()), ("row", pa.binary()), ("dim", pa.binary()), ("value", pa.binary())])


def _asks(queries: DataFrame, seed_ids: np.ndarray, seed: np.ndarray, k: int) -> DataFrame:
    """Query blocks with a proven lower bound of each query's k-th score, from the sample."""
    narrow = np.abs(seed).max(axis=1, initial=0) < NARROW
    seed_ids, seed = seed_ids[narrow], seed[narrow].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_BLOCK):
                cut = b.slice(lo, QUERY_BLOCK)
                ids, q = cut.column(0).to_numpy(), matrix(cut.column(1))
                wide = bool(np.abs(q).max(initial=0) >= NARROW)
                floor = np.full(len(ids), -LONG_MAX, np.int64)
                d = min(q.shape[1], seed.shape[1])
                if not wide and len(seed):
                    s = seed[:, :d] @ q[:, :d].astype(np.int64).T
                    for j in range(len(ids)):
                        own = s[seed_ids != ids[j], j]
                        if len(own) >= k:
                            floor[j] = np.partition(own, len(own) - k)[len(own) - k]
                made += 1
                yield pa.RecordBatch.from_pylist([{"ask": (part << 32) + made, "q_n": len(ids), "q_dims": q.shape[1], "q_wide": wide, "q_ids": ids.astype(np.int64).tobytes(), "q_value": q.tobytes(), "q_floor": floor.tobytes()}], schema=ASK)
    return queries.mapInArrow(run, "ask long, q_n int, q_dims int, q_wide boolean, q_ids binary, q_value binary, q_floor binary")


ASK = pa.schema([("ask", pa.int64()), ("q_n", pa.int32()), ("q_dims", pa.int32()), ("q_wide", pa.bool_()), ("q_ids", pa.binary()), ("q_value", pa.binary()), ("q_floor", pa.binary())])


class _Best:
    """The k best rows so far of each query of a block, and the thresholds they prove."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.k, self.ids = k, ids
        self.floor = floor.copy()
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[q]
        a = np.concatenate([self.rows[q][0], ids[other]])
        s = np.concatenate([self.rows[q][1], scores[other]])
        top = best(s, a, self.k)
        self.rows[q] = (a[top], s[top])
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], int(s[top[-1]]))

    def batch(self) -> pa.RecordBatch:
        n = [len(r[0]) for r in self.rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(np.concatenate([r[0] for r in self.rows])), pa.array(np.concatenate([r[1] for r in self.rows]))],
            names=["query_id", "vec_id", "score"])


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates
    are all rows but those with the query's own vec_id. Vectors that are null,
    or hold null or non-finite components, and rows without a vec_id take no
    part; a shorter vector counts as filled up with zeros. Rows that repeat
    (same vec_id and vector) count once. Scores beyond a long are held at its
    ends. Every query block meets every index block once.
    """
    spark = embeddings.sparkSession
    vec = F.col("embedding").cast("array<double>")
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct())
    rows = C.materialise(rows, "topk-rows")
    index = C.materialise(_blocks(rows), "topk-index")
    sample = (rows.select(F.xxhash64("vec_id").alias("_h"), "vec_id", "vec").orderBy("_h", "vec_id").limit(SEED_ROWS).toArrow())
    seed_ids = sample.column("vec_id").to_numpy()
    seed = matrix(sample.column("vec").combine_chunks()) if sample.num_rows else np.zeros((0, 0))
    asks = C.materialise(_asks(rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id")), seed_ids, seed, k), "topk-asks")
    n = index.count()
    groups = min(max(1, n), max(2 * spark.sparkContext.defaultParallelism, n // 64))
    pairs = (index.withColumn("_g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
             .join(asks.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "_g").drop("_g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, _Best] = {}
        block, seg, ids = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != block:
                    block, ids = r["block"], np.frombuffer(r["ids"], np.int64)
                    seg = None if r["wide"] else Segments.read(r)
                q = np.frombuffer(r["q_value"], float).reshape(r["q_n"], r["q_dims"])
                if r["ask"] not in kept:
                    if len(kept) >= REMEMBERED:
                        yield kept.pop(next(iter(kept))).batch()
                    kept[r["ask"]] = _Best(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_floor"], np.int64), k)
                state = kept[r["ask"]]
                if r["wide"] or r["q_wide"]:
                    x = np.frombuffer(r["value"], float).reshape(r["n"], r["dims"]) if r["wide"] else seg.dense()
                    s = exact_wide(x, q)
                    for j in range(r["q_n"]):
                        state.add(j, ids, s[:, j])
                    continue
                v, c, s = search(seg, q.astype(np.int64), state.floor)
                order = np.argsort(c, kind="stable")
                v, c, s = v[order], c[order], s[order]
                cuts = np.searchsorted(c, np.arange(r["q_n"] + 1))
                for j in np.flatnonzero(np.diff(cuts)):
                    state.add(int(j), ids[v[cuts[j]:cuts[j + 1]]], s[cuts[j]:cuts[j + 1]])
        for state in kept.values():
            yield state.batch()

    with arrow_rows(spark, 16):  # a row holds a block of the index
        part = C.materialise(pairs.mapInArrow(run, "query_id long, vec_id long, score long"), "topk-part")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (part.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
