"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation learned on a bounded sample turns each unit vector into a balanced
binary code. Substrings of the code are the keys of several tables; vectors
that share a key and differ in few bits of the code are candidates, and the
original vectors decide. Codes are signs of centred vectors, and centring
widens the angle of a near pair where vectors have a common mean; key length,
number of tables and the share of the mean that is taken off follow from the
number of vectors and the sample's centred lengths, so that a bucket of
unrelated vectors stays small and a pair right at the limit is found with
probability 0.99. Every vector is in every table; a bucket is never cut, only
split.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log1p, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C
from basketry.llm.topk import usable

SAMPLE, ROUNDS = 4096, 40
RECALL = 0.99
#: Unrelated vectors expected in a bucket.
BUCKET = 128
SUB_BLOCK = 512
#: Shares of the sample's mean that may be taken off before signs are read.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)


def itq(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The rotation for which rounding to signs moves the centred sample least (alternating with a Procrustes step)."""
    d = x.shape[1]
    r, _ = np.linalg.qr(rng.normal(size=(d, d)))
    if len(x) < 2:
        return r
    for _ in range(ROUNDS):
        z = x @ r
        u, _, v = np.linalg.svd(np.where(z >= 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


def axes_of(x: np.ndarray) -> np.ndarray:
    """Principal axes of the centred sample; all axes are kept, so angles are too."""
    if not len(x):
        return np.eye(x.shape[1])
    _, _, v = np.linalg.svd(x, full_matrices=True)
    return v.T


def tables_for(p: float, bits: int) -> int:
    """Tables in which a pair that differs in a share ``p`` of the bits shares a key with probability RECALL."""
    return ceil(log(1 - RECALL) / log1p(-(1 - p) ** bits))


def plan(n: int, dims: int, limit: float, x: np.ndarray) -> tuple[float, int, int, int]:
    """Share of the sample's mean to take off, bits of a key, tables, and the largest Hamming distance (of 64 bits) of a candidate.

    ``x``: a sample of unit vectors. Two vectors of centred length ``r`` or more
    whose cosine is ``limit`` have a centred cosine of 1 - (1 - limit) / r^2 at
    least. Taking off the whole mean spreads the codes best but may widen this
    angle too far; the share with the least work for the same recall is taken,
    and with share 0 the angle is that of the limit itself.
    """
    usual = max(3, min(24, round(log2(max(n, 1) / BUCKET + 1))))
    mean = x.mean(0) if len(x) else np.zeros(dims)
    best: list[tuple[float, float, int, float]] = []
    for share in SHARES:
        y = x - share * mean
        r = np.linalg.norm(y, axis=1)
        p = acos(max(-1.0, min(1.0, 1 - (1 - limit) / max(1e-9, r.min(initial=1.0)) ** 2))) / pi  # share of bits in which a pair at the limit differs
        if p >= 0.5 and share:
            continue
        y = y / np.maximum(r, 1e-9)[:, None]
        half = len(y) // 2
        alike = 1 - np.arccos(np.clip((y[:half] * y[half:2 * half]).sum(1), -1, 1)) / pi if half else np.full(1, 0.5)
        for bits in range(3, (usual if share == 1 else 24) + 1):
            bits = min(bits, dims)
            # work of a vector: its rows, and its partners in the buckets; codes that are less balanced must save half
            work = tables_for(p, bits) * (1 + n * float((alike ** bits).mean()) / BUCKET)
            best.append((work * (1 if share == 1 else 2), -share, bits, p))
    _, share, bits, p = min(best)
    return -share, bits, tables_for(p, bits), ceil(64 * p + 4.5 * sqrt(64 * p * (1 - p)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0), np.finfo(float).tiny)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def padded(column: pa.Array, dims: int) -> np.ndarray:
    at = column.offsets.to_numpy()
    lens = np.diff(at)
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), dims))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(at[0], at[-1]) - np.repeat(at[:-1], lens)] = flat[at[0]:at[-1]]
    return out


def hamming_pairs(code: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the two index lists within the radius; i < j where the lists are the same."""
    near = np.bitwise_count(code[left][:, None] ^ code[right][None, :]) <= radius
    if left is right:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    return left[i], right[j]


def _sides(own: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(own == p)
    return left, left if p == q else np.flatnonzero(own == q)


KEYS = ["_t", "_key", "_p", "_q"]


def links(nodes: DataFrame, dims: int, limit: float) -> DataFrame:
    """Rows (node, add, a, b) of distinct vectors ``nodes`` (node, weight, vec).

    ``add`` is the weight that a node gains by links (null in edge rows); a and
    b are edges, a spanning forest of each batch's links.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    x = unit(padded(sample, dims)) if len(sample) else np.zeros((0, dims))
    share, bits, tables, radius = plan(n, dims, limit, x)
    mean = share * x.mean(0) if len(x) else np.zeros(dims)
    axes = axes_of(x - mean)
    rotations = max(1, -(-max(64, tables * bits) // dims))
    rng = np.random.default_rng(11)
    # learned on the centred sample whatever part of the mean stays: else all codes would point to it
    centred = (x - x.mean(0)) @ axes if len(x) else x
    turn = np.concatenate([axes @ itq(centred, rng) for _ in range(rotations)], axis=1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            sign = (unit(padded(b.column(1), dims)) - mean) @ turn > 0
            code = np.packbits(sign[:, :64], axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)
            keys = np.stack([sign[:, t * bits:(t + 1) * bits] @ weight for t in range(tables)], axis=1).astype(np.int32)
            at = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=["node", "code", "keys"])

    codes = C.materialise(nodes.select("node", "vec").mapInArrow(encode, "node long, code long, keys array<int>"), "itq-codes")
    members = codes.select("node", "code", F.posexplode("keys").alias("_t", "_key"))
    dealt = C.split_buckets(members, ["_t", "_key"], "node", SUB_BLOCK)
    width = C.partitions(spark, n * tables, 100_000)

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of a part that have a candidate there."""
        for t, starts in C.grouped(batches, KEYS):
            code = np.ascontiguousarray(t.column("code").to_numpy()).view(np.uint64)
            own, p, q = (t.column(c).to_numpy() for c in ("_sub", "_p", "_q"))
            keep = np.zeros(len(code), bool)
            for s, e in zip(starts, [*starts[1:], len(code)]):
                left, right = _sides(own[s:e], p[s], q[s])
                i, j = hamming_pairs(code[s:e], left, right, radius)
                keep[s + i] = True
                keep[s + j] = True
            if keep.any():
                yield from t.filter(pa.array(keep)).select(["node", "_sub", *KEYS]).combine_chunks().to_batches()

    schema = "node long, _sub int, _t int, _key int, _p int, _q int"
    found = C.materialise(dealt.repartition(width, *KEYS).sortWithinPartitions(*KEYS).select("node", "code", "_sub", *KEYS)
                          .mapInArrow(lookup, schema), "itq-found")
    full = found.join(nodes, "node").join(codes.select("node", "code", "keys"), "node")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in C.grouped(batches, KEYS):
            node, weight = (t.column(c).to_numpy() for c in ("node", "weight"))
            code = np.ascontiguousarray(t.column("code").to_numpy()).view(np.uint64)
            own, p, q, table = (t.column(c).to_numpy() for c in ("_sub", "_p", "_q", "_t"))
            vec = unit(padded(t.column("vec").combine_chunks() if isinstance(t.column("vec"), pa.ChunkedArray) else t.column("vec"), dims))
            keys = t.column("keys").combine_chunks()
            keys = keys.values.to_numpy()[keys.offsets[0].as_py():keys.offsets[-1].as_py()].reshape(-1, tables)
            gain = np.zeros(len(node), np.int64)
            ea, eb = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(starts, [*starts[1:], len(node)]):
                left, right = _sides(own[s:e], p[s], q[s])
                near = (vec[s:e][left] @ vec[s:e][right].T >= limit) & (np.bitwise_count(code[s:e][left][:, None] ^ code[s:e][right][None, :]) <= radius)
                if left is right:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                i, j = s + left[i], s + right[j]
                # a pair counts in the first table where it shares a key
                first = ~(keys[i, :table[s]] == keys[j, :table[s]]).any(axis=1)
                i, j = i[first], j[first]
                np.add.at(gain, i, weight[j])
                np.add.at(gain, j, weight[i])
                a, b = C.forest(node[i], node[j])
                ea.append(a)
                eb.append(b)
            has = np.flatnonzero(gain)
            a, b = C.forest(np.concatenate(ea), np.concatenate(eb))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([node[has], np.zeros(len(a), np.int64)])),
                pa.concat_arrays([pa.array(gain[has]), pa.nulls(len(a), pa.int64())]),
                pa.array(np.concatenate([np.zeros(len(has), np.int64), a])), pa.array(np.concatenate([np.zeros(len(has), np.int64), b]))],
                names=["node", "add", "a", "b"])

    return (full.repartition(width, *KEYS).sortWithinPartitions(*KEYS)
            .select("node", "weight", "vec", "code", "keys", "_sub", *KEYS).mapInArrow(rerank, "node long, add long, a long, b long"))


def near_duplicates(embeddings: DataFrame, limit: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``, by cosine >= ``limit``.

    Equal vectors are one node with their number as weight, so no group of
    copies is compared with itself. Vectors that are null, zero, or hold null
    or non-finite components have no links and are components of their own.
    Shorter vectors count as filled up with zeros. Rows that repeat count as
    copies. A null vec_id is never a component's smallest unless it is alone.
    An empty table gives an empty one.
    """
    vec = F.col("embedding").cast("array<double>")
    ok = usable(F.col("vec")) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
            .withColumn("vec", F.when(ok, F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x))))
            .withColumn("_h1", F.when(F.col("vec").isNotNull(), F.xxhash64("vec"))).withColumn("_h2", F.when(F.col("vec").isNotNull(), F.xxhash64("vec", F.lit(1)))))
    rows = C.materialise(rows, "embed-rows")
    nodes = (rows.where(F.col("vec").isNotNull()).groupBy("_h1", "_h2")
             .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.any_value("vec").alias("vec"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = C.materialise(nodes, "embed-nodes")
    dims = nodes.agg(F.max(F.size("vec"))).first()[0] or 1
    found = C.materialise(links(nodes.select("node", "weight", "vec"), dims, limit), "embed-links")
    gain = found.where(F.col("add").isNotNull()).groupBy("node").agg(F.sum("add").alias("gain"))
    roots = C.components(found.where(F.col("add").isNull()).select("a", "b"))
    rooted = nodes.select("_h1", "_h2", "node", "least", "weight").join(gain, "node", "left").join(roots, "node", "left").select(
        "_h1", "_h2", "least", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"))
    rooted = C.materialise(rooted, "embed-rooted")
    label = rooted.groupBy("root").agg(F.min("least").alias("label"))
    classes = rooted.join(label, "root").select("_h1", "_h2", "n_links", "label")
    out = rows.select("vec_id", "_h1", "_h2").join(classes, ["_h1", "_h2"], "left")
    component = F.coalesce("label", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
