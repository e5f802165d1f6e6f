"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are stored vertically: a word of plane b holds bit b of 64
fingerprints. One query fingerprint is compared with 64 others at a time:
each plane is XORed with the query's bit and added to carry-save counters,
and a (query, word) block is abandoned as soon as all its lanes exceed the
radius. Which blocks can hold a link follows from the pigeonhole principle:
of k slices of the fingerprint, two fingerprints within ``radius`` bits agree
in at least ``k - radius``, so the fingerprints that agree in some choice of
``k - radius`` slices meet in a bucket. The search is exact at every size; k
only sets the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

SEED = 42
#: Members of a sub-block; a bucket above it is split (never cut).
SUB_BLOCK = 512
#: Row keys go to all tasks up to this size, at so many bytes each; beyond it they are joined by a shuffle.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 64
PLANES_A_STEP = 8
QUERY_WORDS = 1 << 15


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the whole text; one hash of all words if there are fewer than ``words``."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    buf = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(buf, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return np.array([digest(buf[s:e], SEED) for s, e in zip(starts, ends[words - 1:].tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in more than half the hashes; 0 without hashes."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 255):
        part = hashes[k:k + 255]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, words: int, out: str = "fp", keys: dict[str, Column] | None = None) -> DataFrame:
    """doc_id and the 64-bit fingerprint (as a signed long) of each row; null text counts as empty. ``keys``: further long columns, made from the row."""
    keys = keys or {}
    names = ["doc_id", out, *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(shingle_hashes(t.as_py(), words)) for t in b.column(1)),
                              np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=names)
    schema = ", ".join(f"{c} long" for c in names)
    return (docs.select(C.take_id(), F.col("text").cast("string"), *[k.alias(c) for c, k in keys.items()])
            .mapInArrow(C.lean(run), schema))


def slices(radius: int, distinct: int) -> list[int]:
    """Masks of the tables: the k with the least expected work for so many fingerprints.

    Work of a fingerprint in a table: about 3 us to deal it out and 10 ns for each partner in its bucket.
    """
    def cost(k: int) -> float:
        return comb(k, radius) * (3 + 0.01 * distinct / 2.0 ** (64 * (k - radius) / k))
    k = min(range(radius + 1, radius + 6), key=cost)
    edges = [round(64 * i / k) for i in range(k + 1)]
    part = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(k)]
    return [sum(part[i] for i in c) for c in combinations(range(k), k - radius)]


def _planes(fp: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """planes[w, b]: bit b of the fingerprints of word w, one lane each."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cube = np.zeros((words, 64, 64), np.uint8)
    cube[word, :, lane] = bits
    return np.packbits(cube, axis=2, bitorder="little").view(np.uint64).reshape(words, 64)


def bit_sliced(fp: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray,
               radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word * 64 + lane) of each lane within ``radius`` of its query. ``lanes``: the lanes that count.

    Saturating counters c0, c1, c2 and a sticky ``over`` (radius at most 5: two
    planes are added at a time and the counters hold up to 7).
    """
    if not 0 <= radius <= 5:
        raise ValueError("radius must lie in 0..5")
    zero, one = np.uint64(0), np.uint64(1)
    c0, c1, c2 = (np.zeros(len(query), np.uint64) for _ in range(3))
    over = ~lanes
    q = fp[query]
    for step in range(0, 64, PLANES_A_STEP):
        for b in range(step, step + PLANES_A_STEP, 2):
            d = planes[word, b] ^ (zero - ((q >> np.uint64(b)) & one))
            e = planes[word, b + 1] ^ (zero - ((q >> np.uint64(b + 1)) & one))
            x = d ^ e
            carry = (d & e) | (c0 & x)
            c0 ^= x
            t = c1 & carry
            c1 ^= carry
            c2 |= t
            if radius >= 4:
                over |= c2 & (c1 | c0) if radius == 4 else c2 & c1
            elif radius == 3:
                over |= c2
            elif radius == 2:
                over |= c2 | (c1 & c0)
            else:
                over |= c2 | c1 | (c0 if radius == 0 else zero)
        alive = over != ~zero
        if not alive.all():
            query, word, q, over = query[alive], word[alive], q[alive], over[alive]
            c0, c1, c2 = c0[alive], c1[alive], c2[alive]
        if not len(query):
            break
    if not len(query):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, lane = np.nonzero(hit)
    return query[r], word[r] * 64 + lane


def _links(fp: np.ndarray, own: np.ndarray, p: np.ndarray, q: np.ndarray, starts: np.ndarray,
           radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, group by group, many groups in one pass over the planes."""
    n = len(fp)
    group = np.zeros(n, np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    target = own == q
    idx = np.flatnonzero(target)
    # lane of each target in its group
    tg = group[idx]
    first = np.concatenate([[0], np.flatnonzero(tg[1:] != tg[:-1]) + 1]) if len(tg) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(tg)))
    rank = np.arange(len(tg)) - np.repeat(first, size)
    nwords = np.zeros(len(starts), np.int64)
    nwords[tg[first]] = (size + 63) // 64
    wstart = np.concatenate([[0], np.cumsum(nwords)])
    word = wstart[tg] + rank // 64
    lane = rank % 64
    count = np.bincount(word, minlength=int(wstart[-1])).astype(np.uint64)
    full = np.where(count >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(count, np.uint64(63))) - np.uint64(1))
    planes = _planes(fp[idx], word, lane, int(wstart[-1]))
    member_at = np.full(int(wstart[-1]) * 64, -1, np.int64)
    member_at[word * 64 + lane] = idx
    my_word = np.full(n, -1, np.int64)
    my_lane = np.zeros(n, np.int64)
    my_word[idx], my_lane[idx] = word, lane
    asks = np.flatnonzero(own == p)
    same = p[asks] == q[asks]
    low = np.where(same, my_word[asks], wstart[group[asks]])
    high = wstart[group[asks] + 1]
    reps = np.maximum(high - low, 0)
    ends = np.cumsum(reps)
    done = 0
    while done < len(asks):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + QUERY_WORDS, "right")))
        a, k = asks[done:to], reps[done:to]
        query = np.repeat(a, k)
        w = np.arange(len(query)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[done:to], k)
        lanes = full[w]
        mine = np.repeat(same[done:to], k) & (w == my_word[query])
        above = ~np.uint64(0) << (my_lane[query].astype(np.uint64))
        above &= ~(np.uint64(1) << my_lane[query].astype(np.uint64))
        lanes = np.where(mine, lanes & above, lanes)
        i, at = bit_sliced(fp, planes, query, w, lanes, radius)
        yield i, member_at[at]
        done = to


def links(distinct: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """Edges (a, b) that join all fingerprints within ``radius`` bits, reduced to a spanning forest of each batch.

    ``distinct`` has each fingerprint once. A batch's links are reduced before
    they leave the task, so no group of n copies sends n^2 rows.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    masks = slices(radius, n)
    table = F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]))
    members = (distinct.select(F.col(fp).alias("fp"), table.alias("_t", "_mask"))
               .select("fp", F.col("_t").cast("int").alias("_t"), F.col("fp").bitwiseAND(F.col("_mask")).alias("_key")))
    dealt = C.split_buckets(members, ["_t", "_key"], "fp", SUB_BLOCK)
    keys = ["_t", "_key", "_p", "_q"]
    width = C.partitions(spark, n * len(masks), 200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in C.grouped(batches, keys):
            value = np.ascontiguousarray(t.column("fp").to_numpy()).view(np.uint64)
            own, p, q = (t.column(c).to_numpy() for c in ("_sub", "_p", "_q"))
            # groups of one row have no partner; the rest in slices of bounded size
            at = np.append(starts, len(value))
            lo = 0
            while lo < len(starts):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 4096, "right")) - 1)
                s, e = at[lo], at[hi]
                found = [(np.empty(0, np.int64),) * 2, *_links(value[s:e], own[s:e], p[s:e], q[s:e],
                                                                 at[lo:hi] - s, radius)]
                i, j = (np.concatenate([f[x] for f in found]) for x in (0, 1))
                a, b = C.forest(value[s:e][i].view(np.int64), value[s:e][j].view(np.int64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                lo = hi

    return (dealt.repartition(width, *keys).sortWithinPartitions(*keys)
            .select("fp", "_sub", *keys).mapInArrow(C.lean(run), "a long, b long"))


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    ``words`` is the shingle length and ``radius`` the largest bit distance of a
    link. Null and empty texts have fingerprint zero and are linked like any
    other. Rows that repeat keep one row each. component_id is the smallest
    doc_id reachable over links (null only if the class has none). An empty
    table gives an empty result; other columns are ignored.
    """
    fps = C.materialise(fingerprints(docs, words), "simhash")
    # all rows of one fingerprint are one node, so exact copies cost one row each here
    nodes = C.materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = C.components(links(nodes, radius))
    rooted = (nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    label = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(label, "root").select("fp", "component_id")
    return (fps.join(classes, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def row_key(docs: DataFrame) -> dict[str, Column]:
    """Hashes of a row's text and of all its columns: the same for rows that repeat, whatever their doc_id."""
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return {"_text": F.xxhash64(F.col("text").cast("string"), F.lit(3)), "_all": F.xxhash64(*hashable)}


def _sized(keys: DataFrame) -> DataFrame:
    """A written table of row keys, for broadcast where it is small."""
    keys = C.materialise(keys, "simhash-keys")
    return F.broadcast(keys) if keys.count() * KEY_BYTES <= BROADCAST_BYTES else keys


def dedup(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the smallest doc_id.

    All columns are kept, whatever their names. The choice is by row: null ids
    come last, and rows with one doc_id are ordered by hashes of their text and
    columns, so every class keeps exactly one row, the same in every run. Null
    and empty texts are one class. An empty table gives an empty one.

    Only the keys of rows that go, and of rows that repeat, meet the documents
    again; while they fit a broadcast of known size, no text is shuffled but
    that of rows that repeat.
    """
    fps = fingerprints(docs, words, keys=row_key(docs))
    # null ids last; all rows of one fingerprint are one node
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "_text", "_all")
    rows = C.materialise(fps.select("fp", first.alias("__simhash_key")), "simhash-rows")
    nodes = C.materialise(rows.groupBy("fp").agg(F.min("__simhash_key").alias("first")), "nodes")
    roots = C.components(links(nodes.select("fp"), radius))
    rooted = C.materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    judged = C.materialise(rows.join(rooted.join(kept, "root").select("fp", "kept"), "fp")
                           .groupBy("__simhash_key").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("__simhash_key") == F.col("kept")).alias("stays")), "simhash-judged")
    gone = _sized(judged.where("not stays").select("__simhash_key"))
    repeated = _sized(judged.where("stays and n > 1").select("__simhash_key"))
    key = row_key(docs)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
                    key["_text"].alias("_text"), key["_all"].alias("_all"))
    left = docs.withColumn("__simhash_key", mine).join(gone, "__simhash_key", "left_anti")
    once = left.join(repeated, "__simhash_key", "left_anti")
    twice = left.join(repeated, "__simhash_key", "left_semi").dropDuplicates(["__simhash_key"])
    return once.unionAll(twice).drop("__simhash_key")
