"""Ranked lexical search, reversed: the items are the index and the documents are the stream.

The distinct terms of the items form an inverted index, which is broadcast in
blocks of a fixed number of postings. Every document's counts of the index's
terms pass through it once: a term adds its impact to all items on its posting
list, and an item keeps its best documents in a heap of ``k``. The heaps of all
tasks are merged in two steps. One pass before it gathers the corpus figures
(documents, terms, document frequencies).
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Postings (item, term) of a block of items: the bound of what is broadcast. An item is never cut.
BLOCK_POSTINGS = 200_000
#: (document, item) sums and (document, posting) additions held at once.
CELLS, ADDITIONS = 1 << 21, 1 << 21
#: First step of the merge: so many heaps of an item meet in parallel.
MERGE_WAYS = 64


#: Byte map of the term rule: ASCII but digits and letters to a space, A-Z to lower case; bytes from 0x80 on stay.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters and characters beyond ASCII in UTF-8 text; only A-Z lower-cased."""
    return text.translate(FOLD).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for v in column:
        yield v.as_py() or b""


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (item, term) of all items."""
    source = items.select(F.col(item).alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(_texts(b.column(1))):
                found = sorted(set(terms(raw)))
                if found:
                    owner = b.column(0).take(pa.array(np.full(len(found), i)))
                    yield pa.RecordBatch.from_arrays([owner, pa.array(found, pa.binary())], names=["item_id", "term"])
    schema = f"item_id {source.schema['item_id'].dataType.simpleString()}, term binary"
    return source.mapInArrow(run, schema).distinct()


def count_terms(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), term and tf (the counts of the wanted terms) of every document that has a term."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for b in batches:
            keep, n, cut, term, tf = [], [], [0], [], []
            for i, raw in enumerate(_texts(b.column(1))):
                words = terms(raw)
                if not words:
                    continue
                hits = Counter(filter(index.__contains__, words))
                keep.append(i)
                n.append(len(words))
                term += map(index.__getitem__, hits)
                tf += hits.values()
                cut.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, t)) for v, t in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), *lists],
                                             names=["doc_id", "n", "term", "tf"])
    source = docs.select(C.take_id(), F.col("text").cast("string").cast("binary").alias("text"))
    return source.mapInArrow(C.lean(run), "doc_id long, n long, term array<int>, tf array<long>")


class Index:
    """Posting lists (items of each term) and term weights of a block."""

    def __init__(self, pairs: pa.Table) -> None:
        coded = pairs.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        word = pairs.column("term").combine_chunks().dictionary_encode()
        self.items = coded.dictionary
        self.terms = word.dictionary.to_pylist()
        owner, term = coded.indices.to_numpy(), word.indices.to_numpy()
        order = np.lexsort((owner, term))
        self.post = owner[order].astype(np.int64)
        self.len = np.bincount(term, minlength=len(self.terms))
        self.at = np.cumsum(self.len) - self.len

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)


class Heaps:
    """The ``k`` best documents of each item: higher score, then smaller doc_id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.rows = k, [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores``: documents x items."""
        for r, i in np.argwhere(scores >= self.floor).tolist():
            doc, heap = ids[r], self.rows[i]
            entry = (int(scores[r, i]), doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]

    def batch(self, items: pa.Array) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(self.rows)), [len(h) for h in self.rows])
        flat = [e for h in self.rows for e in h]
        return pa.RecordBatch.from_arrays(
            [items.take(pa.array(owner)), pa.array([-e[2] if e[1] else None for e in flat], pa.int64()), pa.array([e[0] for e in flat], pa.int64())],
            names=["item_id", "doc_id", "score"])


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.values.to_numpy()[at[0]:at[-1]]


def score(counts: DataFrame, index: Index, documents: int, length: int, k: int) -> DataFrame:
    """Heaps of every task: item_id, doc_id, score."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        width = len(ix.items)
        heaps = Heaps(width, k)
        step = 64  # the heaps fill from few documents first, so that their floors hold most others off
        for b in batches:
            ids = b.column(0).to_pylist()
            m = 100 - 90 + (90 * b.column(1).to_numpy() * documents) // length
            at, term = _flat(b.column(2))
            _, tf = _flat(b.column(3))
            row = np.repeat(np.arange(len(ids)), np.diff(at))
            impact = ix.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            work = np.concatenate([[0], np.cumsum(ix.len[term])])[at]
            lo = 0
            while lo < len(ids):
                hi = min(lo + step, lo + max(1, CELLS // width), int(np.searchsorted(work, work[lo] + ADDITIONS, "right")) - 1)
                hi = min(len(ids), max(hi, lo + 1))
                s, e = at[lo], at[hi]
                n = ix.len[term[s:e]]
                to = np.repeat(ix.at[term[s:e]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                sums = np.zeros((hi - lo) * width, np.int64)
                np.add.at(sums, np.repeat((row[s:e] - lo) * width, n) + ix.post[to], np.repeat(impact[s:e], n))
                heaps.offer(sums.reshape(hi - lo, width), ids[lo:hi])
                lo, step = hi, step * 4
        yield heaps.batch(ix.items)
    schema = f"item_id {index.item_type}, doc_id long, score long"
    return counts.mapInArrow(C.lean(run), schema)


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for every item.

    All rows of ``docs`` are documents: repeated rows count and rank as often
    as they stand there. A null or empty text has no terms, so it is neither
    counted nor found. Null doc_ids come last among equal scores. Rows of
    ``items`` that share an item_id (null too) are one item with all their
    terms; an item without a term, or whose terms no document has, gets no
    rows. Items beyond ``BLOCK_POSTINGS`` postings are answered in several
    passes over the documents, each with an index of that size (of one item's
    terms, if it alone has more). Empty tables give no rows.
    """
    spark = docs.sparkSession
    pairs = C.materialise(item_terms(items, item, text), "lexical-items")
    blocks = max(1, -(-pairs.count() // BLOCK_POSTINGS))
    found = []
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        if not rows.num_rows:
            continue
        index = Index(rows)
        index.item_type = pairs.schema["item_id"].dataType.simpleString()
        counts = C.materialise(count_terms(docs, {t: i for i, t in enumerate(index.terms)}), "lexical-counts")
        total = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        if not total.n:
            continue
        df = counts.select(F.explode("term").alias("t")).groupBy("t").count().toArrow()
        index.weigh(total.n, dict(zip(df.column(0).to_pylist(), df.column(1).to_pylist())))
        heaps = score(counts, index, total.n, total.l, k).withColumn("_way", F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)))
        best = _best(_best(heaps, ["item_id", "_way"], k).drop("rank", "_way"), ["item_id"], k)
        found.append(C.materialise(best.select("item_id", "rank", "doc_id", "score"), "lexical-best"))
        C.release(counts)
    if not found:
        return spark.createDataFrame([], f"item_id {pairs.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)
