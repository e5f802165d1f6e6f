"""Hard-negative mining with cover trees over norm-augmented candidates.

Blocks of candidates become cover trees. Each vector gets one more component
that brings it to the block's greatest norm, so that near points have near
inner products with any query. A node holds a centre and the covering radius
of all points below it; its children cover it with radii that shrink level by
level. For a query q, every inner product below a node lies within
|q| * radius of the one with its centre (the query's added component is zero).

A descent takes a batch of queries through a tree, best node first. A node is
left out for a query when its bounds lie outside the query's window of scores
or below the k-th best score found so far; leaves are scored exactly. Positives
are found with an open window, then negatives with the windows that the
positives' scores set.

Queries go to the trees in broadcast rounds of a fixed number of rows, so that
a tree is read once a round and never moved.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common as C
from basketry.llm.topk import LONG_MAX, arrow_rows, exact_wide, usable

#: Vectors of a tree, vectors of a leaf, ratio of the covering radii of two levels.
BLOCK, LEAF, SHRINK = 2048, 24, 1.3
#: Queries that descend together, and values (rows times dimensions) of a broadcast round: the bound of what is sent.
BATCH, ROUND_VALUES = 64, 1 << 21
SCALE = 256
#: Vectors from this norm on are scored plainly with unbounded integers; below it all scores are exact in doubles.
WIDE = float(1 << 26)
#: Guard of the bounds against rounding.
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as floor(256 * x); shorter vectors are filled with zeros."""
    at = column.offsets.to_numpy().astype(np.int64)
    lens = np.diff(at)
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lens), int(lens.max(initial=0))))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(at[0], at[-1]) - np.repeat(at[:-1], lens)] = flat[at[0]:at[-1]]
    return np.nan_to_num(np.floor(out * SCALE))


class CoverTree:
    """Points in the order of the tree, and its nodes; the children of a node are consecutive."""

    FIELDS = ("order", "centre", "radius", "start", "end", "first", "last")

    def __init__(self, x: np.ndarray) -> None:
        norm = (x * x).sum(axis=1)
        lifted = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1)
        square = (lifted * lifted).sum(axis=1)
        gram = lifted @ lifted.T
        centre, start, end, first, last = [0], [0], [len(x)], [0], [0]
        order = np.arange(len(x))
        radius = []

        def reach(c: int, points: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[points] + square[c] - 2 * gram[c, points], 0))

        i = 0
        while i < len(centre):
            points = order[start[i]:end[i]]
            c = centre[i]
            r = np.sqrt(((lifted[points] - lifted[c]) ** 2).sum(axis=1).max())
            radius.append(r * (1 + SLACK))
            if len(points) > LEAF and r > 0:
                rest, sets, centres = points, [], []
                while len(rest):
                    near = reach(c, rest) <= r / SHRINK
                    near[rest == c] = True
                    sets.append(rest[near])
                    centres.append(c)
                    rest = rest[~near]
                    c = int(rest[0]) if len(rest) else c
                # points that rounding cannot part stay one leaf
                if len(sets) > 1:
                    first[i], last[i] = len(centre), len(centre) + len(sets)
                else:
                    sets = []
                at = start[i]
                for s, own in zip(sets, centres):
                    order[at:at + len(s)] = s
                    centre.append(own)
                    start.append(at)
                    end.append(at + len(s))
                    first.append(0)
                    last.append(0)
                    at += len(s)
            i += 1
        self.order = order
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.centre, self.radius = place[np.array(centre)], np.array(radius)
        self.start, self.end, self.first, self.last = (np.array(v, np.int64) for v in (start, end, first, last))


def descend(tree: CoverTree, x: np.ndarray, labels: np.ndarray, q: "Queries", rows: np.ndarray, take) -> None:
    """Hands ``take`` all (point, query) that may be among a query's best: points of ``x`` (in tree order), queries ``rows``.

    Nodes wait in a heap by their best possible score; the bounds are tested
    again when a node's turn has come, since the queries' floors have risen.
    """
    d = min(x.shape[1], q.x.shape[1])
    queries, points = q.x[rows][:, :d], x[:, :d]
    norm, high, label = q.norm[rows], q.high[rows], q.label[rows]

    waiting: list[tuple[float, int, np.ndarray, np.ndarray]] = []

    def wait(nodes: np.ndarray, active: np.ndarray) -> None:
        score = points[tree.centre[nodes]] @ queries[active].T
        spread = tree.radius[nodes][:, None] * norm[active][None, :] * (1 + SLACK) + SLACK * np.abs(score)
        best = np.minimum(score + spread, high[active])
        may = (best >= q.floor[rows[active]]) & (score - spread <= high[active])
        for j in np.flatnonzero(may.any(axis=1)):
            heapq.heappush(waiting, (-float(best[j][may[j]].max()), int(nodes[j]), active[may[j]], best[j][may[j]]))

    def verify(at: np.ndarray, active: np.ndarray) -> None:
        score = points[at] @ queries[active].T
        same = labels[at][:, None] == label[active][None, :]
        ok = (same == q.same) & (score >= q.floor[rows[active]]) & (score <= high[active])
        p, k = np.nonzero(ok)
        if len(p):
            take(rows[active[k]], at[p], score[p, k])

    wait(np.array([0]), np.arange(len(rows)))
    while waiting:
        _, node, active, best = heapq.heappop(waiting)
        active = active[best >= q.floor[rows[active]]]
        if not len(active):
            continue
        if tree.first[node] == tree.last[node]:
            verify(np.arange(tree.start[node], tree.end[node]), active)
            continue
        below = np.arange(tree.first[node], tree.last[node])
        single = tree.end[below] - tree.start[below] == 1
        if single.any():
            verify(tree.start[below[single]], active)
        if not single.all():
            wait(below[~single], active)


class Queries:
    """Queries of a round: vectors, labels, own row, window top and bottom, and the best candidates so far of each."""

    def __init__(self, table: pa.Table, same: bool, k: int) -> None:
        t = table.combine_chunks()
        self.ask, self.row, self.label = (t.column(c).to_numpy() for c in ("ask", "row", "label"))
        self.x = matrix(t.column("vec").combine_chunks())
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.wide = self.norm >= WIDE
        self.same, self.k = same, k
        n = len(self.ask)
        if same:
            self.low, self.top = np.full(n, -LONG_MAX), np.full(n, LONG_MAX)
            self.floor, self.high = np.full(n, -np.inf), np.full(n, np.inf)
        else:
            self.top = t.column("high").to_numpy()
            # 80 p <= 100 s, that is s >= 4 p / 5 rounded up; p is not negative
            self.low = self.top - self.top // 5
            self.floor, self.high = self.low.astype(float), self.top.astype(float)
        self.best: list[list[tuple]] = [[] for _ in self.ask]

    def offer(self, i: int, entry: tuple) -> None:
        """``entry``: (score, has an id, -id, row); the k best stay."""
        heap = self.best[i]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.floor[i] = max(self.floor[i], float(heap[0][0]))

    def batch(self) -> pa.RecordBatch:
        flat = [(int(a), e[3], -e[2] if e[1] else None, e[0]) for a, heap in zip(self.ask, self.best) for e in heap]
        cols = list(zip(*flat)) if flat else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["ask", "found", "vec_id", "score"])


def candidates(embeddings: DataFrame, shift: int, classes: int) -> DataFrame:
    """row (a key of its own for every row), vec_id, label (changed where vec_id is divisible by ``shift``), vec."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    changed = F.when(vec_id % shift == 0, (label + 1) % classes).otherwise(label)
    rows = (embeddings.select(vec_id.alias("vec_id"), changed.alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
            .where(F.col("label").isNotNull() & usable(F.col("vec"))))
    return C.materialise(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")


TREE = pa.schema([("row", pa.binary()), ("vec_id", pa.binary()), ("known", pa.binary()), ("label", pa.binary()), ("x", pa.binary()),
                  ("dims", pa.int32()), ("wide", pa.bool_()), *[(f, pa.binary()) for f in CoverTree.FIELDS[1:]]])
TREE_SQL = "row binary, vec_id binary, known binary, label binary, x binary, dims int, wide boolean, " + ", ".join(f"{f} binary" for f in CoverTree.FIELDS[1:])


def plant(rows: DataFrame) -> DataFrame:
    """One row a tree (or a block of wide vectors, which has no nodes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                cut = b.slice(lo, BLOCK)
                row, label = cut.column(0).to_numpy(), cut.column(2).to_numpy()
                known = pc.is_valid(cut.column(1)).to_numpy(zero_copy_only=False)
                vec_id = pc.fill_null(cut.column(1), 0).to_numpy()
                x = matrix(cut.column(3))
                large = ~((x * x).sum(axis=1) < WIDE * WIDE)
                out = []
                for wide in (False, True):
                    at = np.flatnonzero(large == wide)
                    if not len(at):
                        continue
                    tree = None if wide else CoverTree(x[at])
                    at = at if wide else at[tree.order]
                    out.append({"row": row[at].tobytes(), "vec_id": vec_id[at].tobytes(), "known": known[at].tobytes(), "label": label[at].tobytes(),
                                "x": x[at].tobytes(), "dims": x.shape[1], "wide": wide,
                                **{f: b"" if wide else getattr(tree, f).tobytes() for f in CoverTree.FIELDS[1:]}})
                yield pa.RecordBatch.from_pylist(out, schema=TREE)
    return rows.select("row", "vec_id", "label", "vec").mapInArrow(run, TREE_SQL)


def ask_trees(trees: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """ask, found (row), vec_id, score: each ask's ``k`` best in every task, in broadcast rounds over ``asks``."""
    spark = trees.sparkSession
    size = asks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).first()
    rounds = max(1, -(-size.n * max(1, size.d) // ROUND_VALUES))
    out = None
    for r in range(rounds):
        table = asks.where(F.pmod(F.xxhash64("ask", F.lit(3)), F.lit(rounds)) == r).orderBy("label", "ask").toArrow()
        if not table.num_rows:
            continue
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = Queries(shared.value, same, k)
            narrow = np.flatnonzero(~q.wide)
            for b in batches:
                for t in b.to_pylist():
                    offer_tree(t, q, narrow)
            yield q.batch()

        with arrow_rows(spark, 8):  # a row holds a tree
            got = C.materialise(trees.mapInArrow(C.lean(run), "ask long, found long, vec_id long, score long"), "negatives-part")
        out = got if out is None else out.unionAll(got)
    return out if out is not None else spark.createDataFrame([], "ask long, found long, vec_id long, score long")


def offer_tree(t: dict, q: Queries, narrow: np.ndarray) -> None:
    """Offers the points of a tree to the queries."""
    row, vec_id, label = (np.frombuffer(t[c], np.int64) for c in ("row", "vec_id", "label"))
    known = np.frombuffer(t["known"], bool)
    x = np.frombuffer(t["x"], float).reshape(len(row), t["dims"])

    def take(asks: np.ndarray, points: np.ndarray, scores: np.ndarray) -> None:
        # of the points offered at once, only a query's k best (and its own row) can stay
        order = np.lexsort((vec_id[points], ~known[points], -scores, asks))
        asks, points, scores = asks[order], points[order], scores[order]
        nth = np.arange(len(asks)) - np.searchsorted(asks, asks)
        few = nth <= q.k
        for a, p, s in zip(asks[few].tolist(), points[few].tolist(), scores[few].tolist()):
            if q.row[a] != row[p] and s >= q.floor[a]:
                q.offer(a, (int(s), bool(known[p]), -int(vec_id[p]), int(row[p])))

    if not t["wide"]:
        tree = CoverTree.__new__(CoverTree)
        for f in CoverTree.FIELDS[1:]:
            setattr(tree, f, np.frombuffer(t[f], float if f == "radius" else np.int64))
        for lo in range(0, len(narrow), BATCH):
            descend(tree, x, label, q, narrow[lo:lo + BATCH], take)
    for a in np.arange(len(q.ask)) if t["wide"] else np.flatnonzero(q.wide):
        score = exact_wide(x, q.x[a:a + 1])[:, 0]
        ok = ((label == q.label[a]) == q.same) & (score >= q.low[a])
        ok &= score <= q.top[a]
        for p in np.flatnonzero(ok):
            if q.row[a] != row[p]:
                q.offer(int(a), (int(score[p]), bool(known[p]), -int(vec_id[p]), int(row[p])))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, shift: int = 7, classes: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. The score of
    a row is its integer inner product with the anchor, floor(256 * x) by
    component; higher first, ties to the smaller vec_id, null ids last. An
    anchor's positives are its first ``positives`` other rows of its label; a
    positive's negatives the first ``negatives`` rows of other labels from
    80 % of its score to its score (none, if it is negative). A positive
    without negatives has no rows.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part. Rows with a null vec_id are candidates, never anchors. Every
    row counts, also one that repeats another: the anchor itself is left out
    by row, so its copies are other rows, and an anchor that stands there
    twice is mined twice. A shorter vector counts as filled up with zeros;
    scores beyond a long are held at its ends. Empty tables give no rows.
    """
    rows = candidates(embeddings, shift, classes)
    trees = C.materialise(plant(rows), "negatives-trees")
    anchors = rows.where(F.col("vec_id") % every == 0)
    asks = anchors.select(F.col("row").alias("ask"), "row", "label", "vec")
    found = ask_trees(trees, asks, True, positives)
    pairs = C.materialise(_ranked(found, positives).select(F.col("ask").alias("anchor"), F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                                                           F.col("score").alias("positive_score")), "negatives-pairs")
    windows = C.materialise(pairs.select("anchor", "positive_score").distinct()
                            .select(F.monotonically_increasing_id().alias("ask"), "*"), "negatives-windows")
    asks = (windows.where("positive_score >= 0").withColumnRenamed("positive_score", "high")
            .join(anchors.select("row", "label", "vec"), F.col("anchor") == F.col("row")).select("ask", "row", "label", "vec", "high"))
    asks = C.materialise(asks, "negatives-asks")
    best = (_ranked(ask_trees(trees, asks, False, negatives), negatives)
            .select("ask", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    return (best.join(windows, "ask").join(pairs, ["anchor", "positive_score"])
            .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
