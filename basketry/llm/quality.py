"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents; the unlabelled side is web
text of unknown quality. The class prior is estimated from the two samples,
and a small network minimises the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``.
The fit uses bounded samples drawn by hash (``FIT_ROWS``); every document is
scored, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Expected size of each of the two samples of the fit.
FIT_ROWS = 20_000
THRESHOLD = 0.7
HIDDEN, STEPS, BATCH, RATE, DECAY = 16, 1200, 1024, 0.01, 1e-3

FEATURES = ("bytes", "words", "bytes_a_word", "upper", "digits", "stops", "commas", "quotes", "marks", "bars",
            "newlines", "high", "distinct_words", "repeats", "distinct_lines", "capital_words", "short_words", "word_end_marks")


def _group(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_GROUPS = np.stack([
    _group(bytes(range(65, 91))), _group(b"0123456789"), _group(b".!?"), _group(b",;:"), _group(b"'\"`"),
    _group(b"#$%&*@^~_=+<>{}[]\\/"), _group(b"|"), _group(b"\n\r"), _group(bytes(range(128, 256)))], axis=1)
_MARKS = tuple("#$%&*@^~_=+<>|!")


def features(text: str | None) -> np.ndarray:
    """Measures of the whole text; all zero for a null or empty one."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    n, w = len(raw), len(words)
    lines = raw.split(b"\n")
    out[0], out[1], out[2] = np.log1p(n), np.log1p(w), n / w
    out[3:12] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUPS / n
    out[12] = len(set(words)) / w
    out[13] = sum(map(eq, words, words[1:])) / w
    out[14] = len(set(lines)) / len(lines)
    out[15] = sum(map(bytes.isupper, words)) / w
    lens = list(map(len, words))
    out[16] = sum(x <= 3 for x in lens) / w
    ends = np.bincount(np.frombuffer(b"".join([x[-1:] for x in words]), np.uint8), minlength=256)
    out[17] = ends[[ord(c) for c in _MARKS]].sum() / w
    return out


class Network:
    """Standardised features, one tanh layer, one logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator) -> None:
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.slope = 1.0

    def layer(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.layer(x)[2], -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _descend(net: Network, p: np.ndarray, u: np.ndarray, slopes, steps: int, rng: np.random.Generator) -> None:
    """Adam over batches of BATCH rows of each side; ``slopes(logits, rows of p)`` gives dRisk/dlogit."""
    m = [np.zeros_like(v) for v in net.p]
    s = [np.zeros_like(v) for v in net.p]
    for t in range(1, steps + 1):
        a, b = (v if len(v) <= BATCH else v[rng.integers(0, len(v), BATCH)] for v in (p, u))
        z, h, g = net.layer(np.concatenate([a, b]))
        dg = slopes(g, len(a))
        dh = np.outer(dg, net.p[2]) * (1 - h * h)
        grads = [z.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()])]
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, grad in enumerate(grads):
            grad = grad + DECAY * net.p[i]
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad * grad
            net.p[i] = net.p[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled sample, from scores of a positive-against-unlabelled model.

    Above a score that negatives do not reach, the unlabelled tail is the prior
    times the positive tail; the smallest ratio of the tails, with a bound on
    its sampling error, estimates the prior (best-bin estimation).
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.95, 200)))
    tail_p = 1 - np.searchsorted(p, cuts) / len(p)
    tail_u = 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(20) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((tail_u + slack) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> tuple[Network, float]:
    """The network of least non-negative risk and the estimated class prior.

    Without positives, or without unlabelled rows, every score is 0.5.
    """
    rng = np.random.default_rng(seed)
    d = len(FEATURES)
    both = np.concatenate([positive.reshape(-1, d), unlabelled.reshape(-1, d)])
    if not len(positive) or not len(unlabelled):
        net = Network(np.zeros(d), np.ones(d), rng)
        net.slope = 0.0
        return net, 0.5
    mean, scale = both.mean(0), both.std(0) + 1e-6
    # 1. positives against unlabelled, for the prior; one half fits, the other measures
    guess = Network(mean, scale, rng)

    def apart(g: np.ndarray, k: int) -> np.ndarray:
        dg = _sigmoid(g)
        dg[:k] -= 1
        dg[:k] /= k
        dg[k:] /= len(g) - k
        return dg

    _descend(guess, positive[::2], unlabelled[::2], apart, STEPS // 3, rng)
    prior = estimate_prior(guess.score(positive[1::2]), guess.score(unlabelled[1::2]))
    # 2. non-negative risk with the logistic loss: l+(g) = log(1 + e^-g), l-(g) = log(1 + e^g)
    net = Network(mean, scale, rng)

    def risk(g: np.ndarray, k: int) -> np.ndarray:
        sg, soft, n = _sigmoid(g), np.logaddexp(0, g), len(g) - k
        dg = np.empty_like(g)
        if soft[k:].mean() >= prior * soft[:k].mean():
            dg[:k] = -prior / k  # of prior * (l+ - l-)
            dg[k:] = sg[k:] / n
        else:  # the negative part went below zero: step back along it alone
            dg[:k] = prior / k * sg[:k]
            dg[k:] = -sg[k:] / n
        return dg

    _descend(net, positive, unlabelled, risk, STEPS, rng)
    return net, prior


def held_out(column: str = "doc_id"):
    """True for the fold whose labels are never learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fraction(rows: int) -> int:
    """Of 2^20 hash values, how many keep about FIT_ROWS of so many rows."""
    return (1 << 20) if rows <= FIT_ROWS else max(1, FIT_ROWS * (1 << 20) // rows)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Network, float]:
    """Fit on hash samples of the labelled good documents and of all documents, both outside the held-out fold.

    Labels that are null, or that contradict each other for a doc_id, teach
    nothing. Each sample is drawn by row and has about FIT_ROWS rows, however
    often a doc_id repeats; the label side is that small (a few hundred KB), so
    it is broadcast.
    """
    def drawn(salt: int, rows: int, *by: Column) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id"), *by, F.lit(salt)), F.lit(1 << 20)) < _fraction(rows)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
            .where((F.col("low") == 1) & (F.col("high") == 1) & ~held_out()).select("doc_id"))
    good = good.where(drawn(1, good.count())).withColumn("good", F.lit(True))
    n = ids.count()
    taught = ids.select("doc_id").join(F.broadcast(good), "doc_id").count()  # rows of the drawn labels
    row = F.monotonically_increasing_id()
    rows = (ids.withColumn("row", row).where(~held_out() & F.col("doc_id").isNotNull()).join(F.broadcast(good), "doc_id", "left")
            .withColumn("good", F.coalesce("good", F.lit(False)) & drawn(3, taught, F.col("row"))).withColumn("web", drawn(2, n, F.col("row")))
            .where("good or web").select("doc_id", "good", "web", "text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v.tolist() for v in x], pa.list_(pa.float64()))],
                                             names=["doc_id", "good", "web", "x"])

    got = rows.mapInArrow(C.lean(measure), "doc_id long, good boolean, web boolean, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))  # the fit does not depend on the order of tasks
    got, x = got.iloc[order], x[order]
    return fit(x[got["good"].to_numpy(bool)], x[got["web"].to_numpy(bool)])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts get the score of an all-zero feature row; repeated
    rows repeat; an empty table gives an empty one.
    """
    net, _ = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.score(np.array([features(t.as_py()) for t in b.column(2)]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string"))
            .mapInArrow(C.lean(run), "doc_id long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns as they were.

    Null and empty texts are judged like any other; an empty table gives an empty one.
    """
    net, _ = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = net.score(np.array([features(t.as_py()) for t in b.column(at)]).reshape(-1, len(FEATURES)))
            yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(C.lean(run), docs.schema)
