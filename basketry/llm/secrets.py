"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The base patterns label the corpus: the values they find are samples of
random strings, all other token characters are samples of ordinary text and
identifiers. Character pairs of both kinds are counted over every document,
in one pass with one small table per task; a stretch of a token that no pattern
found is a secret if the model of random strings explains it better by a margin.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Fixed patterns. ASCII letters of the key names in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_NAMES = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")
#: Shortest string that the models compare: as short as the shortest assigned value.
LEAST = 8
#: Runs of token characters; every access and hex match lies inside one.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Letters of the models; every other byte ends a token.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: What lies between separators in a run.
PIECE = re.compile(rb"[A-Za-z0-9]+")
LETTERS, SEPARATORS = len(ALPHABET), 62
APART = -1e4
CODE = np.full(256, LETTERS, np.int64)
CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(LETTERS)
#: A stretch is a secret if its ratio is above so many nats, and above so many for each of its pairs.
MARGIN, MARGIN_A_PAIR = 12.0, 0.5

Span = tuple[int, int, int]


def runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def base_spans(text: str, found: list[tuple[int, int]]) -> tuple[list[Span], list[tuple[int, int]]]:
    """(start, kind, end) of the base matches, and the spans of their secret values."""
    spans: list[Span] = []
    values: list[tuple[int, int]] = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(k in low for k in KEY_NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 8:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    for s, e in found:
        if e - s < 16:  # shorter than any access or hex match
            continue
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(text, s, e):
                spans.append((m.start(), kind, m.end()))
                values.append(m.span())
    return sorted(spans), values


def pair_counts(text: str) -> np.ndarray:
    """Counts of neighbouring letters of the models, as a flat LETTERS x LETTERS table."""
    c = CODE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    both = (c[:-1] < LETTERS) & (c[1:] < LETTERS)
    return np.bincount(c[:-1][both] * LETTERS + c[1:][both], minlength=LETTERS * LETTERS)


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each letter pair, random against ordinary, learned from all documents.

    Pairs with a separator tell nothing, pairs with the space between runs end any stretch.

    One row for each task and pair that occurs reaches the shuffle, and at most
    2 * 67 * 67 sums reach the driver. One is added to every count, so a corpus
    without a match gives a uniform random model.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, LETTERS * LETTERS), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                texts = [t for t in b.column(0).slice(lo, 256).to_pylist() if t]
                for t in texts:
                    found = runs(t)
                    secret = np.zeros(LETTERS * LETTERS, np.int64)
                    for s, e in set(base_spans(t, found)[1]):
                        secret += pair_counts(t[s:e])
                    total[0] += secret
                    total[1] -= secret
                total[1] += pair_counts("\n".join(texts))
        kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)),
                                          pa.array(total[kind, pair])], names=["kind", "pair", "n"])

    rows = (docs.select(F.col("text").cast("string")).mapInArrow(C.lean(count), "kind int, pair int, n long")
            .groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect())
    table = np.ones((2, LETTERS * LETTERS))
    for r in rows:
        table[r["kind"], r["pair"]] += max(0, r["n"])
    table = table.reshape(2, LETTERS, LETTERS)
    table /= table.sum(axis=2, keepdims=True)
    # half of the random strings are taken to come from alphabets that the samples do not show
    ratio = np.log((table[0] + 1 / LETTERS) / 2) - np.log(table[1])
    ratio[SEPARATORS:] = ratio[:, SEPARATORS:] = 0.0
    return np.pad(ratio, (0, 1), constant_values=APART)


def left_over(found: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    """What base matches leave of the runs, in stretches of LEAST characters and more."""
    if not base:
        return found
    out = []
    base = sorted(base)
    k = 0
    for s, e in found:
        while k < len(base) and base[k][2] <= s:
            k += 1
        for i in range(k, len(base)):
            x, _, y = base[i]
            if x >= e:
                break
            if x - s >= LEAST:
                out.append((s, x))
            s = max(s, y)
        if e - s >= LEAST:
            out.append((s, e))
    return out


def random_stretches(scores: list[float]) -> list[tuple[int, int]]:
    """Disjoint stretches [i, j) that maximise the sum of their scores less MARGIN for each stretch.

    This is the best path through two states, ordinary and random, where entering
    the random one costs MARGIN; one pass. A start is given up when its sum is
    no longer above 0, and a stretch ends at its highest sum once a fall from
    there costs more than a new start.
    """
    out = []
    start, total, end, best = 0, 0.0, 0, 0.0
    for i, x in enumerate(scores):
        total += x
        if total > best:
            end, best = i + 1, total
        if total <= 0 or total < best - MARGIN:
            if best > MARGIN:
                out.append((start, end))
            start, total, end, best = i + 1, 0.0, i + 1, 0.0
    if best > MARGIN:
        out.append((start, end))
    return out


def run_units(letters: bytes, pairs: np.ndarray) -> list[tuple[int, int, float]]:
    """A run in units (start, end, score): its pieces between separators, which score nothing themselves.

    A piece above MARGIN_A_PAIR as a whole is one unit and scores its ratio, so
    that a span begins and ends where a piece does. Any other is cut around the
    stretches that are random by themselves, if it has any; a rest of fewer than
    LEAST letters at an end of the piece goes with them, as a random string may
    end in a common pair. What is left scores what it lacks of MARGIN_A_PAIR.
    """
    units = []
    for m in PIECE.finditer(letters):
        s, e = m.span()
        over = pairs[s:e - 1] - MARGIN_A_PAIR
        if float(over.sum()) > 0:
            units.append((s, e, float(pairs[s:e - 1].sum())))
            continue
        last = 0
        for i, j in random_stretches(over.tolist()):
            score = float(pairs[s + i:s + j].sum())
            # pairs i to j - 1 are the letters i to j
            x, y = (0 if i < LEAST else i), (e - s if e - s - j - 1 < LEAST else j + 1)
            if last < x:
                units.append((s + last, s + x, float(over[last:x].sum())))
            units.append((s + max(x, last), s + y, score))
            last = y
        if s + last < e:
            units.append((s + last, e, float(over[last:].sum())))
    return units


def markov_spans(text: str, found: list[tuple[int, int]], base: list[Span], ratio: np.ndarray) -> list[Span]:
    """Random stretches of the runs outside base matches, by the margins of their log-likelihood ratio."""
    rest = left_over(found, base)
    if not rest:
        return []
    joined = " ".join([text[s:e] for s, e in rest]).encode()
    c = CODE[np.frombuffer(joined, np.uint8)]
    pairs = ratio[c[:-1], c[1:]]
    at = np.zeros(len(rest), np.int64)
    np.cumsum([e - s + 1 for s, e in rest[:-1]], out=at[1:])
    # the highest sum of neighbouring pairs that ends at each pair, or more; what has none above MARGIN has no span
    total = np.concatenate([[0.0], np.cumsum(pairs)])
    highest = np.maximum.reduceat((total - np.minimum.accumulate(total))[1:], at)
    out = []
    for k in np.flatnonzero(highest > MARGIN):
        s, e = rest[k]
        lo = int(at[k])
        letters = joined[lo:lo + e - s]
        units = run_units(letters, pairs[lo:lo + e - s - 1])
        for i, j in random_stretches([u[2] for u in units]):
            x, y = units[i][0], units[j - 1][1]
            score = sum(u[2] for u in units[i:j])
            if y - x >= LEAST and score > MARGIN_A_PAIR * (y - x - 1):
                # separators at an end of the run, such as padding, go with the span beside them
                x = 0 if x == units[0][0] else x
                y = len(letters) if y == units[-1][1] else y
                out.append((s + x, 3, s + y))
    return out


def scan(text: str | None, ratio: np.ndarray) -> tuple[list[Span], list[Span]]:
    """All base spans and all added spans of a text."""
    text = text or ""
    found = runs(text)
    base, _ = base_spans(text, found)
    return base, markov_spans(text, found, base, ratio)


def written(spans: list[Span]) -> str:
    """kind:start:end, by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts and spans (code points, end exclusive).

    Null texts count as empty: no span, and base_sha256 is that of the empty
    string. Texts are scanned whole. Repeated rows repeat; an empty table gives
    an empty one.
    """
    ratio = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[list[int]] = [[], [], []]
            sha, spans, extra = [], [], []
            for t in b.column(1):
                base, more = scan(t.as_py(), ratio)
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + more))
                extra.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (*n, extra)), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(C.lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def blank(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, last = [], 0
    for s, _, e in sorted(spans):
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; other columns, null texts and rows stay."""
    ratio = train(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base, more = scan(t, ratio)
                    t = blank(t, base + more, mark) if base or more else t
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, b.column(at).type) if i == at else c
                                              for i, c in enumerate(b.columns)], schema=b.schema)

    out = docs.mapInArrow(C.lean(run), docs.schema)
    if "n_chars" in docs.columns:  # where it was the text's length it still is
        return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
