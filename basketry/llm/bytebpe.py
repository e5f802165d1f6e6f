"""Byte-level BPE with a segment tree over the byte positions of each piece.

A piece is one match of the pretoken pattern. The leaf of byte position p
holds the rank of the pair of live tokens that starts there, together with p,
so that the root is the leftmost pair of the lowest rank. A merge joins that
pair, unlinks the right token and renews three leaves (the merged position,
its live neighbour on the left, the position that is gone), each by a walk to
the root. The work on a piece of n bytes is O(n log n).

Many short pieces are merged side by side: the trees of all pieces of one
size lie in one array, and a step takes the root of each. Where only a few
pieces share a size (long ones), they are merged one by one.

The ranks come from a public file whose path is a parameter; the driver reads
it and broadcasts arrays whose size the file fixes.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Bytes of text that share a step of merging, and of ids in a batch that is returned.
PART_BYTES = 16 << 20
#: Pieces a task remembers; beyond it the memory starts anew (results do not change).
REMEMBERED = 400_000
#: Pieces of one tree size from which on their trees are worked side by side.
SIDE_BY_SIDE = 32
#: Low bits of a leaf: the position. A leaf without a mergeable pair.
SHIFT, NONE = 32, np.iinfo(np.int64).max


class Ranks:
    """Ranks of a file of base64 tokens and numbers; a token's rank is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.id = {base64.b64decode(t): int(r) for t, r in rows}
        missing = [b for b in range(256) if bytes([b]) not in self.id]
        if missing:
            raise ValueError(f"the file lacks the bytes {missing}")
        self.byte_id = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        key, made = [], []
        for token, rank in self.id.items():
            for cut in range(1, len(token)):
                a, b = self.id.get(token[:cut]), self.id.get(token[cut:])
                if a is not None and b is not None:
                    key.append(a << SHIFT | b)
                    made.append(rank)
        order = np.argsort(np.array(key, np.int64))
        self.key, self.made = np.array(key, np.int64)[order], np.array(made, np.int64)[order]
        token = [b""] * (max(self.id.values()) + 1)
        for t, r in self.id.items():
            token[r] = t
        self.token = Strings(token)
        self.decimal = Strings([b"%d," % i for i in range(len(token))])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 if none."""
        if not len(self.key):
            return np.full(len(a), -1)
        pair = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.made[at], -1)

    def pairs(self) -> dict[int, int]:
        """The same as a map, for pieces merged one by one (built on first use)."""
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.key.tolist(), self.made.tolist()))
        return self._pairs


class Strings:
    """Byte strings end to end."""

    def __init__(self, items: list[bytes]) -> None:
        self.len = np.array([len(t) for t in items], np.int64)
        self.at = np.cumsum(self.len) - self.len
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of ``ids``, end to end."""
        return gather(self.flat, self.at[ids], self.len[ids]).tobytes()


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + lens[i]] for all i, end to end."""
    total = int(lens.sum())
    return flat[np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(total)]


def tree_size(n: int) -> int:
    """Leaves of the tree of a piece of n bytes: a power of two, a leaf a pair."""
    return 1 << max(0, (n - 2).bit_length())


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece."""
    pairs, n = ranks.pairs(), len(piece)
    sym = ranks.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    size = tree_size(n)
    none = int(NONE)
    leaves = [none] * size
    for p in range(n - 1):
        r = pairs.get(sym[p] << SHIFT | sym[p + 1])
        if r is not None:
            leaves[p] = r << SHIFT | p
    tree = [none] * size + leaves
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def renew(p: int) -> None:
        r = pairs.get(sym[p] << SHIFT | sym[nxt[p]]) if nxt[p] < n else None
        put(p, none if r is None else r << SHIFT | p)

    def put(p: int, value: int) -> None:
        i = size + p
        tree[i] = value
        while i > 1:
            least = min(tree[i], tree[i ^ 1])
            i >>= 1
            if tree[i] == least:
                break
            tree[i] = least

    while tree[1] != none:
        p, rank = tree[1] & 0xFFFFFFFF, tree[1] >> SHIFT
        gone = nxt[p]
        sym[p], nxt[p] = rank, nxt[gone]
        if nxt[p] < n:
            prv[nxt[p]] = p
        if gone < n - 1:
            put(gone, none)
        renew_at = prv[p]
        if p < n - 1:
            renew(p)
        if renew_at >= 0:
            renew(renew_at)
    out, p = [], 0
    while p < n:
        out.append(sym[p])
        p = nxt[p]
    return out


def merge_many(pieces: list[bytes], size: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces whose trees have ``size`` leaves, end to end, and how many each has."""
    m, width = len(pieces), size + 1
    lens = np.fromiter(map(len, pieces), np.int64, m)
    # position p of piece c is cell c * width + p of the flat arrays; its leaf is cell 2 * size * c + size + p of the trees
    row, base = np.arange(m) * width, np.arange(m) * 2 * size
    pos = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    cell = np.repeat(row, lens) + pos
    sym = np.zeros(m * width, np.int64)
    sym[cell] = ranks.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
    nxt = np.tile(np.arange(1, width + 1), m)
    prv = np.tile(np.arange(-1, width - 1), m)
    alive = np.zeros(m * width, bool)
    alive[cell] = True
    tree = np.full(m * 2 * size, NONE)
    first = pos < np.repeat(lens, lens) - 1
    r = ranks.ranks(sym[cell[first]], sym[cell[first] + 1])
    tree[np.repeat(base + size, lens)[first] + pos[first]] = np.where(r >= 0, r << SHIFT | pos[first], NONE)
    whole = tree.reshape(m, 2 * size)
    level = size
    while level > 1:
        level >>= 1
        whole[:, level:2 * level] = np.minimum(whole[:, 2 * level:4 * level:2], whole[:, 2 * level + 1:4 * level:2])

    def put(c: np.ndarray, p: np.ndarray, value: np.ndarray) -> None:
        i, at = size + p, base[c]
        tree[at + i] = value
        for _ in range(size.bit_length() - 1):
            here = at + i
            value = np.minimum(value, tree[here ^ 1])
            i >>= 1
            tree[at + i] = value

    def renew(c: np.ndarray, p: np.ndarray) -> None:
        here, top = row[c] + p, lens[c]
        after = nxt[here]
        r = ranks.ranks(sym[here], sym[row[c] + np.minimum(after, top - 1)])
        put(c, p, np.where((after >= top) | (r < 0), NONE, r << SHIFT | p))

    c = np.flatnonzero(whole[:, 1] != NONE)
    while len(c):
        root = whole[c, 1]
        p = root & 0xFFFFFFFF
        here = row[c] + p
        gone = nxt[here]
        after = nxt[row[c] + gone]
        sym[here], nxt[here] = root >> SHIFT, after
        alive[row[c] + gone] = False
        inner = after < lens[c]
        prv[row[c[inner]] + after[inner]] = p[inner]
        has_leaf = gone < size
        put(c[has_leaf], gone[has_leaf], np.full(int(has_leaf.sum()), NONE))
        left = prv[here]
        has_left = left >= 0
        renew(c, p)
        renew(c[has_left], left[has_left])
        c = c[whole[c, 1] != NONE]
    return sym[alive], alive.reshape(m, width).sum(axis=1)


def merge_pieces(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Ids of each piece; a piece that is itself a token is that token."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    sizes: dict[int, list[int]] = defaultdict(list)
    for i, raw in enumerate(pieces):
        whole = ranks.id.get(raw)
        if whole is not None:
            out[i] = np.array([whole], np.int32)
        else:
            sizes[tree_size(len(raw))].append(i)
    for size, members in sizes.items():
        if len(members) < SIDE_BY_SIDE:
            for i in members:
                out[i] = np.array(merge_one(pieces[i], ranks), np.int32)
            continue
        step = max(SIDE_BY_SIDE, PART_BYTES // (64 * size))
        for lo in range(0, len(members), step):
            some = members[lo:lo + step]
            ids, count = merge_many([pieces[i] for i in some], size, ranks)
            for i, x in zip(some, np.split(ids.astype(np.int32), np.cumsum(count)[:-1])):
                out[i] = x
    return out


class Encoder:
    """Encodes whole texts; remembers the ids of the pieces it has met."""

    def __init__(self, ranks: Ranks, pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).finditer
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.flat = np.empty(0, np.int32)
        self.at = self.len = np.empty(0, np.int64)

    def _learn(self) -> None:
        """Merge the pieces that are new since the last call."""
        new = [p.encode() for p in islice(self.seen, len(self.at), None)]
        if new:
            ids = merge_pieces(new, self.ranks)
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
            self.len = np.concatenate([self.len, lens])
            self.flat = np.concatenate([self.flat, *ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.seen) > REMEMBERED:
            self.forget()
        number = self.seen.__getitem__
        docs = [np.fromiter(map(number, map(itemgetter(0), self.find(t))), np.int32) for t in texts]
        self._learn()
        return [gather(self.flat, self.at[d], self.len[d]) for d in docs]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.ranks.token.join(ids)


def parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of about ``PART_BYTES`` of text (a longer text alone), with the first row's number; null is empty."""
    start, texts, held = 0, [], 0
    for i, v in enumerate(column):
        text = v.as_py() or ""
        if texts and held + len(text) > PART_BYTES:
            yield start, texts
            start, texts, held = i, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield start, texts


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and the digests of the ids and of what they decode to.

    Each match of ``pattern`` is encoded by itself; special tokens are not
    known. Returns the ``keep`` columns, n_tokens long, ids_sha256 (of the
    decimal ids joined by commas), decoded_sha256 (of the decoded bytes) and,
    with ``ids``, the ids themselves (array<int>). A null or empty text has no
    ids. One output row for each input row, repeated rows and null ids too; an
    empty table gives none. No text is cut, and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Ranks(path))
    n = len(keep)
    source = docs.select(*keep, F.col("text").cast("string").alias("__bpe_text"))
    empty = source.drop("__bpe_text").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("ids", "array<int>"))[:3 + ids]])
    names = empty.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value, pattern)
        for b in batches:
            for start, texts in parts(b.column(n)):
                found = enc.encode(texts)
                cols = [pa.array([len(x) for x in found], pa.int64()),
                        pa.array([hashlib.sha256(enc.ranks.decimal.join(x)[:-1]).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in found], pa.string())]
                if ids:
                    at = np.cumsum([0, *map(len, found)])
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(found), pa.int32())))
                yield pa.RecordBatch.from_arrays([*b.slice(start, len(texts)).columns[:n], *cols], names=names)

    return source.mapInArrow(C.lean(run), empty.schema)
