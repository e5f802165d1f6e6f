"""BPE encoding and decoding with a pair occurrence index.

All distinct pretokens of a part of the data lie in one symbol sequence. The
index maps each mergeable pair, by its rank, to all its positions there.
Active ranks leave a heap in ascending order; a rank is applied to all its
positions at once, and only the pairs beside a merged position enter lists
anew. Every word sees its lowest rank first, as in word-by-word BPE.

The vocabulary comes from a public tokenizer file whose path is a parameter.
The driver reads it and broadcasts its arrays, whose size the file fixes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: The byte-level pretoken rule of the file (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are pretokenised before the index is built.
PART_BYTES = 32 << 20
#: Units a task remembers; beyond it the memory starts anew (results do not change).
REMEMBERED = 250_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in set(own) else next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks, token bytes and added tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if (spec["normalizer"] is not None or model["type"] != "BPE" or pre["type"] != "ByteLevel"
                or pre["add_prefix_space"] or model.get("ignore_merges")):
            raise ValueError("a plain byte-level BPE file is asked for")
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens with strip or word flags are not supported")
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # a pair listed twice keeps its last rank, as in a map
        last = {k: r for r, k in enumerate(key.tolist())}
        rank = np.array(sorted(last.values()), np.int64)
        order = rank[np.argsort(key[rank], kind="stable")]
        self.key, self.rank = key[order], order
        self.left, self.right, self.made = key >> 32, key & 0xFFFFFFFF, made
        self.added = {a["content"]: a["id"] for a in added}
        size = max([*vocab.values(), *self.added.values()]) + 1
        token = [b""] * size
        for t, i in [*vocab.items(), *self.added.items()]:
            token[i] = bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode()
        self.token_len = np.array([len(t) for t in token], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)

    def ranks(self, pair: np.ndarray) -> np.ndarray:
        """Rank of each pair key, -1 if it is no merge."""
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], -1)


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, end to end, and the number of ids of each (every word has a byte at least)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    sym = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    ends = np.cumsum(lens)
    nxt = np.arange(1, n + 1)
    nxt[ends - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[ends - lens] = -1
    alive = np.ones(n, bool)
    merged = np.zeros(n, bool)
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def enter(pos: np.ndarray) -> None:
        r = vocab.ranks(sym[pos] << 32 | sym[nxt[pos]])
        known = r >= 0
        if not known.any():
            return
        pos, r = pos[known], r[known]
        order = np.argsort(r, kind="stable")
        pos, r = pos[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        at = [0, *cuts.tolist(), len(r)]
        for s, e in zip(at, at[1:]):
            rank = int(r[s])
            if rank not in index:
                heapq.heappush(active, rank)
            index[rank].append(pos[s:e])

    enter(np.flatnonzero(nxt >= 0))
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        pos = lists[0]
        if len(lists) > 1:
            pos = np.sort(np.concatenate(lists))
            pos = pos[np.append(True, pos[1:] != pos[:-1])]
        a, b = vocab.left[rank], vocab.right[rank]
        pos = pos[alive[pos] & (sym[pos] == a) & (nxt[pos] >= 0)]
        pos = pos[sym[nxt[pos]] == b]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:  # of overlapping pairs every second one, from the left
            pos.sort()
            first = np.ones(len(pos), bool)
            first[1:] = nxt[pos[:-1]] != pos[1:]
            run = np.flatnonzero(first)
            pos = pos[(np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))) % 2 == 0]
        gone = nxt[pos]
        after = nxt[gone]
        sym[pos] = vocab.made[rank]
        alive[gone] = False
        nxt[pos] = after
        more = after >= 0
        prv[after[more]] = pos[more]
        before = prv[pos]
        before = before[before >= 0]
        # a merged neighbour on the left enters the pair itself, as its right one
        merged[pos] = True
        near = np.concatenate([before[~merged[before]], pos[more]])
        merged[pos] = False
        if len(near):
            enter(near)
    count = np.add.reduceat(alive, ends - lens, dtype=np.int64) if len(words) else np.empty(0, np.int64)
    return sym[alive], count


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + lens[i]] for all i, end to end."""
    total = int(lens.sum())
    return flat[np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(total)]


class Encoder:
    """Encodes whole texts part by part; remembers the ids of the text units it has met.

    A unit is a stretch between cuts that no pretoken straddles: a cut lies
    before a space whose two neighbours are no white space. Texts are first
    cut before every space; a unit that shows a wrong cut marks its texts, and
    they are cut again with care.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.find = regex.compile(PRETOKEN).findall
        words = sorted(vocab.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, words))) if words else None
        self.forget()

    def forget(self) -> None:
        self.seen: dict = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.flat = np.empty(0, np.int32)
        self.at = self.len = np.empty(0, np.int64)
        self.wrong_head = self.wrong_tail = np.empty(0, bool)
        # added tokens stand in the same table, under a key that no unit can have
        for t, i in self.vocab.added.items():
            self.seen[("added", t)]
            self._append(np.array([i]), np.array([1]), [False], [False])

    def _append(self, ids: np.ndarray, lens: np.ndarray, head: list[bool], tail: list[bool]) -> None:
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lens) - lens])
        self.len = np.concatenate([self.len, lens])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.wrong_head = np.concatenate([self.wrong_head, head])
        self.wrong_tail = np.concatenate([self.wrong_tail, tail])

    def _learn(self) -> None:
        """Encode the units that are new since the last call."""
        new = list(islice(self.seen, len(self.at), None))
        if not new:
            return
        head = [u[:1] == " " and (u == " " or u[1].isspace()) for u in new]
        tail = [u[-1:].isspace() for u in new]
        words: dict = defaultdict()
        words.default_factory = words.__len__
        find, number = self.find, words.__getitem__
        each = np.empty(len(new), np.int64)
        pre: list[int] = []
        for i, u in enumerate(new):
            found = find(u)
            each[i] = len(found)
            pre += map(number, found)
        ids, lens = merge_words([w.encode() for w in words], self.vocab)
        at = np.cumsum(lens) - lens
        pre = np.array(pre, np.int64)
        total = np.concatenate([[0], np.cumsum(lens[pre])])
        ends = np.cumsum(each)
        self._append(gather(ids, at[pre], lens[pre]), total[ends] - total[ends - each], head, tail)

    def _segments(self, text: str) -> Iterator[tuple[str, str | None]]:
        """Stretches without added tokens, each with the added token after it."""
        last = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[last:m.start()], m[0]
            last = m.end()
        yield text[last:], None

    def _fast(self, text: str) -> np.ndarray:
        units = text.replace(" ", "\0 ").split("\0")
        return np.fromiter(map(self.seen.__getitem__, units), np.int32, len(units))

    def _careful(self, text: str) -> np.ndarray:
        out = []
        for part, added in self._segments(text):
            start = 0
            for m in re.finditer(r"(?<=\S) (?=\S)", part):
                out.append(self.seen[part[start:m.start()]])
                start = m.start()
            if part:
                out.append(self.seen[part[start:]])
            if added is not None:
                out.append(self.seen[("added", added)])
        return np.array(out, np.int32)

    def _plain(self, text: str) -> bool:
        return "\0" not in text and not (self.special and self.special.search(text))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; null counts as empty."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < PART_BYTES):
                size += len(texts[hi] or "")
                hi += 1
            if len(self.seen) > REMEMBERED:
                self.forget()
            part = [t or "" for t in texts[lo:hi]]
            plain = [self._plain(t) for t in part]
            docs = [self._fast(t) if p else self._careful(t) for t, p in zip(part, plain)]
            self._learn()
            for i, u in enumerate(docs):
                if plain[i] and (self.wrong_head[u].any() or self.wrong_tail[u[:-1]].any()):
                    docs[i] = self._careful(part[i])
            self._learn()
            for u in docs:
                yield gather(self.flat, self.at[u], self.len[u])
            lo = hi

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, special tokens stay."""
        v = self.vocab
        raw = gather(v.token_bytes, v.token_at[ids], v.token_len[ids]).tobytes()
        return raw.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and what they decode to.

    Returns the ``keep`` columns, n_tokens long, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded
    text in UTF-8) and, with ``ids``, the ids themselves (array<int>). A null or
    empty text has no ids. One output row for each input row; repeated rows
    repeat. Texts are never cut: a long one is a part of its own. No shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Vocabulary(path))
    n = len(keep)
    source = docs.select(*keep, F.col("text").cast("string").alias("__bpe_text"))
    fields = [*source.schema.fields[:-1]]
    types = ", ".join(["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * ids)
    schema = F_struct(fields, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model.value)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                count, sha, back, out = [], [], [], []
                for x in enc.encode(part.column(n).to_pylist()):
                    raw = x.astype("<u4")
                    count.append(len(x))
                    sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
                    back.append(hashlib.sha256(enc.decode(x).encode()).hexdigest())
                    if ids:
                        out.append(x.astype(np.int32))
                cols = [pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                if ids:
                    at = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out) if out else [], pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return source.mapInArrow(C.lean(run), schema)


def F_struct(fields: list, more: str):
    """A schema of given fields followed by those of a DDL string."""
    from pyspark.sql import types as T
    return T.StructType([*fields, *T._parse_datatype_string(more).fields])
