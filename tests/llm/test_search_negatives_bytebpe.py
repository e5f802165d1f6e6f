"""Lexical search, hard negatives and byte-level BPE against brute force and the library."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from basketry.llm import bytebpe, lexical, negatives
from tests.conftest import SMALL
from tests.llm.test_vectors_pages_chat import usable

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def brute_search(docs, items, k):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = Counter()
    for item, terms in asked.items():
        scored = []
        for doc, w in words:
            tf, m = Counter(w), 10 + (90 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out.update((item, r + 1, None if e[1] else e[2], -e[0]) for r, e in enumerate(sorted(scored)[:k]))
    return out


ITEMS = "item_id long, text string, score string, doc_id string"


@pytest.fixture(scope="module")
def odd_items(spark, odd_docs):
    texts = [r.text for r in odd_docs.select("text").where("doc_id in (0, 3, 10, 63)").collect()]
    return spark.createDataFrame([(1, texts[0], "x", "y"), (2, texts[1].upper(), "x", "y"), (3, texts[2], "x", "y"), (4, "One two", "x", "y"), (5, "", "x", "y"), (6, None, "x", "y"),
                                  (7, "nowhere-to-be-found", "x", "y"), (None, texts[0], "x", "y"), (8, "ÀB ß", "x", "y"), (8, "three", "x", "y"), (1, texts[0], "x", "y"),
                                  (9, " ".join(t for t in texts if t) * 3, "x", "y")], ITEMS)


@pytest.mark.parametrize("postings", [200_000, 40])
def test_search_equals_brute_force(spark, odd_docs, odd_items, monkeypatch, postings):
    """One index, and items in several blocks; nulls, empty and very long texts, ties, repeated rows."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "ADDITIONS", 500)
    docs = odd_docs.repartition(7)
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in odd_items.collect()], 10)
    got = rows(lexical.search(docs, odd_items, 10))
    assert got == want and len(want) > 30


def test_search_of_empty_tables(spark, odd_docs, no_docs, odd_items):
    assert lexical.search(no_docs, odd_items).count() == 0
    assert lexical.search(odd_docs, odd_items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, " .,"), (2, None)], "doc_id long, text string")
    assert lexical.search(blank, odd_items).collect() == []


def test_heaps_keep_the_best():
    rnd = random.Random(3)
    heaps, seen = lexical.Heaps(3, 4), [[] for _ in range(3)]
    for _ in range(40):
        ids = [rnd.choice([None, *range(30)]) for _ in range(5)]
        scores = np.array([[rnd.randint(0, 6) for _ in range(3)] for _ in ids])
        heaps.offer(scores, ids)
        for r, i in np.argwhere(scores > 0).tolist():
            seen[i].append((-int(scores[r, i]), ids[r] is None, ids[r] or 0))
    for i in range(3):
        assert sorted((-s, not known, -d) for s, known, d in heaps.rows[i]) == sorted(seen[i])[:4]


def brute_negatives(table, every, n_pos, n_neg):
    kept = []
    for vec_id, vec, label in table:
        if label is None or not usable(vec):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * x) for x in vec]))
    hold = lambda s: max(-negatives.LONG_MAX, min(negatives.LONG_MAX, s))
    out = Counter()
    for a, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = sorted((-hold(sum(x * y for x, y in zip(q, v))), i is None, i or 0, lab) for b, (i, lab, v) in enumerate(kept) if b != a)
        for s, none, pos, _ in [e for e in scored if e[3] == label][:n_pos]:
            fit = [e for e in scored if e[3] != label and 80 * -s <= 100 * -e[0] <= 100 * -s][:n_neg]
            out.update((anchor, None if none else pos, r + 1, None if e[1] else e[2], -s, -e[0]) for r, e in enumerate(fit))
    return out


VECTORS = "vec_id long, embedding array<float>, label int, row string, score string"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 12)) + 1
    near = base[:60] + rng.normal(size=(60, 12)) * 0.05
    vec = [*base, *near, *base[:20], *([base[0]] * 60)]
    out = [(i, [float(x) for x in v], int(rng.integers(0, 4)) if i % 11 else -3, "a", "b") for i, v in enumerate(vec)]
    n = len(out)
    out += [(n, None, 0, "", ""), (n + 1, [], 0, "", ""), (n + 2, [0.0] * 12, 0, "", ""), (n + 3, [float("nan")] * 12, 0, "", ""), (n + 4, [float("inf")] * 12, 0, "", ""),
            (n + 5, [None] + [1.0] * 11, 0, "", ""), (n + 6, [1.0] * 5, 1, "", ""), (n + 7, [1e30] * 12, 0, "", ""), (n + 8, [9e29] * 12, 1, "", ""), (n + 9, [1.0] * 12, None, "", ""),
            (None, [1.0] * 12, 0, "", ""), (None, [1.0] * 12, 2, "", ""), (500, [2.0] * 12, 0, "", ""), (510, [2e7] * 12, 0, "", ""), (520, [-1.0] * 12, 0, "", ""),
            out[10], out[10], out[33], out[40]]
    return spark.createDataFrame(out, VECTORS)


@pytest.mark.parametrize("block", [2048, 64])
def test_negatives_equal_brute_force(spark, odd_vectors, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "BATCH", 8)
    if block == 64:
        monkeypatch.setattr(negatives, "ROUND_VALUES", 200)
        monkeypatch.setattr(negatives, "LEAF", 2)
    df = odd_vectors.repartition(3)
    want = brute_negatives([(r.vec_id, r.embedding, r.label) for r in df.collect()], 10, 5, 5)
    assert rows(negatives.mine(df, every=10)) == want and len(want) > 200


def test_negatives_of_empty_and_one_label(spark, odd_vectors):
    assert negatives.mine(odd_vectors.limit(0)).count() == 0
    one = odd_vectors.where("vec_id between 1 and 6 or vec_id = 100")
    assert rows(negatives.mine(one)) == brute_negatives([(r.vec_id, r.embedding, r.label) for r in one.collect()], 100, 5, 5)


def test_cover_tree_covers_and_bounds():
    """Every node's points lie within its radius; children part their node's points; radii shrink."""
    rng = np.random.default_rng(2)
    x = np.floor(np.concatenate([rng.normal(size=(10, 1, 8)) * 900 + rng.normal(size=(10, 60, 8)) * 40]).reshape(-1, 8))
    x = np.concatenate([x, np.tile(x[:1], (50, 1))])
    t = negatives.CoverTree(x)
    y = x[t.order]
    assert sorted(t.order.tolist()) == list(range(len(x)))
    inner = 0
    for i in range(len(t.centre)):
        own = np.arange(t.start[i], t.end[i])
        assert t.centre[i] in own and np.linalg.norm(y[own] - y[t.centre[i]], axis=1).max() <= t.radius[i] + 1e-6
        kids = np.arange(t.first[i], t.last[i])
        if len(kids):
            inner += 1
            assert np.concatenate([np.arange(t.start[k], t.end[k]) for k in kids]).tolist() == own.tolist()
            assert t.radius[kids].max() <= t.radius[i] / negatives.SHRINK * (1 + 1e-6) + 1e-3
    assert inner > 5


def test_descent_skips_nodes_outside_the_window():
    """With clustered points most nodes fall to their bounds, and no point inside a window is lost."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 1, 16)) * 2000
    x = np.floor((centre + rng.normal(size=(20, 100, 16)) * 20).reshape(-1, 16))
    t = negatives.CoverTree(x)
    y, label = x[t.order], np.zeros(len(x), np.int64)
    score = y @ y[:1].T
    top = int(np.quantile(score, 0.9))
    table = pa.table({"ask": [0], "row": [-1], "label": [1], "vec": [(y[0] / 256).tolist()], "high": [top]})
    q, seen = negatives.Queries(table, False, 5), []
    negatives.descend(t, y, label, q, np.array([0]), lambda a, p, s: seen.extend(p.tolist()))
    inside = np.flatnonzero((score[:, 0] <= top) & (5 * score[:, 0] >= 4 * top))
    assert set(inside.tolist()) <= set(seen) and len(seen) < len(y) / 2


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, odd_docs, library):
    whole = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df in (odd_docs, whole):
        got = bytebpe.encode_documents(df, RANKS, P.PATTERN, keep=("doc_id", "text")).collect()
        assert len(got) == df.count()
        for r in got:
            ids = library.encode_ordinary(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_byte_bpe_of_an_empty_table(no_docs):
    out = bytebpe.encode_documents(no_docs, RANKS, P.PATTERN, ids=False)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_byte_bpe_of_odd_characters_and_long_runs(library, monkeypatch):
    """Mixed scripts and white space, runs without a break, and a memory that starts anew."""
    monkeypatch.setattr(bytebpe, "REMEMBERED", 50)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab \n\té中😀'sţ 　́٣\x00<|>") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 100_000, " " * 5000, "ab" * 3000, "x", "", "\U0010ffff"]
    enc = bytebpe.Encoder(bytebpe.Ranks(RANKS), P.PATTERN)
    for lo in range(0, len(texts), 40):
        for t, x in zip(texts[lo:lo + 40], enc.encode(texts[lo:lo + 40])):
            assert x.tolist() == library.encode_ordinary(t) and enc.decode(x) == t.encode()


def plain_merges(piece, ranks):
    """The leftmost pair of the lowest rank, again and again."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_trees_merge_the_leftmost_lowest_pair(library):
    ranks = bytebpe.Ranks(RANKS)
    rnd = random.Random(6)
    pieces = [bytes(rnd.choice(b"abcdeht a") for _ in range(rnd.randint(2, 40))) for _ in range(800)]
    for p in pieces:
        assert bytebpe.merge_one(p, ranks) == plain_merges(p, ranks.id)
    for size in {bytebpe.tree_size(len(p)) for p in pieces}:
        some = [p for p in pieces if bytebpe.tree_size(len(p)) == size]
        ids, count = bytebpe.merge_many(some, size, ranks)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain_merges(p, ranks.id) for p in some]
