"""Fuzzy ratio vs dynamic programming; clustering vs a brute-force union-find."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.fuzzy import indel_ratio, lcs_length, token_sort_ratio
from basketry.operators import entity


def dp_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ABC D", max_size=25), st.text(alphabet="ABC D", max_size=25))
def test_bit_parallel_lcs(a, b):
    assert lcs_length(a, b) == dp_lcs(a, b)


def test_token_sort_ratio_values():
    assert token_sort_ratio("SURF EXCEL 1 KG", "EXCEL SURF 1 KG") == 100.0
    assert indel_ratio("abc", "abd") == 100.0 * (1 - 2 / 6)


def uf_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for n in nodes:
        comp.setdefault(find(n), []).append(n)
    return {n: min(members) for members in comp.values() for n in members}


def test_connected_components_matches_union_find(spark):
    rnd = random.Random(7)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(90)]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.label for r in entity.connected_components(df).collect()}
    touched = sorted({x for e in edges for x in e})
    want = uf_components(touched, edges)
    assert got == {n: want[n] for n in touched}


def test_chain_cluster_far_member_scores_zero(spark):
    """a-b and b-c pass the threshold, a-c does not: one cluster, a-c suggestion scored 0."""
    names = [("1", "ABCDEFGH 5"), ("2", "ABCDEFXY 5"), ("3", "ABCDXYZW 5")]
    cands = spark.createDataFrame(names, "barcode string, name string")
    products = spark.createDataFrame([], "barcode string")
    thr = 80
    blk = entity.blocked(cands)
    norm = {r.barcode: r.norm for r in blk.collect()}
    s = lambda x, y: token_sort_ratio(norm[x], norm[y])
    assert s("1", "2") >= thr and s("2", "3") >= thr and s("1", "3") < thr
    clusters, edges = entity.name_clusters(cands, products, thr)
    sug = {r.alias_barcode: r.similarity_score for r in entity.merge_suggestions(clusters, edges).collect()}
    assert set(sug) == {"2", "3"}
    assert sug["3"] == 0.0 and sug["2"] == round(s("1", "2"), 2)


def test_alias_violations(spark):
    al = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "alias_barcode string, canonical_barcode string")
    got = sorted((r.alias_barcode, r.reason) for r in entity.alias_violations(al).collect())
    assert got == [("b", "alias_is_canonical"), ("c", "canonical_is_alias")]


def test_large_block_is_split_and_loses_no_pair(spark):
    """One block of 600 names in parts of about 40 gives the pairs of the unsplit block, over many parts."""
    rnd = random.Random(3)
    names = sorted({"ABC" + "".join(rnd.choice("DEFG ") for _ in range(rnd.randint(3, 9))).strip() for _ in range(600)})
    blk = entity.blocked(spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "barcode string, name string"))
    key = lambda df: sorted((r.norm_a, r.norm_b, r.score) for r in df.collect())
    assert key(entity.name_pairs(blk, 80, limit=40)) == key(entity.name_pairs(blk, 80)) != []
    parts = entity.split_blocks(blk.select("block_key", "norm").distinct(), 40).groupBy("_p", "_q").count().collect()
    assert len(parts) > 50 and max(r["count"] for r in parts) < 200


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = entity.saved
    monkeypatch.setattr(entity, "saved", lambda df, name: rounds.append(name) or keep(df, name))
    df = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}") for i in range(1000)], "a string, b string")
    got = {r.node: r.label for r in entity.connected_components(df).collect()}
    assert len(got) == 1001 and set(got.values()) == {"00000"}
    assert len(rounds) <= 15


def random_names(rnd, count, low, high):
    return sorted({"ABC" + "".join(rnd.choice("DEFGIKLMNOPRST 0189") for _ in range(rnd.randint(low, high))).strip()
                   for _ in range(count)})


def as_block(spark, names):
    return spark.createDataFrame([("b", n) for n in names], "block_key string, norm string")


def test_bounds_lose_no_pair_of_any_score(spark):
    """Names of 3 to 60 characters, near copies among them, signs outside all groups: the pairs of brute force, split or not."""
    rnd = random.Random(11)
    names = random_names(rnd, 150, 0, 57)
    names += [n[:rnd.randint(1, len(n))] + rnd.choice("XÜ東Z") + n[rnd.randint(1, len(n)):] for n in names[:100]] + ["", "Ü"]
    names = sorted(set(names))
    blk = as_block(spark, names)
    for score in (0, 40, 62, 78, 95, 100):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if token_sort_ratio(a, b) >= score}
        for limit in (30, 2000):
            got = [(r.norm_a, r.norm_b) for r in entity.name_pairs(blk, score, limit).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_one_block_of_20000_names_is_hardly_compared(spark):
    """Of 200 million pairs, few pass the counts; parts whose lengths cannot match do not exist."""
    rnd = random.Random(5)
    names = random_names(rnd, 20000, 4, 60)
    blk, n = as_block(spark, names), len(names)
    assert n > 19000
    dealt = entity.split_blocks(blk, 1000, 78).groupBy("_p", "_q").count().collect()
    s = -(-n // 1000)
    assert max(r["count"] for r in dealt) <= 2300 and len(dealt) < 0.6 * s * (s + 1) / 2
    assert entity.bounded_pairs(blk, 78, 1000).count() < 0.1 * n * (n - 1) / 2
