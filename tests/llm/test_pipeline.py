"""The pipeline against brute-force versions of its stages, and the registered queries' SQL."""

from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import mixing, quality, secrets
from basketry.llm.oracles import ORACLE
from basketry.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_docs import WORDS, brute_base, brute_components, brute_fingerprint
from tools.oracle_check import rows_duck, rows_spark


def test_stages_equal_brute_force(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "secrets", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    step = {}
    df = docs
    for name, stage in stages.items():
        df = corpus_pipeline.materialise(stage(spark, df, SMALL), f"test-{name}")
        step[name] = df.collect()
        assert name == "bpe" or df.columns == docs.columns
    # quality: exactly the rows that the scoring query accepts
    good = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.score >= 0.7}
    assert Counter(r.doc_id for r in step["quality"]) == Counter(r.doc_id for r in docs.collect() if r.doc_id in good)
    # near-dedup: the smallest doc_id of each brute-force component
    before = step["quality"]
    label = brute_components([r.doc_id for r in before], [brute_fingerprint(r.text) for r in before], 4)
    assert Counter(r.doc_id for r in step["simhash"]) == Counter(set(label))
    # secrets: same rows, base matches gone, clean texts untouched
    after = {r.doc_id: r for r in step["secrets"]}
    ratio = secrets.train(spark.createDataFrame(step["simhash"], docs.schema))
    assert Counter(r.doc_id for r in step["secrets"]) == Counter(r.doc_id for r in step["simhash"])
    for r in step["simhash"]:
        base = brute_base(r.text)
        more = secrets.markov_spans(r.text, secrets.runs(r.text), base, ratio)
        assert after[r.doc_id].text == secrets.blank(r.text, base + more) and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        assert not brute_base(after[r.doc_id].text)
    # mixing: each document as often as the mix takes it
    mixed = spark.createDataFrame(step["secrets"], docs.schema)
    copies = Counter(r.doc_id for r in step["mixing"])
    taken = defaultdict(int)
    for r in mixing.mix(mixed).collect():
        assert r.size == len(WORDS.findall(after[r.doc_id].text))
        assert r.size == 0 or copies[r.doc_id] == r.taken // r.size
        taken[r.source] += r.taken
    # BPE: the library's ids of every copy
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    assert Counter(r.doc_id for r in step["bpe"]) == copies
    for r in step["bpe"]:
        assert r.ids == t.encode(after[r.doc_id].text, add_special_tokens=False).ids


def test_pipeline_is_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert sorted(k for k in E.queries() if k.startswith("op")) == sorted(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cols, rows = rows_spark(QUERIES[key](spark, SMALL))
    dcols, drows, _ = rows_duck(con, ORACLE[key])
    assert cols == dcols and Counter(rows) == Counter(drows)
