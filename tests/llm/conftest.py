import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9)))
    base = [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    near = [t + " " + word() for t in base[:20]]
    long = " ".join(word() for _ in range(30_000))
    texts = base + near + [base[0]] * 5 + ["", None, "   \t\n", "one", "one two three", "One TWO\x0bthree", long, "ÀB ß x <|endoftext|> y"]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "B", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "a", 10)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    for c in ("fp", "size", "shard", "node", "root", "target", "score", "label", "_key", "_h", "spans", "component_id", "good"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
