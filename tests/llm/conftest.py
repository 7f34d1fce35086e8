from __future__ import annotations

import random

import pytest

@pytest.fixture(scope="session")
def vocabulary():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]


@pytest.fixture(scope="session")
def odd_texts(vocabulary):
    """Null, empty, blank, short, very long and repeated texts."""
    rnd = random.Random(6)
    long = " ".join(rnd.choice(vocabulary) for _ in range(30_000))
    return [None, "", " \t\n\x0b\x0c\r ", "one", "One TWO three", "a b c d e", "A B C D E", "ünïcödé 😀 wörds ſK\n\n", long, long, "For " * 500, "\n" * 50, "x" * 5000]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with a null id, repeated ids and rows, and columns that clash with results."""
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "some words without an id here"), (None, None), (3, "one"), (3, "another text of the same id")]
    return spark.createDataFrame(rows, "doc_id long, text string")


CLASHING = ("size", "score", "label", "rank", "n", "key", "token", "predicted", "items", "n_bytes", "kept", "found", "base", "finish", "taken", "starts", "fp", "d", "th", "licenses", "host", "n_removed")


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """odd_docs with a source and columns of the names that results and helpers use."""
    from pyspark.sql import functions as F

    out = odd_docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    for c in CLASHING:
        out = out.withColumn(c, F.lit("mine"))
    return out


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
