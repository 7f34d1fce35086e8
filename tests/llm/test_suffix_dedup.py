from __future__ import annotations

import os
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.llm import suffix_dedup as S


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = S.merged([(p, p + length) for p in range(len(d) - length + 1) if seen[d[p : p + length]] > 1])
        edges = [0, *[x for s in spans for x in s], len(d)]
        kept = b"".join(d[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
        out.append((len(d), len(d) - len(kept), len(spans), kept))
    return out


@pytest.fixture(scope="module")
def texts(vocabulary):
    rnd = random.Random(1)
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(70, 150))) for _ in range(6)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                parts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))))
                continue
            x = rnd.choice(passages)
            x = x[rnd.randint(0, 100) : len(x) - rnd.randint(0, 100)]
            if rnd.random() < 0.3:
                j = rnd.randint(0, len(x) - 1)
                x = x[:j] + "é" + x[j + 1 :]
            parts.append(x)
        out.append(" ".join(parts))
    return out + ["For " * 300, "For " * 120, None, "", "x" * 399, "y" * 401, "z" * 400, "z" * 400, "😀" * 150]


def repeated_words(texts):
    """For each text its words that a string of WORDS words covers which starts anywhere else, too."""
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[p : p + S.WORDS]) for w in data for p in range(len(w) - S.WORDS + 1))
    covered = [S.merged([(p, p + S.WORDS) for p in range(len(w) - S.WORDS + 1) if seen[tuple(w[p : p + S.WORDS])] > 1]) for w in data]
    return [sum(e - s for s, e in spans) for spans in covered]


@pytest.mark.parametrize("most_classes", [0, 3, 64])
def test_passages_against_brute_force(spark, texts, vocabulary, monkeypatch, most_classes):
    """Passages of 45 to 60 words in two to ninety texts, between all kinds of blanks."""
    monkeypatch.setattr(S.covered_ranges, "__defaults__", (S.LENGTH, S.GRAM, most_classes))
    rnd = random.Random(5)
    passages = [[rnd.choice(vocabulary)[:4] for _ in range(rnd.randint(45, 60))] for _ in range(12)] + [["a", "b"] * 40, ["x"] * 52, ["y"] * 51]
    own = list(texts)
    for k in range(240):
        x = passages[0] if k < 90 else rnd.choice(passages)
        x = x[rnd.randint(0, 3) :]
        around = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30))] for _ in range(2)]
        words = around[0] + x + around[1]
        own.append("".join(w + rnd.choice([" ", "  ", "\n", "\t"]) for w in words))
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_repeated_words"] for r in S.dedup_substrings(df).collect()}
    want = repeated_words(own)
    assert got == dict(enumerate(want))
    assert sum(x > 0 for x in want) > 150 and 0 in want


def test_a_few_words_on_and_on_are_one_run(spark):
    """A text that repeats itself has a row for each change, not for each repetition."""
    text = "many words " * 5000
    docs = spark.createDataFrame([(1, 1, text), (2, 2, text[3:])], "d long, th long, text string")
    rows = S.anchors(docs).collect()
    assert len(rows) < 40 and sum(r["m"] for r in rows) > 10_000


@pytest.mark.parametrize("most_classes", [0, 3, 64])
def test_against_brute_force(spark, texts, monkeypatch, most_classes):
    monkeypatch.setattr(S.covered_ranges, "__defaults__", (S.LENGTH, S.GRAM, most_classes))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.dedup_substrings(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    rows = odd_docs.collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.dedup_substrings(odd_docs).collect())
    assert got == Counter((r["doc_id"], *x[:3]) for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True))
    got = Counter((r["doc_id"], r["n_repeated_words"]) for r in S.dedup_substrings(odd_docs).collect())
    assert got == Counter((r["doc_id"], n) for r, n in zip(rows, repeated_words([r["text"] for r in rows]), strict=True))
    assert S.dedup_substrings(no_docs).count() == 0
    assert S.dedup_substrings(clashing).filter(F.col("source").isNotNull() & (F.col("n_bytes") >= 0)).count() > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=30), st.sampled_from([0, 2, 5, 100]))
def test_deep_shallow_sorts(strings, shallow):
    order = S.deep_shallow(strings, shallow)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 2 for x in b)), min_size=2, max_size=12))
def test_common_lengths(strings):
    got = S._common_lengths(strings)
    for i, x in enumerate(strings):
        for j, y in enumerate(strings):
            if i != j:
                assert got[i, j] == len(os.path.commonprefix([x, y]))


def test_blind_trie_keeps_equal_strings():
    strings = [b"abc" * 40, b"abc" * 40, b"abc" * 39 + b"abd", b"abc" * 39]
    assert [strings[i] for i in S.blind_trie(strings, [0, 1, 2, 3])] == sorted(strings)
