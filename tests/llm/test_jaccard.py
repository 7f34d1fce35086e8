from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plinth.llm import jaccard
from plinth.llm.components import components
from plinth.llm.hashing import shingle_sets

#: Lower-casing of A-Z alone, as the words have it.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{doc_id: smallest doc_id reachable} by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            same = len(x & y)
            if same and 100 * same >= 75 * (len(x) + len(y) - same):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {d: root(d) for d in up}


def edited(rnd, vocabulary, base, n):
    w = list(base)
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(vocabulary):
    """Groups of near copies at all distances, a group of 60, shared passages, chains."""
    rnd = random.Random(8)
    rows = []
    passage = [rnd.choice(vocabulary) for _ in range(80)]
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 12, 30, 80, 200]))]
        for _ in range(60 if g == 0 else rnd.randint(1, 6)):
            rows.append(edited(rnd, vocabulary, base, rnd.randint(0, 1 + len(base) // 20)))
    for _ in range(60):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        rows.append(" ".join(own + passage + own[:3]))
    chain = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = chain[4:] + [rnd.choice(vocabulary) for _ in range(4)]
    rnd.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("most_matches", [1, 4, 9])
def test_components_equal_all_pairs(spark, corpus, monkeypatch, most_matches):
    monkeypatch.setattr(jaccard, "MOST_MATCHES", most_matches)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.jaccard_components(df).collect()}
    want = brute(corpus)
    assert {d: c for d, (c, _) in got.items()} == want
    assert {d: n for d, (_, n) in got.items()} == {d: len(shingles(t)) for d, t in corpus}
    assert len(set(want.values())) < len(want)


def test_short_documents_near_the_threshold(spark, vocabulary):
    """Pairs of all sizes whose similarity lies about 0.75, where every bound is tight."""
    rnd = random.Random(21)
    rows = []
    for _ in range(350):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 45))]
        for _ in range(rnd.randint(2, 3)):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.choice([0, -1, rnd.randrange(len(w))])] = rnd.choice(vocabulary)
            w = w[rnd.randint(0, len(w) // 8) :] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, len(w) // 8))]
            rows.append(" ".join(w))
    corpus = list(enumerate(rows, 1))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    assert got == brute(corpus)


def test_multi_match_prefixes_are_used(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    scanned = jaccard.sets_and_sketch(df).filter("tag = 1").groupBy("id", "n").sum("a").toArrow()
    sketch = np.zeros((2, jaccard.CELLS), np.int64)
    sketch[scanned[0].to_numpy(), scanned[1].to_numpy()] = scanned[2].to_numpy()
    ks = {r["k"] for r in jaccard._opened(jaccard.prefixes(df, sketch)).select("k").distinct().collect()}
    assert len(ks) > 1


def test_matches_follow_the_estimated_cost(spark, vocabulary):
    """Only documents of significantly frequent shingles lengthen their prefixes; sketch noise does not."""
    rnd = random.Random(12)
    fresh = [" ".join(rnd.choice(vocabulary) for _ in range(300)) for _ in range(40)]
    common = [rnd.choice(vocabulary) for _ in range(100)]
    copies = [" ".join(common + [rnd.choice(vocabulary) for _ in range(4)]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(fresh + copies)), "doc_id long, text string")
    sketch = np.full((2, jaccard.CELLS), 50, np.int64)  # noise of fifty in each cell
    for own in shingle_sets(fresh + copies):
        for r, cell in enumerate(jaccard._cells(own)):
            np.add.at(sketch[r], cell, 1)
    ks = {r["doc"]: r["k"] for r in jaccard._opened(jaccard.prefixes(df, sketch)).collect()}
    assert {ks[d] for d in range(40)} == {1}
    assert all(ks[d] > 1 for d in range(40, 340))


def test_odd_rows(spark, odd_docs):
    got = defaultdict(set)
    for r in jaccard.jaccard_components(odd_docs).collect():
        got[r["doc_id"]].add((r["component_id"], r["n_shingles"]))
    assert {n for _, n in got[0] | got[1] | got[2]} == {0}
    assert all(got[d] == {(d, 0)} for d in (0, 1, 2))
    assert got[3] == {(3, 1), (3, 2)}  # rows of one id, of two texts
    assert got[5] == {(5, 1)} and got[6] == {(5, 1)}
    assert {c for c, _ in got[8]} == {c for c, _ in got[9]} == {8}
    assert {c for c, _ in got[None]} == {None}


def test_documents_without_an_id_link_too(spark, vocabulary):
    rnd = random.Random(2)
    base = [rnd.choice(vocabulary) for _ in range(60)]
    near, far = [*base[:-1], "other"], [rnd.choice(vocabulary) for _ in range(60)]
    rows = [(7, " ".join(base)), (None, " ".join(near)), (None, " ".join(far)), (None, " ".join(far[:-1]))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 7), (7, 7)]
    assert jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).select("component").distinct().count() == 2


def test_empty_and_clashing(spark, no_docs, clashing):
    assert jaccard.jaccard_components(no_docs).count() == 0
    assert jaccard.jaccard_components(clashing).count() == clashing.count()


def test_shingle_sets_match_words(odd_texts):
    for text, own in zip(odd_texts, shingle_sets(odd_texts), strict=True):
        assert len(own) == len(shingles(text))
    a, b = shingle_sets(["A b C d E f", "a B c D e F"])
    assert (a == b).all()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
