from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plinth.llm import decontaminate as X

#: Lower-casing of A-Z alone, as the words have it.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def brute(docs, items):
    """{(doc_id, item_id): largest share} over all windows of the item's size."""
    own = {}
    for i, t in items:
        if w := tuple(words(t)):
            own[w] = min(i, own.get(w, i))
    df = Counter(s for w in own for s in set(shingles(w)))
    weight = {s: 1 + math.log(len(own) / c) for s, c in df.items()}
    by = defaultdict(set)
    for w in own:
        for s in shingles(w):
            by[s].add(w)
    out = {}
    for d, t in docs:
        ws = words(t)
        for w in {w for s in set(shingles(ws)) for w in by.get(s, ())}:
            mine = set(shingles(w))
            best = max(sum(weight[s] for s in mine & set(shingles(ws[p : p + len(w)]))) for p in range(max(1, len(ws) - len(w) + 1)))
            if best >= (X.MIN_SHARE - 1e-9) * sum(weight[s] for s in mine):
                out[d, own[w]] = best
    return out


def found(docs, items):
    return {(r["doc_id"], i) for r in X.decontaminate(docs, items).collect() for i in r["items"]}


@pytest.fixture(scope="module")
def items(vocabulary):
    rnd = random.Random(3)
    own = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(15, 59)))) for i in range(100)]
    common = " ".join(rnd.choice(vocabulary) for _ in range(8))
    own += [(200 + i, common + " " + " ".join(rnd.choice(vocabulary) for _ in range(20))) for i in range(20)]
    return own + [(900, "one two"), (901, None), (902, ""), (903, "One  TWO"), (904, own[0][1].upper())]


@pytest.fixture(scope="module")
def rows(vocabulary, items):
    rnd = random.Random(4)
    fill = lambda: [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
    out = []
    for k in range(200):
        w = rnd.choice(items[:120])[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        out.append((k, " ".join(fill() + w + fill())))
    out += [(1000 + k, " ".join(fill())) for k in range(100)]
    return out + [(5000, "one TWO"), (5001, "one two three"), (5002, items[3][1][: len(items[3][1]) // 2])]


def test_against_brute_force(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, want = found(docs, spark.createDataFrame(items, "item_id long, text string")), brute(rows, items)
    assert got <= want.keys()
    assert len(want.keys() - got) <= 0.01 * len(want)
    exact = {(d, i) for d, t in rows for i, own in items[:120] if " ".join(words(own)) in " ".join(words(t))}
    assert exact <= got
    assert (5000, 900) in got and not any(d in (5001, 5002) or 1000 <= d < 2000 for d, _ in got)


def test_cut_and_broken_copies_equal_brute_force(spark, vocabulary, items):
    """Copies that lose their end or beginning, or have words put in or taken out in one place."""
    rnd = random.Random(8)
    some = lambda most: [rnd.choice(vocabulary) for _ in range(rnd.randint(0, most))]
    rows = []
    for k in range(300):
        w = rnd.choice(items[:120])[1].split()
        n, at = max(1, round(len(w) * rnd.uniform(0.1, 0.24))), rnd.randrange(len(w))
        other = [rnd.choice(vocabulary) for _ in range(n)]
        w = [w[:-n] + other, other + w[n:], w[:at] + some(6) + w[at:], w[:at] + w[at + rnd.randint(1, 4) :]][k % 4]
        rows.append((k, " ".join(some(80) + w + some(80))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, items)
    assert len(want) > 150
    assert found(docs, spark.createDataFrame(items, "item_id long, text string")) == want.keys()


def test_radius_is_guaranteed(spark):
    """Every pair of fingerprints within the radius shares a listed block."""
    rnd = random.Random(1)
    bits = X._BITS
    changes = set(X._changes(bits, X.RADIUS // X.BLOCKS))
    for _ in range(500):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), X.RADIUS):
            y ^= 1 << b
        assert any(((x >> bits * i) ^ (y >> bits * i)) & ((1 << bits) - 1) in changes for i in range(X.BLOCKS))


def test_simhash(spark):
    rnd = random.Random(2)
    own = [[rnd.randrange(-(2**63), 2**63) for _ in range(n)] for n in (1, 2, 7, 40)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(own)], "i int, ws array<long>")
    for r in df.select("i", X.simhash(F.col("ws")).alias("fp")).collect():
        w = own[r["i"]]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in w) > len(w))
        assert r["fp"] % 2**64 == want


def test_odd_rows(spark, odd_docs, no_docs, clashing, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert X.decontaminate(odd_docs, bench).filter(F.size("items") > 0).count() == 0
    assert X.decontaminate(no_docs, bench).count() == 0
    none = X.decontaminate(odd_docs, bench.filter("false"))
    assert none.count() == odd_docs.count() and none.filter(F.size("items") > 0).count() == 0
    out = X.decontaminate(clashing, bench)
    assert out.count() == clashing.count() and dict(out.dtypes)["items"] == "array<bigint>"
    same = spark.createDataFrame([(None, items[5][1]), (7, items[5][1]), (7, items[5][1])], "doc_id long, text string")
    assert [list(r["items"]) for r in X.decontaminate(same, bench).collect()] == [[5]] * 3
