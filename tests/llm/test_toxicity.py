from __future__ import annotations

import math
import random
import re
import zlib

import pytest

from plinth.llm import toxicity as X

RUDE = ["grobbish", "flarnt", "skuzzle", "drokked"]


@pytest.fixture(scope="module")
def rows(vocabulary):
    rnd = random.Random(3)
    out = []
    for i in range(900):
        sentences = [[rnd.choice(vocabulary) for _ in range(rnd.randint(2, 12))] for _ in range(rnd.randint(1, 25))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(rnd.randint(1, 3)):
                rnd.choice(sentences).append(rnd.choice(RUDE))
        out.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("toxic")
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(r[0], r[2]) for r in rows] + [(10**6, 1), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def test_held_out_accuracy(spark, rows, tables):
    got = {r["doc_id"]: r for r in X.op8_toxicity(spark, tables).collect()}
    assert len(got) == len(rows)
    held = [(y, got[d]) for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] for _, r in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(r["predicted"] == y for y, r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_offending_sentences_are_found(spark, rows, tables):
    docs = spark.read.parquet(tables + "/documents.parquet")
    model = X.fit(X.training_sample(docs, spark.read.parquet(tables + "/labels.parquet")))
    for r in X.score_documents(docs, model).filter("predicted = 1").collect():
        for span in r["offending"]:
            assert any(w in r["text"][span["start"] : span["end"]] for w in RUDE)


def test_sample_is_bounded_and_excludes_the_held_out(spark, rows, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    sample = X.training_sample(docs, labels, most=100)
    assert len(sample) == 100
    held = {t for d, t, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    assert not held & {t for t, _ in X.training_sample(docs, labels)}


def test_noisy_or():
    model = X.Model({"bad": 9.0}, -8.0)
    score, found = model.score("fine words. bad words! fine")
    p, q = 1 / (1 + 2.718281828459045**8), 1 / (1 + 2.718281828459045**-1)
    assert abs(score - (1 - (1 - p) ** 2 * (1 - q))) < 1e-9
    assert [(s, e) for s, e, _ in found] == [(11, 21)]
    assert model.score(None) == model.score("") == (0.0, [])


def plain_score(model, text):
    """The noisy-or of the worst run of PASSAGE sentences, sentence by sentence."""
    logs = []
    for s in re.findall(r"[^.!?\n]+", text):
        words = set(re.findall(r"[^\W\d_]+", s.lower()))
        own = words | {w[:n] + "*" for w in words for n in X.PREFIXES if len(w) >= n}
        logs.append(-math.log1p(math.exp(model.bias + sum(model.weights.get(f, 0.0) for f in own))))
    return 1 - math.exp(min([sum(logs[i : i + X.PASSAGE]) for i in range(max(1, len(logs) - X.PASSAGE + 1))], default=0.0))


def test_score_against_plain_sums(rows):
    model = X.Model({"grobbish": 7.0, "gro*": 1.5, "flarnt": 6.0, "abc*": 2.0, "x": -1.0, "straße": 5.0, "i̇": 3.0}, -8.0)
    texts = [t for _, t, _ in rows[:200]] + ["Grobbish grob x. flarnt! FLARNT\nabcd? Straße İ grobbish", "flarnt. " * 700, "x. " * 400 + "grobbish. " * 3, "ΑΣ ΑΣΑ. " * 5, "...", "12 _ 3"]
    for t in texts:
        assert abs(model.score(t)[0] - plain_score(model, t)) < 1e-9
    for t in texts:
        for s, e, p in model.score(t)[1]:
            assert abs(p - plain_score(model, t[s:e])) < 1e-9


def test_fit_follows_the_loss(rows):
    """The fitted weights are near a point where the loss, summed up by a plain loop, has no slope."""
    sample = [(t, y) for _, t, y in rows[:300]]
    model = X.fit(sample)

    def loss(weights, bias):
        moved = X.Model(weights, bias)
        total = 0.0
        for t, y in sample:
            logs = [math.log1p(math.exp(moved.sentence(set(X._WORD.findall(s.lower()))))) for s in X._SENTENCE.findall(t)]
            total += -math.log(-math.expm1(-sum(logs))) if y else sum(logs)
        return total / len(sample) + X.DECAY / 2 * sum(w * w for w in weights.values())

    best = loss(model.weights, model.bias)
    for f in list(model.weights)[:6]:
        for step in (-0.5, 0.5):
            assert loss(model.weights | {f: model.weights[f] + step}, model.bias) > best - 1e-4


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, "w" * 100) for i in range(200)] + [(7, "w" * 50), (7, "z" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample = X.training_sample(docs, labels, most_bytes=2000)
    assert 15 <= len(sample) <= 20 and sum(len(t) for t, _ in sample) <= 2000
    whole = X.training_sample(docs, labels)
    assert len(whole) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))


def test_length_alone_is_not_toxic(spark, rows, tables):
    """A clean text of 1 MB is clean; one rude sentence anywhere in it is still found."""
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    model = X.fit(X.training_sample(docs, labels))
    clean = [t for _, t, y in rows if not y and model.score(t)[0] < 0.5]
    size, parts = 0, []
    while size < 1_000_000:
        parts.append(clean[len(parts) % len(clean)])
        size += len(parts[-1]) + 1
    assert model.score(" ".join(parts))[0] < 0.5
    for at in (0, len(parts) // 2, len(parts)):
        score, found = model.score(" ".join([*parts[:at], "grobbish skuzzle.", *parts[at:]]))
        assert score >= 0.5 and len(found) == 1
    weak = X.Model({"meh": 4.0}, -9.2)
    assert weak.score("plain words. " * 80_000)[0] < 0.5
    assert weak.score(("plain words. " * 99 + "meh words. ") * 800)[0] < 0.5


def test_without_two_classes():
    assert X.fit([]).score("bad") == (0.0, [])
    assert X.fit([("a b", 1)]).score("a b") == (0.0, [])


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    model = X.Model({"one": 20.0}, -8.0)
    got = X.score_documents(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert [r["predicted"] for r in got if r["text"] == "one"] == [1, 1]
    assert X.score_documents(no_docs, model).count() == 0
    assert dict(X.score_documents(clashing, model).dtypes)["score"] == "double"
