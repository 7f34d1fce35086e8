from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from plinth.llm import imatch


def edited(rows):
    rows = [(d, t or "") for d, t in rows]
    out = {}
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        out[d] = text[: len(text) - q] + after[:q]
    return out


@pytest.fixture(scope="module")
def rows(vocabulary):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 400))) for _ in range(300)]
    texts[10] = texts[20] = texts[200]
    texts[30], texts[31], texts[32], texts[33] = None, "", "😀é" * 30, " \n"
    ids = rnd.sample(range(-50, 10**9), 300)
    return sorted(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("imatch")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(folder / "documents.parquet"))
    return {r["doc_id"]: r for r in imatch.op3_imatch(spark, str(folder)).collect()}


def test_edited_texts(rows, result):
    want = edited(rows)
    assert len(result) == len(rows)
    for d, text in rows:
        assert result[d]["edited_sha256"] == hashlib.sha256(want[d].encode()).hexdigest()
        assert result[d]["n_chars"] == len(text or "")


def test_equal_texts_have_equal_fingerprints(rows, result):
    by = defaultdict(set)
    for d, text in rows:
        by[text or ""].add(result[d]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())


def test_likeness_tells_edits_from_strangers(rows, result):
    own = [r for d, r in result.items() if r["n_chars"] > 200]
    assert sum(r["near_edited"] for r in own) / len(own) > 0.4
    assert sum(r["near_next"] for r in own) / len(own) < 0.1
    assert sum(r["near_edited"] > r["near_next"] for r in own) > 0.95 * len(own)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in result.values())


def long_hash(x, seed=42):
    return xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def term_hashes(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w}


def plain_fingerprint(text, lexicon):
    """Scale, main codes and finer codes, counted one by one with another hash library."""
    own = term_hashes(text)
    chosen = sorted(own & lexicon or own)

    def whole(ts):
        h = 42
        for t in ts:
            h = long_hash(t, h)
        return signed(h) if ts else 0

    main = [whole(chosen)] + [whole([t for t in chosen if t >> 2 * k & 3]) for k in range(imatch.LEXICONS)]
    if not chosen:
        return -imatch.SCALES, main, [[1]]
    s = len(chosen).bit_length()
    codes = []
    for scale in range(s, s + imatch.SCALES):
        codes.append([])
        for j in range(imatch.SUBSETS):
            h, n = 42, 0
            for t in chosen:
                place = (t % (1 << 64)) >> 20 & 0x3FFFFFFF
                if place % (1 << scale) == j:
                    h = long_hash(t, xxhash.xxh64_intdigest(place.to_bytes(4, "little"), h))
                    n += 1
            codes[-1].append((h & 0xFFFFFF) + 1 if n else 0)
    return s, main, codes


def plain_likeness(x, y):
    pairs = list(zip(x[1], y[1], strict=True))
    for i, own in enumerate(x[2]):
        j = x[0] + i - y[0]
        if 0 <= j < len(y[2]):
            pairs += zip(own, y[2][j], strict=True)
    used = [(p, q) for p, q in pairs if p or q]
    return sum(p == q for p, q in used) / len(used) if used else 0.0


def plain_text(fp):
    one = lambda xs: ".".join(f"{x % (1 << 64):x}" if x else "-" for x in xs)
    return ":".join([str(fp[0]), one(fp[1]), *map(one, fp[2])])


def test_against_brute_force(rows, result):
    """Lexicon, fingerprints of texts and edited texts, and likeness, all computed anew."""
    texts = {d: t or "" for d, t in rows}
    counts = Counter(t for x in texts.values() for t in term_hashes(x))
    n = len(rows)
    least, most = (max(imatch.MIN_DOCS, share * n) for share in (imatch.MIN_SHARE, imatch.MAX_SHARE))
    lexicon = {t for t, c in counts.items() if least <= c <= most}
    after = edited(rows)
    order = [d for d, _ in rows]
    prints = {d: plain_fingerprint(texts[d], lexicon) for d in order}
    for i, d in enumerate(order):
        of_edited = plain_fingerprint(after[d], lexicon)
        r = result[d]
        assert r["fingerprint"] == plain_text(prints[d]) and r["edited_fingerprint"] == plain_text(of_edited)
        assert abs(r["near_edited"] - plain_likeness(prints[d], of_edited)) < 1e-12
        assert abs(r["near_next"] - plain_likeness(prints[d], prints[order[(i + 1) % n]])) < 1e-12


def test_main_codes_hash_most_terms_and_miss_few_changes(spark, vocabulary):
    """A changed term leaves the code of a subset that lacks it; each subset keeps about three quarters."""
    rnd = random.Random(9)
    own = rnd.sample(vocabulary, 300)
    lexicon = {t for w in vocabulary for t in term_hashes(w)}
    x = plain_fingerprint(" ".join(own), lexicon)
    y = plain_fingerprint(" ".join([*own[:-1], next(w for w in vocabulary if w not in own)]), lexicon)
    assert x[1][0] != y[1][0]
    kept = [sum(1 for t in term_hashes(" ".join(own)) if t >> 2 * k & 3) for k in range(imatch.LEXICONS)]
    assert all(190 < k < 260 for k in kept)


def test_lexicon_is_a_band(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").fillna({"text": ""})
    held = [x for own in imatch.lexicon(df, 0.05, 0.2).first()["lexicon"] for x in own]
    n = len(rows)
    counts = defaultdict(int)
    for r in df.select(imatch.terms(df["text"]).alias("t")).collect():
        for x in set(r["t"]):
            counts[x] += 1
    assert sorted(held) == sorted(x for x, c in counts.items() if max(2, 0.05 * n) <= c <= 0.2 * n)


def test_odd_rows(spark, odd_docs, no_docs, clashing, tmp_path):
    for name, df in (("odd", odd_docs), ("none", no_docs), ("clash", clashing)):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = imatch.op3_imatch(spark, str(tmp_path / name)).collect()
        assert len(got) == df.count()
        assert all(r["fingerprint"] for r in got)


def test_documents_without_id_come_in_many_ranges(spark, tmp_path, vocabulary):
    rnd = random.Random(8)
    texts = sorted({" ".join(rnd.choice(vocabulary) for _ in range(5)) for _ in range(3000)})
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, "with an id")], "doc_id long, text string")
    got = imatch.with_next(df, ["text"], per_range=16)
    order = {r["text"]: r["next_text"] for r in got.collect()}
    at, seen = "with an id", set()
    while at not in seen:
        seen.add(at)
        at = order[at]
    assert len(seen) == len(texts) + 1 and at == "with an id"


def test_one_document_follows_itself(spark, tmp_path):
    spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = imatch.op3_imatch(spark, str(tmp_path)).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert row["near_next"] == 1.0
