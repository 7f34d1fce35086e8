from __future__ import annotations

import random

import pytest

from plinth.llm.line_dedup import dedup_lines


def brute(rows):
    """rows of (doc_id, text) in order of doc_id: {doc_id: (text, n_lines, n_removed)}."""
    seen, gone = {}, {}
    for d, text in rows:
        lines = [] if text is None else text.split("\n")
        gone[d] = set()
        for p in range(len(lines) - 2):
            key = tuple(x.strip(" \t\r") for x in lines[p : p + 3])
            if not any(key):
                continue
            if seen.setdefault(key, (d, p)) != (d, p):
                gone[d] |= {p, p + 1, p + 2}
    out = {}
    for d, text in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for i, x in enumerate(lines) if i not in gone[d]]
        out[d] = (None if text is None else "\n".join(left), len(lines), len(gone[d]))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    lines = [f"line {i}" for i in range(12)] + ["", "  ", "\t"]
    out = [(i, "\n".join(rnd.choice(lines) + rnd.choice(["", " ", "\r"]) for _ in range(rnd.randint(0, 14)))) for i in range(150)]
    boiler = "\n".join(f"boiler {i}" for i in range(8))
    out += [(200 + i, f"own {i}\n{boiler}\nend {i}") for i in range(40)]
    return out + [(900, None), (901, ""), (902, "a\nb"), (903, "a\nb"), (904, "a\nb\nc\na\nb\nc\na\nb\nc")]


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(df).collect()}
    assert got == brute(rows)
    assert got[904][0] == "a\nb\nc"


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    got = dedup_lines(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["n_removed"] == 0 for r in got)  # repeated rows are one document
    assert dedup_lines(no_docs).count() == 0
    assert dedup_lines(clashing).count() == clashing.count()


def test_repeated_rows_are_treated_alike(spark):
    text = "a\nb\nc\nd"
    got = dedup_lines(spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 4), (1, 4), (2, 4)]
