from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plinth.llm.mixing import mix, schedule, source_targets


def fill(sizes, weights, total, most=3):
    """Targets by sharing anew what is above the stops until none is."""
    target, open_ = {}, dict(zip(sizes, weights, strict=True))
    left = total
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s, x in share.items() if x > most * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            del open_[s]
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 5, "d": 0, "e": 700}, {"a": 100, "b": 1, "c": 1, "d": 1}, {"a": 7}])
def test_targets(spark, sizes):
    rows = [(f"s{s}", s, n) for s, n in sizes.items()]
    got = {r["skey"][1:]: r["target"] for r in source_targets(spark.createDataFrame(rows, "skey string, source string, size long")).collect()}
    want = fill(sizes, [i % 3 + 1 for i in range(len(sizes))], sum(sizes.values()))
    assert got.keys() == want.keys()
    for s, x in want.items():
        assert abs(got[s] - x) < 1e-6


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 37), None if i % 10 == 9 else f"s{i % 10 if i % 2 else 0}") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_targets(docs):
    got = mix(docs)
    by = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s"), F.sum("size").alias("own")).collect()
    for r in by:
        assert 0 <= r["g"] - r["t"] < 1 and r["own"] == r["s"]
    total = got.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[0] - total[1]) <= len(by)
    assert got.filter("taken > 3 * size or taken < 0").count() == 0


def test_reruns_and_partitions_agree(docs):
    a = {r["doc_id"]: r["taken"] for r in mix(docs).collect()}
    assert a == {r["doc_id"]: r["taken"] for r in mix(docs.repartition(9, "text")).collect()}


def test_schedule_is_fair(docs):
    """At any virtual time every source has been served its share, up to one document."""
    served = schedule(mix(docs)).select("source", "finish", "taken", "target", "size").collect()
    assert [r["finish"] for r in served] == sorted(r["finish"] for r in served)
    assert max(r["finish"] for r in served) <= 1 + 1e-9


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    plain = odd_docs.withColumn("source", F.lit(None).cast("string"))
    got = mix(plain).collect()
    assert len(got) == odd_docs.count() and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    assert mix(no_docs.withColumn("source", F.lit("x"))).count() == 0
    out = mix(clashing)
    assert out.count() == clashing.count() and dict(out.dtypes)["size"] == "bigint"
    assert sorted(out.columns) == sorted(set(clashing.columns) | {"size", "source_size", "target", "taken", "finish"})
    none = mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string"))
    assert [r["taken"] for r in none.collect()] == [0, 0]


def test_budget(docs):
    got = mix(docs, budget=5000).agg(F.sum("taken")).first()[0]
    assert 4990 <= got <= 5000
