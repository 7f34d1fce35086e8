from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plinth.operators import joins
from plinth.sources import generate

NODES = {"broadcast": "BroadcastHashJoin", "shuffle_hash": "ShuffledHashJoin", "merge": "SortMergeJoin"}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", joins.STRATEGIES)
def test_pk_fk(spark, name):
    r, s = generate.pk_relation(spark, 1024, seed=12345), generate.fk_relation(spark, 4096, 1024)
    df = joins.join_count(r, s, name)
    assert df.first()["matches"] == 4096
    assert NODES[joins.STRATEGIES[name].hint] in final_plan(df)


@pytest.mark.parametrize("name", [n for n, s in joins.STRATEGIES.items() if not s.unique])
def test_duplicates_multiply(spark, name):
    r = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "key long, payload long")
    s = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 8)], "key long, payload long")
    got = sorted(map(tuple, joins.join_relations(r, s, name).collect()))
    assert got == [(10, 5), (10, 6), (11, 5), (11, 6), (20, 7)]


@pytest.mark.parametrize("name", ["vj", "prvj"])
def test_contract_of_dense_joins(spark, name):
    s = spark.createDataFrame([(1, 5), (-1, 6)], "key long, payload long")
    assert joins.join_count(spark.createDataFrame([(1, 1)], "key long, payload long"), s, name).first()["matches"] == 1
    with pytest.raises(ValueError, match="unique"):
        joins.join_count(spark.createDataFrame([(1, 1), (1, 2)], "key long, payload long"), s, name)
    for bad in ((-1, 1), (1, -1)):
        with pytest.raises(ValueError, match="0 or more"):
            joins.join_count(spark.createDataFrame([bad], "key long, payload long"), s, name)


def test_broadcast_only_up_to_a_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    df = joins.join_count(generate.pk_relation(spark, 100), generate.fk_relation(spark, 200, 100), "npo")
    assert df.first()["matches"] == 200
    assert "ShuffledHashJoin" in final_plan(df)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "key long, payload long")
    one = spark.createDataFrame([(1, 1)], "key long, payload long")
    for name in joins.STRATEGIES:
        assert joins.join_count(none, one, name).first()["matches"] == 0
        assert joins.join_count(one, none, name).first()["matches"] == 0


@pytest.mark.parametrize("mode", joins.STAR_MODES)
def test_star(spark, mode):
    data = generate.star_data(spark, lineorder=6000, orders=1500, partsupp=800)
    assert tuple(joins.star_join(data, mode).first()) == (6000, 18000)
    with pytest.raises(ValueError, match="unique"):
        joins.star_join(dict(data, orders=data["orders"].unionByName(data["orders"])), mode)


def test_star_narrow(spark):
    data = generate.star_data(spark, lineorder=100, orders=100, partsupp=100)
    data["orders"] = data["orders"].withColumn("payload", F.lit(300).cast("bigint"))
    assert joins.star_join(data, "vj", 1).first()["aggregate_sum"] == 100 * 44
    assert joins.star_join(data, "vj", 2).first()["aggregate_sum"] == 100 * 300


def test_generators(spark):
    assert sorted(r["key"] for r in generate.pk_relation(spark, 50, seed=3).collect()) == list(range(1, 51))
    counts = {r["key"]: r["count"] for r in generate.fk_relation(spark, 100, 30).groupBy("key").count().collect()}
    assert set(counts.values()) == {3, 4} and len(counts) == 30
    assert generate.fk_from_pk(generate.pk_relation(spark, 7), 20).groupBy("key").count().agg(F.max("count")).first()[0] == 3
    uniform = generate.uniform_relation(spark, 1000, 10).agg(F.min("key"), F.max("key")).first()
    assert tuple(uniform) == (0, 9)


def test_zipf(spark):
    n = 20000
    drawn = {r["key"]: r["count"] for r in generate.zipf_relation(spark, n, 50, 1.0).groupBy("key").count().collect()}
    total = sum(1 / k for k in range(1, 51))
    assert min(drawn) == 1 and max(drawn) == 50
    for k in (1, 2, 10):
        assert abs(drawn[k] / n - 1 / k / total) < 0.02
