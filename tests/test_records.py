from __future__ import annotations

import json
import sys

import pytest
from pyspark.sql import functions as F

from plinth.functions.scalars import local_number, result_hash
from plinth.operators import compare, joins, revenue, stats
from plinth.operators.revenue import RevenueParams
from plinth.sources import records, sinks
from plinth.sources.scratch import delete_path, scratch_path
from plinth.streaming.matrix import configurations, run_matrix
from plinth.streaming.session import RevenueSession

ROWS = [("JAPAN", 1900000), ("INDIA", 900000)]


@pytest.mark.parametrize(
    ("text", "number", "single"),
    [
        ("1.234", 1234.0, 1.234), ("1,234", 1234.0, 1.234), ("1.234.567", 1234567.0, 1234567.0), ("1,234.5", 1234.5, 1234.5), ("1.234,5", 1234.5, 1234.5), ("+5", 5.0, 5.0), ("-7.25", -7.25, -7.25),
        ("1234.567", 1234.567, 1234.567), ("12,5", 12.5, 12.5), ("", 0.0, 0.0), (" 1 234 ", 1234.0, 1234.0), ("1e3", 1000.0, 1000.0), ("5.", 5.0, 5.0), (".5", 0.5, 0.5), ("x", None, None), ("1,23,456", None, None), (None, None, None),
    ],
)
def test_local_numbers(spark, text, number, single):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(local_number(F.col("t")), local_number(F.col("t"), single_decimal=True)).first()) == (number, single)


def test_required_ranges(spark):
    rows = spark.createDataFrame([("setup", "range"), ("request", "kernel")], "name string, kind string")
    assert [r["name"] for r in records.missing_ranges(rows, ["setup", "request"]).collect()] == ["request"]


def test_rows_file():
    good = sinks.rows_csv(ROWS, {"input_rows": 5, "matched_rows": 2})
    assert compare.read_rows_file(good) == (ROWS, result_hash(ROWS), {"input_rows": "5", "matched_rows": "2"})
    assert compare.verify_rows_file(good, ROWS) == []
    assert compare.verify_rows_file("", ROWS) == ["the header must be nation,revenue_1e4,revenue"]
    assert "more rows matched" in compare.verify_rows_file(good.replace("matched_rows,2", "matched_rows,6"), ROWS)[0]
    assert "hash is" in compare.verify_rows_file(good.replace("JAPAN", "CHINA"), ROWS)[0]
    assert "not a row" in compare.verify_rows_file(good.replace("190.00", "190.01"), ROWS)[0]
    assert "metric of its own" in compare.verify_rows_file(good + "input_rows,5\n", ROWS)[0]
    assert compare.verify_rows_file(good, ROWS[:1])[-1].startswith("row 2 is")


def test_gate(spark):
    def broken():
        raise RuntimeError("no device")

    runs = {"a": lambda: ROWS, "b": lambda: ROWS[::-1], "c": broken, "z": lambda: ROWS}
    got = {r["variant"]: (r["status"], r["errors"]) for r in compare.correctness_gate(spark, ROWS, runs, {"a", "b", "c", "d"}).collect()}
    assert got["a"] == ("passed", "") and got["z"][0] == "unexpected" and got["d"] == ("failed", "missing")
    assert got["b"][0] == "failed" and "the rows differ" in got["b"][1] and got["c"] == ("failed", "RuntimeError: no device")


def test_strict_checks_name_what_is_wrong(spark, tiny):
    assert revenue.checked(tiny, RevenueParams()) is tiny
    assert {r["bad"] for r in revenue.strict_checks(tiny, RevenueParams()).collect()} == {0}
    twice = dict(tiny, orders=tiny["orders"].unionByName(tiny["orders"]))
    with pytest.raises(ValueError, match="orders.o_orderkey is not unique"):
        revenue.checked(twice, RevenueParams())
    with pytest.raises(ValueError, match="no region"):
        revenue.checked(tiny, RevenueParams("ATLANTIS"))
    null = dict(tiny, lineitem=tiny["lineitem"].withColumn("l_discount", F.lit(None).cast("decimal(15,2)")))
    with pytest.raises(ValueError, match="price below 0"):
        revenue.checked(null, RevenueParams())


def test_lines_meet_suppliers_before_orders(spark, tiny):
    plan = revenue.matched_lines(tiny, RevenueParams())._jdf.queryExecution().optimizedPlan().toString()
    joins_in_order = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "o_orderkey" in joins_in_order[0] and "s_nationkey" in joins_in_order[0]
    assert any("l_suppkey" in line for line in joins_in_order[1:])


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    build = spark.range(1000).select(F.col("id").alias("key"), F.col("id").alias("payload"))
    assert joins._fits(build)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 999 * 48)
    assert not joins._fits(build)
    assert joins._fits(build.filter("key % 10 = 0"))


def test_strategy_stats(spark):
    build = spark.createDataFrame([(1, 5), (9, 6)], "key long, payload long")
    assert joins.strategy_stats(build, "vj", width=2).first().asDict() == {"payload_width_bytes": 2, "vector_total_bytes": 20}
    assert joins.strategy_stats(build, "sort_merge").first().asDict() == {"sortmerge_buffer_bytes": 32}
    assert joins.strategy_stats(build.filter("false"), "prvj", radix_bits=3).first().asDict() == {"payload_width_bytes": 4, "partition_vector_total_bytes": 0, "partition_count": 8, "radix_bits": 3}
    assert sinks.stats_lines("VJ", {"a": 1, "b": 2}) == "VJ_STATS_CSV_HEADER,a,b\nVJ_STATS_CSV,1,2\n"


@pytest.mark.parametrize("bad", ["", "/etc/x", "../x", "a/../../x", "file:/x"])
def test_unsafe_paths(bad):
    with pytest.raises(ValueError, match="unsafe"):
        sinks.safe_path("/root", bad)
    assert sinks.safe_path("/root/", "a/b.csv") == "/root/a/b.csv"


def test_record_summary_refuses(spark):
    kinds = ", ".join(f"{f} string" for f in stats.GROUP_FIELDS) + ", is_warmup boolean, status string, result_hash string, query_total_ms double"
    row = ["x"] * len(stats.GROUP_FIELDS)
    setup = spark.createDataFrame([("x", 1.0, 2.0, 0.0, 1, 2, 3)], "config_id string, dataset_load_ms double, session_setup_ms double, tune_ms double, resident_host_bytes long, resident_gpu_bytes long, resident_pinned_bytes long")
    of = lambda *ends: spark.createDataFrame([(*row, *end) for end in ends], kinds)
    good = stats.record_summary(of((False, "ok", "h", 4.0), (False, "error", None, 0.0)), setup).first()
    assert (good["success_count"], good["failure_count"], good["median"], good["amortised_10"], good["resident_total_bytes"]) == (1, 1, 4.0, 4.3, 6)
    with pytest.raises(ValueError, match="measured"):
        stats.record_summary(of((True, "ok", "h", 4.0)), setup)
    with pytest.raises(ValueError, match="2 result hashes"):
        stats.record_summary(of((False, "ok", "h", 4.0), (False, "ok", "i", 4.0)), setup)
    with pytest.raises(ValueError, match="2 setups"):
        stats.record_summary(of((False, "ok", "h", 4.0)), setup.unionByName(setup))


def test_identity(spark, tmp_path):
    body = {"git": {"commit": "c"}, "formal_runner": {"git_commit": "c", "matrix_payload": {"experiment_id": "e", "dataset": {"scale_factor": "1", "path": "p", "manifest_sha256": "a" * 64, "expected_hash": "b" * 16}}}}
    (tmp_path / "raw.csv").write_text("experiment_id,scale_factor,cpu_ratio,query_total_ms\ne,1,0.5,3\n")

    def read(**change):
        (tmp_path / "environment.json").write_text(json.dumps(body | change))
        return [tuple(r) for r in records.read_observations(spark, str(tmp_path)).collect()]

    assert read() == [("1", 0.5, 3.0)]
    with pytest.raises(ValueError, match="commit"):
        read(git={"commit": "d"})
    (tmp_path / "raw.csv").write_text("experiment_id,scale_factor,cpu_ratio,query_total_ms\nf,1,0.5,3\n")
    with pytest.raises(ValueError, match="experiment_id"):
        read()


def test_evaluation_files(spark, tmp_path):
    points = spark.createDataFrame([(1, 0.0, 9.0), (1, 1.0, 3.0), (2, 0.0, 1.0)], "scale int, ratio double, p50 double")
    auto = spark.createDataFrame([(1, 3.3), (2, 1.0)], "scale int, auto_ms double")
    sinks.evaluation_files(stats.evaluation(points, auto, spark.createDataFrame([(1, 5.0), (2, 5.0)], "scale int, baseline_ms double")), str(tmp_path / "out"))
    body = json.loads((tmp_path / "out/evaluation.json").read_text())
    assert [x["scale"] for x in body["scales"]] == [1, 2] and body["scales"][0]["break_even"] == [{"lo": 0.0, "hi": 1.0}]
    assert (tmp_path / "out/evaluation.md").read_text().count("\n") == 4
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["evaluation.csv", "evaluation.json", "evaluation.md"]


def test_matrix(tmp_path):
    configs = list(configurations(["/data/sf1"], [1, 8], [None, 0.25]))
    assert [c["config_id"] for c in configs] == ["sf1-plain-t01", "sf1-r0250-t01", "sf1-plain-t08", "sf1-r0250-t08"]
    script = "import json, sys; print(json.dumps({'record_type': 'request', 'is_warmup': False})); sys.exit(int(sys.argv[1]))"
    out = run_matrix(configs[:2], str(tmp_path), command=lambda c: [sys.executable, "-c", script, "0" if c["ratio"] is None else "3"])
    assert [(r["status"], r["requests"]) for r in out] == [("ok", 1), ("error", 0)]
    assert json.loads((tmp_path / "sf1-plain-t01.jsonl").read_text())["config_id"] == "sf1-plain-t01"
    late = run_matrix(configs[:1], str(tmp_path), timeout_s=0.2, command=lambda c: [sys.executable, "-c", "import time; time.sleep(60)"])
    assert late[0]["status"] == "timeout" and len(json.loads((tmp_path / "matrix.json").read_text())) == 1


def test_session_setup_and_share(spark, tiny):
    session = RevenueSession(tiny, RevenueParams(), ratio=0.5)
    assert session.setup()["resident_host_bytes"] > 100
    assert [r["nation"] for r in session.execute()["rows"]] == ["JAPAN", "INDIA"]
    session.close()


def test_scratch_paths(spark, tmp_path):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    delete_path(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
