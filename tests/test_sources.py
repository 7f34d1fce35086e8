from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.scalars import result_hash
from plinth.operators import stats, validate
from plinth.operators.compare import first_mismatch, missing_and_extra, numbered
from plinth.operators.revenue import RevenueParams, regional_revenue
from plinth.sources import dataset, records, sinks, text
from plinth.sources.tables import CONTRACT

TBL = {
    "region": ["0|AFRICA|x|", "1|AMERICA|x|", "2|ASIA|x|", "", "3|EUROPE|x|", "4|MIDDLE EAST|x|"],
    "nation": ["1|ARGENTINA|1|x|", "8|INDIA|2|x|", "9|INDONESIA|2|x|", "12|JAPAN|2|x|"],
    "supplier": ["1|a|b|8|", "2|a|b|12|", "3|a|b|1|"],
    "customer": ["10|a|b|8|", "20|a|b|12|", "30|a|b|9|", "40|a|b|1|"],
    "orders": ["100|10|O|1.0|1994-02-01|", "101|20|O|1.0|1994-06-01|", "102|10|O|1.0|1993-06-01|", "103|40|O|1.0|1994-03-01|", "104|30|O|1.0|1994-05-01|"],
    "lineitem": ["100|1|1|1|1|100.00|0.10|", "100|1|2|1|1|50.00|0.00|", "101|1|2|1|1|200.00|0.05|", "102|1|1|1|1|300.00|0.00|", "103|1|3|1|1|120.00|0.00|", "104|1|1|1|1|80.00|0.00|"],
}


@pytest.fixture
def folder(tmp_path):
    for name, lines in TBL.items():
        (tmp_path / f"{name}.tbl").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_tbl(spark, folder):
    tables = text.read_tbl_dataset(spark, str(folder))
    got = [(r[0], r[1]) for r in regional_revenue(tables, RevenueParams()).collect()]
    assert result_hash(got) == "248d10b6ee352953"
    assert {n: df.schema.names for n, df in tables.items()} == {n: c.names for n, c in CONTRACT.items()}


@pytest.mark.parametrize(("table", "line"), [("nation", "1|X|"), ("orders", "1|2|O|1|1994-02-30|"), ("lineitem", "1|1|1|1|1|1.005|0.1|"), ("region", "x|ASIA|")])
def test_bad_tbl_lines_raise(spark, folder, table, line):
    (folder / f"{table}.tbl").write_text(line + "\n")
    with pytest.raises(Exception):  # noqa: B017
        text.read_tbl(spark, str(folder / f"{table}.tbl"), table).collect()


@pytest.mark.parametrize("mark", [" ", ",", "|"])
def test_relation_text(spark, tmp_path, mark):
    path = tmp_path / "r.txt"
    path.write_text("#KEY, VAL\n" + "".join(f"{k}{mark}{v}\n" for k, v in ((3, 0), (1, 1), (2, 2))))
    assert [tuple(r) for r in text.read_relation(spark, str(path), 2).collect()] == [(3, 0), (1, 1)]


def test_relation_keys_alone_and_round_trip(spark, tmp_path):
    (tmp_path / "k.txt").write_text("#KEY\n5\n6\n")
    assert [tuple(r) for r in text.read_relation(spark, str(tmp_path / "k.txt"), 9).collect()] == [(5, 0), (6, 0)]
    df = spark.createDataFrame([(7, 0), (8, 1), (9, 2)], "key long, payload long")
    text.write_relation(df, str(tmp_path / "out"))
    assert "#KEY, VAL" in next((tmp_path / "out").glob("part-*")).read_text()
    assert sorted(map(tuple, text.read_relation(spark, str(tmp_path / "out")).collect())) == [(7, 0), (8, 1), (9, 2)]


def test_arrow_dataset(spark, tiny, tmp_path):
    folder = str(tmp_path / "ds")
    manifest = dataset.write_arrow_dataset(tiny, folder, batch_rows=2)
    assert manifest["tables"]["lineitem"]["record_batches"] == 3
    got = [(r[0], r[1]) for r in regional_revenue(dataset.read_arrow_dataset(spark, folder), RevenueParams()).collect()]
    assert result_hash(got) == "248d10b6ee352953"
    with pytest.raises(FileExistsError):
        dataset.write_arrow_dataset(tiny, folder)
    dataset.write_arrow_dataset(tiny, folder, replace=True)
    hashes = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in dataset.file_hashes(spark, f"{folder}/*.arrow").collect()}
    assert hashes["region.arrow"] == dataset.read_manifest(folder)["tables"]["region"]["sha256"]


class _Counted:
    """The most bytes that Arrow held in this process since the start, the driver's own rows among them."""

    def __enter__(self):
        self.before = pa.default_memory_pool()
        self.pool = pa.proxy_memory_pool(self.before)
        pa.set_memory_pool(self.pool)
        return self.pool

    def __exit__(self, *_):
        pa.set_memory_pool(self.before)


@pytest.fixture(scope="module")
def many(tiny):
    """The small tables with 900 000 lines, 36 MB in an Arrow file."""
    return dict(tiny, lineitem=tiny["lineitem"].crossJoin(tiny["region"].sparkSession.range(0, 150_000, 1, 6)).drop("id"))


def test_arrow_dataset_is_written_within_bounds(many, tmp_path):
    with _Counted() as pool:
        manifest = dataset.write_arrow_dataset(many, str(tmp_path / "ds"), batch_rows=1000)
    assert manifest["tables"]["lineitem"]["rows"] == 900_000 and manifest["tables"]["lineitem"]["record_batches"] == 900
    assert manifest["tables"]["lineitem"]["bytes"] > 36e6 and pool.max_memory() < 12e6
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ds"] and len(list((tmp_path / "ds").iterdir())) == 7


def test_arrow_dataset_is_read_by_the_executors(spark, many, tmp_path, monkeypatch):
    folder = str(tmp_path / "ds")
    dataset.write_arrow_dataset(many, folder)
    monkeypatch.setattr(dataset, "TASK_BYTES", 10_000_000, raising=False)
    with _Counted() as pool:
        read = dataset.read_arrow_dataset(spark, folder)
        found = regional_revenue(read, RevenueParams()).collect()
    assert pool.max_memory() < 12e6
    assert [tuple(r) for r in found] == [("JAPAN", 1900000 * 150_000), ("INDIA", 900000 * 150_000)]
    assert read["lineitem"].rdd.getNumPartitions() == 4 and read["lineitem"].count() == 900_000


def test_arrow_dataset_keeps_the_rows_order(spark, tiny, tmp_path):
    wanted = spark.range(0, 1000, 1, 7).select(F.col("id").cast("int").alias("o_orderkey"), F.lit(10).alias("o_custkey"), F.lit("1994-02-01").cast("date").alias("o_orderdate"))
    for rows in (7, 999, 5000):
        entry = dataset.write_arrow_dataset(dict(tiny, orders=wanted), str(tmp_path / str(rows)), batch_rows=rows)["tables"]["orders"]
        assert entry["record_batches"] == -(-1000 // rows)
        assert dataset.read_arrow_dataset(spark, str(tmp_path / str(rows)))["orders"].collect() == wanted.collect()
    with pytest.raises(ValueError, match="positive"):
        dataset.write_arrow_dataset(tiny, str(tmp_path / "none"), batch_rows=0)


def test_arrow_files_of_uneven_and_empty_batches(spark, tiny, tmp_path):
    folder = tmp_path / "ds"
    manifest = dataset.write_arrow_dataset(dict(tiny, customer=tiny["customer"].limit(0)), str(folder))
    assert manifest["tables"]["customer"]["record_batches"] == 0
    path, keys = folder / "supplier.arrow", []
    schema = pa.schema([("s_suppkey", pa.int32()), ("s_nationkey", pa.int32())])
    with pa.ipc.new_file(str(path), schema) as out:
        for n in (0, 3, 0, 0, 1, 5, 0):
            own = list(range(len(keys), len(keys) + n))
            out.write_batch(pa.record_batch([pa.array(own, pa.int32())] * 2, schema=schema))
            keys += own
    entry = manifest["tables"]["supplier"]
    manifest["tables"]["supplier"] = entry | {"rows": 9, "record_batches": 7, "schema": str(schema), "bytes": path.stat().st_size, "sha256": dataset.sha256_file(path)}
    (folder / "manifest.json").write_text(json.dumps(manifest))
    read = dataset.read_arrow_dataset(spark, str(folder))
    assert [tuple(r) for r in read["supplier"].collect()] == [(k, k) for k in keys] and read["customer"].collect() == []
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(Exception, match="another file"):
        read["supplier"].collect()


def test_rows_that_the_driver_does_not_find_raise(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(dataset, "_parts", lambda folder: iter(()))
    with pytest.raises(ValueError, match="share the folder"):
        dataset.write_arrow_dataset(tiny, str(tmp_path / "ds"))
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="has nulls"):
        monkeypatch.undo()
        dataset.write_arrow_dataset(dict(tiny, nation=tiny["nation"].withColumn("n_name", F.nullif("n_name", F.lit("INDIA")))), str(tmp_path / "ds"))


def test_tampering_is_found(spark, tiny, tmp_path):
    folder = tmp_path / "ds"
    dataset.write_arrow_dataset(tiny, str(folder))
    path = folder / "orders.arrow"
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="checksum"):
        dataset.verify_dataset(str(folder))
    for change, what in (({"format_version": 2}, "format_version"), ({"tables": {}}, "six tables")):
        good = dataset.read_manifest(str(folder))
        (folder / "manifest.json").write_text(json.dumps(good | change))
        with pytest.raises(ValueError, match=what):
            dataset.read_manifest(str(folder))
        (folder / "manifest.json").write_text(json.dumps(good))
    (folder / "manifest.json").write_text('{"format_version": 1, "format_version": 1}')
    with pytest.raises(ValueError, match="twice"):
        dataset.read_manifest(str(folder))


def test_failed_replace_keeps_the_old_dataset(spark, tiny, tmp_path):
    folder = str(tmp_path / "ds")
    before = dataset.write_arrow_dataset(tiny, folder)
    with pytest.raises(Exception):  # noqa: B017
        dataset.write_arrow_dataset(dict(tiny, orders=tiny["orders"].drop("o_orderdate")), folder, replace=True)
    assert dataset.verify_dataset(folder) == before


def test_parquet_dataset(spark, tiny, tmp_path):
    dataset.write_parquet_dataset(tiny, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/lineitem.parquet")).count() == 6


def test_session_records(spark, tmp_path):
    request = {"session_id": "a", "status": "ok", "result_hash": "0" * 16, "input_lineitem_rows": 6, "matched_lineitem_rows": 2}
    lines = sinks.session_jsonl({"session_id": "a"}, [request | {"request_index": i, "is_warmup": i < 1} for i in range(3)])
    (tmp_path / "s.jsonl").write_text(lines)
    setups, requests = records.read_session(spark, str(tmp_path / "s.jsonl"))
    assert setups.count() == 1 and requests.count() == 3
    assert records.session_faults(setups, requests).count() == 0
    broken = requests.withColumn("result_hash", F.lpad(F.col("request_index").cast("string"), 16, "0")).withColumn("matched_lineitem_rows", F.lit(7).cast("bigint"))
    faults = {r["fault"] for r in records.session_faults(setups.unionByName(setups), broken.filter("request_index <> 1").unionByName(broken.filter("request_index = 2"))).collect()}
    assert faults == {"setup rows", "request numbers", "result hash", "counters"}


def test_strict_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "ok.csv").write_text("a,b\n1,x\n")
    assert records.read_strict_csv(spark, str(tmp_path / "ok.csv"), schema).count() == 1
    (tmp_path / "bad.csv").write_text("b,a\nx,1\n")
    with pytest.raises(ValueError, match="header"):
        records.read_strict_csv(spark, str(tmp_path / "bad.csv"), schema)


def test_profiler_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("Total Time (ns);Count;Name\n1.234,5;2;[CUDA memcpy HtoD]\n10;1;kernel_a\n5;1;:range\n")
    got = {r["name"]: (r["kind"], r["total"]) for r in records.read_profiler_csv(spark, str(tmp_path / "n.csv")).collect()}
    assert got == {"[CUDA memcpy HtoD]": ("memcpy", 1234.5), "kernel_a": ("kernel", 10.0), ":range": ("range", 5.0)}


def test_kernel_metrics(spark):
    rows = spark.createDataFrame([("k1", "m", 1.0), ("k1", "n", 2.0), ("other", "m", 5.0)], "kernel string, metric string, value double")
    assert records.kernel_metrics(rows, "k1").first().asDict() == {"kernel": "k1", "m": 1.0, "n": 2.0}
    with pytest.raises(ValueError, match="one kernel"):
        records.kernel_metrics(rows, "none")
    with pytest.raises(ValueError, match="several values"):
        records.kernel_metrics(rows.unionByName(spark.createDataFrame([("k1", "m", 9.0)], rows.schema)), "k1")


def test_sinks(spark, tmp_path):
    rows = [("JAPAN", 1900000), ("INDIA", 900000)]
    assert sinks.rows_csv(rows, {"total_ms": 1}) == "nation,revenue_1e4,revenue\nJAPAN,1900000,190.00\nINDIA,900000,90.00\nresult_hash,248d10b6ee352953\ntotal_ms,1\n"
    assert json.loads(sinks.result_json([('A"\n\\', 1)]))["rows"][0]["nation"] == 'A"\n\\'
    assert sinks.benchmark_csv({"a": 1, "b": "x,y"}) == 'a,b\n1,"x,y"\n'
    sinks.write_atomically(str(tmp_path / "x.json"), "{}")
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]
    df = spark.createDataFrame([(1, 2)], "r_payload long, s_payload long")
    sinks.write_rid_pairs(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "1 2"
    assert sinks.markdown(df) == "| r_payload | s_payload |\n| --- | --- |\n| 1 | 2 |\n"
    sinks.compact_csv(df, ["r_payload"], str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no such"):
        sinks.compact_csv(df, ["zz"], str(tmp_path / "d"))


def test_validation(spark, tiny):
    report = {r["check"]: r["value"] for r in validate.validation_report(tiny, RevenueParams()).collect()}
    assert report["rows_lineitem"] == 6 and report["orders_in_window"] == 4 and report["nations_in_region"] == 3
    assert validate.duplicate_keys(tiny["supplier"], "s_suppkey").count() == 0
    assert validate.schema_differences(tiny["region"], CONTRACT["region"]) == ["r_regionkey may be null", "r_name may be null"]
    assert {r["nulls"] for r in validate.null_report(tiny).collect()} == {0}


def test_compare(spark):
    a = numbered(spark.createDataFrame([("x", 1), ("y", 2)], "n string, v int"), "n")
    b = numbered(spark.createDataFrame([("x", 1), ("y", 3), ("z", 4)], "n string, v int"), "n")
    assert tuple(first_mismatch(a, b, ["n", "v"]).first()) == (2, "v", "2", "3")
    assert first_mismatch(a, a, ["n", "v"]).count() == 0
    assert missing_and_extra({"a", "b"}, {"b", "c"}) == (["a"], ["c"])


def test_regret_of_a_best_of_zero(spark):
    points = spark.createDataFrame([(1, 0.5, 0.0), (1, 0.25, 0.0)], "scale int, ratio double, p50 double")
    auto = spark.createDataFrame([(1, 2.0)], "scale int, auto_ms double")
    row = stats.best_and_regret(points, auto).first()
    assert (row["best_ratio"], row["regret_ms"], row["regret_percent"]) == (0.25, 2.0, None)


def test_prepare_tbl(folder, tmp_path):
    made = dataset.prepare_tbl(str(folder), str(tmp_path / "copy"))
    assert made["tables"]["region"]["rows"] == 5
    linked = dataset.prepare_tbl(str(folder), str(tmp_path / "linked"), link=True)
    assert linked == made and (tmp_path / "linked/region.tbl").is_symlink()


def test_audited_result(tmp_path):
    body = sinks.audited_result(str(tmp_path / "o.json"), "select 1", [("JAPAN", 1900000), ("INDIA", 900000)], {"b": "2", "a": "1"})
    assert json.loads((tmp_path / "o.json").read_text()) == body
    assert body["result_hash"] == "248d10b6ee352953" and list(body["tables"]) == ["a", "b"]


def test_observations(spark, tmp_path):
    (tmp_path / "sf1").mkdir()
    requests = [{"status": "ok", "is_warmup": i == 0, "selected_cpu_ratio": 0.5, "query_total_ms": float(i), "request_index": i} for i in range(4)]
    (tmp_path / "sf1/s.jsonl").write_text(sinks.session_jsonl({}, requests))
    (tmp_path / "summary.csv").write_text("scale_factor,cpu_ratio,request_median_ms\n1,0.25,3.5\n1,,9\n")
    (tmp_path / "raw.csv").write_text("scale_factor,cpu_ratio,query_total_ms\n1,0.25,3\n1,0.25,5\n")
    (tmp_path / "bad.csv").write_text("a\n1\n")
    read = lambda name: [tuple(r) for r in records.read_observations(spark, str(tmp_path / name)).collect()]
    assert read("sf1/s.jsonl") == [("sf1", 0.5, 2.0)]
    assert read("summary.csv") == [("1", 0.25, 3.5)]
    assert read("raw.csv") == [("1", 0.25, 4.0)]
    with pytest.raises(ValueError, match="neither"):
        read("bad.csv")


def test_monitor():
    import sys

    from plinth.streaming.monitor import monitored

    good = monitored([sys.executable, "-c", "x = b'1' * 50_000_000; import time; time.sleep(0.3); print('done')"])
    assert (good.status, good.stdout) == ("ok", "done\n") and good.peak_kb > 40_000
    assert monitored([sys.executable, "-c", "raise SystemExit(3)"]).returncode == 3
    assert monitored([sys.executable, "-c", "import time; time.sleep(60)"], timeout_s=0.2).status == "timeout"
    stubborn = "import signal, time; signal.signal(signal.SIGTERM, signal.SIG_IGN); print('x', flush=True); time.sleep(60)"
    assert monitored([sys.executable, "-c", stubborn], timeout_s=0.5, grace_s=0.3).returncode == -9


def test_evaluation(spark):
    points = spark.createDataFrame([(1, 0.0, 9.0), (1, 0.5, 3.0), (1, 1.0, 6.0)], "scale int, ratio double, p50 double")
    row = stats.evaluation(points, spark.createDataFrame([(1, 3.3)], "scale int, auto_ms double"), spark.createDataFrame([(1, 5.0)], "scale int, baseline_ms double")).first()
    assert (row["best_ratio"], round(row["regret_percent"], 6)) == (0.5, 10.0)
    assert [tuple(x) for x in row["break_even"]] == [(0.0, 0.5), (0.5, 1.0)]
