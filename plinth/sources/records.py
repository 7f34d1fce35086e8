"""Benchmark record sources: session JSON lines, strict CSV, profiler CSV."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.scalars import local_number

_BIGINTS = lambda *names: [T.StructField(n, T.LongType()) for n in names]
_DOUBLES = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]
_TEXTS = lambda *names: [T.StructField(n, T.StringType()) for n in names]

#: Columns of the session file's two kinds of rows, fixed values.
SETUP = T.StructType(
    [
        *_TEXTS("record_type", "session_id", "lifecycle", "status", "error_class", "engine", "dataset", "region", "date"),
        *_BIGINTS("threads", "warmup", "repeat", "resident_host_bytes", "resident_gpu_bytes", "resident_pinned_bytes"),
        *_DOUBLES("dataset_load_ms", "session_setup_ms", "plan_build_ms", "host_staging_ms", "allocation_ms", "initial_h2d_ms", "tune_ms", "selected_cpu_ratio", "predicted_cpu_ratio"),
    ]
)
REQUEST = T.StructType(
    [
        *_TEXTS("record_type", "session_id", "lifecycle", "status", "error_class", "error_message", "result_hash"),
        *_BIGINTS("request_index", "result_rows", "input_lineitem_rows", "matched_lineitem_rows", "cpu_input_rows", "gpu_input_rows", "h2d_bytes", "d2h_bytes", "mapped_remote_read_bytes"),
        T.StructField("is_warmup", T.BooleanType()),
        T.StructField("rows", T.ArrayType(T.StructType([*_TEXTS("nation"), *_BIGINTS("revenue_1e4")]))),
        *_DOUBLES("selected_cpu_ratio", "query_total_ms", "build_ms", "scan_ms", "h2d_ms", "kernel_ms", "d2h_ms", "cpu_ms", "gpu_ms", "overlap_wall_ms"),
    ]
)


def read_session(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(setups, requests) of a session file; malformed lines raise."""

    def of(schema: T.StructType, kind: str) -> DataFrame:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path).filter(F.col("record_type") == kind)

    return of(SETUP, "session_setup"), of(REQUEST, "request")


def session_faults(setups: DataFrame, requests: DataFrame) -> DataFrame:
    """session_id, fault: sessions without one setup row, gaps in numbering, unstable hashes, broken counters."""
    once = setups.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").select("session_id", F.lit("setup rows").alias("fault"))
    lost = requests.join(setups, "session_id", "left_anti").select("session_id", F.lit("no setup row").alias("fault")).distinct()
    by = requests.groupBy("session_id", "is_warmup").agg(F.count(F.lit(1)).alias("n"), F.min("request_index").alias("lo"), F.max("request_index").alias("hi"), F.count_distinct("request_index").alias("d"))
    gaps = by.filter("hi - lo + 1 <> n or d <> n").select("session_id", F.lit("request numbers").alias("fault"))
    hashes = requests.filter("status = 'ok'").groupBy("session_id").agg(F.count_distinct("result_hash").alias("n")).filter("n > 1").select("session_id", F.lit("result hash").alias("fault"))
    wrong = (F.col("matched_lineitem_rows") > F.col("input_lineitem_rows")) | ((F.col("status") == "ok") & ~F.coalesce(F.rlike(F.col("result_hash"), F.lit("^[0-9a-f]{16}$")), F.lit(False)))
    broken = requests.filter(wrong).select("session_id", F.lit("counters").alias("fault")).distinct()
    return once.unionByName(lost).unionByName(gaps).unionByName(hashes).unionByName(broken)


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must equal the schema's names, and whose values must fit its types."""
    header = spark.read.text(path).first()
    names = header["value"].split(",") if header else []
    if names != schema.names:
        raise ValueError(f"header is {names}, not {schema.names}")
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")


def read_profiler_csv(spark: SparkSession, path: str) -> DataFrame:
    """report, name, kind, total, average, instances, time_percent: rows of a profiler's summary.

    Comma- or semicolon-separated, with numbers of any locale; headers count by their letters
    and digits alone. A row with a range's name is a range, a colon before it is dropped; the
    kind of any other row is told from the report, which is the file's name, and its own name.
    """
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    head = lines.first()
    if head is None:
        raise ValueError(f"{path}: no rows")
    mark = ";" if head["value"].count(";") > head["value"].count(",") else ","
    raw = spark.read.csv(path, header=True, sep=mark)
    report = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    names = {"".join(x for x in c.lower() if x.isalnum()): F.col(f"`{c}`") for c in raw.columns}

    def value(*headers: str) -> Column:
        return F.coalesce(*[names[h] for h in headers if h in names], F.lit(""))

    own = F.regexp_replace(value("range", "rangename"), "^:", "")
    name = F.when(own != "", own).otherwise(value("operation", "name"))
    return raw.select(
        F.lit(report).alias("report"),
        name.alias("name"),
        F.when(own != "", F.lit("range")).otherwise(row_kind(name, report)).alias("kind"),
        local_number(value("totaltimens", "durationns")).alias("total"),
        local_number(value("averagens", "averagetimens")).alias("average"),
        local_number(value("instances", "calls")).alias("instances"),
        local_number(value("time", "timepercent"), single_decimal=True).alias("time_percent"),
    )


def row_kind(name: Column, report: str = "") -> Column:
    """memcpy, kernel, range or other by the names of a profiler's row and report."""
    low = F.lower(F.concat(F.lit(report + " "), name))
    return (
        F.when(F.contains(low, F.lit("mem")) & F.contains(low, F.lit("cpy")), "memcpy")
        .when(F.contains(low, F.lit("kern")) | F.contains(F.lower(name), F.lit("void ")), "kernel")
        .when(F.contains(low, F.lit("nvtx")) | F.contains(low, F.lit("range")), "range")
        .otherwise("other")
    )


def missing_ranges(rows: DataFrame, required: list[str]) -> DataFrame:
    """name: required ranges that the profiler's rows lack."""
    wanted = rows.sparkSession.createDataFrame([(x,) for x in required], "name string")
    return wanted.join(rows.filter("kind = 'range'"), "name", "left_anti").distinct()


def kernel_metrics(long_rows: DataFrame, kernel: str) -> DataFrame:
    """One row of metrics (kernel, metric, value as rows) of the one kernel whose name holds `kernel`.

    Raises when no or several kernels fit, or a metric has two values.
    """
    own = long_rows.filter(F.contains("kernel", F.lit(kernel)))
    if own.select("kernel").distinct().count() != 1:
        raise ValueError(f"not exactly one kernel holds {kernel!r}")
    if not own.groupBy("metric").agg(F.count_distinct("value").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a metric has several values")
    return own.groupBy("kernel").pivot("metric").agg(F.first("value"))


def read_identity(spark: SparkSession, folder: str) -> dict[str, str]:
    """experiment_id, scale_factor, dataset, manifest_sha256, expected_hash and commit of a folder's environment.json."""
    body = json.loads(spark.read.text(f"{folder}/environment.json", wholetext=True).first()["value"])
    runner = body["formal_runner"]
    matrix = runner["matrix_payload"]
    own = matrix["dataset"]
    found = {
        "experiment_id": matrix["experiment_id"],
        "scale_factor": own["scale_factor"],
        "dataset": own["path"],
        "manifest_sha256": own["manifest_sha256"],
        "expected_hash": own["expected_hash"],
        "commit": body["git"]["commit"],
    }
    if found["commit"] != runner["git_commit"]:
        raise ValueError("the environment's commit is not the runner's")
    for key, digits in (("manifest_sha256", 64), ("expected_hash", 16)):
        if not re.fullmatch(f"[0-9a-f]{{{digits}}}", str(found[key])):
            raise ValueError(f"{key} must be {digits} hex digits in lower case")
    return {k: str(v) for k, v in found.items()}


def check_identity(rows: DataFrame, identity: dict[str, str]) -> None:
    """Raise ValueError where a record names another experiment, scale or dataset than its folder does."""
    for key in ("experiment_id", "scale_factor", "dataset"):
        if key in rows.columns and not rows.filter(F.col(key).cast("string") != identity[key]).isEmpty():
            raise ValueError(f"a record's {key} is not {identity[key]!r}")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """scale, ratio, p50 of fixed-share runs from a session file, a summary CSV or a raw CSV.

    A `.jsonl` file gives the median of its measured requests by selected_cpu_ratio;
    a CSV with a column request_median_ms is a summary, one with query_total_ms raw
    records. The scale of a session file is the name of its folder. A folder with an
    environment.json gives its raw.csv or session.jsonl, after check_identity.
    """
    if not path.endswith((".jsonl", ".csv")):
        identity = read_identity(spark, path)
        try:
            raw = spark.read.csv(f"{path}/raw.csv", header=True)
        except AnalysisException:
            out = read_observations(spark, f"{path}/session.jsonl")
            return out.withColumn("scale", F.lit(identity["scale_factor"]))
        check_identity(raw, identity)
        return read_observations(spark, f"{path}/raw.csv")
    if path.endswith(".jsonl"):
        scale = path.rstrip("/").split("/")[-2] if path.count("/") else ""
        measured = read_session(spark, path)[1].filter("not is_warmup and status = 'ok'")
        return measured.groupBy(F.lit(scale).alias("scale"), F.col("selected_cpu_ratio").alias("ratio")).agg(F.percentile("query_total_ms", F.lit(0.5)).alias("p50"))
    raw = spark.read.csv(path, header=True)
    scale = F.col("scale_factor").cast("string").alias("scale")
    if "request_median_ms" in raw.columns:
        return raw.filter("cpu_ratio is not null").select(scale, F.col("cpu_ratio").cast("double").alias("ratio"), F.col("request_median_ms").cast("double").alias("p50"))
    if "query_total_ms" in raw.columns:
        return raw.groupBy(scale, F.col("cpu_ratio").cast("double").alias("ratio")).agg(F.percentile(F.col("query_total_ms").cast("double"), F.lit(0.5)).alias("p50"))
    raise ValueError(f"{path}: neither a summary nor raw records")
