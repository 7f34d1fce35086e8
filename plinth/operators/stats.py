"""Statistics of benchmark records: summaries, amortised cost, regret, break-even."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMORTISE_OVER = (1, 10, 100)
#: Differences of two curves within this count as a crossing point.
SAME = 1e-12


def summary(df: DataFrame, keys: list[str], value: str, digits: int | None = None) -> DataFrame:
    """n, median, mean, min, max, pstdev, p25, p75, p95 of value by keys.

    Percentiles interpolate linearly; the deviation is the population's.
    """
    x = F.col(value).cast("double")
    of = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        of(F.percentile(x, F.lit(0.5))).alias("median"),
        of(F.avg(x)).alias("mean"),
        of(F.min(x)).alias("min"),
        of(F.max(x)).alias("max"),
        of(F.stddev_pop(x)).alias("pstdev"),
        of(F.percentile(x, F.lit(0.25))).alias("p25"),
        of(F.percentile(x, F.lit(0.75))).alias("p75"),
        of(F.percentile(x, F.lit(0.95))).alias("p95"),
    )


def measured(requests: DataFrame) -> DataFrame:
    """The requests that are no warm-ups, with measured_index, their number from 0 in each session."""
    first = requests.filter("is_warmup").groupBy("session_id").agg(F.count(F.lit(1)).alias("_warm"))
    rest = requests.filter(~F.col("is_warmup")).join(first, "session_id", "left")
    return rest.withColumn("measured_index", F.col("request_index") - F.coalesce("_warm", F.lit(0).cast("bigint"))).drop("_warm")


def run_summary(requests: DataFrame, setups: DataFrame, keys: list[str], value: str = "query_total_ms") -> DataFrame:
    """summary of the successful measured requests, with counts, hash consensus and setup cost.

    requests has keys, is_warmup, status, result_hash and value; setups has one
    row for each keys with dataset_load_ms and session_setup_ms.
    """
    measured = requests.filter(~F.col("is_warmup"))
    good = measured.filter("status = 'ok'")
    counts = measured.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") != "ok").alias("n_failed"),
        F.count_distinct(F.when(F.col("status") == "ok", F.col("result_hash"))).alias("n_hashes"),
    )
    cost = setups.select(*keys, (F.col("dataset_load_ms") + F.col("session_setup_ms")).alias("setup_cost_ms"))
    return amortised(summary(good, keys, value).join(counts, keys).join(cost, keys))


def amortised(df: DataFrame, median: str = "median", setup: str = "setup_cost_ms") -> DataFrame:
    """df with amortised_1, _10, _100: median + setup / requests."""
    for k in AMORTISE_OVER:
        df = df.withColumn(f"amortised_{k}", F.col(median) + F.col(setup) / F.lit(float(k)))
    return df


def throughput(rows: Column, ms: Column) -> Column:
    """Rows a second; null for no time."""
    return rows * F.lit(1000.0) / F.nullif(ms.cast("double"), F.lit(0.0))


def best_and_regret(points: DataFrame, auto: DataFrame) -> DataFrame:
    """scale, best_ratio, best_ms, auto_ms, regret_ms, regret_percent.

    points has scale, ratio, p50; auto has scale, auto_ms. The least p50 wins,
    ties by the smaller ratio; the percentage is null for a best of 0.
    """
    best = points.groupBy("scale").agg(F.min(F.struct("p50", "ratio")).alias("b")).select("scale", F.col("b.ratio").alias("best_ratio"), F.col("b.p50").alias("best_ms"))
    both = best.join(auto, "scale").withColumn("regret_ms", F.col("auto_ms") - F.col("best_ms"))
    return both.withColumn("regret_percent", F.col("regret_ms") * 100.0 / F.nullif(F.col("best_ms"), F.lit(0.0)))


def break_even(points: DataFrame) -> DataFrame:
    """scale, lo, hi: ratios where delta is 0 (lo = hi), or between which it changes its sign.

    points has scale, ratio, delta.
    """
    order = Window.partitionBy("scale").orderBy("ratio")
    near = points.select("scale", "ratio", "delta", F.lead("ratio").over(order).alias("next_ratio"), F.lead("delta").over(order).alias("next_delta"))
    zero = F.abs("delta") <= SAME
    crossing = (F.abs("delta") > SAME) & (F.abs("next_delta") > SAME) & (F.signum("delta") * F.signum("next_delta") < 0)
    touch = near.filter(zero).select("scale", F.col("ratio").alias("lo"), F.col("ratio").alias("hi"))
    return touch.unionByName(near.filter(crossing).select("scale", F.col("ratio").alias("lo"), F.col("next_ratio").alias("hi")))


def mean_of_successes(df: DataFrame, keys: list[str], value: str, ok: Column) -> DataFrame:
    """keys, n_ok, mean: the mean over successful repeats, null when there are none."""
    return df.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col(value))).alias("mean"))


def broken_records(records: DataFrame) -> DataFrame:
    """Records that break an invariant: shares, counters, or the hash of a success."""
    good = (
        (F.abs(F.col("cpu_ratio") + F.col("gpu_ratio") - 1) <= 1e-9)
        & (F.col("matched_rows") <= F.col("input_rows"))
        & (F.col("cpu_rows") + F.col("gpu_rows") == F.col("input_rows"))
        & ((F.col("status") != "ok") | F.coalesce(F.rlike(F.col("result_hash"), F.lit("^[0-9a-f]{16}$")), F.lit(False)))
    )
    return records.filter(~F.coalesce(good, F.lit(False)))


def scale_order(scale: Column) -> list[Column]:
    """Sort keys: numeric scales first by value, then the others as text."""
    number = F.expr(f"try_cast({scale._jc.toString()} as double)")
    return [number.isNull().asc(), number.asc(), scale.asc()]


def evaluation(points: DataFrame, auto: DataFrame, baseline: DataFrame) -> DataFrame:
    """scale, best_ratio, best_ms, auto_ms, regret_ms, regret_percent, break_even.

    points has scale, ratio, p50 of fixed shares, baseline has scale, baseline_ms;
    break_even lists the shares at which the fixed curve crosses the baseline.
    """
    deltas = points.join(baseline, "scale").select("scale", "ratio", (F.col("p50") - F.col("baseline_ms")).alias("delta"))
    crossings = break_even(deltas).groupBy("scale").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("break_even"))
    return best_and_regret(points, auto).join(crossings, "scale", "left")


#: What a summary of benchmark records is grouped by, fixed values of the record format.
GROUP_FIELDS = ("experiment_id", "scale_factor", "config_id", "engine", "threads", "ratio_mode", "cpu_ratio", "gpu_ratio", "lifecycle")
RESIDENT = ("resident_host_bytes", "resident_gpu_bytes", "resident_pinned_bytes")


def record_summary(records: DataFrame, setups: DataFrame) -> DataFrame:
    """A row for each group of GROUP_FIELDS with a success: counts, hash, statistics, setup and amortised cost.

    Raises where warm-ups are among the records, a configuration has not one setup, or its hashes differ.
    """
    if not records.filter("is_warmup").isEmpty():
        raise ValueError("a summary takes measured requests only")
    ok = F.col("status") == "ok"
    x = F.when(ok, F.col("query_total_ms").cast("double"))
    out = records.groupBy(*GROUP_FIELDS).agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("failure_count"),
        F.count_distinct(F.when(ok, F.col("result_hash"))).alias("hashes"),
        F.max(F.when(ok, F.col("result_hash"))).alias("result_hash"),
        *[F.percentile(x, F.lit(q)).alias(name) for name, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))],
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_pop(x).alias("pstdev"),
    )
    own = setups.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_setups"), *[F.max(c).alias(c) for c in ("dataset_load_ms", "session_setup_ms", "tune_ms", *RESIDENT)])
    both = out.filter("success_count > 0").join(own, "config_id", "left")
    bad = both.filter("coalesce(n_setups, 0) <> 1 or hashes > 1").first()
    if bad:
        raise ValueError(f"configuration {bad['config_id']} has {bad['n_setups'] or 0} setups and {bad['hashes']} result hashes")
    cost = F.col("dataset_load_ms") + F.col("session_setup_ms")
    resident = sum((F.col(c) for c in RESIDENT[1:]), F.col(RESIDENT[0]))
    return amortised(both.drop("n_setups", "hashes").withColumn("setup_cost_ms", cost).withColumn("resident_total_bytes", resident))


def provenance_faults(setups: DataFrame) -> DataFrame:
    """config_id, fault: setups whose account of how the share was chosen does not add up.

    Where it is unavailable all its fields are null; where it is measured they are not, rows
    and times are above 0, rates are rows over times, the boundary is the realised share of the
    rows, and the fixed time is what the calibration took beyond its kernel.
    """
    fields = ("model_version", "calibration_rows", "cpu_calibration_ms", "gpu_calibration_ms", "gpu_kernel_calibration_ms", "cpu_rows_per_ms", "gpu_rows_per_ms", "gpu_fixed_ms", "boundary_rows", "realized_ratio", "predicted_ratio")
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-9), F.abs(b) * 1e-9)
    c, rows = F.col, F.col("calibration_rows")
    known = [c(f).isNotNull() for f in fields]
    measured = c("provenance") == "measured"
    every, some = reduce(lambda a, b: a & b, known), reduce(lambda a, b: a | b, known)
    rules = (
        ("status", ~c("provenance").isin("measured", "unavailable")),
        ("fields of an unavailable one", (c("provenance") == "unavailable") & some),
        ("auto without one", (c("provenance") == "unavailable") & (c("ratio_mode") == "auto") & (c("status") == "ok")),
        ("missing fields", measured & ~every),
        ("mode", measured & (c("ratio_mode") != "auto")),
        ("not above 0", measured & ~((rows > 0) & (c("cpu_calibration_ms") > 0) & (c("gpu_kernel_calibration_ms") > 0))),
        ("share", measured & ~(c("realized_ratio").between(0, 1) & near(c("realized_ratio"), c("selected_ratio")))),
        ("boundary", measured & ~(c("boundary_rows").between(F.lit(0), rows) & near(c("realized_ratio") * rows, c("boundary_rows")))),
        ("rates", measured & ~(near(c("cpu_rows_per_ms") * c("cpu_calibration_ms"), rows.cast("double")) & near(c("gpu_rows_per_ms") * c("gpu_kernel_calibration_ms"), rows.cast("double")))),
        ("fixed time", measured & ~near(c("gpu_fixed_ms"), F.greatest(F.lit(0.0), c("gpu_calibration_ms") - c("gpu_kernel_calibration_ms")))),
    )
    faults = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for what, bad in rules]), lambda x: x.isNotNull())
    return setups.select("config_id", F.explode(faults).alias("fault"))
