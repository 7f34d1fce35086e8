"""Splitting the fact table between two executions, and the model that picks the share."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.revenue import RevenueParams, line_revenue, matched_lines, total_by_nation
from plinth.sources.tables import NAMES

_PARTS = 1000


def check_ratio(ratio: float) -> float:
    if not (isinstance(ratio, (int, float)) and math.isfinite(ratio) and 0 <= ratio <= 1):
        raise ValueError(f"ratio must be between 0 and 1, not {ratio!r}")
    return float(ratio)


def split_revenue(tables: dict[str, DataFrame], params: RevenueParams, ratio: float) -> DataFrame:
    """regional_revenue from two halves of lineitem, by a hash of its keys, merged by name."""
    share = round(check_ratio(ratio) * _PARTS)
    part = F.pmod(F.xxhash64("l_orderkey", "l_suppkey"), F.lit(_PARTS))
    halves = []
    for side in (part < share, part >= share):
        own = {n: tables[n] for n in NAMES} | {"lineitem": tables["lineitem"].filter(side)}
        lines = matched_lines(own, params).select("n_name", line_revenue().alias("revenue_1e4"))
        halves.append(lines.groupBy("n_name").agg(F.sum("revenue_1e4").alias("revenue_1e4")))
    return total_by_nation(halves[0].unionByName(halves[1]))


@dataclass(frozen=True)
class Prediction:
    ratio: float
    first_ms: float
    second_ms: float

    @property
    def total_ms(self) -> float:
        return max(self.first_ms, self.second_ms)


def predict_ratio(rows: int, first_ms: float, second_ms: float, fixed_ms: float = 0.0) -> Prediction:
    """The first side's share that ends both sides soonest.

    The first side takes share * first_ms; the second takes a fixed time and
    (1 - share) * second_ms, nothing without rows. Ties prefer share 1, then 0.
    """
    times = (first_ms, second_ms, fixed_ms)
    if rows <= 0 or not all(math.isfinite(t) for t in times) or first_ms <= 0 or second_ms <= 0 or fixed_ms < 0:
        raise ValueError("rows and times must be finite and above 0, the fixed time 0 or more")

    def at(share: float) -> Prediction:
        return Prediction(share, share * first_ms, 0.0 if share == 1 else fixed_ms + (1 - share) * second_ms)

    even = min(1.0, max(0.0, (fixed_ms + second_ms) / (first_ms + second_ms)))
    return min((at(1.0), at(0.0), at(even)), key=lambda p: p.total_ms)


def exact_split(batches: DataFrame, ratio: float) -> DataFrame:
    """batch, len, first_len, second_len: the first round(total * ratio) rows go to the first side.

    batches has batch (its place) and len.
    """
    check_ratio(ratio)
    if not batches.filter("len < 0").isEmpty():
        raise ValueError("a batch has a negative length")
    whole = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    target = F.floor(F.sum("len").over(whole) * F.lit(float(ratio)) + 0.5).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("len"), target - F.coalesce(F.sum("len").over(before), F.lit(0))))
    return batches.withColumn("first_len", first).withColumn("second_len", F.col("len") - F.col("first_len")).select("batch", "len", "first_len", "second_len")


def boundary_split(batches: DataFrame, ratio: float) -> DataFrame:
    """One row: first_batches, first_rows, the batch boundary nearest to total * ratio; ties take the lower."""
    check_ratio(ratio)
    total = batches.agg(F.coalesce(F.sum("len"), F.lit(0).cast("bigint")).alias("total"))
    ends = batches.select(F.row_number().over(Window.orderBy("batch")).cast("bigint").alias("k"), F.sum("len").over(Window.orderBy("batch")).alias("cum"))
    start = batches.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("cum"))
    apart = F.abs(F.col("cum") - F.col("total") * F.lit(float(ratio)))
    best = start.unionByName(ends).withColumn("total", total.scalar()).agg(F.min(F.struct(apart.alias("apart"), "cum", "k")).alias("b"))
    return best.select(F.col("b.k").alias("first_batches"), F.col("b.cum").alias("first_rows"))


def auto_split(tables: dict[str, DataFrame], params: RevenueParams, batches: int = 16) -> tuple[DataFrame, Prediction]:
    """split_revenue at the share that the model predicts from one timed run of each side.

    Both sides run on all rows first and must agree; the share is then moved to the
    nearest of the boundaries between equal batches of the hash space.
    """
    import time

    from plinth.operators.compare import first_mismatch, numbered

    results, ms = [], []
    for ratio in (1.0, 0.0):
        began = time.perf_counter()
        rows = split_revenue(tables, params, ratio).collect()
        ms.append(max((time.perf_counter() - began) * 1000, 1e-6))
        results.append(tables["nation"].sparkSession.createDataFrame(rows, "n_name string, revenue_1e4 bigint"))
    order = (F.desc("revenue_1e4"), "n_name")
    if not first_mismatch(*[numbered(r, *order) for r in results], ["n_name", "revenue_1e4"]).isEmpty():
        raise RuntimeError("the two sides differ on all rows")
    found = predict_ratio(max(1, tables["lineitem"].count()), ms[0], ms[1])
    snapped = math.ceil(found.ratio * batches - 0.5) / batches
    return split_revenue(tables, params, snapped), Prediction(snapped, snapped * ms[0], (1 - snapped) * ms[1])
