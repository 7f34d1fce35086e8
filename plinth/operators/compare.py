"""Comparing ordered results row by row, and verifying a stored result."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.money import format_revenue_text
from plinth.functions.scalars import result_hash


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with its place in the order, from 1, as position."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def rows_diff(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """position, field, expected, actual of each difference of two numbered frames.

    A row that one side lacks differs in every field.
    """
    e = expected.select("position", F.struct(*columns).alias("e"))
    a = actual.select("position", F.struct(*columns).alias("a"))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"e.{c}").cast("string").alias("expected"), F.col(f"a.{c}").cast("string").alias("actual")) for c in columns])
    joined = e.join(a, "position", "full").select("position", F.explode(fields).alias("d")).select("position", "d.*")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def first_mismatch(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of rows_diff."""
    return rows_diff(expected, actual, columns).orderBy("position", "field").limit(1)


def verify_result(rows: list[tuple[str, int]], stored_hash: str, counters: dict[str, int]) -> list[str]:
    """What is wrong with a stored result: order, repeats, hash, counters."""
    out = []
    if rows != sorted(rows, key=lambda r: (-r[1], r[0].encode())):
        out.append("rows are not in order of revenue, then name")
    if len({n for n, _ in rows}) != len(rows):
        out.append("a nation occurs twice")
    if (own := result_hash(rows)) != stored_hash:
        out.append(f"hash is {own}, not {stored_hash}")
    if counters.get("matched_rows", 0) > counters.get("input_rows", 0):
        out.append("more rows matched than read")
    if {"cpu_rows", "gpu_rows"} <= counters.keys() and counters["cpu_rows"] + counters["gpu_rows"] != counters.get("input_rows"):
        out.append("the parts' rows do not add up")
    return out


def read_rows_file(text: str) -> tuple[list[tuple[str, int]], str, dict[str, str]]:
    """Rows, hash and metrics of a result's CSV text; a wrong header, second hash or repeated metric raises."""
    lines = [[x.strip() for x in line] for line in csv.reader(io.StringIO(text))]
    if not lines or lines[0] != ["nation", "revenue_1e4", "revenue"]:
        raise ValueError("the header must be nation,revenue_1e4,revenue")
    lines = [line for line in lines[1:] if any(line)]
    at = next((i for i, line in enumerate(lines) if line[0] == "result_hash"), None)
    if at is None or len(lines[at]) != 2 or not re.fullmatch("[0-9A-Fa-f]{16}", lines[at][1]):
        raise ValueError("there must be one result_hash of 16 hex digits after the rows")
    rows = []
    for line in lines[:at]:
        if len(line) != 3 or format_revenue_text(int(line[1])) != line[2]:
            raise ValueError(f"not a row: {line}")
        rows.append((line[0], int(line[1])))
    metrics: dict[str, str] = {}
    for line in lines[at + 1 :]:
        if len(line) != 2 or line[0] in metrics or line[0] == "result_hash":
            raise ValueError(f"not a metric of its own: {line}")
        metrics[line[0]] = line[1]
    return rows, lines[at][1].lower(), metrics


def verify_rows_file(text: str, expected: list[tuple[str, int]]) -> list[str]:
    """What is wrong with a result's CSV text: its form, its own hash and counters, and where it differs from expected."""
    try:
        rows, stored, metrics = read_rows_file(text)
    except ValueError as wrong:
        return [str(wrong)]
    counters = {k: int(v) for k, v in metrics.items() if k.endswith("_rows") and v.isdigit()}
    out = verify_result(rows, stored, counters)
    for i, (mine, theirs) in enumerate(zip_longest(rows, expected), 1):
        if mine != theirs:
            return [*out, f"row {i} is {mine}, not {theirs}"]
    return out


def correctness_gate(spark: SparkSession, expected: list[tuple[str, int]], variants: dict[str, Callable[[], list[tuple[str, int]]]], required: set[str]) -> DataFrame:
    """variant, status, errors, result_hash: every required variant run, its rows and hash held against the expected ones.

    A variant that is missing or raises has failed; one that is not required is reported as unexpected.
    """
    missing, extra = missing_and_extra(required, set(variants))
    out = [(name, "failed", "missing", None) for name in missing] + [(name, "unexpected", "", None) for name in extra]
    for name in sorted(required & set(variants)):
        try:
            rows = variants[name]()
        except Exception as failure:  # any failure of a variant is its result
            out.append((name, "failed", f"{type(failure).__name__}: {failure}"[:300], None))
            continue
        own = result_hash(rows)
        wrong = verify_result(rows, result_hash(expected), {}) + ([] if rows == expected else ["the rows differ"])
        out.append((name, "failed" if wrong else "passed", "; ".join(wrong), own))
    return spark.createDataFrame(out, "variant string, status string, errors string, result_hash string")


def missing_and_extra(expected: set[str], found: set[str]) -> tuple[list[str], list[str]]:
    return sorted(expected - found), sorted(found - expected)
