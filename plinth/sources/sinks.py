"""Result sinks: CSV lines, JSON, benchmark rows, session JSON lines, tables of text."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import uuid
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.money import format_revenue_text
from plinth.functions.scalars import result_hash

Rows = list[tuple[str, int]]


def rows_csv(rows: Rows, metrics: Mapping[str, object] = {}) -> str:
    """nation,revenue_1e4,revenue lines, then result_hash and the metrics as key,value."""
    out = io.StringIO()
    to = csv.writer(out, lineterminator="\n")
    to.writerow(("nation", "revenue_1e4", "revenue"))
    to.writerows((n, r, format_revenue_text(r)) for n, r in rows)
    to.writerows([("result_hash", result_hash(rows)), *metrics.items()])
    return out.getvalue()


def result_json(rows: Rows, metrics: Mapping[str, object] = {}) -> str:
    body = {"rows": [{"nation": n, "revenue_1e4": r, "revenue": format_revenue_text(r)} for n, r in rows], "result_hash": result_hash(rows)}
    return json.dumps(body | dict(metrics), ensure_ascii=False)


def benchmark_csv(record: Mapping[str, object]) -> str:
    """One header line and one line of values."""
    out = io.StringIO()
    to = csv.DictWriter(out, list(record), lineterminator="\n")
    to.writeheader()
    to.writerow(record)
    return out.getvalue()


def session_jsonl(setup: Mapping[str, object], requests: Iterable[Mapping[str, object]]) -> str:
    lines = [{"record_type": "session_setup"} | dict(setup), *({"record_type": "request"} | dict(r) for r in requests)]
    return "".join(json.dumps(x) + "\n" for x in lines)


def write_atomically(path: str, text: str) -> None:
    """Write beside, flush, read back, then replace."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    work = target.with_name(f".{target.name}-{uuid.uuid4().hex}")
    try:
        with work.open("w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        if work.read_text() != text:
            raise OSError(f"{path}: what was written does not read back")
        os.replace(work, target)
    finally:
        work.unlink(missing_ok=True)


def write_rid_pairs(pairs: DataFrame, path: str) -> None:
    """`r_payload s_payload` lines of a join, one file for each partition."""
    pairs.select(F.concat_ws(" ", F.col("r_payload").cast("string"), F.col("s_payload").cast("string")).alias("value")).write.text(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table of the first `most` rows of a report."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *[line(r) for r in rows]]) + "\n"


def safe_path(root: str, relative: str) -> str:
    """A path below root; an absolute one, or one that leads out of root, raises."""
    parts = relative.split("/")
    if not relative or relative.startswith("/") or ":" in parts[0] or ".." in parts:
        raise ValueError(f"unsafe path: {relative!r}")
    return f"{root.rstrip('/')}/{relative}"


def compact_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """A subset of columns as CSV with a header."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    df.select(*columns).write.csv(path, header=True)


def audited_result(path: str, sql: str, rows: Rows, table_hashes: Mapping[str, str]) -> dict:
    """Write a result with what it was made from: the SQL and its hash, the tables' hashes, the rows' hash."""
    body = {
        "sql": sql,
        "sql_sha256": hashlib.sha256(sql.encode()).hexdigest(),
        "tables": dict(sorted(table_hashes.items())),
        "rows": [{"nation": n, "revenue_1e4": r} for n, r in rows],
        "result_hash": result_hash(rows),
    }
    write_atomically(path, json.dumps(body, indent=2, ensure_ascii=False))
    return body


def stats_lines(name: str, stats: Mapping[str, int]) -> str:
    """Two lines of a join's statistics: NAME_STATS_CSV_HEADER and its columns, NAME_STATS_CSV and the values."""
    return f"{name}_STATS_CSV_HEADER,{','.join(stats)}\n{name}_STATS_CSV,{','.join(map(str, stats.values()))}\n"


def evaluation_files(df: DataFrame, folder: str) -> None:
    """evaluation.json, .csv and .md of a stats.evaluation(), a row for each scale."""
    rows = [r.asDict(recursive=True) for r in df.orderBy("scale").collect()]
    flat = [r | {"break_even": json.dumps([[x["lo"], x["hi"]] for x in r["break_even"] or []])} for r in rows]
    out = io.StringIO()
    to = csv.DictWriter(out, df.columns, lineterminator="\n")
    to.writeheader()
    to.writerows(flat)
    Path(folder).mkdir(parents=True, exist_ok=True)
    write_atomically(f"{folder}/evaluation.json", json.dumps({"scales": rows}, indent=2, sort_keys=True) + "\n")
    write_atomically(f"{folder}/evaluation.csv", out.getvalue())
    line = lambda xs: "| " + " | ".join("n/a" if x is None else str(x) for x in xs) + " |"
    write_atomically(f"{folder}/evaluation.md", "\n".join([line(df.columns), line("---" for _ in df.columns), *[line(r.values()) for r in flat]]) + "\n")
