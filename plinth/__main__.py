"""Command line: `python -m plinth revenue|session|join|check`."""

from __future__ import annotations

import argparse
import time
from datetime import date

from plinth.operators import hybrid, joins, validate
from plinth.operators.revenue import RevenueParams, checked, regional_revenue
from plinth.session import build_session
from plinth.sources import generate, sinks
from plinth.sources.dataset import read_arrow_dataset
from plinth.sources.tables import read_parquet
from plinth.sources.text import read_tbl_dataset
from plinth.streaming.session import RevenueSession

READERS = {"parquet": read_parquet, "arrow": read_arrow_dataset, "tbl": read_tbl_dataset}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plinth", description=__doc__)
    parser.add_argument("--threads", type=int, default=0, help="local threads; 0 uses all")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("revenue", "session", "check"):
        own = sub.add_parser(name)
        own.add_argument("--data-dir", required=True)
        own.add_argument("--source", choices=READERS, default="parquet")
        own.add_argument("--region", default="ASIA")
        own.add_argument("--date", type=date.fromisoformat, default=date(1994, 1, 1))
        own.add_argument("--cpu-ratio", type=float)
        own.add_argument("--strict", action="store_true")
        own.add_argument("--format", choices=("rows", "json", "benchmark"), default="rows")
        own.add_argument("--warmup", type=int, default=3)
        own.add_argument("--repeat", type=int, default=10)
    own = sub.add_parser("join")
    own.add_argument("-a", "--algo", choices=[*joins.STRATEGIES, *(f"star_{m}" for m in joins.STAR_MODES)], default="pro")
    own.add_argument("-r", type=int, default=1 << 20)
    own.add_argument("-s", type=int, default=1 << 22)
    args = parser.parse_args(argv)
    spark = build_session(f"local[{args.threads or '*'}]", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    if args.command == "join":
        if args.algo.startswith("star_"):
            row = joins.star_join(generate.star_data(spark, lineorder=args.s, orders=args.r, partsupp=max(1, args.r // 2)), args.algo[5:]).first()
        else:
            row = joins.join_count(generate.pk_relation(spark, args.r), generate.fk_relation(spark, args.s, args.r), args.algo).first()
        print(sinks.benchmark_csv({"algo": args.algo, **row.asDict(), "total_ms": round((time.perf_counter() - began) * 1000, 3)}), end="")
        return
    tables, params = READERS[args.source](spark, args.data_dir), RevenueParams(args.region, args.date)
    if args.command == "check":
        print(sinks.markdown(validate.validation_report(tables, params)), end="")
        return
    if args.command == "session":
        session = RevenueSession(tables, params, args.strict, args.cpu_ratio)
        print(sinks.session_jsonl(session.setup(), session.run(args.warmup, args.repeat)), end="")
        return
    tables = checked(tables, params) if args.strict else tables
    df = regional_revenue(tables, params) if args.cpu_ratio is None else hybrid.split_revenue(tables, params, args.cpu_ratio)
    rows = [(r["n_name"], r["revenue_1e4"]) for r in df.collect()]
    metrics = {"total_ms": round((time.perf_counter() - began) * 1000, 3)}
    if args.format == "benchmark":
        print(sinks.benchmark_csv({"region": args.region, "date": args.date, "result_rows": len(rows), "result_hash": sinks.result_hash(rows), **metrics}), end="")
    else:
        print(sinks.rows_csv(rows, metrics) if args.format == "rows" else sinks.result_json(rows, metrics), end="")


if __name__ == "__main__":
    main()
