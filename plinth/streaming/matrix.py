"""Running a matrix of configurations, one process each, and gathering their session records."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from itertools import product
from pathlib import Path

from plinth.streaming.monitor import monitored

WARMUP, REPEAT, TIMEOUT_S = 3, 10, 1800.0


def configurations(sources: list[str], threads: list[int], ratios: list[float | None]) -> Iterator[dict]:
    """config_id, source, threads and ratio of every combination; a ratio of None is the plain query."""
    for source, n, ratio in product(sources, threads, ratios):
        share = "plain" if ratio is None else f"r{round(ratio * 1000):04d}"
        yield {"config_id": f"{Path(source).name}-{share}-t{n:02d}", "source": source, "threads": n, "ratio": ratio}


def run_matrix(configs: list[dict], out: str, region: str = "ASIA", date: str = "1994-01-01", warmup: int = WARMUP, repeat: int = REPEAT, timeout_s: float = TIMEOUT_S, command=None) -> list[dict]:
    """A record for each configuration: status, wall time, peak memory, requests; raw lines go to out/<config_id>.jsonl.

    A configuration that fails or takes too long is recorded and the next one runs. command
    makes the argument list of a configuration, that of `python -m plinth session` when None.
    """
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    records = []
    for c in configs:
        own = command(c) if command else [
            sys.executable, "-m", "plinth", "--threads", str(c["threads"]), "session", "--data-dir", c["source"], "--region", region, "--date", date,
            "--warmup", str(warmup), "--repeat", str(repeat), *(["--cpu-ratio", str(c["ratio"])] if c["ratio"] is not None else []),
        ]
        run = monitored(own, timeout_s=timeout_s)
        lines = [json.loads(x) for x in run.stdout.splitlines() if x.startswith("{")] if run.status == "ok" else []
        (folder / f"{c['config_id']}.jsonl").write_text("".join(json.dumps(x | {"config_id": c["config_id"]}) + "\n" for x in lines))
        requests = [x for x in lines if x.get("record_type") == "request" and not x.get("is_warmup")]
        records.append(c | {"status": run.status, "returncode": run.returncode, "wall_ms": run.wall_ms, "peak_kb": run.peak_kb, "requests": len(requests), "error": run.stderr[-300:] if run.status != "ok" else ""})
    (folder / "matrix.json").write_text(json.dumps(records, indent=2))
    return records
