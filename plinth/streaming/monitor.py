"""Running a command with a time limit, its wall time and the peak memory of its process tree."""

from __future__ import annotations

import os
import signal
import subprocess
import time
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Run:
    """status is ok, error or timeout; peak_kb is of the whole tree, 0 where /proc is missing."""

    status: str
    returncode: int
    wall_ms: float
    peak_kb: int
    stdout: str
    stderr: str


def _tree_kb(pid: int) -> int:
    total, left = 0, [pid]
    while left:
        own = left.pop()
        try:
            lines = Path(f"/proc/{own}/status").read_text().splitlines()
            total += next((int(x.split()[1]) for x in lines if x.startswith("VmRSS:")), 0)
            for task in os.listdir(f"/proc/{own}/task"):
                left += map(int, Path(f"/proc/{own}/task/{task}/children").read_text().split())
        except OSError:
            continue
    return total


def monitored(command: list[str], timeout_s: float = 1800, grace_s: float = 5, every_s: float = 0.05) -> Run:
    """Run command in a session of its own; at the limit its group gets SIGTERM, then SIGKILL."""
    began = time.perf_counter()
    process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True)
    peak, late = 0, False
    while True:
        try:
            out, err = process.communicate(timeout=every_s)
            break
        except subprocess.TimeoutExpired:
            peak = max(peak, _tree_kb(process.pid))
            spent = time.perf_counter() - began
            if spent > timeout_s + grace_s:
                os.killpg(process.pid, signal.SIGKILL)
            elif spent > timeout_s and not late:
                late = True
                os.killpg(process.pid, signal.SIGTERM)
    status = "timeout" if late else "ok" if process.returncode == 0 else "error"
    return Run(status, process.returncode, (time.perf_counter() - began) * 1000, peak, out, err)
