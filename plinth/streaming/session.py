"""A resident session: tables prepared once, the revenue query asked again and again."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from plinth.functions.scalars import result_hash
from plinth.operators.hybrid import split_revenue
from plinth.operators.revenue import RevenueParams, checked, regional_revenue
from plinth.operators.validate import resident_bytes
from plinth.sources.tables import CONTRACT, read_parquet


class RevenueSession:
    """Holds the six pruned tables in the executors' storage and answers requests.

    Every request plans and runs the query on them; the first one's hash is what the
    others have to give. resident_host_bytes counts what the tables' columns hold.
    """

    def __init__(self, tables: dict[str, DataFrame], params: RevenueParams, strict: bool = False, ratio: float | None = None):
        self.ratio = ratio
        self.session_id = str(uuid.uuid4())
        self.params = params
        began = time.perf_counter()
        pruned = {n: tables[n].select(*CONTRACT[n].names) for n in CONTRACT}
        self.tables = {n: df.cache() for n, df in (checked(pruned, params) if strict else pruned).items()}
        for df in self.tables.values():
            df.count()
        self.setup_ms = (time.perf_counter() - began) * 1000
        self.resident_host_bytes = sum(r["bytes"] for r in resident_bytes(self.tables).collect())
        self._hash: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str, params: RevenueParams, strict: bool = False) -> RevenueSession:
        return cls(read_parquet(spark, sf_dir), params, strict)

    def execute(self, index: int = 0, warmup: bool = False) -> dict:
        """A request record; raises if the result differs from the first one's."""
        began = time.perf_counter()
        rows = [(r["n_name"], r["revenue_1e4"]) for r in (regional_revenue(self.tables, self.params) if self.ratio is None else split_revenue(self.tables, self.params, self.ratio)).collect()]
        took = (time.perf_counter() - began) * 1000
        own = result_hash(rows)
        self._hash = self._hash or own
        if own != self._hash:
            raise RuntimeError(f"result hash changed from {self._hash} to {own}")
        return {
            "session_id": self.session_id,
            "request_index": index,
            "is_warmup": warmup,
            "status": "ok",
            "rows": [{"nation": n, "revenue_1e4": r} for n, r in rows],
            "result_rows": len(rows),
            "result_hash": own,
            "query_total_ms": took,
        }

    def setup(self) -> dict:
        """The setup record of the session."""
        return {"session_id": self.session_id, "session_setup_ms": self.setup_ms, "resident_host_bytes": self.resident_host_bytes, "resident_gpu_bytes": 0, "resident_pinned_bytes": 0}

    def run(self, warmup: int = 3, repeat: int = 10) -> list[dict]:
        return [self.execute(i, i < warmup) for i in range(warmup + repeat)]

    def close(self) -> None:
        for df in self.tables.values():
            df.unpersist()
