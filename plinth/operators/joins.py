"""A registry of inner equi-join strategies over (key, payload) relations, and star joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.scalars import narrow


@dataclass(frozen=True)
class Strategy:
    """How a join is run.

    hint: Spark's join hint for the build side; broadcasts are bounded by ``BROADCAST_BYTES``
    and ``BROADCAST_ROWS`` of the build side and fall back to a shuffled hash join.
    single: one partition. unique: build keys must be unique. dense: keys and
    payloads must not be negative, negative probe keys are skipped.
    """

    hint: str
    single: bool = False
    unique: bool = False
    dense: bool = False


#: Rows and bytes of a build side that a broadcast strategy sends to every executor at most.
BROADCAST_ROWS = 5_000_000
BROADCAST_BYTES = 256 << 20
#: Bytes of a hashed row besides its columns' own, as an estimate.
ROW_BYTES = 32

STRATEGIES = {
    "npo": Strategy("broadcast"),
    "npo_st": Strategy("broadcast", single=True),
    "pro": Strategy("shuffle_hash"),
    "prh": Strategy("shuffle_hash"),
    "prho": Strategy("shuffle_hash"),
    "prvj": Strategy("shuffle_hash", unique=True, dense=True),
    "rj": Strategy("shuffle_hash", single=True),
    "vj": Strategy("broadcast", unique=True, dense=True),
    "sort_merge": Strategy("merge"),
}


def _fits(build: DataFrame) -> bool:
    """Whether the build side may be broadcast: a count of its fixed-width rows, that ends at the limit, proves it."""
    most = min(BROADCAST_ROWS, BROADCAST_BYTES // (ROW_BYTES + 8 * len(build.columns)))
    return build.limit(most + 1).count() <= most


def _hinted(build: DataFrame, hint: str) -> DataFrame:
    if hint == "broadcast" and not _fits(build):
        hint = "shuffle_hash"
    return build.hint(hint)


def check_build(build: DataFrame, name: str, unique: bool, dense: bool) -> None:
    """Raise ValueError where the build side breaks the strategy's contract."""
    if dense and not build.filter("key < 0 or payload < 0").isEmpty():
        raise ValueError(f"{name} needs keys and payloads of 0 or more on the build side")
    if unique and not build.groupBy("key").count().filter("count > 1").isEmpty():
        raise ValueError(f"{name} needs unique keys on the build side")


def join_relations(build: DataFrame, probe: DataFrame, strategy: str) -> DataFrame:
    """r_payload, s_payload for each matching pair of build and probe rows."""
    how = STRATEGIES[strategy]
    check_build(build, strategy, how.unique, how.dense)
    probe = probe.filter("key >= 0") if how.dense else probe
    r = build.select("key", F.col("payload").alias("r_payload"))
    s = probe.select("key", F.col("payload").alias("s_payload"))
    if how.single:
        r, s = r.coalesce(1), s.coalesce(1)
    return s.join(_hinted(r, how.hint), "key").select("r_payload", "s_payload")


def join_count(build: DataFrame, probe: DataFrame, strategy: str) -> DataFrame:
    """One row: matches."""
    return join_relations(build, probe, strategy).agg(F.count(F.lit(1)).alias("matches"))


def strategy_stats(build: DataFrame, strategy: str, width: int = 4, radix_bits: int = 14) -> DataFrame:
    """One row: what the strategy's side structure holds by its definition, in bytes.

    Dense ones have a slot of `width` bytes for each key up to the largest; prvj deals them to
    2**radix_bits parts. The others hold the build side's rows, 16 bytes each.
    """
    slots = F.coalesce(F.max("key") + 1, F.lit(0)).cast("bigint")
    rows = (F.count(F.lit(1)) * 16).cast("bigint")
    if strategy == "vj":
        return build.agg(F.lit(width).cast("bigint").alias("payload_width_bytes"), (slots * width).alias("vector_total_bytes"))
    if strategy == "prvj":
        return build.agg(F.lit(width).cast("bigint").alias("payload_width_bytes"), (slots * width).alias("partition_vector_total_bytes"), F.lit(1 << radix_bits).cast("bigint").alias("partition_count"), F.lit(radix_bits).cast("bigint").alias("radix_bits"))
    return build.agg(rows.alias("sortmerge_buffer_bytes" if strategy == "sort_merge" else "hash_table_bytes"))


def radix_histogram(relation: DataFrame, bits: int) -> DataFrame:
    """part, cnt, offset: rows for each value of the keys' lowest bits, and rows before."""
    from pyspark.sql import Window

    parts = relation.groupBy(F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).alias("part")).agg(F.count(F.lit(1)).alias("cnt"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0).cast("bigint")).alias("offset"))


def _npo(data: dict[str, DataFrame], width: int) -> DataFrame:
    return _probe(_probe(data["lineorder"], data["orders"], "order_fk", "o", "broadcast"), data["partsupp"], "partsupp_fk", "ps", "broadcast")


def _pro_ps_first(data: dict[str, DataFrame], width: int) -> DataFrame:
    return _probe(_probe(data["lineorder"], data["partsupp"], "partsupp_fk", "ps", "shuffle_hash"), data["orders"], "order_fk", "o", "shuffle_hash")


def _pro_orders_first(data: dict[str, DataFrame], width: int) -> DataFrame:
    return _probe(_probe(data["lineorder"], data["orders"], "order_fk", "o", "shuffle_hash"), data["partsupp"], "partsupp_fk", "ps", "shuffle_hash")


def _vj(data: dict[str, DataFrame], width: int) -> DataFrame:
    own = dict(data)
    for name in ("orders", "partsupp"):
        check_build(data[name], f"star {name}", True, True)
        own[name] = data[name].withColumn("payload", narrow(F.col("payload"), width))
    return _npo(own, width)


def _probe(facts: DataFrame, dim: DataFrame, fk: str, name: str, hint: str) -> DataFrame:
    side = dim.select(F.col("key").alias(f"{name}_key"), F.col("payload").alias(f"{name}_payload"))
    return facts.join(_hinted(side, hint), F.col(fk) == F.col(f"{name}_key")).drop(f"{name}_key")


STAR_MODES: dict[str, Callable[[dict[str, DataFrame], int], DataFrame]] = {
    "npo": _npo,
    "pro_l_ps": _pro_ps_first,
    "pro_l_o": _pro_orders_first,
    "vj": _vj,
}


def star_join(data: dict[str, DataFrame], mode: str, width: int = 4) -> DataFrame:
    """One row: matches, and aggregate_sum of o.payload - (1 - ps.payload).

    Dimension keys must be unique; width is the bytes kept of a payload in mode vj.
    """
    for name in ("orders", "partsupp"):
        check_build(data[name], f"star {name}", True, False)
    joined = STAR_MODES[mode](data, width)
    value = F.col("o_payload") - (F.lit(1).cast("bigint") - F.col("ps_payload"))
    return joined.agg(F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum(value), F.lit(0).cast("bigint")).alias("aggregate_sum"))
