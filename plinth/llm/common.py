"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import plinth

#: Functions go to the executors by value: they need not have this package.
cloudpickle.register_pickle_by_value(plinth)

#: A word is a maximal run of characters other than space, tab, line feed,
#: vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

#: Lengths that are summed up in one go.
_BLOCK = 64

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only in local mode, where
    one process holds driver and executors, an unset value falls back to a
    temporary folder; on a cluster an unset value is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir.setdefault("dir", tempfile.mkdtemp(prefix="plinth-"))


def packed(docs: DataFrame, *results: str) -> tuple[Column, list[Column]]:
    """A struct column `row` of docs' columns but text, and the columns to select in the end.

    Columns named like the results are left out, so that results replace them. The
    struct keeps docs' other columns apart from the names that an operator uses.
    """
    names = [c for c in docs.columns if c.lower() not in results]
    row = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"] or [F.lit(0).alias("_none")]).alias("row")
    return row, [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Spark deletes a query's shuffle files at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tables of the scratch() blocks that are open, the innermost last.
_scratch: list[list[DataFrame]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    A lost executor then costs a reread, not a recomputation, and later steps
    start from a short plan. The shuffle files behind the table are deleted with the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._plinth_path = path
    if _scratch:
        _scratch[-1].append(back)
    return back


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that are materialized inside are deleted at the end, but for those put in the list."""
    kept: list[DataFrame] = []
    _scratch.append([])
    try:
        yield kept
    finally:
        made = _scratch.pop()
        stays = {df._plinth_path for df in kept}
        for df in made:
            if df._plinth_path not in stays:
                discard(df)
            elif _scratch:
                _scratch[-1].append(df)


def discard(df: DataFrame) -> None:
    """Delete the table of a materialize() that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._plinth_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to as many tasks as the session has cores where its scan has fewer.

    A file of one row group is one task's, however long its texts take. A scan with a task for
    each core stays as it is, so nothing is shuffled where there is much to read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, _UPPER, _LOWER)


def n_words(text: Column | str) -> Column:
    """Number of words as bigint; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def sha256_hex(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes of a string column."""
    return F.sha2(text.cast("binary"), 256)


def running_sums(xs: Column) -> Column:
    """Running sums of an array, in blocks, so that no sum copies all that came before it."""

    def add(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x))

    def sums(ys: Column) -> Column:
        return F.aggregate(ys, F.array().cast("array<int>"), add)

    def carried(own: Column) -> Column:
        before = sums(F.transform(own, lambda b: F.get(b, F.size(b) - 1)))
        return F.transform(F.array(before), lambda t: F.flatten(F.transform(own, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(t, i - 1), F.lit(0))))))[0]

    starts = F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(_BLOCK)), lambda i: i < F.size(xs))
    blocks = F.transform(starts, lambda i: sums(F.slice(xs, i + 1, F.lit(_BLOCK))))
    return F.transform(F.array(blocks), carried)[0]


def holds(spans: Column, x: Column) -> Column:
    """Whether the last of the sorted spans that starts by x's start ends by x's end or later."""
    by_half = F.array(*[F.lit(1 << i) for i in reversed(range(30))])
    last = F.aggregate(by_half, F.lit(-1), lambda at, step: F.when(F.coalesce(F.get(spans, at + step)["s"] <= x["s"], F.lit(False)), at + step).otherwise(at))
    return F.coalesce(F.get(spans, last)["e"] >= x["e"], F.lit(False))
