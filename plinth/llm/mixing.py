"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order. A document's
virtual finish time is the number of its source's words up to and including it,
divided by the source's target weight; documents of all sources are served in
the order of their finish times until the budget is spent. A source whose words
run out before its share is reached is read again, up to ``max_passes`` times
in all, each pass carrying on the same word count.

The target weights are the water-filled targets themselves, so a source's words come to
its target at virtual time 1. A document that begins before and ends after its source's target is
two pieces, cut there. The pieces of all sources and passes are range-sorted by finish time;
the words of each range are summed, the sums of ranges are summed up in their order, and in the
one range where they reach the budget, its pieces' words are. The piece that does so ends the
mix: what comes later in the order is not taken, and it is itself cut at the budget.

Running sums are taken over (source, bucket) where the bucket is a prefix of
the shuffle key, so one source that holds a third of all rows is spread over
many tasks; sums of buckets are then summed over their sources. The depth of
the buckets follows the square root of the largest source. Documents without an id have one shuffle
key; they are dealt by their sizes, too.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; a null doc_id shuffles as the empty string;
equal rows are documents of their own; a source without words has target 0; an
empty table gives an empty result; columns of docs that the result also has
(size, source_size, ...) are replaced, all others are kept by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plinth.llm.common import materialize, n_words, scratch

#: Weights of sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES, budget: int | None = None) -> DataFrame:
    """One row for each source: skey, source_size, target.

    sizes has skey, source, size. Targets share the budget (all words when
    None) by weight, stop at max_passes times the source's size, and what is
    above is shared anew by weight until none is above. In order of
    size-to-weight ratio the sources that stop come first, so the level of the
    rest is found with running sums over one row for each source.
    """
    sources = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ratio = (F.col("source_size") * max_passes).cast("double") / F.col("w")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    total = total if budget is None else F.least(F.lit(budget).cast("bigint"), total * max_passes)
    level = (F.col("total") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_passes).cast("double") / (
        F.col("wsum") - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    return (
        sources.withColumn("w", weight)
        .withColumn("ratio", ratio)
        .withColumn("total", total)
        .withColumn("wsum", F.sum("w").over(everything))
        .withColumn("own_level", level)
        .withColumn("pos", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("own_level") <= F.col("ratio"), F.struct("pos", "own_level"))).over(everything)["own_level"])
        .select(
            "skey",
            "source_size",
            F.least((F.col("source_size") * max_passes).cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"),
        )
    )


def mix(docs: DataFrame, columns=None, weights=WEIGHTS, max_passes: int = MAX_PASSES, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """All rows of docs with size, source_size, target, taken and finish.

    columns names the columns of docs to keep, all when None.

    finish is the virtual time at which the last word taken of the document is
    served (null when none is taken). ``schedule`` orders the result by it.
    """
    own = [c for c in columns or docs.columns if c.lower() not in ("size", "source_size", "target", "taken", "finish")]
    lean = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),  # apart from the names used here
        F.col("doc_id").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words("text").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")).alias("key"),
    )
    with scratch() as kept:
        placed = _placed(materialize(lean, "mix-sizes"), seed, weights, max_passes, budget)
        kept.append(placed)
        last = _cut(placed, max_passes, budget)
    return _taken(placed, last, max_passes).select("row.*", "size", "source_size", "target", "taken", "finish")


def _placed(sized: DataFrame, seed: str, weights, max_passes: int, budget: int | None) -> DataFrame:
    """row, skey, size, source_size, target and begin, the words of the source before the document."""
    most = sized.groupBy("skey").count().agg(F.max("count")).first()[0] or 1
    depth = max(1, math.ceil(math.log(math.sqrt(most), 16)))
    targets = source_targets(sized, weights, max_passes, budget)
    # The key of all documents without an id: they are dealt by size, and what has their prefix lies before or after.
    without = F.md5(F.lit(f":{seed}").cast("binary"))
    place = F.when(F.col("key") < without, F.lit("0")).when(F.col("key") > without, F.lit("2")).otherwise(F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 19, "0")))
    bucketed = sized.withColumn("bucket", F.concat(F.substring("key", 1, depth), place))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        bucketed.groupBy("skey", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(targets, "skey")
        .select("skey", "bucket", "offset", "source_size", "target")
    )
    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(buckets, ["skey", "bucket"])
    placed = placed.select("row", "skey", "size", "source_size", "target", (F.col("offset") + F.col("before")).alias("begin"))
    return materialize(placed, "mix-placed")


def _pieces(max_passes: int) -> Column:
    """array of struct(finish, skey, end, words): a document's pieces in all passes, cut where the target is reached."""
    words = F.floor("target").cast("bigint")
    out = []
    for p in range(max_passes):
        start = F.col("source_size") * p + F.col("begin")
        end = start + F.col("size")
        for lo, hi in ((start, F.least(end, words)), (F.greatest(start, words), end)):
            out.append(F.struct(F.try_divide(hi, F.col("target")).alias("finish"), F.col("skey").alias("skey"), hi.alias("end"), (hi - lo).alias("words")))
    return F.filter(F.array(*out), lambda x: (x["words"] > 0) & x["finish"].isNotNull())


def _cut(placed: DataFrame, max_passes: int, budget: int | None) -> Row | None:
    """finish, skey, end and words (as many of it as the budget has) of the last piece taken; None without any."""
    sources = placed.groupBy("skey").agg(F.max("target").alias("target"))
    left = sources.agg(F.sum(F.floor("target").cast("bigint"))).first()[0] or 0
    left = left if budget is None else min(left, budget)
    ranges = placed.select(F.explode(_pieces(max_passes)).alias("x")).select("x.*")
    parts = max(8, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written, so that the ranges do not change between the sums.
    sorted_ = materialize(ranges.repartitionByRange(parts, "finish", "skey", "end").withColumn("part", F.spark_partition_id()), "mix-sorted")
    sums = sorted_.groupBy("part").agg(F.sum("words").alias("words")).orderBy("part").collect()  # a row for each range
    for r in sums:
        if left > r["words"]:
            left -= r["words"]
            continue
        so_far = F.sum("words").over(Window.partitionBy("part").orderBy("finish", "skey", "end"))
        own = sorted_.filter(F.col("part") == r["part"]).withColumn("so_far", so_far)
        found = own.filter(F.col("so_far") >= left).agg(F.min(F.struct("finish", "skey", "end", (F.col("words") - F.col("so_far") + left).alias("words"))).alias("x")).first()
        return found["x"]
    return sorted_.agg(F.max(F.struct("finish", "skey", "end", "words")).alias("x")).first()["x"]


def _taken(placed: DataFrame, last: Row | None, max_passes: int) -> DataFrame:
    """placed with taken and finish: the words of its pieces up to the last one, and when they are served."""
    zero = F.lit(0).cast("bigint")
    if last is None or last["words"] <= 0:
        return placed.withColumn("taken", zero).withColumn("finish", F.lit(None).cast("double"))
    at = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["skey"]).alias("skey"), F.lit(last["end"]).cast("bigint").alias("end"))
    key = lambda x: F.struct(x["finish"].alias("finish"), x["skey"].alias("skey"), x["end"].alias("end"))
    own = F.filter(_pieces(max_passes), lambda x: key(x) <= at)
    words = lambda x: F.when(key(x) == at, F.lit(last["words"]).cast("bigint")).otherwise(x["words"])
    served = placed.withColumn("_own", own)
    taken = F.aggregate("_own", zero, lambda acc, x: acc + words(x))
    finish = F.array_max(F.transform("_own", lambda x: F.when(key(x) == at, F.try_divide(x["end"] - x["words"] + words(x), F.col("target"))).otherwise(x["finish"])))
    return served.withColumn("taken", taken).withColumn("finish", finish).drop("_own", "skey", "begin")


def schedule(mixed: DataFrame) -> DataFrame:
    """What the mix takes, range-sorted by virtual finish time."""
    return mixed.filter("taken > 0").orderBy("finish", "doc_id")


def op6_mix(spark, sf_dir: str) -> DataFrame:
    from plinth.llm.common import spread, table

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':mix-1') as k
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from s),
r as (select *, cast(source_size * 3 as double) / w as ratio, cast(sum(source_size) over () as bigint) as total, cast(sum(w) over () as bigint) as wsum from w),
l as (select *, row_number() over (order by ratio, source nulls last) as pos,
        cast(total - 3 * coalesce(sum(source_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as double)
        / cast(wsum - coalesce(sum(w) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as double) as lev
      from r),
lv as (select coalesce(arg_min(lev, pos) filter (where lev <= ratio), 0.0) as level from l),
t as (select source, source_size, least(cast(source_size * 3 as double), level * w) as target from l, lv),
c as (select d.*, t.source_size, t.target,
        cast(coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as b
      from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(greatest(0, least(size, cast(floor(target) as bigint) - b))
     + greatest(0, least(size, cast(floor(target) as bigint) - b - source_size))
     + greatest(0, least(size, cast(floor(target) as bigint) - b - 2 * source_size)) as bigint) as taken
from c
"""
