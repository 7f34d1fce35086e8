"""Deterministic workload generators on spark.range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of the star workload at scale 1, and the payloads of its dimensions.
LINEORDER_ROWS, ORDERS_ROWS, PARTSUPP_ROWS = 6_000_000, 1_500_000, 800_000
ORDERS_PAYLOAD, PARTSUPP_PAYLOAD = 3, 1


def pk_relation(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """key 1..n once each, payload the row's number from 0; a seed permutes the keys.

    The permutation multiplies the row's number by a factor that has no divisor in
    common with n, so no row needs to know of any other.
    """
    if seed is None:
        return spark.range(n).select((F.col("id") + 1).alias("key"), F.col("id").alias("payload"))
    factor = max(1, int(n * 0.6180339887)) + seed % max(1, n // 7)
    while math.gcd(factor, n) != 1:
        factor += 1
    place = (F.col("id").cast("decimal(20,0)") * F.lit(factor).cast("decimal(18,0)") + F.lit(seed % n).cast("decimal(18,0)")) % F.lit(n).cast("decimal(18,0)")
    return spark.range(n).select((place.cast("bigint") + 1).alias("key"), F.col("id").alias("payload"))


def fk_relation(spark: SparkSession, n: int, max_id: int) -> DataFrame:
    """n rows whose keys cycle 1..max_id; payload is the row's number."""
    return spark.range(n).select((F.col("id") % max_id + 1).alias("key"), F.col("id").alias("payload"))


def fk_from_pk(pk: DataFrame, n: int) -> DataFrame:
    """n rows repeating the tuples of pk, whose payloads number its rows from 0."""
    size = pk.count()
    base = pk.sparkSession.range(n).select("id", (F.col("id") % size).alias("at"))
    return base.join(pk.select("key", F.col("payload").alias("at")), "at").select("key", F.col("id").alias("payload"))


def uniform_relation(spark: SparkSession, n: int, max_id: int = 2**31 - 1, seed: int = 1) -> DataFrame:
    """n keys drawn from [0, max_id) by a hash of (row, seed); keys may repeat."""
    return spark.range(n).select(F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max_id)).alias("key"), F.col("id").alias("payload"))


def zipf_cdf(spark: SparkSession, max_id: int, theta: float, block: int = 1 << 16) -> DataFrame:
    """key 1..max_id and the cumulative share of its Zipf weight 1 / key**theta.

    Weights are summed within blocks of keys, and blocks over their own sums.
    """
    weights = spark.range(1, max_id + 1).select(F.col("id").alias("key"), F.floor((F.col("id") - 1) / block).alias("block"), F.pow(F.col("id").cast("double"), F.lit(-theta)).alias("w"))
    sums = weights.groupBy("block").agg(F.sum("w").alias("s"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = sums.select("block", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("before"), F.sum("s").over(whole).alias("total"))
    within = F.sum("w").over(Window.partitionBy("block").orderBy("key"))
    return weights.withColumn("own", within).join(blocks, "block").select("key", ((F.col("before") + F.col("own")) / F.col("total")).alias("cdf"), (F.col("w") / F.col("total")).alias("share"))


def zipf_relation(spark: SparkSession, n: int, max_id: int, theta: float, seed: int = 1) -> DataFrame:
    """n keys of a Zipf distribution over 1..max_id; payload is the row's number.

    A row's hash as a share of 1 meets the key whose range of the distribution
    holds it, by a join on slots of equal width that the ranges are cut into.
    """
    slots = max(1, max_id)
    cdf = zipf_cdf(spark, max_id, theta).select("key", (F.col("cdf") - F.col("share")).alias("lo"), F.when(F.col("key") == max_id, F.lit(2.0)).otherwise(F.col("cdf")).alias("hi"))
    slot = lambda x: F.least(F.floor(F.greatest(x, F.lit(0.0)) * slots).cast("bigint"), F.lit(slots - 1).cast("bigint"))
    # Neighbours' bounds are rounded alike, so a bound belongs to the upper range on both sides.
    bounds = cdf.withColumn("lo", F.when(F.col("key") == 1, F.lit(-1.0)).otherwise(F.round("lo", 12))).withColumn("hi", F.round("hi", 12))
    ranges = bounds.withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    drawn = spark.range(n).select("id", (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("u"))
    met = drawn.withColumn("slot", slot(F.col("u"))).join(ranges, "slot").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    return met.select("key", F.col("id").alias("payload"))


def star_data(spark: SparkSession, scale: float = 1.0, lineorder: int | None = None, orders: int | None = None, partsupp: int | None = None) -> dict[str, DataFrame]:
    """lineorder(order_fk, partsupp_fk), orders(key, payload), partsupp(key, payload)."""
    n, o, p = (x if x is not None else max(1, int(scale * y)) for x, y in ((lineorder, LINEORDER_ROWS), (orders, ORDERS_ROWS), (partsupp, PARTSUPP_ROWS)))
    return {
        "lineorder": spark.range(n).select((F.col("id") % o + 1).alias("order_fk"), (F.col("id") % p + 1).alias("partsupp_fk")),
        "orders": spark.range(1, o + 1).select(F.col("id").alias("key"), F.lit(ORDERS_PAYLOAD).cast("bigint").alias("payload")),
        "partsupp": spark.range(1, p + 1).select(F.col("id").alias("key"), F.lit(PARTSUPP_PAYLOAD).cast("bigint").alias("payload")),
    }


def revenue_data(spark: SparkSession, customers: int = 1000, orders: int = 5000, lines: int = 20000, suppliers: int = 500, seed: int = 1, skewed: bool = False) -> dict[str, DataFrame]:
    """The six tables by modular formulas; skewed puts two of three customers into ASIA."""
    regions = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    region = spark.createDataFrame(list(enumerate(regions)), "r_regionkey int, r_name string")
    nation = spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("n_name"), (F.col("id") % 5).cast("int").alias("n_regionkey"))
    home = (F.col("id") % 25).cast("int")
    asian = (F.col("id") % 5 * 5 + 2).cast("int")
    customer_home = F.when(F.col("id") % 3 != 0, asian).otherwise(home) if skewed else home
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(suppliers)) + 1
    return {
        "region": region,
        "nation": nation,
        "supplier": spark.range(1, suppliers + 1).select(F.col("id").alias("s_suppkey"), home.alias("s_nationkey")),
        "customer": spark.range(1, customers + 1).select(F.col("id").alias("c_custkey"), customer_home.alias("c_nationkey")),
        "orders": spark.range(1, orders + 1).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % customers + 1).alias("o_custkey"), F.date_add(F.lit("1994-01-01").cast("date"), (F.col("id") % 730).cast("int")).alias("o_orderdate")),
        "lineitem": spark.range(lines).select(
            (F.col("id") % orders + 1).alias("l_orderkey"),
            F.when(F.col("id") % 2 == 0, draw).otherwise(F.col("id") % suppliers + 1).alias("l_suppkey"),
            ((F.col("id") * 37 % 100000 + 100) / 100).cast("decimal(15,2)").alias("l_extendedprice"),
            ((F.col("id") % 11) / 100).cast("decimal(15,2)").alias("l_discount"),
        ),
    }
