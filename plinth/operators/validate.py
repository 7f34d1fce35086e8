"""Checks of tables: keys, nulls, schemas, and a report on fitness for the revenue query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plinth.functions.dates import parse_day
from plinth.functions.money import parse_scaled, scaled
from plinth.operators.revenue import RevenueParams
from plinth.sources.tables import CONTRACT, FOREIGN_KEYS, PRIMARY_KEYS
from plinth.sources.text import LAYOUT


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def pk_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, total, distinct_keys of each primary key."""
    one = lambda name, key: tables[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("distinct_keys"))
    return _stacked([one(name, key) for name, key in PRIMARY_KEYS.items()])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """key, n of keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fk_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """table, fk, orphans: rows whose foreign key has no row to point to."""

    def one(child: str, fk: str, parent: str, pk: str) -> DataFrame:
        lost = tables[child].select(fk).join(tables[parent].select(pk), F.col(fk) == F.col(pk), "left_anti")
        return lost.agg(F.lit(child).alias("table"), F.lit(fk).alias("fk"), F.count(F.lit(1)).alias("orphans"))

    return _stacked([one(*x) for x in FOREIGN_KEYS])


def null_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, nulls for the contract's columns."""

    def one(name: str) -> DataFrame:
        columns = CONTRACT[name].names
        counted = tables[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return counted.unpivot([], columns, "column", "nulls").select(F.lit(name).alias("table"), "column", "nulls")

    return _stacked([one(n) for n in CONTRACT])


def schema_differences(df: DataFrame, contract: StructType) -> list[str]:
    """What keeps a frame's schema from equalling the contract: names, order, types, nullability."""
    out = []
    if df.schema.names != contract.names:
        out.append(f"columns are {df.schema.names}, not {contract.names}")
    own = {f.name: f for f in df.schema}
    for want in contract:
        have = own.get(want.name)
        if have is None:
            continue
        if have.dataType != want.dataType:
            out.append(f"{want.name} is {have.dataType.simpleString()}, not {want.dataType.simpleString()}")
        if have.nullable and not want.nullable:
            out.append(f"{want.name} may be null")
    return out


def resident_bytes(tables: dict[str, DataFrame]) -> DataFrame:
    """table, bytes of the contract's columns: 4 an int or date, 8 a decimal of up to 18 digits, the bytes of a text."""

    def one(name: str) -> DataFrame:
        fixed = sum({"int": 4, "date": 4}.get(f.dataType.simpleString(), 8) for f in CONTRACT[name] if f.dataType.simpleString() != "string")
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in CONTRACT[name] if f.dataType.simpleString() == "string"]
        row = sum(texts, F.lit(fixed)).cast("bigint")
        return tables[name].agg(F.lit(name).alias("table"), F.coalesce(F.sum(row), F.lit(0).cast("bigint")).alias("bytes"))

    return _stacked([one(n) for n in CONTRACT])


def max_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """table, max_key of each primary key."""
    return _stacked([tables[n].agg(F.lit(n).alias("table"), F.max(F.col(k).cast("bigint")).alias("max_key")) for n, k in PRIMARY_KEYS.items()])


def validation_report(tables: dict[str, DataFrame], params: RevenueParams) -> DataFrame:
    """check, value: row counts, values out of range, and what the query would find."""
    line = tables["lineitem"]
    price, discount = scaled(F.col("l_extendedprice")), scaled(F.col("l_discount"))
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("value"))
    regions = tables["region"].filter(F.col("r_name") == params.region)
    orders = tables["orders"]
    if params.window:
        orders = orders.filter((F.col("o_orderdate") >= F.lit(params.window[0])) & (F.col("o_orderdate") < F.lit(params.window[1])))
    lost = F.col("l_orderkey").isNull() | F.col("l_suppkey").isNull() | price.isNull() | discount.isNull()
    return _stacked(
        [
            *[count(tables[n], f"rows_{n}") for n in CONTRACT],
            count(line.filter(lost), "lineitem_nulls"),
            count(line.filter((price < 0) | (discount < 0) | (discount > 100)), "lineitem_out_of_range"),
            count(regions, "regions_found"),
            count(tables["nation"].join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"), "nations_in_region"),
            count(orders, "orders_in_window"),
        ]
    )


def tbl_report(spark: SparkSession, folder: str, params: RevenueParams) -> DataFrame:
    """check, value for the six .tbl files: rows, lines with too few fields, values that do not parse, and what the query would find."""
    parts, good = [], {}
    for name, (least, columns) in LAYOUT.items():
        lines = spark.read.text(f"{folder}/{name}.tbl").filter(F.btrim("value") != "").select(F.split("value", r"\|", -1).alias("f"))
        # One trailing pipe ends the last field.
        lines = lines.select(F.when(F.get("f", F.size("f") - 1) == "", F.slice("f", 1, F.size("f") - 1)).otherwise(F.col("f")).alias("f"))
        kinds = {"int": lambda c: F.expr(f"try_cast({c} as int)"), "string": F.col, "date": lambda c: parse_day(F.col(c), strict=False), "money": lambda c: parse_scaled(F.col(c), strict=False)}
        fields = lines.select(F.size("f").alias("_n"), *[F.get("f", F.lit(at)).alias(c) for c, at, _ in columns])
        good[name] = parsed = fields.select("_n", *[kinds[kind](c).alias(c) for c, _, kind in columns])
        counts = {f"{name}_rows": F.count(F.lit(1)), f"{name}_short": F.count_if(F.col("_n") < least)} | {f"{c}_bad": F.count_if((F.col("_n") >= least) & F.col(c).isNull()) for c, _, kind in columns if kind != "string"}
        parts.append(parsed.agg(*[n.alias(k) for k, n in counts.items()]).unpivot([], list(counts), "check", "value"))
    count = lambda df, what: df.agg(F.lit(what).alias("check"), F.count(F.lit(1)).alias("value"))
    regions = good["region"].filter(F.col("r_name") == params.region)
    orders = good["orders"]
    if params.window:
        orders = orders.filter((F.col("o_orderdate") >= F.lit(params.window[0])) & (F.col("o_orderdate") < F.lit(params.window[1])))
    parts += [count(regions, "regions_found"), count(good["nation"].join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi"), "nations_in_region"), count(orders, "orders_in_window")]
    return _stacked(parts)
