"""Text sources: pipe-separated tables, and relations of keys and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.dates import parse_day
from plinth.functions.money import parse_scaled

#: For each table: least number of fields, and (column, position, kind) of those read.
LAYOUT = {
    "region": (2, (("r_regionkey", 0, "int"), ("r_name", 1, "string"))),
    "nation": (3, (("n_nationkey", 0, "int"), ("n_name", 1, "string"), ("n_regionkey", 2, "int"))),
    "supplier": (4, (("s_suppkey", 0, "int"), ("s_nationkey", 3, "int"))),
    "customer": (4, (("c_custkey", 0, "int"), ("c_nationkey", 3, "int"))),
    "orders": (5, (("o_orderkey", 0, "int"), ("o_custkey", 1, "int"), ("o_orderdate", 4, "date"))),
    "lineitem": (7, (("l_orderkey", 0, "int"), ("l_suppkey", 2, "int"), ("l_extendedprice", 5, "money"), ("l_discount", 6, "money"))),
}


def read_tbl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of pipe-separated lines, without header, with a trailing pipe or not.

    Blank lines are skipped. A line with too few fields, a bad number, date or
    decimal raises. Money comes as decimal(15,2).
    """
    least, columns = LAYOUT[table]
    fields = F.split("value", r"\|", -1)
    lines = spark.read.text(path).filter(F.btrim("value") != "").select("value", fields.alias("f"))
    short = F.raise_error(F.concat(F.lit(f"{table}: too few fields: "), F.col("value")))
    field = F.when(F.size("f") >= least, F.col("f")).otherwise(short.cast("array<string>"))
    kinds = {
        "int": lambda c: c.cast("int"),
        "string": lambda c: c,
        "date": parse_day,
        "money": lambda c: (parse_scaled(c).cast("decimal(17,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(15,2)"),
    }
    return lines.select(field.alias("f")).select(*[kinds[kind](F.get("f", F.lit(at))).alias(name) for name, at, kind in columns])


def read_tbl_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_tbl(spark, f"{folder}/{name}.tbl", name) for name in LAYOUT}


def read_relation(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """key, payload from lines `k v`, `k,v`, `k|v` or `k` after one header line a file.

    A line with a key alone has payload 0; a key that is no number raises. rows keeps
    the first rows in file order.
    """
    sample = spark.read.text(path).limit(2).collect()[-1:]
    mark = next((c for c in "|, " if sample and c in sample[0]["value"].strip()), "|")
    raw = spark.read.csv(path, schema="key long, payload long", header=True, sep=mark)
    bad = F.raise_error(F.lit("a key is no number")).cast("bigint")
    out = raw.select(F.coalesce("key", bad).alias("key"), F.coalesce("payload", F.lit(0).cast("bigint")).alias("payload"), F.monotonically_increasing_id().alias("at"))
    return (out.orderBy("at").limit(rows) if rows is not None else out).select("key", "payload")


def write_relation(df: DataFrame, path: str) -> None:
    """`#KEY, VAL` header and `k v` lines, range-sorted by payload over the files of a folder."""
    line = F.concat_ws(" ", F.col("key").cast("string"), F.col("payload").cast("string")).alias("#KEY, VAL")
    df.orderBy("payload", "key").select(line).write.option("comment", "\x02").csv(path, sep="\x01", header=True)
