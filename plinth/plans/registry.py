"""Where queries register, with their SQL, and what several of them share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from plinth.operators.revenue import REVENUE_SQL, RevenueParams

#: Orders in the generated tables start here.
START = date(1995, 1, 1)

QUERIES = {}
ORACLES = {}


def query(sql: str, name: str | None = None):
    """Register a function of (spark, tables, sf_dir) with its SQL."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(spark, Tables(spark, sf_dir))
        ORACLES[key] = sql
        return f

    return put


class Tables(dict):
    """Tables by name, read when first asked for; a table's schema is read from its files once."""

    schemas: dict[str, StructType] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        known = self.schemas.get(path)
        self[name] = (self.spark.read.schema(known) if known else self.spark.read).parquet(path)
        self.schemas[path] = self[name].schema
        return self[name]


def revenue_sql(region: str = "ASIA", start: str = "1995-01-01", end: str = "1996-01-01") -> str:
    return REVENUE_SQL.format(region=region, start=start, end=end)


MATCHED = """
from customer c
join orders o on c.c_custkey = o.o_custkey
join lineitem l on l.l_orderkey = o.o_orderkey
join supplier s on l.l_suppkey = s.s_suppkey and c.c_nationkey = s.s_nationkey
join nation n on s.s_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
where r.r_name = 'ASIA' and o.o_orderdate >= date '1995-01-01' and o.o_orderdate < date '1996-01-01'
"""
REV = "(cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint)))"
ASIA = RevenueParams("ASIA", START)
