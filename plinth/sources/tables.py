"""The six tables of the revenue query, from Parquet or as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = ("region", "nation", "supplier", "customer", "orders", "lineitem")

_INT, _TEXT, _DAY, _MONEY = T.IntegerType(), T.StringType(), T.DateType(), T.DecimalType(15, 2)


def _contract(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, False) for name, kind in columns.items()])


#: Strict contract of the six tables: columns and types, none of them null.
CONTRACT = {
    "region": _contract(r_regionkey=_INT, r_name=_TEXT),
    "nation": _contract(n_nationkey=_INT, n_name=_TEXT, n_regionkey=_INT),
    "supplier": _contract(s_suppkey=_INT, s_nationkey=_INT),
    "customer": _contract(c_custkey=_INT, c_nationkey=_INT),
    "orders": _contract(o_orderkey=_INT, o_custkey=_INT, o_orderdate=_DAY),
    "lineitem": _contract(l_orderkey=_INT, l_suppkey=_INT, l_extendedprice=_MONEY, l_discount=_MONEY),
}
PRIMARY_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)


def read_parquet(spark: SparkSession, sf_dir: str, names=NAMES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
