from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plinth.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_showConsoleProgress="false", spark_driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    """Six small tables: one line each that matches, misses the nation, the year or the region."""
    return {
        "region": spark.createDataFrame([(0, "AFRICA"), (1, "AMERICA"), (2, "ASIA"), (3, "EUROPE"), (4, "MIDDLE EAST")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(1, "ARGENTINA", 1), (8, "INDIA", 2), (9, "INDONESIA", 2), (12, "JAPAN", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": spark.createDataFrame([(1, 8), (2, 12), (3, 1)], "s_suppkey int, s_nationkey int"),
        "customer": spark.createDataFrame([(10, 8), (20, 12), (30, 9), (40, 1)], "c_custkey int, c_nationkey int"),
        "orders": spark.sql(
            "select * from values (100, 10, date'1994-02-01'), (101, 20, date'1994-06-01'), (102, 10, date'1993-06-01'), (103, 40, date'1994-03-01'), (104, 30, date'1994-05-01') t(o_orderkey, o_custkey, o_orderdate)"
        ),
        "lineitem": spark.sql(
            "select k l_orderkey, s l_suppkey, cast(p as decimal(15,2)) l_extendedprice, cast(d as decimal(15,2)) l_discount from values "
            "(100, 1, 100.00, 0.10), (100, 2, 50.00, 0.00), (101, 2, 200.00, 0.05), (102, 1, 300.00, 0.00), (103, 3, 120.00, 0.00), (104, 1, 80.00, 0.00) t(k, s, p, d)"
        ),
    }
