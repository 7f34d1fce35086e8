"""Regional revenue: orders of a year whose customer and supplier share a nation of a region."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.dates import next_year
from plinth.functions.money import revenue_1e4, scaled
from plinth.sources.tables import PRIMARY_KEYS

MAX_HUNDREDTHS = 100


@dataclass(frozen=True)
class RevenueParams:
    """region, and the order dates from start up to before end (a year later when None)."""

    region: str = "ASIA"
    start: date | None = date(1994, 1, 1)
    end: date | None = None

    @property
    def window(self) -> tuple[date, date] | None:
        if self.start is None:
            return None
        return self.start, self.end or next_year(self.start)


def matched_lines(tables: dict[str, DataFrame], params: RevenueParams) -> DataFrame:
    """n_name, l_extendedprice, l_discount of the lines that count.

    The region restricts customers and suppliers before the large joins. Lines meet the
    region's suppliers first, so only the region's share of them is shuffled for the join with
    orders, where the nation is a second key, not a filter. Strategies are left to the
    optimizer, which broadcasts a side only by its size.
    """
    regions = tables["region"].filter(F.col("r_name") == params.region).select("r_regionkey")
    nations = tables["nation"].join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")
    customers = tables["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    suppliers = tables["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_nationkey")
    orders = tables["orders"]
    if params.window:
        start, end = params.window
        orders = orders.filter((F.col("o_orderdate") >= F.lit(start)) & (F.col("o_orderdate") < F.lit(end)))
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "n_name")
    lines = tables["lineitem"].select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(placed, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .select("n_name", "l_extendedprice", "l_discount")
    )


def line_revenue() -> Column:
    return revenue_1e4(F.col("l_extendedprice"), F.col("l_discount"))


def regional_revenue(tables: dict[str, DataFrame], params: RevenueParams) -> DataFrame:
    """n_name, revenue_1e4, largest first, then by name; nations without revenue are dropped."""
    return total_by_nation(matched_lines(tables, params).select("n_name", line_revenue().alias("revenue_1e4")))


def total_by_nation(parts: DataFrame) -> DataFrame:
    """Sum parts (n_name, revenue_1e4) by name: also merges partial results."""
    sums = parts.groupBy("n_name").agg(F.sum("revenue_1e4").alias("revenue_1e4"))
    return sums.filter("revenue_1e4 <> 0").orderBy(F.desc("revenue_1e4"), "n_name")


def strict_checks(tables: dict[str, DataFrame], params: RevenueParams) -> DataFrame:
    """what, bad: a row for each check, with the rows that break it; one pass over each table."""
    count = lambda df, what, bad: df.agg(F.lit(what).alias("what"), bad.cast("bigint").alias("bad"))
    unique = [count(tables[name].groupBy(key).agg(F.count(F.lit(1)).alias("n")), f"{name}.{key} is not unique", F.count_if(F.col("n") > 1)) for name, key in PRIMARY_KEYS.items()]
    price, discount = scaled(F.col("l_extendedprice")), scaled(F.col("l_discount"))
    wrong = F.coalesce((price < 0) | (discount < 0) | (discount > MAX_HUNDREDTHS), F.lit(True))
    known = count(tables["region"], f"no region {params.region!r}", (F.count_if(F.col("r_name") == params.region) == 0).cast("int"))
    money = count(tables["lineitem"], "lineitem has a price below 0 or a discount outside 0 to 1", F.count_if(wrong))
    return reduce(DataFrame.unionByName, [known, *unique, money])


def checked(tables: dict[str, DataFrame], params: RevenueParams) -> dict[str, DataFrame]:
    """The tables, after strict checks: the region exists, keys are unique, money is in range."""
    for row in strict_checks(tables, params).filter("bad > 0").collect():
        raise ValueError(row["what"])
    return tables


REVENUE_SQL = """
select n.n_name,
       cast(sum(cast(round(l.l_extendedprice * 100) as bigint)
              * (100 - cast(round(l.l_discount * 100) as bigint))) as bigint) as revenue_1e4
from customer c
join orders o on c.c_custkey = o.o_custkey
join lineitem l on l.l_orderkey = o.o_orderkey
join supplier s on l.l_suppkey = s.s_suppkey and c.c_nationkey = s.s_nationkey
join nation n on s.s_nationkey = n.n_nationkey
join region r on n.n_regionkey = r.r_regionkey
where r.r_name = '{region}' and o.o_orderdate >= date '{start}' and o.o_orderdate < date '{end}'
group by n.n_name
having sum(cast(round(l.l_extendedprice * 100) as bigint) * (100 - cast(round(l.l_discount * 100) as bigint))) <> 0
order by revenue_1e4 desc, n.n_name
"""
