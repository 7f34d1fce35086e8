"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions import dates, money, scalars
from plinth.operators import compare, hybrid, joins, revenue, stats, validate
from plinth.operators.revenue import REVENUE_SQL, RevenueParams
from plinth.plans import files  # noqa: F401  registers its queries
from plinth.plans.registry import ASIA, MATCHED, ORACLES, QUERIES, REV, START, Tables, query, revenue_sql  # noqa: F401
from plinth.sources import generate
from plinth.sources.records import row_kind
from plinth.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS, read_parquet, register_views

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue.regional_revenue(Tables(spark, sf_dir), RevenueParams("ASIA", START))


# Regional revenue ------------------------------------------------------------


def _revenue(name: str, params: RevenueParams, sql: str) -> None:
    query(sql, name)(lambda spark, t: revenue.regional_revenue(t, params))


_revenue("q5_asia_1995", ASIA, revenue_sql())
_revenue("q5_america_1995", RevenueParams("AMERICA", START), revenue_sql("AMERICA"))
_revenue("q5_europe_1997", RevenueParams("EUROPE", date(1997, 1, 1)), revenue_sql("EUROPE", "1997-01-01", "1998-01-01"))
_revenue("q5_all_dates", RevenueParams("ASIA", None), revenue_sql("ASIA", "1000-01-01", "3000-01-01"))
_revenue("q5_empty_window", RevenueParams("ASIA", date(1994, 1, 1)), revenue_sql("ASIA", "1994-01-01", "1995-01-01"))
_revenue("q5_unknown_region", RevenueParams("ATLANTIS", START), revenue_sql("ATLANTIS"))


@query(revenue_sql())
def q5_sql_views(spark, t):
    register_views({n: t[n] for n in ("region", "nation", "supplier", "customer", "orders", "lineitem")}, "plinth_")
    own = REVENUE_SQL.format(region="ASIA", start="1995-01-01", end="1996-01-01")
    for n in ("customer", "orders", "lineitem", "supplier", "nation", "region"):
        own = own.replace(f"from {n} ", f"from plinth_{n} ").replace(f"join {n} ", f"join plinth_{n} ")
    return spark.sql(own)


@query(f"select (select count(*) from lineitem) as input_rows, (select count(*) {MATCHED}) as matched_rows")
def q5_matched_counts(spark, t):
    matched = revenue.matched_lines(t, ASIA).agg(F.count(F.lit(1)).alias("matched_rows")).scalar()
    return t["lineitem"].agg(F.count(F.lit(1)).alias("input_rows")).withColumn("matched_rows", matched)


@query(f"select n_name, count(*) as matched, cast(sum{REV} as bigint) as revenue_1e4 {MATCHED} group by n_name")
def q5_nation_matched(spark, t):
    lines = revenue.matched_lines(t, ASIA)
    return lines.groupBy("n_name").agg(F.count(F.lit(1)).alias("matched"), F.sum(revenue.line_revenue()).alias("revenue_1e4"))


@query(f"select n_name, cast(cast(sum(cast(l_extendedprice as decimal(15,2)) * (1 - cast(l_discount as decimal(15,2)))) as decimal(38,4)) as varchar) as revenue {MATCHED} group by n_name")
def q5_decimal_revenue(spark, t):
    price, discount = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(15,2)")
    total = F.sum(price * (F.lit(1).cast("decimal(15,2)") - discount)).cast("decimal(38,4)").cast("string")
    return revenue.matched_lines(t, ASIA).groupBy("n_name").agg(total.alias("revenue"))


@query(
    f"""with q as (select n_name, cast(sum{REV} as bigint) as r {MATCHED} group by n_name),
    c as (select n_name, (abs(r) + 50) // 100 as cents, r from q)
    select n_name, case when r < 0 then '-' else '' end || cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0') as revenue from c"""
)
def q5_formatted_revenue(spark, t):
    return revenue.regional_revenue(t, ASIA).select("n_name", money.format_revenue(F.col("revenue_1e4")).alias("revenue"))


for _ratio in (0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0):
    query(revenue_sql(), f"q5_hybrid_r{round(_ratio * 1000):04d}")(lambda spark, t, ratio=_ratio: hybrid.split_revenue(t, ASIA, ratio))


@query(
    f"""select n_name, cast(sum(case when n_name = 'NATION_7' then 0 else {REV} end) as bigint) as revenue_1e4 {MATCHED}
    group by n_name having sum(case when n_name = 'NATION_7' then 0 else {REV} end) <> 0"""
)
def q5_zero_revenue_dropped(spark, t):
    lines = revenue.matched_lines(t, ASIA)
    free = F.when(F.col("n_name") == "NATION_7", F.lit(1.0)).otherwise(F.col("l_discount"))
    return revenue.total_by_nation(lines.withColumn("l_discount", free).select("n_name", revenue.line_revenue().alias("revenue_1e4")))


@query(
    f"""with m as (select l.l_orderkey, l.l_suppkey, count(*) as c {MATCHED} group by all),
    k as (select (select max(o_orderkey) from orders) as mo, (select max(s_suppkey) from supplier) as ms)
    select cast(sum(8 + case when l_orderkey between 0 and mo and l_suppkey between 0 and ms then 8 else 0 end) + 12 * (select coalesce(sum(c), 0) from m) as bigint) as mapped_bytes
    from lineitem, k"""
)
def q5_mapped_read_bytes(spark, t):
    most_order = t["orders"].agg(F.max("o_orderkey")).scalar()
    most_supplier = t["supplier"].agg(F.max("s_suppkey")).scalar()
    matched = revenue.matched_lines(t, ASIA).agg(F.count(F.lit(1))).scalar()
    known = F.col("l_orderkey").between(F.lit(0), most_order) & F.col("l_suppkey").between(F.lit(0), most_supplier)
    read = t["lineitem"].agg(F.sum(F.lit(8).cast("bigint") + F.when(known, 8).otherwise(0)).alias("bytes"))
    return read.select((F.col("bytes") + matched * 12).alias("mapped_bytes"))


@query(
    """select n.n_name, (select count(*) from customer c where c.c_nationkey = n.n_nationkey) as customers,
    (select count(*) from supplier s where s.s_nationkey = n.n_nationkey) as suppliers
    from nation n where exists (select 1 from region r where r.r_regionkey = n.n_regionkey and r.r_name = 'ASIA')"""
)
def q5_semi_dims(spark, t):
    region = t["region"].filter("r_name = 'ASIA'")
    nations = t["nation"].join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = t["customer"].groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    suppliers = t["supplier"].groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    zero = F.lit(0).cast("bigint")
    return (
        nations.join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .select("n_name", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"))
    )


@query(revenue_sql())
def q5_strict(spark, t):
    return revenue.regional_revenue(revenue.checked(t, ASIA), ASIA)


# Joins -------------------------------------------------------------------------

_BUILD = lambda t: t["orders"].select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload"))
_PROBE = lambda t: t["lineitem"].select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("payload"))

for _name in joins.STRATEGIES:
    query("select count(*) as matches from orders join lineitem on o_orderkey = l_orderkey", f"join_count_{_name}")(
        lambda spark, t, how=_name: joins.join_count(_BUILD(t), _PROBE(t), how)
    )


@query("select o_custkey as r_payload, l_suppkey as s_payload from orders join lineitem on o_orderkey = l_orderkey")
def join_rid_pairs(spark, t):
    return joins.join_relations(_BUILD(t), _PROBE(t), "pro")


@query("select count(*) as matches from customer join supplier on c_nationkey = s_nationkey")
def join_dup_keys(spark, t):
    build = t["supplier"].select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("payload"))
    probe = t["customer"].select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("payload"))
    return joins.join_count(build, probe, "sort_merge")


@query("select count(*) as matches from orders join lineitem on o_orderkey = -1 - l_orderkey")
def join_no_match(spark, t):
    probe = t["lineitem"].select((-1 - F.col("l_orderkey")).alias("key"), F.col("l_suppkey").alias("payload"))
    return joins.join_count(_BUILD(t), probe, "npo")


@query("select count(*) as matches from range(1024) r(k) join (select id % 1024 as k from range(4096) s(id)) s using (k)")
def join_fk_generated(spark, t):
    return joins.join_count(generate.pk_relation(spark, 1024, seed=12345), generate.fk_relation(spark, 4096, 1024), "pro")


_STAR = """select count(*) as matches, cast(sum(o.payload - (1 - p.payload)) as bigint) as aggregate_sum
from (select id % 15000 + 1 as order_fk, id % 8000 + 1 as partsupp_fk from range(60000) l(id)) l
join (select id as key, {o} as payload from range(1, 15001) o(id)) o on l.order_fk = o.key
join (select id as key, {p} as payload from range(1, 8001) p(id)) p on l.partsupp_fk = p.key"""
_star = lambda spark: generate.star_data(spark, lineorder=60000, orders=15000, partsupp=8000)

for _name in joins.STAR_MODES:
    query(_STAR.format(o=3, p=1), f"star_{_name}")(lambda spark, t, mode=_name: joins.star_join(_star(spark), mode))

for _width, _mask in ((1, 255), (2, 65535), (4, 4294967295)):

    def _narrow(spark, t, width=_width):
        data = _star(spark)
        data["orders"] = data["orders"].withColumn("payload", F.col("key") * 1000)
        return joins.star_join(data, "vj", width)

    query(_STAR.format(o=f"(id * 1000) & {_mask}", p=1), f"star_vj_narrow_{_width}")(_narrow)


@query(
    """with p as (select l_orderkey & 63 as part, count(*) as cnt from lineitem group by 1)
    select part, cnt, cast(coalesce(sum(cnt) over (order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from p"""
)
def radix_histogram(spark, t):
    return joins.radix_histogram(_PROBE(t), 6)


# Validation and comparison -----------------------------------------------------------


@query(" union all ".join(f"select '{n}' as \"table\", count(*) as total, count(distinct {k}) as distinct_keys from {n}" for n, k in PRIMARY_KEYS.items()))
def pk_uniqueness_report(spark, t):
    return validate.pk_report(t)


@query(" union all ".join(f"select '{c}' as \"table\", '{fk}' as fk, count(*) as orphans from {c} where not exists (select 1 from {p} where {pk} = {fk})" for c, fk, p, pk in FOREIGN_KEYS))
def fk_orphans(spark, t):
    return validate.fk_orphans(t)


@query("select s_nationkey, count(*) as n from supplier group by s_nationkey having count(*) > 1")
def duplicate_key_report(spark, t):
    return validate.duplicate_keys(t["supplier"], "s_nationkey")


@query(
    " union all ".join(
        f"select '{n}' as \"table\", '{c}' as \"column\", count(*) filter (where {c} is null) as nulls from {n}" for n, contract in validate.CONTRACT.items() for c in contract.names
    )
)
def null_report(spark, t):
    return validate.null_report(t)


@query(
    " union all ".join(f"select 'rows_{n}' as \"check\", count(*) as value from {n}" for n in validate.CONTRACT)
    + """ union all select 'lineitem_nulls', count(*) from lineitem where l_orderkey is null or l_suppkey is null or l_extendedprice is null or l_discount is null
    union all select 'lineitem_out_of_range', count(*) from lineitem where l_extendedprice < 0 or l_discount < 0 or l_discount > 1
    union all select 'regions_found', count(*) from region where r_name = 'ASIA'
    union all select 'nations_in_region', count(*) from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'
    union all select 'orders_in_window', count(*) from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-01-01'"""
)
def validation_report(spark, t):
    return validate.validation_report(t, ASIA)


@query(" union all ".join(f"select '{n}' as \"table\", cast(max({k}) as bigint) as max_key from {n}" for n, k in PRIMARY_KEYS.items()))
def max_keys(spark, t):
    return validate.max_keys(t)


@query(
    f"""with e as (select *, row_number() over (order by revenue_1e4 desc, n_name) as position from ({revenue_sql()})),
    a as (select *, row_number() over (order by revenue_1e4 desc, n_name) as position from ({revenue_sql(start="1996-01-01", end="1997-01-01")})),
    j as (select coalesce(e.position, a.position) as position, e.n_name as en, a.n_name as an, cast(e.revenue_1e4 as varchar) as er, cast(a.revenue_1e4 as varchar) as ar
          from e full join a on e.position = a.position)
    select position, 'n_name' as field, en as expected, an as actual from j where en is distinct from an
    union all select position, 'revenue_1e4', er, ar from j where er is distinct from ar"""
)
def rows_diff(spark, t):
    order = (F.desc("revenue_1e4"), "n_name")
    own = [compare.numbered(revenue.regional_revenue(t, RevenueParams("ASIA", date(y, 1, 1))), *order) for y in (1995, 1996)]
    return compare.rows_diff(*own, ["n_name", "revenue_1e4"])


@query(
    f"""with p as (select n_name, cast(sum{REV} as bigint) as revenue_1e4 {MATCHED} and l.l_orderkey % 2 = 0 group by n_name
    union all select n_name, cast(sum{REV} as bigint) {MATCHED} and l.l_orderkey % 2 <> 0 group by n_name)
    select n_name, cast(sum(revenue_1e4) as bigint) as revenue_1e4 from p group by n_name having sum(revenue_1e4) <> 0"""
)
def merge_partials(spark, t):
    def half(side):
        own = {**{n: t[n] for n in ("region", "nation", "supplier", "customer", "orders")}, "lineitem": t["lineitem"].filter(side)}
        return revenue.regional_revenue(own, ASIA)

    return revenue.total_by_nation(half("l_orderkey % 2 = 0").unionByName(half("l_orderkey % 2 <> 0")))


# Scalar functions ----------------------------------------------------------------------


@query(
    """with d as (select distinct cast(o_orderdate as date) as d from orders)
    select d as o_orderdate, cast(d + interval 1 year as date) as next_year, date_diff('day', date '1970-01-01', d) as days,
    cast(day(last_day(d)) as integer) as month_days, (year(d) % 4 = 0 and (year(d) % 100 <> 0 or year(d) % 400 = 0)) as leap from d"""
)
def date_functions(spark, t):
    days = t["orders"].select(F.col("o_orderdate").cast("date").alias("o_orderdate")).distinct()
    d = F.col("o_orderdate")
    return days.select(d, dates.add_year(d).alias("next_year"), dates.epoch_days(d).cast("bigint").alias("days"), dates.days_in_month(d).alias("month_days"), dates.is_leap_year(d).alias("leap"))


@query("select o_orderkey, cast(cast(o_orderdate as date) as varchar) as text, cast(o_orderdate as date) as parsed from orders")
def parse_dates(spark, t):
    text = F.col("o_orderdate").cast("date").cast("string")
    return t["orders"].select("o_orderkey", text.alias("text"), dates.parse_day(text).alias("parsed"))


_TEXTS = ("12", "-3.5", "0.05", "0.055", "7.", ".5", "1e3", "", "-0.10", "+1", "99.99", "1.2.3")


@query("select * from (values " + ", ".join(f"('{x}', {v})" for x, v in zip(_TEXTS, (1200, -350, 5, "null", "null", "null", "null", "null", -10, "null", 9999, "null"), strict=True)) + ") v(text, scaled)")
def parse_decimals(spark, t):
    texts = spark.createDataFrame([(x,) for x in _TEXTS], "text string")
    return texts.select("text", money.parse_scaled(F.col("text"), strict=False).alias("scaled"))


@query("select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as cents, cast(round(l_discount * 100) as bigint) as hundredths, " + REV + " as revenue_1e4 from lineitem")
def line_money(spark, t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", money.scaled(F.col("l_extendedprice")).alias("cents"), money.scaled(F.col("l_discount")).alias("hundredths"), revenue.line_revenue().alias("revenue_1e4"))


_NUMBERS = ("1,234.5", "1.234,5", "12,5", "1,234", "1 234", "x", "-7.25")


@query("select * from (values " + ", ".join(f"('{x}', {v})" for x, v in zip(_NUMBERS, ("1234.5::double", "1234.5", "12.5", "1234", "1234", "null", "-7.25"), strict=True)) + ") v(text, number)")
def local_numbers(spark, t):
    return spark.createDataFrame([(x,) for x in _NUMBERS], "text string").select("text", scalars.local_number(F.col("text")).alias("number"))


@query("select event_type, case when regexp_matches(lower(event_type), 'memcpy|memset|h2d|d2h') then 'memcpy' when regexp_matches(lower(event_type), 'kernel|<<<|__global__') then 'kernel' when regexp_matches(lower(event_type), 'range|nvtx') or lower(event_type) like ':%' then 'range' else 'other' end as kind, count(*) as n from events group by 1, 2")
def row_kinds(spark, t):
    return t["events"].groupBy("event_type", row_kind(F.col("event_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, sha256(cast(o_orderkey as varchar)) as hash, regexp_matches(substr(sha256(cast(o_orderkey as varchar)), 1, 16), '^[0-9a-f]{16}$') as short_ok from orders")
def hash_texts(spark, t):
    own = F.upper(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256))
    return t["orders"].select("o_orderkey", scalars.sha256_text(own).alias("hash"), scalars.is_result_hash(F.substring(F.lower(own), 1, 16)).alias("short_ok"))


@query("select n_name, dense_rank() over (order by n_name) - 1 as code from nation")
def dictionary_codes(spark, t):
    return t["nation"].select("n_name", (F.dense_rank().over(Window.orderBy("n_name")) - 1).cast("bigint").alias("code"))


@query("select distinct o_orderpriority as value from orders order by value")
def distinct_values(spark, t):
    return t["orders"].select(F.col("o_orderpriority").alias("value")).distinct().orderBy("value")


@query("select l_orderkey as key, l_suppkey as payload from lineitem order by key, payload")
def key_sort(spark, t):
    return _PROBE(t).orderBy("key", "payload")


@query("select c_custkey, c_name from customer order by c_custkey limit 5")
def sample_rows(spark, t):
    return t["customer"].select("c_custkey", "c_name").orderBy("c_custkey").limit(5)


@query("select s, row_number() over (order by try_cast(s as double) is null, try_cast(s as double), s) as place from (values ('10'), ('2'), ('0.5'), ('tiny'), ('large'), ('1')) v(s)")
def scale_sort(spark, t):
    scales = spark.createDataFrame([(x,) for x in ("10", "2", "0.5", "tiny", "large", "1")], "s string")
    return scales.select("s", F.row_number().over(Window.orderBy(*stats.scale_order(F.col("s")))).cast("bigint").alias("place"))


@query("select r.r_name, n.n_name, to_json({'r': r.r_name, 'n': n.n_name}) as j from region r join nation n on r.r_regionkey = n.n_regionkey")
def json_rows(spark, t):
    pairs = t["region"].join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey"))
    return pairs.select("r_name", "n_name", F.to_json(F.struct(F.col("r_name").alias("r"), F.col("n_name").alias("n"))).alias("j"))


# Statistics ------------------------------------------------------------------------------


@query(
    """select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as median, round(avg(value), 6) as mean, round(min(value), 6) as min, round(max(value), 6) as max,
    round(stddev_pop(value), 6) as pstdev, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.95), 6) as p95
    from events group by event_type"""
)
def stats_percentiles(spark, t):
    return stats.summary(t["events"], ["event_type"], "value", digits=6)


_RUNS = """select id % 5 as config, id // 5 as request_index, id // 5 < 3 as is_warmup, case when id % 17 = 16 then 'error' else 'ok' end as status,
    case when id % 17 = 16 then null else lpad(cast(id % 5 as varchar), 16, '0') end as result_hash, cast((id * 37) % 101 as double) + cast(id % 5 as double) * 10 as query_total_ms from range(200) r(id)"""


@query(
    f"""with r as ({_RUNS}), m as (select * from r where not is_warmup),
    s as (select config, count(*) filter (where status = 'ok') as n, quantile_cont(query_total_ms, 0.5) filter (where status = 'ok') as median,
      count(*) filter (where status = 'ok') as n_ok, count(*) filter (where status <> 'ok') as n_failed, count(distinct result_hash) filter (where status = 'ok') as n_hashes from m group by config),
    c as (select id as config, 100.0::double + 25 * id as setup_cost_ms from range(5) c(id))
    select config, n, round(median, 6) as median, n_ok, n_failed, n_hashes, setup_cost_ms, round(median + setup_cost_ms, 6) as amortised_1, round(median + setup_cost_ms / 10, 6) as amortised_10,
      round(median + setup_cost_ms / 100, 6) as amortised_100 from s join c using (config)"""
)
def stats_amortized(spark, t):
    i = F.col("id")
    bad = i % 17 == 16
    requests = spark.range(200).select(
        (i % 5).alias("config"),
        F.floor(i / 5).alias("request_index"),
        (F.floor(i / 5) < 3).alias("is_warmup"),
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(~bad, F.lpad((i % 5).cast("string"), 16, "0")).alias("result_hash"),
        ((i * 37 % 101).cast("double") + (i % 5).cast("double") * 10).alias("query_total_ms"),
    )
    setups = spark.range(5).select(i.alias("config"), F.lit(100.0).alias("dataset_load_ms"), (i * 25.0).alias("session_setup_ms"))
    out = stats.run_summary(requests, setups, ["config"])
    rounded = [F.round(c, 6).alias(c) for c in ("median", "amortised_1", "amortised_10", "amortised_100")]
    return out.select("config", "n", "n_ok", "n_failed", "n_hashes", "setup_cost_ms", *rounded)


_POINTS = "select s as scale, r / 8.0::double as ratio, cast((r - s) * (r - s) + s as double) as p50 from range(1, 6) s(s), range(9) r(r)"


def _points(spark) -> DataFrame:
    grid = spark.range(1, 6).select(F.col("id").alias("scale"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("r"))
    return grid.select("scale", (F.col("r") / 8.0).alias("ratio"), ((F.col("r") - F.col("scale")) * (F.col("r") - F.col("scale")) + F.col("scale")).cast("double").alias("p50"))


@query(
    f"""with p as ({_POINTS}), b as (select scale, min(struct_pack(p50 := p50, ratio := ratio)) as b from p group by scale), a as (select s as scale, s * 1.5::double as auto_ms from range(1, 6) s(s))
    select scale, b.ratio as best_ratio, b.p50 as best_ms, auto_ms, auto_ms - b.p50 as regret_ms, round((auto_ms - b.p50) * 100 / nullif(b.p50, 0), 6) as regret_percent from b join a using (scale)"""
)
def stats_best_and_regret(spark, t):
    auto = spark.range(1, 6).select(F.col("id").alias("scale"), (F.col("id") * 1.5).cast("double").alias("auto_ms"))
    return stats.best_and_regret(_points(spark), auto).withColumn("regret_percent", F.round("regret_percent", 6))


@query(
    f"""with p as (select scale, ratio, p50 - scale - 2 as delta from ({_POINTS})), n as (select *, lead(ratio) over w as nr, lead(delta) over w as nd from p window w as (partition by scale order by ratio))
    select scale, ratio as lo, case when abs(delta) <= 1e-12 then ratio else nr end as hi from n where abs(delta) <= 1e-12 or (abs(nd) > 1e-12 and delta * nd < 0)"""
)
def stats_break_even(spark, t):
    return stats.break_even(_points(spark).select("scale", "ratio", (F.col("p50") - F.col("scale") - 2).alias("delta")))


@query("select l_returnflag as flag, count(*) filter (where l_quantity > 10) as n_ok, round(avg(l_quantity) filter (where l_quantity > 10), 6) as mean from lineitem group by 1")
def stats_mean_of_successes(spark, t):
    lines = t["lineitem"].withColumnRenamed("l_returnflag", "flag")
    return stats.mean_of_successes(lines, ["flag"], "l_quantity", F.col("l_quantity") > 10).withColumn("mean", F.round("mean", 6))


@query("select event_type, round(count(*) * 1000.0::double / nullif(sum(value), 0), 6) as per_second from events group by event_type")
def stats_throughput(spark, t):
    grouped = t["events"].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("ms"))
    return grouped.select("event_type", F.round(stats.throughput(F.col("n"), F.col("ms")), 6).alias("per_second"))


_RECORDS = """select id, (id % 9) / 8.0::double as cpu_ratio, 1 - (id % 9) / 8.0::double + case when id % 10 = 9 then 0.1 else 0 end as gpu_ratio, 1000 as input_rows,
    case when id % 13 = 12 then 1001 else id end as matched_rows, 100 * (id % 9) as cpu_rows, 1000 - 100 * (id % 9) as gpu_rows, case when id % 7 = 6 then 'xyz' else '0123456789abcdef' end as result_hash from range(100) r(id)"""


@query(f"select id from ({_RECORDS}) where abs(cpu_ratio + gpu_ratio - 1) > 1e-9 or matched_rows > input_rows or cpu_rows + gpu_rows <> input_rows or not regexp_matches(result_hash, '^[0-9a-f]{{16}}$')")
def record_invariants(spark, t):
    i = F.col("id")
    share = (i % 9) / 8.0
    records = spark.range(100).select(
        i,
        share.alias("cpu_ratio"),
        (1 - share + F.when(i % 10 == 9, 0.1).otherwise(0.0)).alias("gpu_ratio"),
        F.lit(1000).alias("input_rows"),
        F.when(i % 13 == 12, 1001).otherwise(i).alias("matched_rows"),
        (i % 9 * 100).alias("cpu_rows"),
        (1000 - i % 9 * 100).alias("gpu_rows"),
        F.lit("ok").alias("status"),
        F.when(i % 7 == 6, "xyz").otherwise("0123456789abcdef").alias("result_hash"),
    )
    return stats.broken_records(records).select("id")


# Splits, model and generators --------------------------------------------------------------

_BATCHES = "select o_orderkey % 16 as batch, count(*) as len from orders group by 1"
_batches = lambda t: t["orders"].groupBy((F.col("o_orderkey") % 16).alias("batch")).agg(F.count(F.lit(1)).alias("len"))


@query(
    f"""with b as ({_BATCHES}), w as (select *, cast(floor(sum(len) over () * 0.375::double + 0.5) as bigint) as target, coalesce(sum(len) over (order by batch rows between unbounded preceding and 1 preceding), 0) as prev from b),
    f as (select batch, len, cast(greatest(0, least(len, target - prev)) as bigint) as first_len from w) select batch, len, first_len, len - first_len as second_len from f"""
)
def batch_split_exact(spark, t):
    return hybrid.exact_split(_batches(t), 0.375)


@query(
    f"""with b as ({_BATCHES}), e as (select cast(0 as bigint) as k, cast(0 as bigint) as cum union all select row_number() over (order by batch), cast(sum(len) over (order by batch) as bigint) from b),
    d as (select *, abs(cum - (select sum(len) from b) * 0.4::double) as apart from e) select k as first_batches, cum as first_rows from d order by apart, cum limit 1"""
)
def batch_split_boundary(spark, t):
    return hybrid.boundary_split(_batches(t), 0.4)


_CASES = ((100, 10.0, 10.0, 0.0), (100, 10.0, 20.0, 0.0), (100, 20.0, 10.0, 0.0), (100, 10.0, 1.0, 100.0), (100, 10.0, 20.0, 4.0))


@query(
    "with c as (select * from (values " + ", ".join(f"({i}, {c[1]}::double, {c[2]}::double, {c[3]}::double)" for i, c in enumerate(_CASES)) + """) v(id, a, b, f)),
    r as (select id, a, b, f, s.r, greatest(s.r * a, case when s.r = 1 then 0 else f + (1 - s.r) * b end) as total from c,
      lateral (select unnest([1.0::double, 0.0::double, least(1.0::double, greatest(0.0::double, (f + b) / (a + b)))]) as r, unnest([0, 1, 2]) as o) s)
    select cast(id as bigint) as id, round(arg_min(r, total), 9) as ratio, round(min(total), 9) as total_ms from r group by id"""
)
def cost_model(spark, t):
    rows = [(i, round(p.ratio, 9), round(p.total_ms, 9)) for i, c in enumerate(_CASES) for p in [hybrid.predict_ratio(*c)]]
    return spark.createDataFrame(rows, "id long, ratio double, total_ms double")


@query("select key, round(sum(1.0::double / pow(key, 0.75)) over (order by key) / sum(1.0::double / pow(key, 0.75)) over (), 9) as cdf from range(1, 1001) r(key)")
def zipf_keys(spark, t):
    return generate.zipf_cdf(spark, 1000, 0.75).select("key", F.round("cdf", 9).alias("cdf"))


@query("select id % 300 + 1 as key, count(*) as n from range(10000) r(id) group by 1")
def fk_multiplicity(spark, t):
    return generate.fk_relation(spark, 10000, 300).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(1000 as bigint) as n, cast(1 as bigint) as lo, cast(1000 as bigint) as hi, cast(1000 as bigint) as different")
def pk_permutation(spark, t):
    return generate.pk_relation(spark, 1000, seed=7).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count_distinct("key").alias("different"))


@query("select count(*) as n, min(k) as lo, max(k) as hi from (select id % 64 + 1 as k from range(1000) r(id))")
def fk_from_pk(spark, t):
    return generate.fk_from_pk(generate.pk_relation(spark, 64, seed=3), 1000).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@query("select n_name, count(*) as customers from (select case when id % 3 <> 0 then id % 5 * 5 + 2 else id % 25 end as k from range(1, 1001) r(id)) c join (select id as k, 'NATION_' || id as n_name from range(25) n(id)) n using (k) group by 1")
def generated_skew(spark, t):
    data = generate.revenue_data(spark, skewed=True)
    return data["customer"].join(data["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))
