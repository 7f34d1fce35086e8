"""Registered queries of sources, sinks, records and sessions: written to a scratch folder, read back, and given as SQL."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions import scalars
from plinth.operators import compare, hybrid, joins, revenue, stats, validate
from plinth.operators.revenue import RevenueParams
from plinth.plans.registry import ASIA, MATCHED, REV, START, query, revenue_sql
from plinth.sources import dataset, generate, records, sinks, text
from plinth.sources.scratch import scratch_path
from plinth.sources.tables import CONTRACT
from plinth.streaming.session import RevenueSession

SIX = tuple(CONTRACT)


def _six(t) -> dict[str, DataFrame]:
    return {n: t[n].select(*[F.col(f.name).cast(f.dataType) for f in CONTRACT[n]]) for n in SIX}


def _rows(df: DataFrame) -> list[tuple[str, int]]:
    """A revenue result's rows, at most one a nation."""
    return [(r["n_name"], r["revenue_1e4"]) for r in df.collect()]


def _text_file(spark: SparkSession, content: str, name: str) -> str:
    """The path of a small text, written by Spark."""
    path = scratch_path(spark, name)
    spark.createDataFrame([(line,) for line in content.splitlines()], "value string").coalesce(1).write.text(path)
    return path


def _values(rows) -> str:
    quote = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x)
    return "(values " + ", ".join("(" + ", ".join(quote(x) for x in row) + ")" for row in rows) + ")"


# Tables as text and as datasets -----------------------------------------------------


def _tbl_folder(spark: SparkSession, t) -> str:
    """The six tables as .tbl text with a trailing pipe, the columns that are not read as x."""
    folder = scratch_path(spark, "tbl")
    for name, df in _six(t).items():
        least, columns = text.LAYOUT[name]
        at = {place: column for column, place, _ in columns}
        fields = [F.col(at[i]).cast("string") if i in at else F.lit("x") for i in range(least)]
        df.select(F.concat(F.concat_ws("|", *fields), F.lit("|")).alias("value")).write.text(f"{folder}/{name}.tbl")
    return folder


@query(revenue_sql())
def tbl_revenue(spark, t):
    return revenue.regional_revenue(text.read_tbl_dataset(spark, _tbl_folder(spark, t)), ASIA)


@query("select l_orderkey, l_suppkey, cast(l_extendedprice as decimal(15,2)) as l_extendedprice, cast(l_discount as decimal(15,2)) as l_discount from lineitem")
def tbl_lineitem(spark, t):
    return text.read_tbl(spark, f"{_tbl_folder(spark, t)}/lineitem.tbl", "lineitem").select(*[F.col(f.name).cast("int" if f.dataType == T.IntegerType() else f.dataType) for f in CONTRACT["lineitem"]])


_TBL_COUNTS = [(n, c, kind) for n, (_, columns) in text.LAYOUT.items() for c, _, kind in columns if kind != "string"]


@query(
    " union all ".join(f"select '{n}_rows' as \"check\", count(*) as value from {n} union all select '{n}_short', 0" for n in SIX)
    + "".join(f" union all select '{c}_bad', count(*) filter (where {c} is null) from {n}" for n, c, _ in _TBL_COUNTS)
    + """ union all select 'regions_found', count(*) from region where r_name = 'ASIA'
    union all select 'nations_in_region', count(*) from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'
    union all select 'orders_in_window', count(*) from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-01-01'"""
)
def tbl_validation(spark, t):
    return validate.tbl_report(spark, _tbl_folder(spark, t), ASIA)


_BAD_TBL = {
    "region": ("0|AFRICA|", "2|ASIA|x|", "|EUROPE|", "x|AMERICA|"),
    "nation": ("8|INDIA|2|", "9|INDONESIA|", "12|JAPAN|2"),
    "supplier": ("1|a|b|8|", "2|a|b||", "3|a|b|1.5|"),
    "customer": ("10|a|b|8|", "1e3|a|b|9|"),
    "orders": ("100|10|O|1|1995-02-01|", "101|10|O|1|1995-02-30|", "102|10|O|1|1996-01-01|", "103|10|"),
    "lineitem": ("100|1|1|1|1|100.00|0.10|", "100|1|2|1|1|1.005|0.10|", "101|1|2|1|1||0.05|", "102|1|1"),
}
_BAD_COUNTS = {
    "region_rows": 4, "region_short": 0, "r_regionkey_bad": 2, "nation_rows": 3, "nation_short": 1, "n_nationkey_bad": 0, "n_regionkey_bad": 0, "supplier_rows": 3, "supplier_short": 0, "s_suppkey_bad": 0, "s_nationkey_bad": 2,
    "customer_rows": 2, "customer_short": 0, "c_custkey_bad": 1, "c_nationkey_bad": 0, "orders_rows": 4, "orders_short": 1, "o_orderkey_bad": 0, "o_custkey_bad": 0, "o_orderdate_bad": 1,
    "lineitem_rows": 4, "lineitem_short": 1, "l_orderkey_bad": 0, "l_suppkey_bad": 0, "l_extendedprice_bad": 2, "l_discount_bad": 0, "regions_found": 1, "nations_in_region": 2, "orders_in_window": 1,
}


@query(f"select * from {_values(_BAD_COUNTS.items())} v(\"check\", value)")
def tbl_validation_faults(spark, t):
    folder = scratch_path(spark, "tbl")
    for name, lines in _BAD_TBL.items():
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{folder}/{name}.tbl")
    return validate.tbl_report(spark, folder, ASIA)


def _local(path: str) -> str:
    """A path of the file system that the driver and the executors share: the driver writes an Arrow file in one piece."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"an Arrow dataset needs a folder that the driver can open, not {path}")
    return path.removeprefix("file://").removeprefix("file:")


@query(revenue_sql())
def arrow_dataset_revenue(spark, t):
    folder = _local(scratch_path(spark, "arrow"))
    dataset.write_arrow_dataset(_six(t), folder)
    return revenue.regional_revenue(dataset.read_arrow_dataset(spark, folder), ASIA)


@query(" union all ".join(f"select '{n}' as \"table\", count(*) as \"rows\", cast(ceil(count(*) / 1000.0) as bigint) as batches from {n}" for n in SIX))
def arrow_manifest(spark, t):
    folder = _local(scratch_path(spark, "arrow"))
    dataset.write_arrow_dataset(_six(t), folder, batch_rows=1000)
    listed = dataset.verify_dataset(folder)["tables"]
    return spark.createDataFrame([(n, e["rows"], e["record_batches"]) for n, e in listed.items()], "table string, rows bigint, batches bigint")


@query(" union all ".join(f"select '{n}' as \"table\", count(*) as \"rows\", true as copied from {n}" for n in SIX))
def prepared_tbl(spark, t):
    source, target = _local(_tbl_folder(spark, t)), _local(scratch_path(spark, "prepared"))
    listed = dataset.prepare_tbl(source, target)["tables"]
    read = {n: df.count() for n, df in text.read_tbl_dataset(spark, target).items()}
    return spark.createDataFrame([(n, e["rows"], read[n] == e["rows"]) for n, e in listed.items()], "table string, rows bigint, copied boolean")


@query("select l_orderkey, l_suppkey from lineitem")
def parquet_dataset(spark, t):
    folder = scratch_path(spark, "parquet")
    dataset.write_parquet_dataset({"lineitem": t["lineitem"].select("l_orderkey", "l_suppkey")}, folder, batch_rows=1000)
    return spark.read.parquet(f"{folder}/lineitem.parquet")


@query("select sha256(string_agg(r_name, chr(10) order by r_regionkey) || chr(10)) as sha256, cast(sum(length(r_name) + 1) as bigint) as bytes from region")
def file_hashes(spark, t):
    path = scratch_path(spark, "hashed")
    t["region"].orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)
    return dataset.file_hashes(spark, f"{path}/part-*").select("sha256", "bytes")


def _resident_sql(name: str) -> str:
    fixed = sum({"int": 4, "date": 4}.get(f.dataType.simpleString(), 8) for f in CONTRACT[name] if f.dataType != T.StringType())
    return f"select '{name}' as \"table\", cast(coalesce(sum({fixed}{''.join(f' + strlen({f.name})' for f in CONTRACT[name] if f.dataType == T.StringType())}), 0) as bigint) as bytes from {name}"


_RESIDENT = " union all ".join(_resident_sql(n) for n in SIX)


@query(_RESIDENT)
def resident_bytes(spark, t):
    return validate.resident_bytes(_six(t))


# Relations --------------------------------------------------------------------------


@query("select o_orderkey as key, o_custkey as payload from orders")
def relation_file(spark, t):
    path = scratch_path(spark, "relation")
    text.write_relation(t["orders"].select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload")), path)
    return text.read_relation(spark, path)


@query("select o_orderkey as key, cast(0 as bigint) as payload from orders")
def relation_keys_alone(spark, t):
    path = scratch_path(spark, "keys")
    t["orders"].select(F.col("o_orderkey").cast("string").alias("#KEY")).write.csv(path, header=True)
    return text.read_relation(spark, path)


@query("select o_custkey as r_payload, l_suppkey as s_payload from orders join lineitem on o_orderkey = l_orderkey")
def rid_pairs_file(spark, t):
    path = scratch_path(spark, "pairs")
    build = t["orders"].select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("payload"))
    probe = t["lineitem"].select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("payload"))
    sinks.write_rid_pairs(joins.join_relations(build, probe, "pro"), path)
    both = F.split("value", " ")
    return spark.read.text(path).select(both[0].cast("bigint").alias("r_payload"), both[1].cast("bigint").alias("s_payload"))


@query(
    "select 'VJ' as name, 4 * (max(o_orderkey) + 1) as bytes from orders union all select 'PRVJ', 4 * (max(o_orderkey) + 1) from orders "
    "union all select 'NPO', 16 * count(*) from orders union all select 'SORTMERGE', 16 * count(*) from orders"
)
def join_stats_lines(spark, t):
    build = t["orders"].select(F.col("o_orderkey").cast("bigint").alias("key"), F.col("o_custkey").alias("payload"))
    lines = "".join(sinks.stats_lines(name, joins.strategy_stats(build, how).first().asDict()) for name, how in (("VJ", "vj"), ("PRVJ", "prvj"), ("NPO", "npo"), ("SORTMERGE", "sort_merge")))
    read = spark.read.text(_text_file(spark, lines, "stats")).filter(~F.contains("value", F.lit("_HEADER")))
    cells = F.split("value", ",")
    # The bytes stand after the payload's width where there is one.
    at = F.when(F.size(cells) > 2, 2).otherwise(1)
    return read.select(F.regexp_extract("value", "^([A-Z]+)_STATS_CSV,", 1).alias("name"), F.get(cells, at).cast("bigint").alias("bytes"))


@query("select cast(10000 as bigint) as n, true as in_range, cast(10000 as bigint) as payloads, true as some_repeat, true as not_all_repeat")
def uniform_keys(spark, t):
    drawn = generate.uniform_relation(spark, 10000, max_id=5000, seed=3)
    keys = F.count_distinct("key")
    return drawn.agg(F.count(F.lit(1)).alias("n"), ((F.min("key") >= 0) & (F.max("key") < 5000)).alias("in_range"), F.count_distinct("payload").alias("payloads"), (keys < 5000).alias("some_repeat"), (keys > 4000).alias("not_all_repeat"))


@query(
    """with w as (select key, 1.0::double / pow(key, 1.0) as w from range(1, 101) r(key)), s as (select key, w / sum(w) over () as share from w)
    select key, true as as_often_as_expected from s"""
)
def zipf_draws(spark, t):
    n = 20000
    drawn = generate.zipf_relation(spark, n, 100, 1.0, seed=5).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    share = generate.zipf_cdf(spark, 100, 1.0).select("key", "share")
    wanted = F.col("share") * n
    return share.join(drawn, "key", "left").select("key", (F.abs(F.coalesce("c", F.lit(0)) - wanted) <= 6 * F.sqrt(wanted)).alias("as_often_as_expected"))


@query(f"select l_orderkey & 31 as part, count(*) as matches from lineitem join orders on o_orderkey = case when l_linenumber <= 6 then 1 else l_orderkey end group by 1")
def skewed_join(spark, t):
    """Most of the probe side has one key; adaptive execution splits it."""
    probe = t["lineitem"].select(F.when(F.col("l_linenumber") <= 6, F.lit(1)).otherwise(F.col("l_orderkey")).cast("bigint").alias("key"), F.col("l_orderkey").alias("payload"))
    build = t["orders"].select(F.col("o_orderkey").cast("bigint").alias("key"), F.col("o_custkey").alias("payload"))
    joined = joins.join_relations(build, probe, "sort_merge")
    return joined.groupBy(F.col("s_payload").bitwiseAND(F.lit(31)).alias("part")).agg(F.count(F.lit(1)).alias("matches"))


# Results and their sinks ----------------------------------------------------------------

_RESULT = revenue_sql()
_MONEY = "cast((revenue_1e4 + 50) // 100 // 100 as varchar) || '.' || lpad(cast((revenue_1e4 + 50) // 100 % 100 as varchar), 2, '0')"
#: The 64-bit FNV-1a fold over rows in their order, in SQL.
_HASH = f"""(with b as (select row_number() over (order by revenue_1e4 desc, n_name) as place, list_concat(list_concat(list_transform(string_split(n_name, ''), lambda c: cast(ascii(c) as uhugeint)), [255::uhugeint]),
    list_transform(range(0, 8), lambda i: cast((revenue_1e4 >> cast(8 * i as integer)) & 255 as uhugeint))) as bs from ({_RESULT})), f as (select flatten(list(bs order by place)) as bs from b)
    select lower(lpad(hex(cast(list_reduce(list_prepend({scalars.FNV_OFFSET}::uhugeint, bs), lambda h, x: (xor(h, x) * {scalars.FNV_PRIME}::uhugeint) % 18446744073709551616::uhugeint) as ubigint)), 16, '0')) from f)"""


@query(f"select {_HASH} as result_hash")
def result_hash(spark, t):
    return spark.createDataFrame([(scalars.result_hash(_rows(revenue.regional_revenue(t, ASIA))),)], "result_hash string")


@query(f"select 0 as place, 'nation,revenue_1e4,revenue' as line union all select row_number() over (order by revenue_1e4 desc, n_name), n_name || ',' || revenue_1e4 || ',' || {_MONEY} from ({_RESULT}) union all select 100, 'result_hash,' || {_HASH} union all select 101, 'total_ms,1.5'")
def rows_csv(spark, t):
    rows = _rows(revenue.regional_revenue(t, ASIA))
    path = _text_file(spark, sinks.rows_csv(rows, {"total_ms": 1.5}), "rows")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    place = F.when(F.startswith("value", F.lit("result_hash")), 100).when(F.startswith("value", F.lit("total_ms")), 101).otherwise(F.col("at"))
    return lines.select(place.cast("bigint").alias("place"), F.col("value").alias("line"))


@query(f"select n_name as nation, revenue_1e4, {_MONEY} as revenue, {_HASH} as result_hash from ({_RESULT})")
def result_json(spark, t):
    body = sinks.result_json(_rows(revenue.regional_revenue(t, ASIA)))
    kind = "struct<rows:array<struct<nation:string,revenue_1e4:bigint,revenue:string>>,result_hash:string>"
    read = spark.read.text(_text_file(spark, body, "json")).select(F.from_json("value", kind).alias("x"))
    return read.select(F.explode("x.rows").alias("r"), "x.result_hash").select("r.*", "result_hash")


@query(f"select 'ASIA' as region, cast(count(*) as integer) as result_rows, {_HASH} as result_hash from ({_RESULT})")
def benchmark_csv(spark, t):
    rows = _rows(revenue.regional_revenue(t, ASIA))
    path = _text_file(spark, sinks.benchmark_csv({"region": "ASIA", "result_rows": len(rows), "result_hash": scalars.result_hash(rows)}), "bench")
    return records.read_strict_csv(spark, path, T.StructType.fromDDL("region string, result_rows int, result_hash string"))


@query(f"select n_name as nation, revenue_1e4, sha256('select 1') as sql_sha256, {_HASH} as result_hash, md5('a') as tables from ({_RESULT})")
def audited_result(spark, t):
    path = _local(scratch_path(spark, "audited"))
    sinks.audited_result(path, "select 1", _rows(revenue.regional_revenue(t, ASIA)), {"region": hashlib.md5(b"a").hexdigest()})
    kind = "sql_sha256 string, tables struct<region:string>, rows array<struct<nation:string,revenue_1e4:bigint>>, result_hash string"
    body = spark.read.schema(kind).json(path, multiLine=True)
    return body.select(F.explode("rows").alias("r"), "sql_sha256", "result_hash", F.col("tables.region").alias("tables")).select("r.*", "sql_sha256", "result_hash", "tables")


@query("select '| r_regionkey | r_name |' as line union all select '| --- | --- |' union all select '| ' || r_regionkey || ' | ' || r_name || ' |' from region")
def markdown_table(spark, t):
    body = sinks.markdown(t["region"].select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.read.text(_text_file(spark, body, "markdown")).select(F.col("value").alias("line"))


@query("select c_custkey, c_nationkey from customer")
def compacted_csv(spark, t):
    path = sinks.safe_path(scratch_path(spark, "compact"), "customer.csv")
    sinks.compact_csv(t["customer"], ["c_custkey", "c_nationkey"], path)
    kinds = {f.name: f for f in t["customer"].schema}
    return records.read_strict_csv(spark, path, T.StructType([kinds["c_custkey"], kinds["c_nationkey"]]))


@query(f"select 'form' as what, '' as wrong union all select 'result', '' union all select 'tampered', 'hash' union all select 'short', 'header'")
def rows_file_verification(spark, t):
    rows = _rows(revenue.regional_revenue(t, ASIA))
    good = sinks.rows_csv(rows, {"input_rows": 10, "matched_rows": 3})
    cases = {"form": good, "result": good + "\n", "tampered": good.replace("result_hash,", "result_hash,0").replace(scalars.result_hash(rows), scalars.result_hash(rows)[1:]), "short": good.split("\n", 1)[1]}
    word = lambda wrong: "" if not wrong else "header" if "header" in wrong[0] else "hash"
    return spark.createDataFrame([(k, word(compare.verify_rows_file(v, rows))) for k, v in cases.items()], "what string, wrong string")


_VARIANTS = ("lazy", "strict", "half", "views", "resident")


@query(f"select v.variant, 'passed' as status, '' as errors, {_HASH} as result_hash from {_values([(v,) for v in _VARIANTS])} v(variant)")
def correctness_gate(spark, t):
    """Every way to run the query, held against the plain one."""
    six = _six(t)

    def resident() -> list[tuple[str, int]]:
        session = RevenueSession(six, ASIA)
        try:
            return [(r["nation"], r["revenue_1e4"]) for r in session.execute()["rows"]]
        finally:
            session.close()

    def views() -> list[tuple[str, int]]:
        from plinth.plans.registry import QUERIES

        return _rows(QUERIES["q5_sql_views"](spark, t.sf_dir))

    runs = {
        "lazy": lambda: _rows(revenue.regional_revenue(t, ASIA)),
        "strict": lambda: _rows(revenue.regional_revenue(revenue.checked(t, ASIA), ASIA)),
        "half": lambda: _rows(hybrid.split_revenue(t, ASIA, 0.5)),
        "views": views,
        "resident": resident,
    }
    return compare.correctness_gate(spark, runs["lazy"](), runs, set(_VARIANTS))


@query(
    f"""with e as (select *, row_number() over (order by revenue_1e4 desc, n_name) as position from ({revenue_sql()})), a as (select *, row_number() over (order by revenue_1e4 desc, n_name) as position from ({revenue_sql(start="1996-01-01", end="1997-01-01")})),
    j as (select coalesce(e.position, a.position) as position, e.n_name as en, a.n_name as an, cast(e.revenue_1e4 as varchar) as er, cast(a.revenue_1e4 as varchar) as ar from e full join a on e.position = a.position),
    d as (select position, 'n_name' as field, en as expected, an as actual from j where en is distinct from an union all select position, 'revenue_1e4', er, ar from j where er is distinct from ar)
    select * from d order by position, field limit 1"""
)
def first_mismatch(spark, t):
    order = (F.desc("revenue_1e4"), "n_name")
    own = [compare.numbered(revenue.regional_revenue(t, RevenueParams("ASIA", START.replace(year=y))), *order) for y in (1995, 1996)]
    return compare.first_mismatch(*own, ["n_name", "revenue_1e4"])


@query("select 'missing' as what, r_name as name from region where r_name not in ('ASIA', 'EUROPE') union all select 'extra', 'ATLANTIS'")
def missing_and_extra(spark, t):
    names = {r["r_name"] for r in t["region"].select("r_name").collect()}
    missing, extra = compare.missing_and_extra(names, {"ASIA", "EUROPE", "ATLANTIS"})
    return spark.createDataFrame([("missing", x) for x in missing] + [("extra", x) for x in extra], "what string, name string")


# Sessions and benchmark records ------------------------------------------------------------


@query(f"select i - 1 as request_index, i - 4 as measured_index, i <= 3 as is_warmup, 'ok' as status, {_HASH} as result_hash, (select count(*) from ({_RESULT})) as result_rows from range(1, 6) r(i)")
def session_requests(spark, t):
    """A resident session's records, written as JSON lines and read back; the third warm-up is numbered -1."""
    session = RevenueSession(_six(t), ASIA)
    try:
        lines = sinks.session_jsonl(session.setup(), session.run(warmup=3, repeat=2))
    finally:
        session.close()
    setups, requests = records.read_session(spark, _text_file(spark, lines, "session"))
    if not records.session_faults(setups, requests).isEmpty():
        raise ValueError("the session's records are broken")
    return requests.select("request_index", (F.col("request_index") - 3).alias("measured_index"), "is_warmup", "status", "result_hash", "result_rows")


@query(f"select cast(sum(bytes) as bigint) as resident_host_bytes, true as is_uuid from ({_RESIDENT})")
def session_setup(spark, t):
    session = RevenueSession(_six(t), ASIA)
    try:
        row = session.setup()
    finally:
        session.close()
    out = spark.createDataFrame([(row["resident_host_bytes"], row["session_id"])], "resident_host_bytes bigint, id string")
    return out.select("resident_host_bytes", F.rlike("id", F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("is_uuid"))


_GROUP_SQL = """select 'e' as experiment_id, '1' as scale_factor, 'c' || (id % 6) as config_id, case when id % 2 = 0 then 'cpu' else 'hybrid' end as engine, 8 as threads, 'fixed' as ratio_mode,
    (id % 6) / 8.0::double as cpu_ratio, 1 - (id % 6) / 8.0::double as gpu_ratio, 'resident' as lifecycle, id // 6 < 2 as is_warmup, case when id % 6 = 5 or id % 19 = 18 then 'error' else 'ok' end as status,
    lpad(cast(id % 6 as varchar), 16, '0') as result_hash, cast((id * 31) % 97 as double) as query_total_ms from range(300) r(id)"""


@query(
    f"""with r as (select * from ({_GROUP_SQL}) where not is_warmup), ok as (select * from r where status = 'ok'),
    s as (select experiment_id, scale_factor, config_id, engine, threads, ratio_mode, cpu_ratio, gpu_ratio, lifecycle, count(*) as success_count, max(result_hash) as result_hash, round(quantile_cont(query_total_ms, 0.5), 6) as median,
      round(quantile_cont(query_total_ms, 0.25), 6) as p25, round(quantile_cont(query_total_ms, 0.75), 6) as p75, round(quantile_cont(query_total_ms, 0.95), 6) as p95, round(avg(query_total_ms), 6) as mean, min(query_total_ms) as min,
      max(query_total_ms) as max, round(stddev_pop(query_total_ms), 6) as pstdev from ok group by 1, 2, 3, 4, 5, 6, 7, 8, 9),
    f as (select config_id, count(*) filter (where status <> 'ok') as failure_count from r group by 1), u as (select 'c' || i as config_id, 100.0::double as setup_cost_ms, cast(1000 + 10 * i as bigint) as resident_total_bytes from range(6) q(i))
    select s.*, failure_count, setup_cost_ms, resident_total_bytes, round(median + setup_cost_ms, 6) as amortised_1, round(median + setup_cost_ms / 10, 6) as amortised_10, round(median + setup_cost_ms / 100, 6) as amortised_100
    from s join f using (config_id) join u using (config_id)"""
)
def record_summary(spark, t):
    i = F.col("id")
    bad = (i % 6 == 5) | (i % 19 == 18)
    requests = spark.range(300).select(
        F.lit("e").alias("experiment_id"), F.lit("1").alias("scale_factor"), F.concat(F.lit("c"), (i % 6).cast("string")).alias("config_id"), F.when(i % 2 == 0, "cpu").otherwise("hybrid").alias("engine"),
        F.lit(8).alias("threads"), F.lit("fixed").alias("ratio_mode"), ((i % 6) / 8.0).alias("cpu_ratio"), (1 - (i % 6) / 8.0).alias("gpu_ratio"), F.lit("resident").alias("lifecycle"), (F.floor(i / 6) < 2).alias("is_warmup"),
        F.when(bad, "error").otherwise("ok").alias("status"), F.lpad((i % 6).cast("string"), 16, "0").alias("result_hash"), (i * 31 % 97).cast("double").alias("query_total_ms"),
    )
    setups = spark.range(6).select(F.concat(F.lit("c"), i.cast("string")).alias("config_id"), F.lit(60.0).alias("dataset_load_ms"), F.lit(40.0).alias("session_setup_ms"), F.lit(0.0).alias("tune_ms"),
        (i * 10 + 600).alias("resident_host_bytes"), F.lit(300).cast("bigint").alias("resident_gpu_bytes"), F.lit(100).cast("bigint").alias("resident_pinned_bytes"))
    out = stats.record_summary(requests.filter("not is_warmup"), setups).drop("dataset_load_ms", "session_setup_ms", "tune_ms", *stats.RESIDENT)
    return out.select(*[F.round(c, 6).alias(c) if c in ("median", "p25", "p75", "p95", "mean", "pstdev", "amortised_1", "amortised_10", "amortised_100") else F.col(c) for c in out.columns])


@query("select s % 3 as session_id, i as request_index, i - (s % 3) as measured_index from range(3) s(s), range(6) r(i) where i >= s % 3")
def warmups_dropped(spark, t):
    grid = spark.range(3).select(F.col("id").alias("session_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("request_index"))
    requests = grid.withColumn("is_warmup", F.col("request_index") < F.col("session_id"))
    return stats.measured(requests).select("session_id", "request_index", "measured_index")


_SETUPS = (
    ("good", "measured", "auto", "ok", 0.25, "v1", 1000, 10.0, 30.0, 20.0, 100.0, 50.0, 10.0, 250, 0.25, 0.26),
    ("none", "unavailable", "fixed", "ok", 0.5, None, None, None, None, None, None, None, None, None, None, None),
    ("auto", "unavailable", "auto", "ok", 0.5, None, None, None, None, None, None, None, None, None, None, None),
    ("some", "unavailable", "fixed", "ok", 0.5, "v1", None, None, None, None, None, None, None, None, None, None),
    ("odd", "guessed", "fixed", "ok", 0.5, None, None, None, None, None, None, None, None, None, None, None),
    ("gap", "measured", "auto", "ok", 0.25, "v1", 1000, 10.0, 30.0, 20.0, 100.0, 50.0, 10.0, 250, 0.25, None),
    ("mode", "measured", "fixed", "ok", 0.25, "v1", 1000, 10.0, 30.0, 20.0, 100.0, 50.0, 10.0, 250, 0.25, 0.26),
    ("share", "measured", "auto", "ok", 0.5, "v1", 1000, 10.0, 30.0, 20.0, 100.0, 50.0, 10.0, 250, 0.25, 0.26),
    ("bound", "measured", "auto", "ok", 0.25, "v1", 1000, 10.0, 30.0, 20.0, 100.0, 50.0, 10.0, 251, 0.25, 0.26),
    ("rates", "measured", "auto", "ok", 0.25, "v1", 1000, 10.0, 30.0, 20.0, 101.0, 50.0, 10.0, 250, 0.25, 0.26),
    ("fixed", "measured", "auto", "ok", 0.25, "v1", 1000, 10.0, 30.0, 20.0, 100.0, 50.0, 11.0, 250, 0.25, 0.26),
)
_FAULTS = (("auto", "auto without one"), ("some", "fields of an unavailable one"), ("odd", "status"), ("gap", "missing fields"), ("mode", "mode"), ("share", "share"), ("bound", "boundary"), ("rates", "rates"), ("fixed", "fixed time"))


@query(f"select * from {_values(_FAULTS)} v(config_id, fault)")
def provenance_faults(spark, t):
    kinds = (
        "config_id string, provenance string, ratio_mode string, status string, selected_ratio double, model_version string, calibration_rows bigint, cpu_calibration_ms double, gpu_calibration_ms double, "
        "gpu_kernel_calibration_ms double, cpu_rows_per_ms double, gpu_rows_per_ms double, gpu_fixed_ms double, boundary_rows bigint, realized_ratio double, predicted_ratio double"
    )
    return stats.provenance_faults(spark.createDataFrame(_SETUPS, kinds))


@query("select event_type as kernel, round(avg(value), 6) as mean, max(value) as most from events where event_type = (select min(event_type) from events) group by 1")
def kernel_metrics(spark, t):
    by = t["events"].groupBy(F.col("event_type").alias("kernel")).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    first = by.agg(F.min("kernel")).first()[0]
    return records.kernel_metrics(by.unpivot("kernel", ["mean", "most"], "metric", "value"), first)


_PROFILE = (
    ("[CUDA memcpy HtoD]", "", "1.234.567", "12,5", "3", "40.125", "memcpy"),
    ("void q5_scan<int>(int*)", "", "1,234,567.5", "7", "1.000", "12,5", "kernel"),
    ("q5_kernel", "", "-5", "+6", "2", "1", "kernel"),
    ("x", ":request", "10", "", "1", "0.5", "range"),
    ("nvtxDomain", "", "12.34", "0,25", "1,5", "1e1", "range"),
    ("cudaMalloc", "", "1 000", "1234.567", "4", "0.125", "other"),
    ("cudaMemset", "", "n/a", "1,23,456", "4", "0", "other"),
)
_PROFILED = (
    ("[CUDA memcpy HtoD]", "memcpy", 1234567.0, 12.5, 3.0, 40.125),
    ("void q5_scan<int>(int*)", "kernel", 1234567.5, 7.0, 1000.0, 12.5),
    ("q5_kernel", "kernel", -5.0, 6.0, 2.0, 1.0),
    ("request", "range", 10.0, 0.0, 1.0, 0.5),
    ("nvtxDomain", "range", 12.34, 0.25, 1.5, 10.0),
    ("cudaMalloc", "other", 1000.0, 1234.567, 4.0, 0.125),
    ("cudaMemset", "other", None, None, 4.0, 0.0),
)


@query(f"select * from {_values(_PROFILED)} v(name, kind, total, average, instances, time_percent)")
def profiler_csv(spark, t):
    lines = "Name;Range;Total Time (ns);Average (ns);Instances;Time (%)\n" + "".join(";".join(row[:6]) + "\n" for row in _PROFILE)
    return records.read_profiler_csv(spark, _text_file(spark, lines, "profile")).drop("report")


_CENTS = "cast(round(l_extendedprice * 100) as bigint)"
_STYLES = ("plain", "point", "comma", "space")


@query(f"select l_orderkey, l_linenumber, s.style, {_CENTS} / 100.0::double as number from lineitem, {_values([(s,) for s in _STYLES])} s(style)")
def local_prices(spark, t):
    """Prices written in four habits and read again, as single decimals where a lone mark could part groups."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    whole, part = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = lambda mark: F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", mark)
    texts = {"plain": F.concat(whole, F.lit("."), part), "point": F.concat(grouped(","), F.lit("."), part), "comma": F.concat(grouped("."), F.lit(","), part), "space": F.concat(grouped(" "), F.lit(","), part)}
    styles = F.explode(F.array(*[F.struct(F.lit(k).alias("style"), v.alias("text")) for k, v in texts.items()])).alias("s")
    return t["lineitem"].select("l_orderkey", "l_linenumber", styles).select("l_orderkey", "l_linenumber", "s.style", scalars.local_number(F.col("s.text")).alias("number"))


@query("select 1 as scale, 0.5::double as best_ratio, 3.0::double as best_ms, 3.3::double as auto_ms, 0.3::double as regret_ms, 10.0::double as regret_percent, '[[0.0, 0.5], [0.5, 1.0]]' as break_even")
def evaluation_report(spark, t):
    points = spark.createDataFrame([(1, 0.0, 9.0), (1, 0.5, 3.0), (1, 1.0, 6.0)], "scale int, ratio double, p50 double")
    found = stats.evaluation(points, spark.createDataFrame([(1, 3.3)], "scale int, auto_ms double"), spark.createDataFrame([(1, 5.0)], "scale int, baseline_ms double"))
    folder = _local(scratch_path(spark, "evaluation"))
    sinks.evaluation_files(found, folder)
    kinds = "scale int, best_ratio double, best_ms double, auto_ms double, regret_ms double, regret_percent double, break_even string"
    read = spark.read.csv(f"{folder}/evaluation.csv", schema=kinds, header=True, escape='"')
    return read.select("scale", "best_ratio", "best_ms", "auto_ms", F.round("regret_ms", 6).alias("regret_ms"), F.round("regret_percent", 6).alias("regret_percent"), "break_even")


_OBSERVED = "select 'sf1' as scale, (i % 5) / 4.0::double as ratio, quantile_cont(cast(i * 7 % 13 as double), 0.5) as p50 from range(60) r(i) group by i % 5"


@query(_OBSERVED)
def observations_folder(spark, t):
    """Raw records of a folder whose environment names the same experiment and scale."""
    folder = scratch_path(spark, "observed")
    env = '{"git": {"commit": "c1"}, "formal_runner": {"git_commit": "c1", "matrix_payload": {"experiment_id": "e", "dataset": {"scale_factor": "sf1", "path": "d", "manifest_sha256": "%s", "expected_hash": "%s"}}}}' % ("0" * 64, "f" * 16)
    spark.createDataFrame([(env,)], "value string").coalesce(1).write.text(f"{folder}/environment.json")
    i = F.col("id")
    raw = spark.range(60).select(F.lit("e").alias("experiment_id"), F.lit("sf1").alias("scale_factor"), ((i % 5) / 4.0).alias("cpu_ratio"), (i * 7 % 13).cast("double").alias("query_total_ms"))
    raw.write.csv(f"{folder}/raw.csv", header=True)
    return records.read_observations(spark, folder)


@query(f"select n_name, cast(sum{REV} as bigint) as revenue_1e4 {MATCHED} group by n_name")
def hybrid_auto(spark, t):
    """The share that the model predicts from one timed run of each side; the result does not depend on it."""
    return hybrid.auto_split(t, ASIA)[0]


@query(f"select x as text, x in ('0', '0.5', '1') as fits from {_values([(x,) for x in ('0', '0.5', '1', '1.5', '-0.1', 'nan', 'inf')])} v(x)")
def share_checks(spark, t):
    def fits(x: str) -> bool:
        try:
            hybrid.check_ratio(float(x))
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(x, fits(x)) for x in ("0", "0.5", "1", "1.5", "-0.1", "nan", "inf")], "text string, fits boolean")


@query("select o_orderkey, o_orderkey & 255 as part, (o_orderkey >> 4) & 15 as field, cast(pow(2, ceil(log2(o_orderkey))) as bigint) as slots from orders where o_orderkey > 0")
def bit_hashes(spark, t):
    key = F.col("o_orderkey").cast("bigint")
    slots = F.pow(F.lit(2.0), F.ceil(F.log2(key.cast("double")))).cast("bigint")
    return t["orders"].filter("o_orderkey > 0").select("o_orderkey", key.bitwiseAND(F.lit(255)).alias("part"), F.shiftright(key, 4).bitwiseAND(F.lit(15)).alias("field"), slots.alias("slots"))
