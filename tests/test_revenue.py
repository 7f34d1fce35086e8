from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from plinth.functions.scalars import result_hash
from plinth.operators import hybrid
from plinth.operators.compare import verify_result
from plinth.operators.revenue import RevenueParams, checked, matched_lines, regional_revenue
from plinth.streaming.session import RevenueSession


def rows(df):
    return [(r["n_name"], r["revenue_1e4"]) for r in df.collect()]


def test_tiny_asia(tiny):
    got = rows(regional_revenue(tiny, RevenueParams()))
    assert got == [("JAPAN", 1900000), ("INDIA", 900000)]
    assert result_hash(got) == "248d10b6ee352953"
    assert matched_lines(tiny, RevenueParams()).count() == 2


def test_tiny_america(tiny):
    got = rows(regional_revenue(tiny, RevenueParams("AMERICA")))
    assert got == [("ARGENTINA", 1200000)]
    assert result_hash(got) == "e23d51c3d56091f0"


@pytest.mark.parametrize(
    ("sf", "hash_"),
    [("0.001", "afcd35f918fc2995"), ("0.01", "be241732a61a3a86"), ("0.1", "7f5032874e472f9a")],
)
def test_generated_tables(spark, sf, hash_):
    from plinth.sources.tables import read_parquet

    tables = read_parquet(spark, f"/root/testdata/sf{sf}")
    assert result_hash(rows(regional_revenue(tables, RevenueParams("ASIA", date(1995, 1, 1))))) == hash_


def test_published_hashes():
    sf1 = [("INDONESIA", 555020411697), ("VIETNAM", 552950869967), ("CHINA", 537244942566), ("INDIA", 520355120002), ("JAPAN", 454101756954)]
    assert result_hash(sf1) == "542abf4003633c7c"
    sf10 = [("INDIA", 5368625879995), ("CHINA", 5353508299282), ("VIETNAM", 5322693887176), ("JAPAN", 5267668371444), ("INDONESIA", 5231768523189)]
    assert result_hash(sf10) == "b1351a421ba8dcfd"


def test_result_does_not_depend_on_partitions(tiny):
    spread = {n: df.repartition(7) for n, df in tiny.items()}
    assert rows(regional_revenue(spread, RevenueParams())) == rows(regional_revenue(tiny, RevenueParams()))


def test_zero_revenue_is_dropped(tiny):
    free = dict(tiny, lineitem=tiny["lineitem"].withColumn("l_discount", F.when(F.col("l_orderkey") == 100, F.lit(1)).otherwise(F.col("l_discount")).cast("decimal(15,2)")))
    assert rows(regional_revenue(free, RevenueParams())) == [("JAPAN", 1900000)]


def test_unknown_region(tiny):
    assert rows(regional_revenue(tiny, RevenueParams("ATLANTIS"))) == []
    with pytest.raises(ValueError, match="no region"):
        checked(tiny, RevenueParams("ATLANTIS"))


def test_strict_checks(tiny):
    assert checked(tiny, RevenueParams()) is tiny
    with pytest.raises(ValueError, match="not unique"):
        checked(dict(tiny, orders=tiny["orders"].unionByName(tiny["orders"])), RevenueParams())
    for column, value in (("l_extendedprice", -1), ("l_discount", 2), ("l_discount", -1)):
        bad = dict(tiny, lineitem=tiny["lineitem"].withColumn(column, F.lit(value).cast("decimal(15,2)")))
        with pytest.raises(ValueError, match="price"):
            checked(bad, RevenueParams())


def test_duplicate_keys_multiply(tiny):
    twice = dict(tiny, supplier=tiny["supplier"].unionByName(tiny["supplier"]))
    assert rows(regional_revenue(twice, RevenueParams())) == [("JAPAN", 3800000), ("INDIA", 1800000)]


def test_overflow_raises(tiny):
    huge = dict(tiny, lineitem=tiny["lineitem"].withColumn("l_extendedprice", F.lit(9e15)))
    with pytest.raises(Exception, match="OVERFLOW"):
        regional_revenue(huge, RevenueParams()).collect()


def test_leap_day_window():
    assert RevenueParams(start=date(1996, 2, 29)).window == (date(1996, 2, 29), date(1997, 2, 28))


def test_pushdown(spark):
    from plinth.sources.tables import read_parquet

    df = regional_revenue(read_parquet(spark, "/root/testdata/sf0.001"), RevenueParams("ASIA", date(1995, 1, 1)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(r_name,ASIA)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "l_tax" not in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("ratio", [0.0, 0.125, 0.5, 0.875, 1.0])
def test_split_does_not_change_the_result(tiny, ratio):
    assert rows(hybrid.split_revenue(tiny, RevenueParams(), ratio)) == [("JAPAN", 1900000), ("INDIA", 900000)]


@pytest.mark.parametrize("ratio", [-0.01, 1.01, float("nan"), float("inf"), "x"])
def test_bad_ratio(ratio):
    with pytest.raises(ValueError, match="ratio"):
        hybrid.check_ratio(ratio)


@pytest.mark.parametrize(
    ("case", "ratio"),
    [((100, 10, 10, 0), 0.5), ((100, 10, 20, 0), 2 / 3), ((100, 20, 10, 0), 1 / 3), ((100, 10, 1, 100), 1.0), ((100, 10, 20, 4), 0.8)],
)
def test_cost_model(case, ratio):
    p = hybrid.predict_ratio(*case)
    assert abs(p.ratio - ratio) < 1e-12
    assert p.total_ms <= min(case[1], case[3] + case[2]) + 1e-12


@pytest.mark.parametrize("case", [(0, 1, 1, 0), (1, 0, 1, 0), (1, 1, -1, 0), (1, 1, 1, -1), (1, float("nan"), 1, 0)])
def test_cost_model_rejects(case):
    with pytest.raises(ValueError):
        hybrid.predict_ratio(*case)


@pytest.mark.parametrize("ratio", [0, 0.25, 0.5, 0.75, 1])
def test_exact_split_covers_every_row(spark, ratio):
    batches = spark.createDataFrame(list(enumerate([3, 5, 2])), "batch int, len long")
    got = hybrid.exact_split(batches, ratio).orderBy("batch").collect()
    assert [r["first_len"] + r["second_len"] for r in got] == [3, 5, 2]
    assert sum(r["first_len"] for r in got) == int(10 * ratio + 0.5)


def test_boundary_split(spark):
    batches = spark.createDataFrame(list(enumerate([4, 4, 2])), "batch int, len long")
    assert [tuple(hybrid.boundary_split(batches, r).first()) for r in (0.0, 0.2, 0.6, 1.0)] == [(0, 0), (0, 0), (1, 4), (3, 10)]
    with pytest.raises(ValueError, match="negative"):
        hybrid.exact_split(spark.createDataFrame([(0, -1)], "batch int, len long"), 0.5)


def test_session_answers_alike(tiny):
    session = RevenueSession(tiny, RevenueParams(), strict=True)
    records = session.run(warmup=1, repeat=2)
    session.close()
    assert [r["is_warmup"] for r in records] == [True, False, False]
    assert {r["result_hash"] for r in records} == {"248d10b6ee352953"}


def test_verify_result():
    good = [("JAPAN", 1900000), ("INDIA", 900000)]
    counters = {"input_rows": 6, "matched_rows": 2, "cpu_rows": 6, "gpu_rows": 0}
    assert verify_result(good, "248d10b6ee352953", counters) == []
    assert len(verify_result(good[::-1], "248d10b6ee352953", {"input_rows": 1, "matched_rows": 2, "cpu_rows": 0, "gpu_rows": 0})) == 4


def test_auto_split(tiny):
    df, found = hybrid.auto_split(tiny, RevenueParams(), batches=8)
    assert rows(df) == [("JAPAN", 1900000), ("INDIA", 900000)]
    assert 0 <= found.ratio <= 1 and (found.ratio * 8).is_integer()


def test_command_line(spark, tiny, tmp_path, capsys):
    from plinth.__main__ import main
    from plinth.sources.dataset import write_arrow_dataset

    write_arrow_dataset(tiny, str(tmp_path / "ds"))
    main(["revenue", "--data-dir", str(tmp_path / "ds"), "--source", "arrow", "--strict"])
    out = capsys.readouterr().out
    assert "JAPAN,1900000,190.00" in out and "result_hash,248d10b6ee352953" in out
    main(["revenue", "--data-dir", str(tmp_path / "ds"), "--source", "arrow", "--cpu-ratio", "0.5", "--format", "json"])
    assert '"result_hash": "248d10b6ee352953"' in capsys.readouterr().out
    main(["check", "--data-dir", str(tmp_path / "ds"), "--source", "arrow"])
    assert "| orders_in_window | 4 |" in capsys.readouterr().out
    main(["join", "-a", "prh", "-r", "100", "-s", "400"])
    assert "prh,400," in capsys.readouterr().out
