from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plinth.functions import dates, money, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "text"), [(1160450, "116.05"), (-1160450, "-116.05"), (49, "0.00"), (50, "0.01"), (-50, "-0.01"), (-49, "0.00"), (0, "0.00"), (2**63 - 1, "922337203685477.58")])
def test_format_revenue(spark, value, text):
    assert one(spark, money.format_revenue(F.lit(value).cast("bigint"))) == text
    assert money.format_revenue_text(value) == text


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**62), 2**62))
def test_format_is_within_half_a_cent(value):
    text = money.format_revenue_text(value)
    cents = int(text.replace(".", ""))
    assert abs(cents * 100 - value) <= 50


def test_scaled_rounds_before_it_casts(spark):
    assert one(spark, money.scaled(F.lit(0.29))) == 29
    assert one(spark, F.lit(0.29 * 100).cast("bigint")) == 28


@pytest.mark.parametrize("bad", ["0.055", "1.", ".5", "x", "", "1e3", "--1", None])
def test_strict_decimals(spark, bad):
    with pytest.raises(Exception, match="not a decimal"):
        one(spark, money.parse_scaled(F.lit(bad).cast("string")))


def test_decimals(spark):
    assert [one(spark, money.parse_scaled(F.lit(x))) for x in ("1", "-1.5", "0.05", "-0.05")] == [100, -150, 5, -5]


@pytest.mark.parametrize("bad", ["1994-1-01", "1994-02-30", "19940101", "1994-01-01x", "", None])
def test_strict_dates(spark, bad):
    with pytest.raises(Exception, match="not a date"):
        one(spark, dates.parse_day(F.lit(bad).cast("string")))


def test_dates(spark):
    day = lambda s: dates.parse_day(F.lit(s))
    assert str(one(spark, dates.add_year(day("1996-02-29")))) == "1997-02-28"
    assert one(spark, dates.epoch_days(day("1970-01-02"))) == 1
    assert one(spark, dates.days_in_month(day("1900-02-01"))) == 28
    assert [one(spark, dates.is_leap_year(day(f"{y}-05-01"))) for y in (1900, 2000, 2023, 2024)] == [False, True, False, True]


def test_narrow(spark):
    assert [one(spark, scalars.narrow(F.lit(70000), w)) for w in (1, 2, 4)] == [70000 & 255, 70000 & 65535, 70000]
    with pytest.raises(ValueError, match="width"):
        scalars.narrow(F.lit(1), 3)


def test_sha_text(spark):
    assert one(spark, scalars.sha256_text(F.lit("AB" * 32))) == "ab" * 32
    assert one(spark, scalars.sha256_text(F.lit("AB"))) is None
