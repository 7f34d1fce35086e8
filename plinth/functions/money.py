"""Exact money as integers: cents, hundredths, and revenue in 1/10000 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(amount: Column, digits: int = 2) -> Column:
    """A double or decimal as bigint in units of 10**-digits, rounded first.

    A bare cast cuts 28.999... to 28; rounding before the cast does not.
    """
    return F.round(amount * (10**digits)).cast("bigint")


def revenue_1e4(price: Column, discount: Column) -> Column:
    """price * (1 - discount) in 1/10000 units; ANSI arithmetic raises on overflow."""
    return scaled(price) * (F.lit(100).cast("bigint") - scaled(discount))


def parse_scaled(text: Column, digits: int = 2, precision: int = 18, strict: bool = True) -> Column:
    """Decimal text as bigint in units of 10**-digits.

    Text is an optional minus, digits, and at most `digits` digits after a point.
    Anything else raises when strict, and is null otherwise.
    """
    fits = F.rlike(text, F.lit(rf"^-?\d{{1,{precision - digits}}}(\.\d{{0,{digits}}})?$")) & ~F.rlike(text, F.lit(r"\.$"))
    whole = F.regexp_extract(text, r"^-?(\d+)", 1)
    part = F.rpad(F.regexp_extract(text, r"\.(\d*)$", 1), digits, "0")
    size = F.concat(whole, part).cast("bigint")
    value = F.when(F.startswith(text, F.lit("-")), -size).otherwise(size)
    bad = F.raise_error(F.concat(F.lit("not a decimal of that scale: "), F.coalesce(text, F.lit("null")))).cast("bigint")
    return F.when(fits, value).otherwise(bad if strict else F.lit(None).cast("bigint"))


def format_revenue(revenue: Column) -> Column:
    """Revenue in 1/10000 units as text with two digits, halves away from zero."""
    return F.round(revenue.cast("decimal(38,0)") / F.lit(10000).cast("decimal(5,0)"), 2).cast("decimal(38,2)").cast("string")


def format_revenue_text(revenue: int) -> str:
    """format_revenue for one Python integer."""
    cents, rest = divmod(abs(revenue), 100)
    cents += rest >= 50
    return f"{'-' if revenue < 0 and cents else ''}{cents // 100}.{cents % 100:02d}"
