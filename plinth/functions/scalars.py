"""Other scalar functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 64-bit FNV-1a, fixed values.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def narrow(payload: Column, width: int) -> Column:
    """The payload's lowest width bytes as an unsigned number; width is 1, 2 or 4."""
    if width not in (1, 2, 4):
        raise ValueError("width must be 1, 2 or 4")
    return payload.cast("bigint").bitwiseAND(F.lit((1 << 8 * width) - 1).cast("bigint"))


def sha256_text(text: Column) -> Column:
    """64 hex digits in lower case; null for any other text."""
    return F.when(F.rlike(text, F.lit("^[0-9A-Fa-f]{64}$")), F.lower(text))


def is_result_hash(text: Column) -> Column:
    return F.rlike(text, F.lit("^[0-9a-f]{16}$"))


def local_number(text: Column, single_decimal: bool = False) -> Column:
    """A number with group and decimal marks of either habit as double; null if it is none, 0 if it is blank.

    Of point and comma the last is the decimal mark when both occur. Marks of one kind part
    groups when there are several and three digits follow each, or when one stands after
    one to three digits and before three; any other single one is the decimal mark, and with
    single_decimal every single one is.
    """
    bare = F.regexp_replace(text, "[\\x20\\x09-\\x0D\u00a0]", "")
    sign = F.when(F.startswith(bare, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    body = F.regexp_replace(bare, "^[+-]", "")
    both = F.contains(body, F.lit(",")) & F.contains(body, F.lit("."))
    grouped = F.rlike(body, F.lit(r"^[^.,]*([.,][^.,]{3}){2,}$"))
    if not single_decimal:
        grouped = grouped | F.rlike(body, F.lit(r"^[^.,]{0,3}[.,][^.,]{3}$"))
    last_only = F.regexp_replace(body, "[.,](?=.*[.,])", "")
    plain = F.when(both, last_only).when(grouped, F.regexp_replace(body, "[.,]", "")).otherwise(body)
    plain = F.replace(plain, F.lit(","), F.lit("."))
    number = F.when(F.rlike(plain, F.lit(r"^(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain).cast("double") * sign
    return F.when(bare == "", F.lit(0.0)).otherwise(number)


def result_hash(rows: Iterable[tuple[str, int]]) -> str:
    """Order-sensitive 64-bit hash of (name, revenue) rows: name, 0xFF, revenue little-endian."""
    h = FNV_OFFSET
    for name, revenue in rows:
        for byte in (*name.encode(), 0xFF, *int(revenue).to_bytes(8, "little", signed=True)):
            h = (h ^ byte) * FNV_PRIME & (1 << 64) - 1
    return f"{h:016x}"
