r"""Line dedup by overlapping three-line windows.

A text is cut at line feeds; a line is compared without spaces, tabs and
carriage returns around it. Each run of three consecutive lines is a window. A
window's first occurrence in order of (doc_id, text hash, position) stays, every
later one, in the same document or another, is covered; a line goes when any
covered window holds it. Windows of three blank lines are not compared.

Window keys are two 64-bit hashes. Repeats are found with a partial
aggregation of one minimum for each key, and joined back to the windows; a hot
window is one row on the aggregated side, so its other side can be split.

Defined cases: a null text has no lines and stays null; an empty text has one
blank line; texts of fewer than three lines are left alone; rows equal in doc_id
and text count as one document and are treated alike; a null doc_id comes first;
an empty table gives an empty result; columns of docs other than text are kept,
and those named like the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import packed, sha256_hex, spread, table

WINDOW = 3
_BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), pos, h1, h2: a row for each window."""
    bare = F.transform(F.col("_l"), lambda x: F.btrim(x, F.lit(_BLANK)))

    def at(i: Column) -> Column:
        own = [F.get(F.col("_b"), i + k) for k in range(window)]
        key = F.xxhash64(*own)
        blank = F.concat(*own) == ""
        return F.struct(i.alias("pos"), key.alias("h1"), F.xxhash64(F.lit(7), *reversed(own)).alias("h2"), blank.alias("blank"))

    starts = F.sequence(F.lit(0), F.size("_b") - window)
    return (
        docs.select("doc_id", F.xxhash64("text").alias("th"), _lines(F.col("text")).alias("_l"))
        .filter(F.size("_l") >= window)
        .select("doc_id", "th", bare.alias("_b"))
        .select("doc_id", "th", F.explode(F.transform(starts, at)).alias("_w"))
        .select("doc_id", "th", "_w.pos", "_w.h1", "_w.h2", "_w.blank")
        .filter(~F.col("blank"))
        .drop("blank")
    )


def covered_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th, starts: for each document with any, the starts of its covered windows."""
    windows = line_windows(docs, window)
    here = F.struct("doc_id", "th", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).filter(~here.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text less its covered lines, n_lines and n_removed."""
    row, columns = packed(docs, "n_lines", "n_removed")
    found = covered_windows(docs, window).select(F.col("doc_id").alias("_d"), F.col("th").alias("_th"), "starts")
    own = docs.select(row, F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_h"))
    lines = _lines(F.col("text"))
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    kept = F.array_except(every, gone)
    left = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    joined = own.join(found, (F.col("_h") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("_d")), "left").select(
        "row",
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(left).alias("text"),
        n_lines.alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(gone)).cast("bigint").alias("n_removed"),
    )
    return joined.select(*columns, "n_lines", "n_removed")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


OP5_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
e as (select doc_id, text, ls, len(ls) as n from d),
l as (select doc_id, text, i - 1 as pos, n,
             trim(ls[i], ' ' || chr(9) || chr(13)) as a,
             trim(ls[i + 1], ' ' || chr(9) || chr(13)) as b,
             trim(ls[i + 2], ' ' || chr(9) || chr(13)) as c
      from e, lateral (select unnest(range(1, n - 1)) as i) u where n >= 3),
w as (select * from l where a || b || c <> ''),
f as (select *, row_number() over (partition by a, b, c order by doc_id, pos) as rn from w),
g as (select distinct doc_id, pos + k as line from f, (select unnest(range(3)) as k) k where rn > 1),
x as (select e.doc_id, i - 1 as line, e.ls[i] as s from e, lateral (select unnest(range(1, n + 1)) as i) u),
k as (select x.doc_id, count(g.line) as n_removed, string_agg(case when g.line is null then x.s end, chr(10) order by x.line) as t
      from x left join g on x.doc_id = g.doc_id and x.line = g.line group by x.doc_id)
select d.doc_id, cast(coalesce(len(d.ls), 0) as bigint) as n_lines, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(k.t, '')) as kept_sha256
from d left join k using (doc_id)
"""
