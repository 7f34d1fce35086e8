r"""Secret scans: base patterns, and sliding-window entropy of candidate strings.

Base spans are the leftmost non-overlapping matches of three patterns:

* ``assign``: a key word, a colon or equals sign, and a value of 12+ characters;
* ``access``: ``AKIA`` and capitals or digits, 18+ characters in all;
* ``hex``: lower-case hex digits, 16+ of them.

The entropy scan adds spans of kind ``entropy``. A candidate is a run of 20+
characters of ``A-Za-z0-9+/_=-`` with a letter and a digit. Its character class
is hex or base64. A window of ``WINDOW`` characters slides over it; the counts of
the alphabet's characters are kept, and with each step one count falls and one
rises, and the sum of count * log2(count) changes by their terms alone. The span
goes from the first to the end of the last window whose Shannon entropy
reaches the class's threshold. Candidates on the allow-list are left out:
placeholders, check sums and data URIs announced before them, uuids, and
ascending runs; so are spans inside a base span.

Offsets are code points, ends are exclusive. They come from the lengths of the
pieces between matches and of the matches, so no character is reserved as a mark; the
lengths are summed in blocks, so the work grows with a text's matches in proportion.

Defined cases: a null text counts as empty; an empty text has no spans; a
match whose value is too short is dropped and what it covers is not searched
again; spans that start together come in the order of the kinds; equal rows come
back as often; an empty table gives an empty result; columns of docs are kept,
those named like the result's are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import holds, packed, running_sums, sha256_hex, spread, table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
KINDS = ("assign", "access", "hex", "entropy")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Counts in a long, and bits of each: room for WINDOW.
_HELD, _FIELD = 12, 5
HEX_BITS = 3.0
BASE64_BITS = 3.8

#: Allow-list, fixed values: what a candidate holds, and what stands before it.
ALLOWED = r"(?i)example|sample|placeholder|changeme|dummy|redacted|x{8,}|0123456789|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ANNOUNCED = r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|integrity|digest|base64,)[\"']?[\x20:=-]*[\"']?$"

_SPAN = "array<struct<s:int,e:int,m:string,v:string,lead:string>>"


def _found(text: Column, pattern: str, group: int) -> Column:
    """All matches as structs: start, end, match, its group, the text since the match before."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def placed(x: Column) -> Column:
        ends = running_sums(F.transform(x["w"], lambda w, i: F.length(w) + F.length(F.get(x["g"], i))))
        at = F.struct(ends.alias("e"), x["w"].alias("w"), x["v"].alias("v"), x["g"].alias("g"))
        return F.transform(F.array(at), lambda y: F.transform(y["w"], lambda w, i: one(y, w, i)))[0]

    def one(y: Column, w: Column, i: Column) -> Column:
        e = F.get(y["e"], i)
        return F.struct((e - F.length(w)).alias("s"), e.alias("e"), w.alias("m"), F.get(y["v"], i).alias("v"), F.get(y["g"], i).alias("lead"))

    pieces = F.struct(whole.alias("w"), value.alias("v"), gaps.alias("g"))
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(F.array(pieces), placed)[0]).otherwise(F.array().cast(_SPAN))


def _windows(candidate: Column, hexadecimal: Column) -> Column:
    """struct(first, last): offsets of the first and last window over the threshold, -1 if none."""
    codes = F.transform(F.split(candidate, ""), lambda ch: F.call_function("locate", ch, F.lit(ALPHABET)) - 1)
    return F.transform(F.array(codes), lambda own: _slid(own, F.length(candidate), hexadecimal))[0]


def _slid(codes: Column, length: Column, hexadecimal: Column) -> Column:
    """_windows by the characters' places in ALPHABET.

    The counts of all characters are fields of ``_FIELD`` bits in a few longs, so a
    step adds 1 to one field and takes 1 from another, whatever the alphabet's size.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    longs = range(-(-len(ALPHABET) // _HELD))
    zero = F.lit(0).cast("bigint")

    def code(p: Column) -> Column:
        return F.get(codes, p - 1)

    def one_in(k: int, c: Column) -> Column:
        return F.when(F.floor(c / _HELD) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (c % _HELD) * _FIELD)).otherwise(zero)

    def held(n: Column, c: Column) -> Column:
        own = F.get(n, F.floor(c / _HELD).cast("int"))
        return F.call_function("shiftright", own, (c % _HELD) * _FIELD).bitwiseAND(F.lit((1 << _FIELD) - 1)).cast("int")

    enough = F.when(hexadecimal, F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    over = lambda total: F.lit(math.log2(WINDOW)) - total / F.lit(float(WINDOW)) >= enough - F.lit(1e-9)

    def grown(acc: Column, p: Column) -> Column:
        return F.transform(F.array(code(p)), lambda c: F.struct(F.array(*[F.get(acc["n"], k) + one_in(k, c) for k in longs]).alias("n"), risen(acc, held(acc["n"], c)).alias("sum")))[0]

    def risen(acc: Column, n: Column) -> Column:
        return acc["sum"] + F.get(term, n + 1) - F.get(term, n)

    none = F.struct(F.array(*[zero for _ in longs]).alias("n"), F.lit(0.0).alias("sum"))

    def begun(x: Column) -> Column:
        at = F.when(over(x["sum"]), 0).otherwise(-1)
        return F.struct(x["n"].alias("n"), x["sum"].alias("sum"), at.alias("first"), at.alias("last"))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), none, grown, begun)

    def step(acc: Column, i: Column) -> Column:
        # i is the offset of the window; position i (from 1) goes, i + WINDOW comes.
        def counted(x: Column) -> Column:
            n_out, n_in = held(acc["n"], x["o"]), held(acc["n"], x["i"])
            changed = F.get(term, n_out - 1) - F.get(term, n_out) + F.get(term, n_in + 1) - F.get(term, n_in)
            counts = F.array(*[F.get(acc["n"], k) - one_in(k, x["o"]) + one_in(k, x["i"]) for k in longs])
            return F.when(x["o"] == x["i"], F.struct(acc["n"].alias("n"), acc["sum"].alias("sum"))).otherwise(F.struct(counts.alias("n"), (acc["sum"] + changed).alias("sum")))

        def moved(x: Column) -> Column:
            return F.struct(
                x["n"].alias("n"),
                x["sum"].alias("sum"),
                F.when((acc["first"] < 0) & over(x["sum"]), i).otherwise(acc["first"]).alias("first"),
                F.when(over(x["sum"]), i).otherwise(acc["last"]).alias("last"),
            )

        pair = F.transform(F.array(F.struct(code(i).alias("o"), code(i + WINDOW).alias("i"))), counted)
        return F.transform(pair, moved)[0]

    steps = F.filter(F.sequence(F.lit(1), F.greatest(length - WINDOW, F.lit(1))), lambda i: i <= length - WINDOW)
    return F.aggregate(steps, first, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def entropy_spans(text: Column) -> Column:
    """array of struct(s, e) of the text's candidates over the threshold."""
    mixed = F.filter(
        _found(text, CANDIDATE, 1),
        lambda x: F.rlike(x["m"], F.lit("[0-9]")) & F.rlike(x["m"], F.lit("[A-Za-z]")) & ~F.rlike(x["m"], F.lit(ALLOWED)) & ~F.rlike(x["lead"], F.lit(ANNOUNCED)),
    )
    measured = F.transform(mixed, lambda x: F.struct(x["s"].alias("s"), _windows(x["m"], F.rlike(x["m"], F.lit("^[0-9A-Fa-f]+$"))).alias("w")))
    high = F.filter(measured, lambda x: x["w"]["first"] >= 0)
    return F.transform(high, lambda x: F.struct((x["s"] + x["w"]["first"]).alias("s"), (x["s"] + x["w"]["last"] + WINDOW).alias("e")))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with base and found: arrays of struct(s, k, e); k indexes KINDS."""
    text = F.coalesce("text", F.lit(""))
    row, columns = packed(docs, "base", "found")

    def kind(k: int, xs: Column) -> Column:
        return F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    base = F.concat(
        kind(0, F.filter(_found(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= 12)),
        kind(1, F.filter(_found(text, ACCESS, 1), lambda x: F.length(x["m"]) >= 18)),
        kind(2, _found(text, HEX, 1)),
    )
    found = docs.select(row, "text", F.array_sort(base).alias("base"), kind(3, entropy_spans(text)).alias("_extra"))
    # Spans of a kind do not overlap, so only the last that starts no later can hold another.
    own = lambda k: F.filter("base", lambda b: b["k"] == k)
    of = F.array(*[F.struct(own(k).alias("own")) for k in range(3)])
    more = F.transform(F.array(of), lambda kinds: F.filter("_extra", lambda x: ~F.exists(kinds, lambda b: holds(b["own"], x))))[0]
    more = F.when(F.size("_extra") > 0, more).otherwise(F.col("_extra"))
    return found.select(*columns, "base", F.array_sort(F.concat("base", more)).alias("found"))


def span_text(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return scanned.select("doc_id", of(0), of(1), of(2), sha256_hex(span_text("base")).alias("base_sha256"), span_text("found").alias("spans"))


def _sql() -> str:
    """The same in SQL, with every window's entropy counted anew."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def matches(name: str, pattern: str, group: int) -> str:
        p = quote(pattern)
        return (
            f"{name}_a as (select doc, regexp_extract_all(t, {p}) as w, regexp_extract_all(t, {p}, {group}) as v, regexp_split_to_array(t, {p}) as g from d where regexp_matches(t, {p})), "
            f"{name}_i as (select doc, w, v, g, unnest(range(1, len(w) + 1)) as i from {name}_a), "
            f"{name} as (select doc, w[i] as m, v[i] as v, g[i] as lead, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as bigint) as s from {name}_i)"
        )

    window = WINDOW
    return (
        "with d as (select row_number() over () as doc, doc_id, coalesce(text, '') as t from documents), "
        + ", ".join(matches(*x) for x in (("assign", ASSIGN, 2), ("access", ACCESS, 1), ("hex", HEX, 1), ("cand", CANDIDATE, 1)))
        + ", base as (select doc, s, 0 as k, s + length(m) as e from assign where length(v) >= 12 union all select doc, s, 1, s + length(m) from access where length(m) >= 18 union all select doc, s, 2, s + length(m) from hex), "
        f"c as (select doc, s, m, case when regexp_full_match(m, '[0-9A-Fa-f]+') then {HEX_BITS} else {BASE64_BITS} end as least from cand where regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') "
        f"and not regexp_matches(m, {quote(ALLOWED)}) and not regexp_matches(lead, {quote(ANNOUNCED)})), "
        f"win as (select doc, s, least, i, substr(m, i + 1, {window}) as w from (select *, unnest(range(0, length(m) - {window} + 1)) as i from c)), "
        "ch as (select doc, s, least, i, ch, count(*) as n from (select doc, s, least, i, unnest(string_split(w, '')) as ch from win) group by all), "
        f"bits as (select doc, s, least, i, log2({window}) - sum(n * log2(n)) / {window} as b from ch group by all), "
        f"high as (select doc, s + min(i) as s, 3 as k, s + max(i) + {window} as e from bits where b >= least - 1e-9 group by doc, bits.s), "
        "more as (select * from high h where not exists (select 1 from base b where b.doc = h.doc and b.s <= h.s and b.e >= h.e)), "
        f"every as (select *, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || s || ':' || e as span from (select * from base union all select * from more)), "
        "j as (select doc, count(*) filter (where k = 0) as a, count(*) filter (where k = 1) as b, count(*) filter (where k = 2) as c, "
        "string_agg(span, ',' order by s, k) filter (where k < 3) as bt, string_agg(span, ',' order by s, k) as ft from every group by doc) "
        "select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex, sha256(coalesce(bt, '')) as base_sha256, coalesce(ft, '') as spans from d left join j using (doc)"
    )


OP2_SQL = _sql()
