r"""Exact substring dedup with deep-shallow sorted suffixes.

Each byte is removed that a string of ``LENGTH`` bytes covers which also starts
anywhere else, in the same document or another. Strings are judged on the input.
Passages are judged in words, too, as ``LENGTH`` bytes are more than many a passage: the words that a
string of ``WORDS`` words covers which also starts anywhere else are counted, not removed.

1. Sampled suffixes. Of each window of LENGTH bytes the ``GRAM``-byte substring with
   the least hash is its anchor, the leftmost of equals; of each window of WORDS words it is the
   least string of ``WORD_GRAM`` words. Equal windows have equal
   anchors at equal offsets, so windows are only compared with those of anchors of
   the same substring. An anchor serves a run of neighbouring windows; what they
   cover together is its context. Neighbouring runs of equal contexts, as a text has that
   repeats a few words on and on, are one row with their number.
2. Contexts that are equal, offsets included, form a class. If a class has two
   anchors, all its windows repeat, and the context is covered. An anchor whose substring
   has one class only, with one anchor, is alone.
3. Left are anchors of substrings with several classes. One context of each
   class is taken from the texts. Buckets (one for each anchor substring) of at most
   ``MOST_CLASSES`` contexts are sorted as suffixes from the anchor on, and as
   reversed texts before it: multikey quicksort to a shallow depth, then blind tries
   for what shares a longer prefix. The common prefixes of neighbours in both orders
   give the windows that any two contexts share.
4. Larger buckets, as of a passage in a third of all documents, are never
   gathered: their contexts are cut into blocks of ``BLOCK`` neighbouring windows. A
   block whose whole bytes occur twice is covered; if not even the bytes common to
   its windows occur twice, none of them does; of the rest every window is
   counted. All of it are partial counts of hashes.
5. Covered ranges are merged for each document.

Hashes have 64 bits beside the 63 of the anchor's substring, whose lowest bit tells words from bytes.

Defined cases: a null text counts as empty; texts shorter than LENGTH keep all bytes;
equal rows are copies of each other and are both removed; a null doc_id is a document like
any other; rows with one doc_id are told apart by their text; an empty table gives an
empty result; columns of docs are kept, those named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import materialize, packed, scratch, slices, spread, table
from plinth.llm.hashing import chunks, joined, mix, powers, prefix_sums, range_hash, word_places, word_sums

LENGTH = 400
GRAM = 32
WORDS = 51
WORD_GRAM = 5
MOST_CLASSES = 64
SHALLOW = 48
BLOCK = 16
_U = np.uint64
_LATE = np.iinfo(np.uint64).max
_BLANKS = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


# Anchors ---------------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _LATE, _U)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, anchor, first and last window start, last one of equal runs, their number, gram hash, context hash.

    sums are prefix sums of the texts' bytes or words; a text lies from begin to end. Places
    are counted from the text's begin.
    """
    n = len(sums) - gram
    none = np.zeros(0, np.int64)
    nothing = (none,) * 6 + (none.astype(_U),) * 2
    if n < length - gram + 1:
        return nothing
    keys = (sums[gram:] - sums[:-gram]) * powers(len(sums))[1][:n] * _U(0xFF51AFD7ED558CCD)
    order = (keys & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U)
    anchor = (_least(order, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(begin, starts, side="right") - 1
    valid = starts + length <= end[text]
    starts, anchor, text = starts[valid], anchor[valid], text[valid]
    if not len(starts):
        return nothing
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    a, p1, p2, t = anchor[new], starts[new], starts[last], text[new]
    gram_hash = range_hash(sums, a, a + gram)
    shape = (a - p1).astype(_U) * _U(0x9FB21C651E98DF25) + (p2 - p1).astype(_U)
    context = mix(range_hash(sums, p1, p2 + length) ^ mix(shape))
    own = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (gram_hash[1:] != gram_hash[:-1]) | (t[1:] != t[:-1])])
    final = np.r_[own[1:], len(t)] - 1
    of = begin[t]
    return t[own], (a - of)[own], (p1 - of)[own], (p2 - of)[own], (p2 - of)[final], final - own + 1, gram_hash[own], context[own]


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """d, th, a, p1, p2, q, m, g, c: the runs of all documents (d, th, text), in bytes and, g being odd, in words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            at = 0
            for own in chunks((t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()):
                data, begin = joined(own)
                sums = prefix_sums(data)
                start, end = word_places(data)
                first = np.searchsorted(start, begin)
                in_bytes = anchor_runs(sums, begin[:-1], begin[1:] - 1, length, gram)
                in_words = anchor_runs(word_sums(range_hash(sums, start, end)), first[:-1], first[1:], WORDS, WORD_GRAM)
                for odd, (t, a, p1, p2, q, m, g, c) in enumerate((in_bytes, in_words)):
                    if len(t):
                        g = g & ~_U(1) | _U(odd)
                        columns = [pa.array(ids[at + t], pa.int64()), pa.array(hashes[at + t], pa.int64()), *[pa.array(x.astype(np.int32)) for x in (a, p1, p2, q, m)], *[pa.array(x.view(np.int64)) for x in (g, c)]]
                        yield pa.RecordBatch.from_arrays(columns, names=["d", "th", "a", "p1", "p2", "q", "m", "g", "c"])
                at += len(own)

    return docs.select("d", "th", "text").mapInArrow(scan, "d long, th long, a int, p1 int, p2 int, q int, m int, g long, c long")


# Deep-shallow sorting ----------------------------------------------------------


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Node:
    __slots__ = ("depth", "below", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.below, self.leaf = depth, {}, leaf


def blind_trie(strings: list[bytes], own: list[int]) -> list[int]:
    """The indexes in own by their strings, through a trie that holds branching bytes only.

    A string is led down by its bytes at the branching depths alone, compared
    once with any leaf it comes to, and put in where the two part.
    """
    byte = lambda s, d: s[d] if d < len(s) else -1
    root: _Node | None = None
    equal: dict[int, list[int]] = {}
    for i in own:
        s = strings[i]
        if root is None:
            root = _Node(-1, i)
            equal[i] = [i]
            continue
        node = root
        while node.below:
            node = node.below.get(byte(s, node.depth)) or next(iter(node.below.values()))
        other = node.leaf
        part = common(s, strings[other])
        if part == len(s) == len(strings[other]):
            equal[other].append(i)
            continue
        equal[i] = [i]
        above, key, node = None, None, root
        while node.below and node.depth < part:
            above, key = node, byte(s, node.depth)
            node = node.below[key]
        if node.below and node.depth == part:
            node.below[byte(s, part)] = _Node(-1, i)
            continue
        split = _Node(part, -1)
        split.below = {byte(strings[other], part): node, byte(s, part): _Node(-1, i)}
        if above is None:
            root = split
        else:
            above.below[key] = split
    out: list[int] = []
    stack = [root] if root else []
    while stack:
        node = stack.pop()
        if node.below:
            stack += [node.below[k] for k in sorted(node.below, reverse=True)]
        else:
            out += equal[node.leaf]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indexes of the strings in their order: multikey quicksort, then blind tries.

    The quicksort skips what all strings of a group have in common.
    """
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        own, depth = stack.pop()
        if len(own) > 1 and depth < shallow:
            first = strings[own[0]][depth:shallow]
            depth += min(common(first, strings[i][depth:shallow]) for i in own[1:])
        if len(own) < 2:
            out += own
        elif depth >= shallow:
            out += blind_trie(strings, own)
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in own]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less = [i for i, x in zip(own, byte, strict=True) if x < pivot]
            same = [i for i, x in zip(own, byte, strict=True) if x == pivot]
            more = [i for i, x in zip(own, byte, strict=True) if x > pivot]
            if more:
                stack.append((more, depth))
            if pivot < 0:
                stack.append((same, shallow))
            else:
                stack.append((same, depth + 1))
            if less:
                stack.append((less, depth))
    return out


def _common_lengths(strings: list[bytes]) -> np.ndarray:
    """Common prefix of any two strings, from the sorted order's neighbours."""
    order = deep_shallow(strings)
    n = len(order)
    near = np.array([common(strings[order[i]], strings[order[i + 1]]) for i in range(n - 1)], np.int64)
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        low = np.minimum.accumulate(near[i:])
        out[order[i], order[i + 1 :]] = low
        out[order[i + 1 :], order[i]] = low
    return out


def _sides(context: bytes, at: int, in_words: bool) -> tuple[bytes, bytes, np.ndarray | None, np.ndarray | None]:
    """The context from the anchor on and, backwards, before it; and for words how many end by each byte of both."""
    if not in_words:
        return context[at:], context[:at][::-1], None, None
    ws = context.split(b" ")
    sides = [b"".join(w + b" " for w in own) for own in (ws[at:], [w[::-1] for w in reversed(ws[:at])])]
    return *sides, *[np.cumsum(np.r_[0, np.frombuffer(x, np.uint8) == 32]) for x in sides]


def shared_windows(contexts: list[tuple[bytes, int]], length: int = LENGTH, in_words: bool = False) -> list[list[tuple[int, int]]]:
    """For each (context, anchor's place): ranges of it, in bytes or words, that windows shared with any other cover."""
    sides = [_sides(c, a, in_words) for c, a in contexts]
    after = _common_lengths([x[0] for x in sides])
    before = _common_lengths([x[1] for x in sides])
    out = []
    for i, (_, a) in enumerate(contexts):
        if in_words:
            after[i], before[i] = sides[i][2][after[i]], sides[i][3][before[i]]
        # Windows begin from a - before[i, j] on and end at a + after[i, j] at last.
        own = [(a - int(before[i, j]), a + int(after[i, j])) for j in range(len(contexts)) if j != i]
        out.append(merged([(s, e) for s, e in own if e - s >= length]))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


# Plan ----------------------------------------------------------------------------


def _by_context(ctx: DataFrame, length: int) -> DataFrame:
    """Covered ranges of the single contexts in small buckets."""

    def solve(rows: list[dict]) -> list[tuple[int, int, int, int]]:
        odd = rows[0]["g"] & 1
        found = shared_windows([(r["ctx"], r["off"]) for r in rows], WORDS if odd else length, bool(odd))
        return [(r["d"], r["th"], odd, r["p1"] + s, r["p1"] + e) for r, own in zip(rows, found, strict=True) if r["single"] for s, e in own]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if rows and rows[-1]["g"] != row["g"]:
                    out += solve(rows)
                    rows = []
                rows.append(row)
            yield _ranges(out)
        if rows:
            yield _ranges(solve(rows))

    return ctx.sortWithinPartitions("g").mapInArrow(scan, "d long, th long, odd int, s int, e int")


def _ranges(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["d", "th", "odd", "s", "e"])


def _odd(g: str = "g") -> Column:
    """1 for runs of words, 0 for those of bytes."""
    return F.col(g).bitwiseAND(F.lit(1).cast("bigint")).cast("int")


def _window(length: int) -> Column:
    return F.when(_odd() == 1, F.lit(WORDS)).otherwise(F.lit(length))


def _by_blocks(blocks: DataFrame, length: int) -> DataFrame:
    """Covered ranges of the single contexts in large buckets, by counts of hashes."""
    key = ["g", "block"]
    cores = blocks.groupBy(*key, "core").agg(F.count(F.lit(1)).alias("n_core")).filter("n_core > 1")
    alive = blocks.join(cores, [*key, "core"])
    wholes = alive.groupBy(*key, "whole").agg(F.count(F.lit(1)).alias("n_whole"))
    alive = alive.join(wholes, [*key, "whole"])
    full = alive.filter("n_whole > 1 and single").select("d", "th", _odd().alias("odd"), F.col("w0").alias("s"), (F.col("w0") + F.size("windows") - 1 + _window(length)).cast("int").alias("e"))
    # Blocks at the ends of a run have fewer windows, so their bytes differ though they share windows.
    one = alive.dropDuplicates([*key, "whole"]).select("g", "d", "th", "w0", "single", "n_whole", F.posexplode("windows").alias("i", "w"))
    twice = one.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "w")
    parts = one.filter("n_whole = 1 and single").join(twice, ["g", "w"]).select("d", "th", _odd().alias("odd"), (F.col("w0") + F.col("i")).alias("s"), (F.col("w0") + F.col("i") + _window(length)).alias("e"))
    return full.unionByName(parts)


def covered_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_classes: int = MOST_CLASSES) -> DataFrame:
    """d, th, odd, s, e: byte ranges and, where odd is 1, word ranges, overlapping ones too, of documents (d, th, text)."""
    spark = docs.sparkSession
    with scratch() as kept:
        found = materialize(anchors(docs, length, gram), "suffix-anchors")
        pick = [F.first(c).alias(c) for c in ("d", "th", "a", "p1", "p2")]
        classes = materialize(found.groupBy("g", "c").agg(F.sum("m").alias("n"), *pick), "suffix-classes")
        repeated = classes.filter("n > 1").select("g", "c")
        whole = found.join(repeated, ["g", "c"]).select("d", "th", _odd().alias("odd"), F.col("p1").alias("s"), (F.col("q") + _window(length)).cast("int").alias("e"))

        buckets = classes.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").select("g", "m")
        taken = classes.join(buckets, "g").select("d", "th", F.struct("g", "a", "p1", "p2", (F.col("n") == 1).alias("single"), (F.col("m") > most_classes).alias("large")).alias("x"))
        wanted = taken.groupBy("d", "th").agg(F.collect_list("x").alias("xs"))
        read = docs.join(wanted, ["d", "th"]).select("d", "th", "text", "xs")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64):
                yield from _contexts(batch.to_pylist(), length)

        schema = T.StructType.fromDDL("d long, th long, g long, single boolean, p1 int, off int, ctx binary, block int, core long, whole long, w0 int, windows array<long>")
        ctx = materialize(read.mapInArrow(cut, schema), "suffix-contexts")
        parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        small = ctx.filter("ctx is not null").select("d", "th", "g", "single", "p1", "off", "ctx").repartition(parts, "g")
        blocks = ctx.filter("ctx is null").select("d", "th", "g", "single", "block", "core", "whole", "w0", "windows")
        ranges = materialize(whole.unionByName(_by_context(small, length)).unionByName(_by_blocks(blocks, length)), "suffix-ranges")
        kept.append(ranges)
    return ranges


def _contexts(rows: list[dict], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts of small buckets as bytes, of large ones as hashes of their blocks."""
    names = ["d", "th", "g", "single", "p1", "off", "ctx", "block", "core", "whole", "w0", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    out: list[list] = [[] for _ in names]

    def put(*values) -> None:
        for to, v in zip(out, values, strict=True):
            to.append(v)

    for row in rows:
        data = (row["text"] or "").encode("utf-8", "surrogatepass")
        words, sums = None, [None, None]
        if any(x["g"] & 1 for x in row["xs"]):
            words = [w for w in data.translate(_BLANKS).split(b" ") if w]
        for x in row["xs"]:
            odd = x["g"] & 1
            size = WORDS if odd else length
            if not x["large"]:
                own = b" ".join(words[x["p1"] : x["p2"] + size]) if odd else data[x["p1"] : x["p2"] + size]
                put(row["d"], row["th"], x["g"], x["single"], x["p1"], x["a"] - x["p1"], own, None, None, None, None, None)
                continue
            if sums[odd] is None:
                sums[odd] = prefix_sums(np.frombuffer(data, np.uint8))
                if odd:
                    sums[odd] = word_sums(range_hash(sums[odd], *word_places(np.frombuffer(data, np.uint8))))
            starts = np.arange(x["p1"], x["p2"] + 1)
            windows = range_hash(sums[odd], starts, starts + size).view(np.int64)
            offsets = (x["a"] - starts) // BLOCK
            for b in np.unique(offsets):
                own = np.flatnonzero(offsets == b)
                w0, w1 = starts[own[0]], starts[own[-1]]
                # The bytes that every window of the block holds, wherever the run of windows ends.
                lo, hi = x["a"] - b * BLOCK, x["a"] - (b * BLOCK + BLOCK - 1) + size
                core, whole = range_hash(sums[odd], np.array([lo, w0]), np.array([hi, w1 + size])).view(np.int64)
                put(row["d"], row["th"], x["g"], x["single"], None, None, None, int(b), int(core), int(whole ^ (x["a"] - w0)), int(w0), windows[own])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, n_repeated_words, kept (binary)."""
    row, columns = packed(docs, "n_bytes", "n_removed", "n_spans", "n_repeated_words", "kept")
    keyed = docs.select(row, "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("th"))
    ranges = covered_ranges(keyed.select("d", "th", "text"), length)
    own = lambda odd: F.collect_set(F.when(F.col("odd") == odd, F.struct("s", "e")))
    ranges = ranges.groupBy("d", "th").agg(own(0).alias("ranges"), own(1).alias("passages"))
    both = keyed.join(ranges, ["d", "th"], "left").select("row", "text", "ranges", "passages")
    schema = T.StructType([*both.select("row", "text").schema.fields, *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, n_repeated_words long, kept binary").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text, found, passages in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = merged([(r["s"], r["e"]) for r in found or ()])
                edges = [0, *[x for span in spans for x in span], len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                words = sum(e - s for s, e in merged([(r["s"], r["e"]) for r in passages or ()]))
                for to, v in zip(out, (len(data), len(data) - len(kept), len(spans), words, kept), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.binary())], names=["row", "text", "n_bytes", "n_removed", "n_spans", "n_repeated_words", "kept"])

    return both.mapInArrow(scan, schema).select(*columns, "n_bytes", "n_removed", "n_spans", "n_repeated_words", "kept")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words")


OP4_SQL = f"""
with d as materialized (select row_number() over () as r, doc_id, text, hex(encode(coalesce(text, ''))) as h from documents),
n as (select *, length(h) // 2 as n from d),
w as (select r, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) as k from (select r, h, unnest(range(0, n - {LENGTH - 1})) as p from n where n >= {LENGTH})),
t as (select k from w group by k having count(*) > 1),
c as (select r, p from w semi join t using (k)),
i as (select r, p, case when p - lag(p) over (partition by r order by p) <= {LENGTH} then 0 else 1 end as new from c),
g as (select r, p, sum(new) over (partition by r order by p) as g from i),
s as (select r, g, min(p) as s, max(p) + {LENGTH} as e from g group by r, g),
x as (select *, coalesce(lag(e) over (partition by r order by s), 0) as before from s),
k as (select r, count(*) as n_spans, sum(e - s) as n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' order by s) || substr(any_value(h), 2 * max(e) + 1) as kept from x join n using (r) group by r),
o as (select r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from d),
u as (select r, p, md5(array_to_string(ws[p:p + {WORDS - 1}], ' ')) as k from (select r, ws, unnest(range(1, len(ws) - {WORDS - 2})) as p from o where len(ws) >= {WORDS})),
v as (select r, p from u semi join (select k from u group by k having count(*) > 1) using (k)),
q as (select r, sum(least({WORDS}, coalesce(further - p, {WORDS}))) as n_words from (select r, p, lead(p) over (partition by r order by p) as further from v) group by r)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256, cast(coalesce(n_words, 0) as bigint) as n_repeated_words
from n left join k using (r) left join q using (r)
"""
