"""Document fingerprints by I-Match with randomised lexicon subsets.

Terms are the runs of a text without white space and ASCII punctuation, lower-
cased and known by a 64-bit hash. The lexicon holds the terms whose document
frequency lies within a band, that is an inverse document frequency
neither too low (function words) nor too high (typing errors, names). A text's
distinct lexicon terms, sorted, are hashed once for each of several random
subsets of the lexicon; one changed term changes only the codes of the subset
that holds it.

A fingerprint's main codes are I-Match's: the 64-bit hash of all of the text's sorted
lexicon terms, and of those left in each of ``LEXICONS`` subsets of the lexicon that
each leave out a random quarter of it, by two bits of the terms' hashes. Texts with an equal
main code differ at most in terms that one subset leaves out.

Beside them are finer codes, which tell how much of two edited texts is the same. A subset of a
scale s holds one in 2**s of the lexicon, by other bits of the hashes;
``SUBSETS`` disjoint ones are used of each scale. A text takes the ``SCALES``
scales from the one on at which a subset holds about one of its terms or less, so
short and long texts get as many codes. The likeness of two fingerprints is the share of equal codes among those
that either has, main and finer ones at the scales that both have.

The lexicon's size is bounded whatever the corpus: with at least ``MIN_SHARE``
of all documents for each term, it holds at most (distinct terms of a mean
document) / MIN_SHARE terms. It is handed to the tasks as one array of buckets.

The next document is found without a global order of rows: documents are dealt
to ranges of (doc_id, hash of the text) that begin at a hash sample of these keys (``most`` of them at
most, on average), and the first document of a range is
also sent to the range before. Documents without an id so come in many ranges, too; only
equal rows cannot be parted.

Defined cases: a null text counts as empty; a text without lexicon terms is
hashed by all its terms, one without terms gives the code of nothing, like only to
itself; a null doc_id is the last; rows with one doc_id are ordered by a hash of
their text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import materialize, sha256_hex, spread, table

#: Share of documents that a lexicon term is in, at least and at most.
MIN_SHARE = 0.001
MAX_SHARE = 0.1
MIN_DOCS = 2
_BUCKETS = 1 << 14
#: Lexicon subsets of the main codes; each takes two of the hash's lowest bits.
LEXICONS = 8
SUBSETS = 32
SCALES = 3
_MAX_ID = (1 << 63) - 1
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.filter(F.split(F.lower(text), _BREAK, -1), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """One row: the terms within the band, as an array of ``_BUCKETS`` arrays by hash."""
    spark = docs.sparkSession
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= max(MIN_DOCS, min_share * n)) & (F.col("df") <= max(MIN_DOCS, max_share * n)))
    filled = band.groupBy(F.pmod("t", F.lit(_BUCKETS)).alias("b")).agg(F.collect_list("t").alias("ts"))
    slot = F.struct("id", F.coalesce("ts", F.array().cast("array<bigint>")).alias("ts"))
    slots = spark.range(_BUCKETS).join(filled, F.col("id") == F.col("b"), "left")
    return slots.agg(F.transform(F.sort_array(F.collect_list(slot)), lambda x: x["ts"]).alias("lexicon"))


def fingerprint(own: Column) -> Column:
    """struct(s, main, codes): the main codes, and those at the SCALES scales from s on, of struct(known, words).

    A code of 0 is an empty subset.
    """

    def whole(t: Column) -> Column:
        return F.when(F.size(t) == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(t))

    def left(t: Column, k: int) -> Column:
        return F.transform(F.array(F.filter(t, lambda x: F.shiftright(x, 2 * k).bitwiseAND(F.lit(3).cast("bigint")) != 0)), whole)[0]

    def main(t: Column) -> Column:
        return F.array(whole(t), *[left(t, k) for k in range(LEXICONS)])

    def of(x: Column) -> Column:
        chosen = F.sort_array(F.when(F.size(x["known"]) > 0, x["known"]).otherwise(x["words"]))
        return F.transform(F.array(F.struct(chosen.alias("t"))), placed)[0]

    def placed(x: Column) -> Column:
        s = F.floor(F.log2(F.greatest(F.size(x["t"]), F.lit(1)).cast("double"))).cast("int") + 1
        return F.transform(F.array(F.struct(s.alias("s"), F.call_function("shiftleft", F.lit(1), s).alias("m"), x["t"].alias("t"))), scaled)[0]

    def scaled(x: Column) -> Column:
        # A term's subset at one scale is its subset at the next less a bit, so few terms are left to place.
        marked = F.transform(x["t"], lambda t: F.struct(F.shiftrightunsigned(t, 20).bitwiseAND(F.lit(0x3FFFFFFF)).cast("int").alias("j"), t.alias("t")))
        few = F.filter(marked, lambda p: p["j"].bitwiseAND(x["m"] - 1) < SUBSETS)
        nothing = F.struct(F.lit(-SCALES).alias("s"), main(x["t"]).alias("main"), F.array(F.array(F.lit(1).cast("bigint"))).alias("codes"))
        some = F.transform(F.array(F.struct(few.alias("p"), x["m"].alias("m"))), lambda y: F.array(*[codes(y["p"], y["m"] * (1 << i)) for i in range(SCALES)]))[0]
        return F.when(F.size(x["t"]) == 0, nothing).otherwise(F.struct(x["s"].alias("s"), main(x["t"]).alias("main"), some.alias("codes")))

    def codes(few: Column, m: Column) -> Column:
        own = F.filter(few, lambda p: p["j"].bitwiseAND(m - 1) < SUBSETS)
        return F.transform(F.array(own), lambda p: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: code(F.filter(p, lambda y: y["j"].bitwiseAND(m - 1) == j))))[0]

    def code(subset: Column) -> Column:
        return F.transform(F.array(subset), lambda p: F.when(F.size(p) == 0, F.lit(0).cast("bigint")).otherwise(F.xxhash64(p).bitwiseAND(F.lit(0xFFFFFF)) + 1))[0]

    return F.transform(F.array(own), of)[0]


def with_fingerprint(docs: DataFrame, lex: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with the fingerprint of its column text; lex is a lexicon()."""
    found = docs.withColumn("_words", terms(F.col(text))).withColumn("_lex", lex.scalar())
    known = F.filter("_words", lambda t: F.array_contains(F.get("_lex", F.pmod(t, F.lit(_BUCKETS))), t))
    found = found.withColumn("_own", F.struct(known.alias("known"), F.col("_words").alias("words"))).drop("_lex", "_words")
    return found.withColumn(name, fingerprint(F.col("_own"))).drop("_own")


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as a string: scale, main codes, then the finer codes in hex, - for an empty subset."""
    one = lambda xs: F.array_join(F.transform(xs, lambda x: F.when(x == 0, F.lit("-")).otherwise(F.lower(F.hex(x)))), ".")
    return F.concat_ws(":", fp["s"].cast("string"), one(fp["main"]), F.array_join(F.transform(fp["codes"], one), ":"))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal codes among those that either has, 0 where neither has any."""
    ahead = y["s"] - x["s"]
    shared = F.greatest(F.least(F.size(x["codes"]), F.size(y["codes"])) - F.abs(ahead), F.lit(0))
    at = lambda z, skip: F.concat(z["main"], F.flatten(F.slice(z["codes"], F.greatest(skip, F.lit(0)) + 1, shared)))
    sides = F.struct(at(x, ahead).alias("p"), at(y, -ahead).alias("q"))

    def share(s: Column) -> Column:
        used = F.filter(F.zip_with(s["p"], s["q"], lambda p, q: F.when((p != 0) | (q != 0), F.when(p == q, 1).otherwise(0))), lambda v: v.isNotNull())
        return F.when(F.size(used) == 0, F.lit(0.0)).otherwise(F.aggregate(used, F.lit(0), lambda acc, v: acc + v) / F.size(used))

    return F.transform(F.array(sides), share)[0]


def with_next(docs: DataFrame, columns: list[str], per_range: int = 64, most: int = 65536) -> DataFrame:
    """docs, without null doc_id gaps, with next_<column> of the next document by doc_id."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_MAX_ID)).alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.withColumn("_k", key)
    rate = max(per_range, -(-docs.count() // most))
    chosen = F.collect_set(F.when(F.pmod(F.xxhash64("_k"), F.lit(rate)) == 0, F.col("_k")))
    bounds = keyed.agg(F.sort_array(F.array_union(F.array(F.min("_k")), chosen)).alias("b")).scalar()
    keyed = keyed.withColumn("_b", bounds)
    steps = [1 << i for i in reversed(range((2 * most).bit_length()))]
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, step: F.when(F.coalesce(F.get("_b", lo + step) <= F.col("_k"), F.lit(False)), lo + step).otherwise(lo))
    first = F.get("_b", F.col("_r")) == F.col("_k")
    before = F.when(F.col("_r") == 0, F.size("_b") - 1).otherwise(F.col("_r") - 1)
    own = F.struct(F.col("_r").alias("r"), F.lit(False).alias("ghost"))
    ghost = F.struct(before.alias("r"), F.lit(True).alias("ghost"))
    to = F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("_to")
    dealt = keyed.withColumn("_r", at).select(*docs.columns, "_k", to).select(*docs.columns, "_k", F.col("_to.r").alias("_r"), F.col("_to.ghost").alias("_ghost"))
    order = Window.partitionBy("_r").orderBy("_ghost", "_k")
    return dealt.select(*docs.columns, "_ghost", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("not _ghost").drop("_ghost")


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    lex = materialize(lexicon(docs), "imatch-lexicon")
    pairs = with_next(with_fingerprint(docs, lex), ["text", "fp"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    pairs = pairs.select("doc_id", "fp", "next_fp", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    pairs = with_fingerprint(pairs, lex, "edited", "edited_fp")
    return pairs.select(
        "doc_id",
        "n_chars",
        sha256_hex(F.col("edited")).alias("edited_sha256"),
        fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
