r"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set are its distinct shingles of five words. Two documents link when
100 * intersection >= 75 * union; the join returns the components of the links.

1. One pass over all texts gives each document's set size and a 128-bit digest of
   its set, and a count-min sketch of fixed width of all shingles. Documents with
   one digest are a class of equal sets, linked without any comparison.
2. Shingles have one order in all documents: those that the sketch shows to be
   frequent come last, by their frequency, all others by their hash. A document of
   n shingles has to share all but n - ceil(0.75 n) with any partner, so two
   linked ones share at least k among the first n - ceil(0.75 n) + k of each, for
   every k. Each document takes the k of 1 to ``MOST_MATCHES`` whose estimated cost is least: k
   lengthens the prefix by k - 1 shingles, and by Markov's bound divides the
   candidates that need a comparison.
   As frequent shingles come last, one is in the prefix only of a document of which frequent ones make up about
   three quarters: a passage that many documents share brings no pairs of documents that are otherwise their own.
3. Prefix shingles that only one document has are dropped. In what is left every
   document is first compared with the least document of each shingle, and what
   links is contracted to components; then only pairs in different components that
   share a shingle are counted. A large group of near copies so costs a star, not
   all its pairs. Pairs are met by shingle and size, only where the shingle's
   places in both documents and what either shares with anyone let them link, and
   are compared when they share k such shingles.
4. Comparison is exact, on the whole texts of both documents.

Defined cases: null and empty texts and texts of blanks have no shingles and link with
nothing; texts of fewer than five words are one shingle; rows with one doc_id count as
one document, linked by any of its texts; a null doc_id is told apart by its text and
its component is the smallest doc_id it reaches, null if there is none; an empty table
gives an empty result; columns of docs other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import materialize, scratch, slices, spread, table
from plinth.llm.components import components
from plinth.llm.hashing import mix, shingle_sets

PERCENT = 75
WIDTH = 5
#: At most 15, as four bits of a prefix row hold it.
MOST_MATCHES = 4
#: Cells of each of the two rows of the sketch. With N distinct shingles of all documents a cell holds
#: about N / CELLS more than it should; only counts six deviations above that are told from it.
CELLS = 1 << 18
#: Cost of one comparison and of one prefix row, in index entries read.
COMPARE, EMIT = 50.0, 1.0
#: Ratio of neighbouring bands of set sizes.
BAND = 1.05
_NO_ID = 1 << 62
_U = np.uint64


def _cells(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (shingles & _U(CELLS - 1)).astype(np.int64), (shingles >> _U(40) & _U(CELLS - 1)).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sets_and_sketch(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of documents (tag 0: id, n, digest a, b) and of the sketch (tag 1: row, cell, count)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CELLS), np.int64)

        def rows(tag: int, *columns) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, tag, np.int32)), *[c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]], names=["tag", "id", "n", "a", "b"])

        for batch in slices(batches):
            ids = batch.column(0).cast(pa.int64())
            n, a, b = [], [], []
            for own in shingle_sets(batch.column(1).to_pylist(), width):
                for r, cell in enumerate(_cells(own)):
                    np.add.at(counts[r], cell, 1)
                n.append(len(own))
                a.append(int(mix(own).sum(dtype=_U).astype(np.int64)))
                b.append(int(mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).astype(np.int64)))
            yield rows(0, ids, n, a, b)
        for r in range(2):
            cell = np.flatnonzero(counts[r])
            if len(cell):
                yield rows(1, np.full(len(cell), r, np.int64), cell, counts[r][cell], np.zeros(len(cell), np.int64))

    return docs.select("doc_id", "text").mapInArrow(scan, "tag int, id long, n long, a long, b long")


def node(docs: DataFrame) -> Column:
    """A document's node: its id, or a number above all ids from its text's hash."""
    return F.coalesce(docs["doc_id"].cast("bigint"), F.shiftrightunsigned(F.xxhash64(docs["text"]), 2).bitwiseOR(F.lit(_NO_ID)))


def prefixes(docs: DataFrame, sketch: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """token, doc, meta: the chosen prefix of each document.

    meta holds the set's size, the token's place in the document's order, and
    the document's k, see ``_opened``: a text has less than 2**30 shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        noise = held[0].sum() / CELLS
        floor = noise + 6 * np.sqrt(noise) + 2
        for batch in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in range(3)]
            ids = batch.column(0).to_pylist()
            for doc, own in zip(ids, shingle_sets(batch.column(1).to_pylist(), width), strict=True):
                n = len(own)
                if not n:
                    continue
                one, two = _cells(own)
                seen = np.minimum(held[0][one], held[1][two]).astype(np.float64)
                many = np.where(seen > floor, seen - noise, 1.0)
                rank = np.ceil(np.log2(many))
                order = np.lexsort((own, rank))
                least = -(-percent * n // 100)
                others = np.cumsum(many[order] - 1)
                ks = np.arange(1, min(MOST_MATCHES, least) + 1)
                length = n - least + ks
                found = others[length - 1]
                k = int(ks[np.argmin(EMIT * length + found + COMPARE * found / ks)])
                size = n - least + k
                own = own[order[:size]]
                columns = (_signed(own), np.full(size, doc, np.int64), n << 34 | np.arange(size) << 4 | k)
                for to, c in zip(out, columns, strict=True):
                    to.append(c)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["token", "doc", "meta"])

    return docs.select("doc_id", "text").mapInArrow(scan, "token long, doc long, meta long")


def shared_tokens(found: DataFrame) -> DataFrame:
    """The rows of found whose token at least two documents have, with its least document as lead.

    A frequent token is one row of partial sums for each task, and one row on the
    small side of the join, whose large side can be split.
    """
    heads = found.groupBy("token").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "lead")
    return found.join(heads, "token")


def _opened(t: DataFrame) -> DataFrame:
    return t.select(
        "token",
        "doc",
        F.shiftrightunsigned("meta", 34).alias("n"),
        F.shiftright("meta", 4).bitwiseAND(F.lit(0x3FFFFFFF)).alias("at"),
        F.col("meta").bitwiseAND(F.lit(0xF)).alias("k"),
    )


def _with_shared(tokens: DataFrame) -> DataFrame:
    """tokens with s, how many of its document's prefix shingles other documents have in theirs."""
    return tokens.join(tokens.groupBy("doc").agg(F.count(F.lit(1)).alias("s")), "doc")


def _least(n, percent: int):
    """Overlap with any linked partner at least."""
    return F.ceil(F.lit(percent) * n / F.lit(100.0) - F.lit(1e-9))


def _overlap(n_a, n_b, percent: int):
    """Least overlap of a linked pair of these sizes."""
    return F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100.0 + percent) - F.lit(1e-9))


def _needed(n_a, n_b, k, percent: int):
    """Prefix shingles that a linked pair of these sizes shares at least, in prefixes of k."""
    return F.greatest(k, _overlap(n_a, n_b, percent) - _least(F.greatest(n_a, n_b), percent) + k)


def verify(pairs: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link, compared by the whole texts."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            texts: dict[str, int] = {}
            ia = [texts.setdefault(t or "", len(texts)) for t in part.column(2).to_pylist()]
            ib = [texts.setdefault(t or "", len(texts)) for t in part.column(3).to_pylist()]
            sets = list(shingle_sets(texts, width))
            keep = []
            for i, j in zip(ia, ib, strict=True):
                x, y = sets[i], sets[j]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same) > 0)
            yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(scan, "a long, b long").distinct()


def _candidates(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents in different components that may link.

    For every k up to both documents' k, a linked pair shares k shingles among the
    first n - overlap + k of each, where the overlap is the one that their sizes need.
    So a row far back in its document's order can only meet smaller documents: rows
    are met by (token, band of the smaller one's size), the larger one's rows being
    listed for the bands that they can meet. What a pair can share at all is
    bounded by the shingles that either shares with anyone, and what lies
    behind the prefixes.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(math.log(BAND))).cast("int")
    n, reach = F.col("n"), F.col("n") - F.col("at") - 1 + F.col("k")
    most = F.least(n, F.floor(reach * F.lit(100.0 + percent) / F.lit(float(percent)) + F.lit(1e-9)) - n)
    columns = ("doc", "n", "at", "k", "s", "label")
    small = tokens.filter(_overlap(n, n, percent) <= reach).select("token", band(n).alias("band"), *[F.col(c).alias(c + "_a") for c in columns])
    large = tokens.filter(most >= _least(n, percent)).select("token", F.explode(F.sequence(band(_least(n, percent)), band(most))).alias("band"), *[F.col(c).alias(c + "_b") for c in columns])
    k, need = F.least("k_a", "k_b"), _overlap(F.col("n_a"), F.col("n_b"), percent)
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_a") < F.col("doc_b")))
    sizes = F.col("n_a") * 100 >= F.col("n_b") * percent
    early = (F.col("at_a") + 1 <= F.col("n_a") - need + k) & (F.col("at_b") + 1 <= F.col("n_b") - need + k)
    behind = F.greatest(_least(F.col("n_a"), percent) - F.col("k_a"), _least(F.col("n_b"), percent) - F.col("k_b"))
    enough = F.least("s_a", "s_b") + behind >= need
    met = small.join(large, ["token", "band"]).filter((F.col("label_a") != F.col("label_b")) & ordered & sizes & early & enough)
    counted = met.groupBy(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(k).alias("k"))
    return counted.filter("c >= k").select("a", "b")


def _labelled(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens with the documents' labels, less groups of one component."""
    own = tokens.join(labels, tokens["doc"] == labels["node"], "left").select(*tokens.columns, F.coalesce("label", "doc").alias("label"))
    mixed = own.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    return own.join(mixed, "token", "left_semi")


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component for each row of docs; a key is a ``node``."""
    docs = docs.select(node(docs).alias("doc_id"), "text")
    with scratch() as kept:
        scanned = materialize(sets_and_sketch(docs, width), "jaccard-sets")
        sets = scanned.filter("tag = 0").select(F.col("id").alias("key"), "n", "a", "b")
        counted = scanned.filter("tag = 1").groupBy("id", "n").agg(F.sum("a").alias("c")).toArrow()
        sketch = np.zeros((2, CELLS), np.int64)
        sketch[counted["id"].to_numpy(), counted["n"].to_numpy()] = counted["c"].to_numpy()

        # A table of its own, so that the join's other side can be split where a class is large.
        classes = materialize(sets.filter("n > 0").groupBy("n", "a", "b").agg(F.min("key").alias("rep")), "jaccard-digests")
        members = materialize(sets.join(classes, ["n", "a", "b"], "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("rep", "key").alias("rep")), "jaccard-classes")
        copies = members.filter("rep <> key").select(F.col("key").alias("a"), F.col("rep").alias("b"))

        tokens = _tokens(docs, sketch, copies.select(F.col("a").alias("doc")).distinct(), width, percent)
        links = materialize(verify(_stars(tokens, percent), docs, width, percent), "jaccard-links")
        near = components(links)
        rest = materialize(verify(_candidates(_labelled(tokens, near), percent), docs, width, percent), "jaccard-links")
        same_id = members.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
        labels = components(copies.unionByName(links).unionByName(rest).unionByName(same_id.select("a", "b")))
        kept += [members, labels]
    return members.join(labels, members["key"] == labels["node"], "left").select("key", "n_shingles", F.coalesce("label", "key").alias("component"))


def _tokens(docs: DataFrame, sketch: np.ndarray, later: DataFrame, width: int, percent: int) -> DataFrame:
    """The prefix rows of all documents but later ones of a class, whose token two of them have at least."""
    with scratch() as kept:
        found = materialize(prefixes(docs, sketch, width, percent), "jaccard-prefixes")
        shared = materialize(shared_tokens(found), "jaccard-shared")
        alive = _opened(shared.join(later, "doc", "left_anti"))
        tokens = materialize(_with_shared(shared_tokens(alive).drop("lead")), "jaccard-tokens")
        kept.append(tokens)
    return tokens


def _stars(tokens: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of a shingle's least document and others that may link."""
    n, n_a = F.col("n"), F.col("n_a")
    heads = tokens.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("h")).select("token", F.col("h.doc").alias("a"), F.col("h.n").alias("n_a"))
    star = tokens.join(heads, "token").filter((F.col("doc") != F.col("a")) & (n_a * 100 >= n * percent) & (n * 100 >= n_a * percent))
    star = star.groupBy("a", F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("n_a").alias("n_a"), F.max("n").alias("n"))
    return star.filter(F.col("c") >= _needed(n_a, n, F.lit(1), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    linked = link_components(docs, width, percent)
    real = lambda c: F.when(F.col(c) < _NO_ID, F.col(c))
    return linked.select(real("key").alias("doc_id"), "n_shingles", real("component").alias("component_id"))


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP1_SQL = rf"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
a as (select doc_id, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end as shs from t),
s as materialized (select distinct doc_id, unnest(shs) as sh from a),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by all),
l as materialized (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= {PERCENT} * (x.n + y.n - c)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as d, doc_id as o from documents union select r.d, e.b from r join e on r.o = e.a)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.o) as component_id
from documents d left join n on d.doc_id = n.doc_id join r on r.d = d.doc_id group by d.doc_id
"""
