r"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score of the words it
holds and of their first three to six letters; a passage's score is the noisy-or of
its sentences, 1 - product(1 - p), and the document's score is that of its worst passage, a
run of ``PASSAGE`` sentences or the whole of a shorter text. So the small p of clean
sentences do not add up with length, and a long text is judged as its passages are. The weights are fitted from document labels
alone, so the sentences that make a document toxic are found, not given: those
with p of at least 0.5 are returned as ``offending``.

The classifier is fitted on the driver on a bounded sample of labelled documents:
at most ``MAX_TRAIN_DOCS`` of them, the first by a hash of doc_id whose texts have ``MAX_TRAIN_BYTES``
bytes together at most, one text for each doc_id; those with
crc32(doc_id as text) mod 5 = 0 are held out and never used. Features are the
``MAX_FEATURES`` words and prefixes most associated with the label in the sample, all above ``LEAST_GAIN``.
Scoring covers whole texts of all rows, partition by partition.

Defined cases: a null or empty text has no sentences and scores 0; a label that
is null is not used; a document labelled more than once is toxic if any label says
so; a null doc_id counts as held out; without two classes to learn from every
text scores 0; equal rows come back as often; an empty table gives an empty
result; columns of docs are kept, those named like the result's are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.common import slices, spread, table

MAX_TRAIN_DOCS = 6000
MAX_TRAIN_BYTES = 64 << 20
MAX_FEATURES = 1500
PREFIXES = (3, 4, 5, 6)
STEPS = 400
RATE = 0.1
DECAY = 1e-4
#: Least signed log-likelihood ratio of a feature; this and DECAY by cross-validation on documents that are not held out.
LEAST_GAIN = 8.0
FIRST_BIAS = -8.0
FOLDS = 5
PASSAGE = 200
#: Words whose features a worker remembers at most.
REMEMBERED = 1 << 18

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


class _Hits(dict):
    """The features of a word, lower-cased, that have a weight; filled as words come."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(f for f in features({word}) if f in self.weights)
        return found


@dataclass
class Model:
    """Weights by feature; a feature is a word, or a prefix and an asterisk."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -math.inf

    def __post_init__(self):
        self._hits = _Hits(self.weights)

    def sentence(self, words: Iterable[str]) -> float:
        """The logit of a sentence with these words."""
        return self._logit({f for w in words for f in self._hits[w]})

    def _logit(self, own: set[str]) -> float:
        return self.bias + sum(self.weights[f] for f in sorted(own))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its offending sentences: start, end, score."""
        if not text or self.bias == -math.inf:
            return 0.0, []
        clean = math.log1p(math.exp(self.bias))  # -log(1 - p) of a sentence without features
        spans = [m.span() for m in _SENTENCE.finditer(text)]
        risk, found = {}, []
        for i, own in self._told(text, spans):
            z = self._logit(own)
            risk[i] = math.log1p(math.exp(z)) if z < 30 else z
            if z >= 0:
                found.append((*spans[i], 1 / (1 + math.exp(-z)) if z < 700 else 1.0))
        if len(spans) <= PASSAGE or not risk:
            n = min(len(spans), PASSAGE)
            return -math.expm1(-sum(risk.values()) - (n - len(risk)) * clean), found
        total, worst = 0.0, 0.0
        for i in range(len(spans)):
            total += risk.get(i, clean)
            if i >= PASSAGE:
                total -= risk.get(i - PASSAGE, clean)
            worst = max(worst, total)
        return -math.expm1(-worst), found

    def _told(self, text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, set[str]]]:
        """The sentences with weighted features, in order, and these features."""
        hits, low = self._hits, text.lower()
        if len(low) != len(text):  # places would differ: sentence by sentence
            for i, (s, e) in enumerate(spans):
                if own := {f for w in _WORD.findall(text[s:e].lower()) for f in hits[w]}:
                    yield i, own
            return
        i, own = -1, set()
        for m in _WORD.finditer(low):
            if more := hits[m[0]]:
                at = bisect_right(spans, (m.start(), len(text))) - 1
                if at != i:
                    if own:
                        yield i, own
                    i, own = at, set()
                own.update(more)
        if own:
            yield i, own


def features(words: set[str]) -> set[str]:
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def held_out(doc_id: Column | str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN_DOCS, most_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[str, int]]:
    """Text and label of at most `most` labelled documents outside the held-out fold, of `most_bytes` bytes at most.

    Of rows with one doc_id the least text counts.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    marks = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    present = docs.select("doc_id").distinct()
    chosen = marks.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # At most `most` rows come into this window.
    so_far = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = own.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).select("text", "y").collect()
    return sorted((r["text"], r["y"]) for r in rows)


def fit(sample: list[tuple[str, int]]) -> Model:
    """Noisy-or logistic regression by full-batch Adam; the same sample gives the same model."""
    n = Counter(y for _, y in sample)
    if not n[0] or not n[1]:
        return Model()
    # Texts are cut up twice, so that at most the features of toxic documents are held.
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for label in (1, 0):
        for text, y in sample:
            if y == label:
                own = features(set(_WORD.findall(text.lower())))
                held[y].update(own if y == 1 else own & held[1].keys())
        if label == 1:
            held = (Counter(), Counter({f: c for f, c in held[1].items() if c >= 2}))
    share = n[1] / len(sample)

    def gain(f: str) -> float:
        # Signed log-likelihood ratio of the label given the feature; rare words gain little.
        pos, neg = held[1][f], held[0][f]
        rate = pos / (pos + neg)
        own = (pos * math.log(rate / share) if pos else 0.0) + (neg * math.log((1 - rate) / (1 - share)) if neg else 0.0)
        return own if rate > share else -own

    ranked = sorted(((gain(f), f) for f in held[1]), key=lambda x: (-x[0], x[1]))
    names = [f for g, f in ranked[:MAX_FEATURES] if g > LEAST_GAIN]
    at = {f: i for i, f in enumerate(names)}
    doc_of, rows, cols, plain = [], [], [], np.zeros(len(sample))
    by_word: dict[str, tuple[int, ...]] = {}
    for d, (text, _) in enumerate(sample):
        if len(by_word) >= REMEMBERED:
            by_word.clear()
        for w in set(_WORD.findall(text.lower())):
            if w not in by_word:
                by_word[w] = tuple(at[f] for f in features({w}) if f in at)
        for found in _SENTENCE.finditer(text):
            own = sorted({i for w in set(_WORD.findall(found[0].lower())) for i in by_word.get(w, ())})
            if own:
                rows += [len(doc_of)] * len(own)
                cols += own
                doc_of.append(d)
            else:
                plain[d] += 1
    doc_of, rows, cols = np.array(doc_of, int), np.array(rows, int), np.array(cols, int)
    y = np.array([label for _, label in sample], float)
    w, bias = np.zeros(len(names)), FIRST_BIAS
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, w[cols], len(doc_of))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-bias))
        clean = np.bincount(doc_of, -np.logaddexp(0, z), len(sample)) - plain * math.log1p(math.exp(bias))
        whole = np.clip(-np.expm1(clean), 1e-12, 1.0)
        # d loss / d log(1 - P): 1 - y and, for label 1, the chain through P = 1 - exp(clean).
        slope = np.where(y == 1, np.exp(np.minimum(clean, 0.0)) / whole, -1.0)
        per_sentence = -slope[doc_of] * p / len(sample)
        grad_w = np.bincount(cols, per_sentence[rows], len(names)) + DECAY * w
        grad_b = per_sentence.sum() - (slope * plain).sum() * p0 / len(sample)
        grad = np.append(grad_w, grad_b)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], min(FIRST_BIAS, bias - move[-1])
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(bias))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, predicted and offending."""
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted", "offending")]
    lean = docs.select(*own)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*lean.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    at = own.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.score(t) for t in batch.column(at).to_pylist()]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s for s, _ in found], pa.float64()), pa.array(spans, arrow_span)],
                names=[*own, "score", "offending"],
            )

    return lean.mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = fit(training_sample(docs, table(spark, sf_dir, "labels")))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("offending").cast("bigint").alias("n_offending"))
