"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
what it returns is written as Parquet in the shared folder and read again as the
next one's docs. All but the last return the columns of documents.

Documents without text or without a doc_id pass every filtering stage unless it
finds something in them; rows that are equal throughout are one document after the
third stage; the mix, which counts words, takes no document without words. Empty
tables give an empty result, and without labels or benchmark items their stages
keep everything. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import discard, materialize, scratch, table
from plinth.llm.decontaminate import decontaminate
from plinth.llm.jaccard import link_components, node
from plinth.llm.line_dedup import dedup_lines
from plinth.llm.mixing import mix, schedule
from plinth.llm.toxicity import fit, score_documents, training_sample

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labels table, does not reject."""
    model = fit(training_sample(docs, table(spark, sf_dir, "labels")))
    return score_documents(docs, model).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated three-line windows; those left without text by it go."""
    deduped = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.btrim(F.col("text"), F.lit(" \t\r\n")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return deduped.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, the one with the smallest doc_id.

    Documents without words, which link with nothing, stay; of rows with one doc_id
    that are kept, one of each text stays.
    """
    linked = link_components(docs)
    gone = linked.filter("component <> key and n_shingles > 0").select("key").distinct()
    kept = docs.join(gone, node(docs) == gone["key"], "left_anti").select(*COLUMNS)
    if linked.groupBy("key").count().filter("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of the benchmark's items."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(F.size("items") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in its order, with how many of their words it takes, repeats counted."""
    return schedule(mix(docs, COLUMNS)).drop("finish")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Fitted weights, approximate candidates and components are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's tables are deleted when its result is written, that one with the next."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(after)
        if docs is not before:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
