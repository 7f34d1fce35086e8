from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from plinth.llm.common import discard, materialize, scratch, shared_dir
from plinth.llm.jaccard import jaccard_components
from plinth.llm.suffix_dedup import dedup_substrings


def here(spark):
    """Tables of this test's names; other sessions may share the folder."""
    folder = shared_dir(spark).removeprefix("file://")
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return {x for x in names if re.match("(jaccard|cc|suffix|[abcd])-", x)}


def test_scratch_deletes_all_but_what_is_kept(spark):
    before = here(spark)
    df = spark.range(10)
    with scratch() as kept:
        materialize(df, "a")
        with scratch() as inner:
            b = materialize(df, "b")
            materialize(df, "c")
            inner.append(b)
        kept.append(b)
        d = materialize(df, "d")
        assert {x.split("-")[0] for x in here(spark) - before} == {"a", "b", "d"}
        kept.append(d)
    assert {x.split("-")[0] for x in here(spark) - before} == {"b", "d"} and b.count() + d.count() == 20
    discard(b)
    discard(d)
    assert here(spark) == before


def test_scratch_deletes_after_a_failure(spark):
    before = here(spark)
    try:
        with scratch():
            materialize(spark.range(3), "a")
            raise RuntimeError
    except RuntimeError:
        pass
    assert here(spark) == before


def test_operators_leave_only_what_their_results_read(spark, odd_docs):
    before = here(spark)
    assert jaccard_components(odd_docs).count() == odd_docs.count()
    assert {x.rsplit("-", 1)[0] for x in here(spark) - before} == {"jaccard-classes", "cc-labels"}
    before = here(spark)
    assert dedup_substrings(odd_docs).filter(F.col("n_bytes") >= 0).count() == odd_docs.count()
    assert {x.rsplit("-", 1)[0] for x in here(spark) - before} == {"suffix-ranges"}


def test_shuffle_cleanup_is_set_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    df = materialize(spark.range(100).repartition(4, "id"), "a")
    assert spark.conf.get(key) == was and df.count() == 100
    discard(df)
