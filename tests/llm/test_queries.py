"""The registered queries: SQL where there is any, contracts, and the pipeline."""

from __future__ import annotations

from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plinth.llm import queries
from plinth.llm.common import materialize, shared_dir, table

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels pages embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple(str(x) if not isinstance(x, float) else repr(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    own = sorted(key(r[c] for c in columns) for r in df.collect())
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert own == sorted(key(r[i] for i in at) for r in rel.fetchall())


COLUMNS = {
    "op1": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.mark.parametrize("op", COLUMNS)
def test_contract(spark, op):
    name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS[op].items() <= dict(df.dtypes).items()
    source = "pages" if op == "op10" else "documents"
    assert df.count() == table(spark, SF, source).count()


NATIVE = ("op2", "op3", "op5", "op7", "op9", "op10")


@pytest.mark.parametrize("op", NATIVE)
def test_native_plans_hold_no_python(spark, op):
    name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, docs, SF), f"test-{name}")
        assert kept.select("doc_id").distinct().count() == kept.count()
        assert kept.join(docs, "doc_id", "left_anti").count() == 0
        if name != "mixing":
            assert kept.columns == columns
        if name not in ("line_dedup", "mixing"):
            assert kept.exceptAll(docs).count() == 0
        docs = kept
    assert docs.filter("taken <= 0 or taken > 3 * size").count() == 0


def test_pipeline_keeps_clean_documents_and_one_of_each_group(spark, tmp_path, vocabulary):
    import random

    rnd = random.Random(11)
    fresh = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    item, base = fresh(30), fresh(120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, fresh(60), "en", "a", 1) for i in range(40)]
    rows += [(100, base, "en", "a", 1), (101, " ".join(near), "en", "a", 1), (102, base, "en", "b", 1), (103, fresh(20) + " " + item.upper() + " " + fresh(9), "en", "b", 1), (104, None, "en", None, 0), (105, "", None, "b", 0)]
    rows += [(200 + i, fresh(20) + " grobbish " + fresh(5), "en", "c", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d >= 200)) for d, *_ in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, str(tmp_path)), f"test-{name}")
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(range(40)) | {100, 104, 105}
    taken = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("taken")).first()[0]
    assert abs(taken - (40 * 60 + 120)) <= 2


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_dir_is_the_sessions():
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))

    assert shared_dir(session(**{"spark.checkpoint.dir": "hdfs:///shared/", "spark.master": "yarn"})) == "hdfs:///shared"
    for master in ("yarn", "local-cluster[2,1,512]", "spark://x:7077"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_dir(session(**{"spark.master": master}))
    assert shared_dir(session(**{"spark.master": "local[4]"}))
