"""The registered corpus queries and the pipeline."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_leaks_equal_their_sql(spark):
    duck = duckdb.connect()
    for file in glob.glob(f"{SMALL}/*.parquet"):
        duck.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    result = duck.execute(entry.oracle_sql()["op5_decontamination"])
    columns = [d[0] for d in result.description]
    got = entry.queries()["op5_decontamination"](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(docs)
    return kept


def test_stages_keep_columns_and_only_drop(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == before.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        assert len(ids) >= 0.7 * before.count()
    last, packed = stages[-2], stages[-1]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in last.collect()}
    assert packed.agg({"doc_tokens": "max"}).first()[0] > 1


def test_run_equals_its_stages(spark, stages):
    ran = corpus_pipeline.run(spark, SMALL)
    columns = ["doc_id", "start", "length", "sequence_id", "offset"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(ran) == key(stages[-1])
