"""Stores that are missing, broken, rewritten, or folders of files."""

import pytest
from pyspark.sql import functions as F

from utxolens.plans import catalog
from utxolens.sources.storage import read_if_present
from utxolens.streaming.incremental import stored_table

SMALL = "/root/testdata/sf0.001"


def test_only_a_missing_path_counts_as_no_rows(spark, tmp_path):
    assert read_if_present(spark, f"{tmp_path}/none") is None
    assert stored_table(spark, f"{tmp_path}/none", "id long").count() == 0
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):
        read_if_present(spark, f"{tmp_path}/broken").count()
    (tmp_path / "broken" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        stored_table(spark, f"{tmp_path}/broken", "id long").count()


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    folder = str(tmp_path)
    whole = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    whole.write.parquet(f"{folder}/lineitem.parquet")
    every = catalog.stored_outputs(spark, folder).count()
    assert every == catalog.stored_outputs(spark, folder).count()
    half = whole.filter(F.col("l_orderkey") < 500)
    half.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    assert 0 < catalog.stored_outputs(spark, folder).count() < every


@pytest.mark.parametrize("name", ["stream_ada_rewards_by_type", "stream_messages", "stream_token_supply"])
def test_streams_read_folders_and_empty_tables(spark, tmp_path, name):
    for table in ("events", "lineitem"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").repartition(3).write.parquet(
            f"{tmp_path}/folder/{table}.parquet"
        )
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(
            f"{tmp_path}/empty/{table}.parquet"
        )
    run = catalog.DATASETS[name]
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(run(spark, f"{tmp_path}/folder"))
    assert got and len(got) == run(spark, SMALL).count()
    assert run(spark, f"{tmp_path}/empty").count() == 0
