"""The disk of q_track_rewards: arriving files compressed, short and whole; shuffle files removed."""

import glob
import os
import time

from pyspark.sql import functions as F

from gradewell.plans import catalog
from gradewell.plans import fixtures as X
from gradewell.session import SHUFFLE_CLEANUP


def small_tables(spark, folder):
    words = [f"w{i * i % 97}x{i}" for i in range(40)]
    tables = {
        "lineitem": spark.createDataFrame(
            [(k // 4, k % 50, k % 7, k % 4 + 1, k / 2) for k in range(600)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double",
        ),
        "orders": spark.createDataFrame([(k,) for k in range(150)], "o_orderkey long"),
        "documents": spark.createDataFrame([(i, f"{w} rose. More.") for i, w in enumerate(words)], "doc_id long, text string"),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_arriving_files_are_compressed_and_short(spark, tmp_dir, monkeypatch):
    small_tables(spark, tmp_dir)
    monkeypatch.setattr(catalog, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(catalog, "shared_path", lambda _, name: f"{tmp_dir}/{name}")
    result = catalog.q_track_rewards(spark, tmp_dir).collect()

    files = glob.glob(f"{tmp_dir}/track-source/part-*")
    lines = spark.read.text(f"{tmp_dir}/track-source").groupBy(F.input_file_name()).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("size")
    ).collect()
    assert len(lines) == len(files) >= 4 and max(r.n for r in lines) <= 100
    assert sum(map(os.path.getsize, files)) * 4 < sum(r.size for r in lines)

    expected = X.timed_completions(spark, tmp_dir).drop("scored_at")
    arrived = spark.read.schema(expected.schema).json(f"{tmp_dir}/track-source")
    assert arrived.exceptAll(expected).isEmpty() and expected.exceptAll(arrived).isEmpty()
    assert sum(r.n for r in result) == 600 and {(r.l_linenumber, r.seen, r.late) for r in result} == {(k, 150, 0) for k in (1, 2, 3, 4)}


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffle_files_go_with_the_batches(spark, tmp_dir):
    small_tables(spark, tmp_dir)
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    result = catalog.q_track_rewards(spark, tmp_dir)
    until = time.time() + 20  # files go a little later
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert sum(r.n for r in result.collect()) == 600
