"""One ordered file written by many tasks equals the file of one task."""

import os

import pytest
from pyspark.sql import functions as F

from gradewell.sinks import one_file
from gradewell.sinks.writers import summary_lines, write_comparison_csv, write_summary

ODD = ["", None, 'say "hi", twice', "line1\nline2", "  é 日本 ", "a\\b", "x" * 5000]


def comparison(spark, n=400):
    rows = [(k * 7919 % 9973, f"p{k} {ODD[k % len(ODD)]}", ODD[(k + 2) % len(ODD)], f"{k}") for k in range(n)]
    return spark.createDataFrame(rows, "id long, prompt string, base_output string, lora_output string").repartition(7)


def only_part(folder):
    (name,) = [f for f in os.listdir(folder) if f.startswith("part-")]
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def content(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture()
def no_coalescing(spark):
    """Small test parts stay apart instead of being merged by AQE."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("stretch", [50, 256 << 20])
def test_comparison_has_the_bytes_of_one_task(spark, tmp_dir, no_coalescing, monkeypatch, stretch):
    monkeypatch.setattr(one_file, "STRETCH", stretch * 20)
    monkeypatch.setattr(one_file, "CHUNK", 64)
    df = comparison(spark)
    write_comparison_csv(df.orderBy("id"), f"{tmp_dir}/task", single_file=True)
    one_file.write_comparison_file(df, f"{tmp_dir}/one.csv", ["id"])
    want = only_part(f"{tmp_dir}/task")
    assert content(f"{tmp_dir}/one.csv") == want
    assert want.count(b"prompt,base_output,lora_output\n") == 1
    assert sorted(f for f in os.listdir(tmp_dir) if not f.startswith("task")) == ["one.csv"]


def test_parts_are_many(spark, tmp_dir, no_coalescing):
    df = one_file.ordered(comparison(spark), ["id"]).select("prompt")
    df.write.text(f"{tmp_dir}/parts")
    parts = one_file._parts(spark, f"{tmp_dir}/parts")
    assert len(parts) > 1
    numbers = [int(p.rsplit("part-", 1)[1].split("-")[0]) for p, _ in parts]
    assert numbers == sorted(numbers)


def test_a_store_that_joins_by_name(spark, tmp_dir, no_coalescing):
    """The local file system's own concat stands in for a store that has one."""
    one_file.ordered(comparison(spark), ["id"]).select("lora_output").write.text(f"{tmp_dir}/parts")
    parts = one_file._parts(spark, f"{tmp_dir}/parts")
    fs, target = one_file._file_system(spark, f"{tmp_dir}/whole")
    one_file._join_by_name(fs.getRawFileSystem(), spark, b"head\n", parts, f"{tmp_dir}/parts", target)
    want = b"head\n" + b"".join(content(one_file._local(p)) for p, _ in parts)
    assert content(f"{tmp_dir}/whole") == want


def test_an_empty_comparison_is_its_header(spark, tmp_dir):
    one_file.write_comparison_file(comparison(spark).limit(0), f"{tmp_dir}/one.csv", ["id"])
    assert content(f"{tmp_dir}/one.csv") == b"prompt,base_output,lora_output\n"


def results(spark, ids):
    rows = [(i, f"img/{i}.png", "Q? é", ["a"], None if i == 3 else "a", "success") for i in ids]
    return spark.createDataFrame(
        rows, "sample_id int, image_path string, question string, ground_truth array<string>, model_answer string, processing_status string"
    ).repartition(5)


@pytest.mark.parametrize("ids", [[], [0], [*range(120), 3, None, None]])
def test_summary_has_the_bytes_of_one_task(spark, tmp_dir, no_coalescing, ids):
    df = results(spark, ids)
    one_file.write_summary_file(df, f"{tmp_dir}/one.txt", "m", "ad", "out")
    lines = summary_lines(df, "m", "ad", "out").collect()
    lines.sort(key=lambda r: (-1 if r[0] is None else r[0], r[0] is None, r[1]))
    assert content(f"{tmp_dir}/one.txt").decode() == "".join(r[1] + "\n" for r in lines)
    write_summary(df, f"{tmp_dir}/many", "m", "ad", "out")
    parts = one_file._parts(spark, f"{tmp_dir}/many")
    assert b"".join(content(one_file._local(p)) for p, _ in parts) == content(f"{tmp_dir}/one.txt")


def test_a_file_is_replaced_only_by_a_whole_one(spark, tmp_dir):
    path = f"{tmp_dir}/one.csv"
    df = comparison(spark, 20)
    one_file.write_comparison_file(df, path, ["id"])
    before = content(path)
    with pytest.raises(Exception, match="wrong here"):
        one_file.write_comparison_file(df.withColumn("prompt", F.raise_error(F.lit("wrong here")).cast("string")), path, ["id"])
    assert content(path) == before
    assert os.listdir(tmp_dir) == ["one.csv"]
    one_file.write_comparison_file(df.where("id = 0"), path, ["id"])
    assert content(path).startswith(b"prompt,base_output,lora_output\np0 ")
    assert spark.read.csv(path, header=True, multiLine=True).count() == 1


def test_a_lost_task_leaves_an_error_and_no_file(spark, tmp_dir):
    short = [(f"file:{tmp_dir}/short", 10)]
    with open(f"{tmp_dir}/short", "wb") as f:
        f.write(b"1234")
    with pytest.raises(OSError, match="4 of 10 bytes"):
        one_file._join_mounted(spark, b"", short, f"{tmp_dir}/whole")
