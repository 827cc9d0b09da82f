"""Fields of drifting files (O-1) and streams with bad lines (O-8, O-57)."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gradewell.sources import readers
from gradewell.streaming import quarantine

KIND = "id bigint, text string"


def put(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("".join(x + "\n" for x in lines))


def problems(spark, path, required=(), by="file"):
    found = readers.schema_problems(readers.json_fields(spark, path, by), required).collect()
    return sorted((r.unit.rsplit("/", 1)[1], r.problem, r.field or "", r.found or "", r.wanted or "", r.n) for r in found)


def test_missing_and_conflicting_fields_by_file(spark, tmp_dir):
    put(tmp_dir, "a.json", '{"id": 1, "x": 1.5, "o": {"p": 1}}', '{"id": 2, "x": 3, "o": null}', "", "  ")
    put(tmp_dir, "b.json", '{"id": "3", "x": 2}', "[1]", "{broken", '{"o": [1], "x": null}')
    got = problems(spark, tmp_dir, ["id", "y"])
    assert ("b.json", "conflict", "id", "string", "bigint", 1) in got
    assert ("a.json", "conflict", "o", "object", "array", 1) in got  # as frequent: the first by name is wanted
    assert ("b.json", "malformed", "", "", "", 2) in got
    assert {("a.json", "missing", "y", "", "", 2), ("b.json", "missing", "y", "", "", 2), ("b.json", "missing", "id", "", "", 1)} <= set(got)
    assert not any(p[2] == "x" for p in got)  # whole numbers, fractions and nulls go together
    assert len(got) == 6


def test_folders_no_problem_and_the_error(spark, tmp_dir):
    put(f"{tmp_dir}/one", "a.json", '{"id": 1, "t": "x"}')
    put(f"{tmp_dir}/two", "a.json", '{"id": 2, "t": null}')
    path = f"{tmp_dir}/*"
    assert problems(spark, path, ["id", "t"], by="folder") == []
    readers.check_examples(spark, path, ["id", "t"])
    with pytest.raises(ValueError, match=r"one: missing u \(1 lines\); .*two: missing u"):
        readers.check_examples(spark, path, ["u"], by="folder")
    for i in range(25):
        put(f"{tmp_dir}/two", f"x{i}.json", "{")
    with pytest.raises(ValueError, match="25 in all"):
        readers.check_examples(spark, path, ["id"])


def run(spark, tmp_dir, **options):
    options.setdefault("files_per_batch", 1)
    quarantine.stream_quarantine(
        spark, f"{tmp_dir}/in", KIND, f"{tmp_dir}/good", f"{tmp_dir}/bad", f"{tmp_dir}/state", available_now=True, **options
    ).awaitTermination()


def read(spark, tmp_dir):
    good, bad = quarantine.read_quarantine(spark, f"{tmp_dir}/good", f"{tmp_dir}/bad", KIND)
    return sorted((r.id or 0, r.text or "") for r in good.collect()), sorted(r.line for r in bad.collect())


def test_good_rows_and_bad_lines_over_restarts(spark, tmp_dir):
    put(f"{tmp_dir}/in", "1.json", '{"id": 1, "text": "a"}', "{", "", '{"id": "x"}')
    run(spark, tmp_dir)
    put(f"{tmp_dir}/in", "2.json", '{"id": 2, "text": "b", "more": 1}', "no json", '{"id": 2, "text": "b", "more": 1}')
    run(spark, tmp_dir)
    run(spark, tmp_dir)
    assert read(spark, tmp_dir) == ([(1, "a"), (2, "b"), (2, "b")], ['no json', "{", '{"id": "x"}'])


def test_a_batch_that_fails_between_the_sinks_counts_once(spark, tmp_dir, monkeypatch):
    put(f"{tmp_dir}/in", "1.json", '{"id": 1, "text": "a"}', "{")
    run(spark, tmp_dir)
    put(f"{tmp_dir}/in", "2.json", '{"id": 2, "text": "b"}', "[")
    folder = quarantine._folder

    def failing(sink, number):
        if sink.endswith("bad") and number == 1:
            raise RuntimeError("lost between the sinks")
        return folder(sink, number)

    monkeypatch.setattr(quarantine, "_folder", failing)
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_dir)
    monkeypatch.setattr(quarantine, "_folder", folder)
    assert os.path.isdir(folder(f"{tmp_dir}/good", 1))
    assert read(spark, tmp_dir) == ([(1, "a")], ["{"])  # the half batch does not count
    run(spark, tmp_dir)
    assert read(spark, tmp_dir) == ([(1, "a"), (2, "b")], ["[", "{"])


def test_a_batch_written_whole_is_not_written_again(spark, tmp_dir):
    put(f"{tmp_dir}/in", "1.json", '{"id": 1, "text": "a"}', "{")
    run(spark, tmp_dir)
    commit = f"{tmp_dir}/state/commits"
    for name in os.listdir(commit):
        os.remove(f"{commit}/{name}")
    run(spark, tmp_dir, transform=lambda rows: rows.withColumn("text", F.lit("again")))
    assert read(spark, tmp_dir) == ([(1, "a")], ["{"])


def test_nothing_yet_and_a_foreign_checkpoint(spark, tmp_dir):
    assert read(spark, tmp_dir) == ([], [])
    put(f"{tmp_dir}/in", "1.json", "{")
    run(spark, tmp_dir)
    with pytest.raises(ValueError, match="another checkpoint"):
        quarantine.stream_quarantine(spark, f"{tmp_dir}/in", KIND, f"{tmp_dir}/good", f"{tmp_dir}/bad", f"{tmp_dir}/fresh")
