"""Sources (O-1, O-5..O-8), sinks (O-53..O-55) and streams (O-57, O-58)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.operators import rewards
from gradewell.operators.normalize import to_prompt_reference
from gradewell.sinks.writers import write_comparison_csv, write_results_json, write_summary
from gradewell.sources.readers import (
    SFT_REQUIRED,
    image_files,
    load_splits,
    quarantine,
    read_examples,
    read_prompts,
    resolve_images,
    stream_examples,
)
from gradewell.streaming.streams import stream_normalise, stream_verifiable_rewards


def _write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_read_examples_required_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sft", "a.jsonl")
    _write_lines(path, [json.dumps({"text": "t", "reasoning": "r", "sentiment": "positive", "confidence": 0.7, "extra": 1})])
    df = read_examples(spark, path, SFT_REQUIRED)
    assert df.count() == 1 and "extra" in df.columns
    with pytest.raises(ValueError, match="no column label"):
        read_examples(spark, path, ("text", "label"))
    rl = os.path.join(tmp_dir, "rl", "b.jsonl")
    _write_lines(rl, [json.dumps({"prompt": "x"})])
    with pytest.raises(ValueError):
        read_examples(spark, rl, ("text",))


def test_quarantine_corrupt_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad", "a.jsonl")
    _write_lines(path, ['{"text": "ok"}', "{not json"])
    good, bad = quarantine(read_examples(spark, path, ("text",), schema="text string, _corrupt_record string", keep_corrupt=True))
    assert [r.text for r in good.collect()] == ["ok"]
    assert [r._corrupt_record for r in bad.collect()] == ["{not json"]


def test_load_splits(spark, tmp_dir):
    root = os.path.join(tmp_dir, "ds")
    for split, rows in {"train": [("q1", "a1")], "validation": [("q2", "a2")], "test": [("q3", "a3")]}.items():
        spark.createDataFrame(rows, "question string, answer string").write.parquet(os.path.join(root, split))
    train, ev, tname, ename = load_splits(spark, root)
    assert (tname, ename) == ("train", "validation")
    assert train.collect()[0].asDict() == {"prompt": "q1", "reference": "a1"}
    assert ev.first().prompt == "q2"
    with pytest.raises(RuntimeError):
        load_splits(spark, os.path.join(tmp_dir, "missing"))


def test_load_splits_by_partition_column(spark, tmp_dir):
    from gradewell.sources.readers import load_splits_by_column

    root = os.path.join(tmp_dir, "one")
    rows = [("q1", "a1", "train_sft"), ("q2", "a2", "test_sft"), ("q3", "a3", "train")]
    spark.createDataFrame(rows, "question string, answer string, split string").write.partitionBy("split").parquet(root)
    train, ev, tname, ename = load_splits_by_column(spark, root)
    assert (tname, ename) == ("train_sft", "test_sft")
    assert [r.prompt for r in train.collect()] == ["q1"] and [r.reference for r in ev.collect()] == ["a2"]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "train_sft" in plan


def test_labelled_sentences_load_failure_falls_back(spark, tmp_dir):
    from gradewell.operators.render import assemble_examples, label_sentences
    from gradewell.sources.readers import read_labelled_sentences

    missing = read_labelled_sentences(spark, os.path.join(tmp_dir, "nope"))
    assert missing.count() == 0
    out = assemble_examples(spark, label_sentences(missing), mode="real")
    assert out.count() == 3  # nothing loaded -> the synthetic rows


def test_read_prompts(spark, tmp_dir):
    assert [r.prompt for r in read_prompts(spark).orderBy("prompt_id").collect()] == list(K.DEFAULT_COMPARISON_PROMPTS)
    path = os.path.join(tmp_dir, "prompts.txt")
    _write_lines(path, ["  first  ", "", "   ", "second"])
    rows = read_prompts(spark, ["lit"], path).orderBy("prompt_id").collect()
    assert [(r.prompt_id, r.prompt) for r in rows] == [(0, "lit"), (1, "first"), (2, "second")]


def test_resolve_images(spark, tmp_dir):
    img_dir = os.path.join(tmp_dir, "img")
    os.makedirs(img_dir)
    with open(os.path.join(img_dir, "a.png"), "wb") as f:
        f.write(b"\x89PNG")
    samples = spark.createDataFrame(
        [(0, os.path.join(img_dir, "a.png"), None), (1, os.path.join(img_dir, "missing.png"), None), (2, "http://x/y.png", bytearray(b"raw"))],
        "idx int, image_path string, image_bytes binary",
    )
    ok, skipped = resolve_images(samples, image_files(spark, img_dir), image_bytes="image_bytes")
    assert sorted(r.idx for r in ok.collect()) == [0, 2]
    assert [r.idx for r in skipped.collect()] == [1]
    assert {r.idx: bytes(r.image) for r in ok.collect()}[0] == b"\x89PNG"


def test_comparison_csv_round_trip(spark, tmp_dir):
    rows = [("p, 1", 'say "hi"', "line1\nline2"), ("é", "", "x"), ("  outer ", "space\t", " ")]
    df = spark.createDataFrame(rows, "prompt string, base_output string, lora_output string")
    out = os.path.join(tmp_dir, "cmp")
    write_comparison_csv(df, out, single_file=True)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out)
    got = sorted(tuple("" if v is None else v for v in r) for r in back.collect())
    assert got == sorted(rows)


def test_results_json_and_summary(spark, tmp_dir):
    df = spark.createDataFrame(
        [(0, 3, "img/0.png", "img/0.png", "Q?", ["a"], "a", "success"), (1, 5, "img/1.png", "img/1.png", "Q2?", ["b"], "ERROR: boom", "error")],
        "sample_id int, dataset_index int, image_path string, original_image_url string, question string, ground_truth array<string>, model_answer string, processing_status string",
    )
    out = os.path.join(tmp_dir, "res")
    write_results_json(df, out)
    assert spark.read.json(out).count() == 2
    summ = os.path.join(tmp_dir, "summary")
    write_summary(df, summ, "m", "ad", "outdir")
    text = "".join(open(os.path.join(summ, f), encoding="utf-8").read() for f in sorted(os.listdir(summ)) if f.startswith("part"))
    assert text.startswith(K.SUMMARY_TITLE)
    assert "Total samples processed: 2" in text
    assert text.index("SAMPLE 01") < text.index("SAMPLE 02")
    assert "Ground Truth: ['a']" in text and "Status: error" in text


def test_stream_normalise_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    _write_lines(os.path.join(src, "1.json"), [json.dumps({"question": "q", "answer": "a"}), json.dumps({"prompt": "", "text": "t"})])
    schema = "prompt string, question string, text string, answer string"
    q = stream_normalise(stream_examples(spark, src, schema), os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    batch = sorted(tuple(r) for r in to_prompt_reference(spark.read.schema(schema).json(src)).collect())
    assert streamed == batch and len(streamed) == 2


def test_stream_rewards_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "comp")
    _write_lines(os.path.join(src, "1.json"), [json.dumps({"pair_id": 1, "completion": "Final answer: 42"}), json.dumps({"pair_id": 2, "completion": "x"})])
    refs = spark.createDataFrame([(1, "#### 42")], "pair_id long, reference string")
    schema = "pair_id long, completion string"
    q = stream_verifiable_rewards(stream_examples(spark, src, schema), refs, "pair_id", os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(120)
    streamed = sorted((r.pair_id, round(r.reward, 9)) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    batch = sorted((r.pair_id, round(r.reward, 9)) for r in rewards.score_verifiable(spark.read.schema(schema).json(src), refs, "pair_id").collect())
    assert streamed == batch == [(1, 1.0), (2, 0.2)]


def test_stream_chart_rows_equal_batch(spark, tmp_dir):
    from gradewell.operators.render import format_chart
    from gradewell.streaming.streams import stream_transform

    src = os.path.join(tmp_dir, "charts")
    _write_lines(os.path.join(src, "1.json"), [json.dumps({"image": "a.png", "query": "q?", "label": ["x", "y"]}), json.dumps({"image": "b.png", "query": "r?", "label": []})])
    schema = "image string, query string, label array<string>"
    q = stream_transform(stream_examples(spark, src, schema), format_chart, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(120)
    flat = lambda df: sorted((r.images[0], r.messages[2].content[0].text) for r in df.collect())
    assert flat(spark.read.parquet(os.path.join(tmp_dir, "out"))) == flat(format_chart(spark.read.schema(schema).json(src))) == [("a.png", "x"), ("b.png", None)]
