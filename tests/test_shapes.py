"""Chat shapes, gapped turns, the teacher path, sinks, loaders and the reward registry."""

import os

import pytest
from pyspark.sql import functions as F

from gradewell.functions.chat import flatten_chat, render_chat
from gradewell.operators import rewards
from gradewell.operators.compare import next_turn_pairs
from gradewell.operators.normalize import to_prompt_reference
from gradewell.operators.render import format_chart
from gradewell.plans.fixtures import length_logit_predictor
from gradewell.sinks import writers
from gradewell.sources.readers import load_splits, load_splits_by_column, resolve_images

TURNS = "conv_id long, turn long, role string, text string"


def test_pairs_skip_missing_numbers(spark):
    rows = [(1, 0, "user", "a"), (1, 5, "assistant", "b"), (1, 6, "user", "c"), (1, 600, "assistant", "d"), (1, 601, "user", "e"), (2, 0, "user", "f")]
    got = next_turn_pairs(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r.conv_id, r.turn, r.prompt, r.reference) for r in got) == [(1, 0, "a", "b"), (1, 6, "c", "d")]


@pytest.mark.parametrize("bucket", [1, 3, 256])
def test_pairs_like_brute_force(spark, bucket):
    rows = [(c, t * (1 + c % 3), "user" if (t * 7 + c) % 3 else "assistant", f"{c}-{t}") for c in range(5) for t in range(60)]
    want = []
    for c in range(5):
        own = sorted(r for r in rows if r[0] == c)
        want += [(a[0], a[1], a[3], b[3]) for a, b in zip(own, own[1:]) if a[2] == "user" and b[2] == "assistant"]
    got = next_turn_pairs(spark.createDataFrame(rows, TURNS), bucket_turns=bucket).collect()
    assert sorted((r.conv_id, r.turn, r.prompt, r.reference) for r in got) == sorted(want)


def test_long_conversations_do_not_collide(spark):
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"0-{t}") for t in range(998, 1004)]
    rows += [(1, t, "user" if t % 2 == 0 else "assistant", f"1-{t}") for t in range(4)]
    pairs = next_turn_pairs(spark.createDataFrame(rows, TURNS))
    done = pairs.select("conv_id", "turn", F.col("reference").alias("completion"))
    scored = rewards.score_verifiable(done, pairs.select("conv_id", "turn", "reference"), ["conv_id", "turn"]).collect()
    assert len(scored) == 5
    assert len({r.reward for r in scored}) <= 2 and min(r.reward for r in scored) > 1


@pytest.mark.parametrize(
    ("kind", "rows", "expected"),
    [
        ("array<struct<`from`:string,value:string>>", [("human", "hi")], "user:"),
        ("array<string>", ["one", None, "two"], "one\n\ntwo"),
        ("array<map<string,string>>", [{"role": "x", "content": " y "}, {}], "x: y\nuser:"),
        ("array<struct<role:string>>", [("a",)], "a:"),
        ("array<struct<role:string,content:array<struct<text:string>>>>", [("a", [("p",), ("q",)])], "a: p q"),
        ("array<string>", [], None),
    ],
)
def test_chat_shapes(spark, kind, rows, expected):
    df = spark.createDataFrame([(rows,)], f"messages {kind}")
    assert df.select(flatten_chat("messages", df.schema["messages"].dataType).alias("t")).first().t == expected
    to_prompt_reference(df).collect()


def test_named_fields(spark):
    df = spark.createDataFrame([([("human", "hi"), (None, "ho")],)], "c array<struct<`from`:string,value:string>>")
    assert df.select(flatten_chat("c", df.schema["c"].dataType, "from", "value").alias("t")).first().t == "human: hi\nuser: ho"


def test_render_typed_parts(spark):
    df = spark.createDataFrame([("a.png", "how many?", ["three"])], "image string, query string, label array<string>")
    rows = format_chart(df)
    text = rows.select(render_chat("messages", msgs_type=rows.schema["messages"].dataType).alias("t")).first().t
    assert "<|im_start|>user\nhow many?<|im_end|>" in text and text.endswith("assistant\nthree<|im_end|>\n")


def test_chat_completions_score_like_text(spark):
    rows = [(1, "Final answer: 42"), (2, "no"), (3, None)]
    refs = spark.createDataFrame([(1, "#### 42"), (2, "x")], "id long, reference string")
    plain = spark.createDataFrame(rows, "id long, completion string")
    chat = plain.select("id", F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content"))).alias("completion"))
    one, two = ({r.id: r.reward for r in rewards.score_verifiable(x, refs, "id").collect()} for x in (plain, chat))
    assert one == two and one[1] > one[2]


def test_teacher_gives_blank_and_null_a_third(spark):
    df = spark.createDataFrame([(1, "some news"), (2, ""), (3, None), (4, "some news"), (5, "x" * 5000)], "id long, text string")
    seen = rewards.score_teacher(df, "text", length_logit_predictor)
    assert seen.count() == 2
    got = {r.id: r.probs for r in rewards.with_teacher(df, "text", seen).collect()}
    assert got[2] == got[3] == [1 / 3] * 3 and got[1] == got[4]
    n = 5000  # the whole text is scored unless a window is asked for
    cut = {r.id: r.probs for r in rewards.with_teacher(df, "text", rewards.score_teacher(df, "text", length_logit_predictor, max_chars=1024)).collect()}
    assert (got[5] == cut[5]) == ([n % m for m in (7, 5, 3)] == [1024 % m for m in (7, 5, 3)])


def test_reward_by_news(spark):
    prefix = "Classify the sentiment of this financial news: "
    from gradewell import constants as K

    body = "<REASONING>Revenue growth; thus up.</REASONING>\n<SENTIMENT>{}</SENTIMENT>\n<CONFIDENCE>0.5</CONFIDENCE>"
    rows = [(1, prefix + K.NEWS_PREFIX + " good news", body.format("positive")), (1, prefix + K.NEWS_PREFIX + " good news", "no tags"), (2, None, body.format("negative"))]
    df = spark.createDataFrame(rows, "prompt_id long, prompt string, completion string")
    got = [(r.prompt_id, r.gate, r.p_teacher, r.finance_reward) for r in rewards.finance_reward_by_news(df, length_logit_predictor).collect()]
    assert len(got) == 3
    assert [p for i, g, p, _ in got if i == 2] == [pytest.approx(1 / 3)]
    assert [r for i, g, _, r in got if g == 0.0] == [0.0]


def test_named_rewards(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    both = [rewards.NamedReward("x", lambda d: F.col("a"), 0.5), rewards.NamedReward("y", lambda d: F.col("b") + F.col("a"))]
    row = rewards.apply_rewards(df, both).first()
    assert (row.x, row.y, row.total_reward) == (1.0, 3.0, 3.5)
    with pytest.raises(ValueError, match="must differ"):
        rewards.apply_rewards(df, both[:1] * 2)


RESULTS = "sample_id long, dataset_index long, image_path string, original_image_url string, question string, ground_truth string, model_answer string, processing_status string"


def test_summary_keeps_samples_with_nulls(spark):
    df = spark.createDataFrame([(0, 0, "p", None, None, None, None, None), (1, 1, None, None, "q", "t", "a", "success")], RESULTS)
    lines = [r.value for r in writers.summary_lines(df, "m", "a", "o").orderBy("_gw_order").collect()]
    assert len(lines) == 3 and "samples processed: 2" in lines[0]
    assert "SAMPLE 01" in lines[1] and "Question: None" in lines[1] and "Image: None" in lines[2]


def test_results_without_a_field_fail(spark, tmp_dir):
    df = spark.createDataFrame([(0, 0, "p", None, "q", "t", "a", "success")], RESULTS)
    writers.write_results_json(df, os.path.join(tmp_dir, "all"))
    assert spark.read.json(os.path.join(tmp_dir, "all")).columns == sorted(writers.RESULT_FIELDS)
    with pytest.raises(ValueError, match="original_image_url"):
        writers.write_results_json(df.drop("original_image_url"), os.path.join(tmp_dir, "some"))


def _rows(spark, path, tag):
    spark.createDataFrame([(f"{tag} question", f"{tag} answer")], "question string, answer string").write.parquet(path)


def test_load_unsplit_config_and_named_split(spark, tmp_dir):
    flat, configs = os.path.join(tmp_dir, "flat"), os.path.join(tmp_dir, "configs")
    _rows(spark, flat, "flat")
    train, held, name, held_name = load_splits(spark, flat)
    assert (train.first().prompt, held, name, held_name) == ("flat question", None, "train", None)
    for config in ("a", "b"):
        for split in ("train", "test", "more"):
            _rows(spark, os.path.join(configs, config, split), f"{config} {split}")
    assert load_splits(spark, configs)[0].first().prompt == "a train question"
    train, held, name, held_name = load_splits(spark, configs, config="b", split="more")
    assert (train.first().prompt, held.first().prompt, name, held_name) == ("b more question", "b test question", "more", "test")
    assert load_splits(spark, configs, config="b", split="test")[3] is None
    for bad in ({"split": "nope"}, {"config": "nope"}):
        with pytest.raises(RuntimeError):
            load_splits(spark, configs, **bad)
    with pytest.raises(RuntimeError):
        load_splits(spark, flat, split="train")


def test_split_column_is_bounded(spark, tmp_dir):
    spark.range(2000).withColumnRenamed("id", "split").write.parquet(os.path.join(tmp_dir, "many"))
    with pytest.raises(RuntimeError, match="values"):
        load_splits_by_column(spark, os.path.join(tmp_dir, "many"))


def test_images_resolve_by_path_alone(spark):
    files = spark.createDataFrame([("file:/d/a.png", bytearray(b"A")), ("/d/b.png", bytearray(b"B"))], "path string, content binary")
    rows = [(1, "/d/a.png", None), (2, "file:///d/b.png", None), (3, "/d/c.png", None), (4, "/d/c.png", bytearray(b"own")), (5, None, None)]
    samples = spark.createDataFrame(rows, "id long, image_path string, raw binary")
    found, skipped = resolve_images(samples, files, image_bytes="raw")
    assert {r.id: bytes(r.image) for r in found.collect()} == {1: b"A", 2: b"B", 4: b"own"}
    assert sorted(r.id for r in skipped.collect()) == [3, 5]
    assert "content" not in skipped._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
