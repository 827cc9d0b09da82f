"""Normalising (O-10..O-14) and rendering (O-2, O-3, O-15..O-19)."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell import constants as K
from gradewell.functions.chat import completion_text, flatten_chat, render_chat
from gradewell.operators import normalize, render

MSG = "array<struct<role:string,content:string>>"


def test_prompt_precedence(spark):
    schema = f"id int, prompt string, question string, instruction string, input string, context string, messages {MSG}, answer string, reference string"
    rows = [
        (0, "p", "q", None, None, None, None, "a", None),
        (1, "", "q", None, None, None, None, None, ""),
        (2, None, None, "", None, None, [("system", " s "), (None, "hi")], None, None),
        (3, "   ", None, None, None, None, None, None, None),
        (4, None, None, None, None, None, [], None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    out = {r.id: r for r in normalize.to_prompt_reference(df, keep=["id"]).collect()}
    assert out[0].prompt == "p" and out[0].reference == "a"
    assert out[1].prompt == "q" and out[1].reference == ""
    assert out[2].prompt == "system: s\nuser: hi"
    assert out[3].prompt == "   "
    whole = json.loads(out[4].prompt)
    assert whole["id"] == 4 and whole["messages"] == [] and "prompt" in whole and whole["prompt"] is None
    assert out[4].reference is None


def test_combined_fields_when_asked(spark):
    df = spark.createDataFrame([("do it", "data", None, None)], "instruction string, input string, context string, question string")
    assert normalize.to_prompt_reference(df).first().prompt == "do it"
    combined = normalize.to_prompt_reference(df, combine=True).first().prompt
    assert combined == "do it" + K.INSTRUCTION_INPUT_SEPARATOR + "data"


def test_flatten_chat_with_parts(spark):
    schema = "m array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    df = spark.createDataFrame([([("user", [("text", "a"), ("image", None), ("text", "b")])],), ([],)], schema)
    got = [r[0] for r in df.select(flatten_chat("m", df.schema["m"].dataType)).collect()]
    assert got == ["user: a  b", None]


def test_completion_text_shapes(spark):
    df = spark.createDataFrame([([("assistant", "x"), ("user", "y")], ("c", None), "s")],
                               f"chat {MSG}, st struct<content:string,text:string>, s string")
    row = df.select(
        completion_text("chat", df.schema["chat"].dataType).alias("a"),
        completion_text("st", df.schema["st"].dataType).alias("b"),
        completion_text("s", df.schema["s"].dataType).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ("x\ny", "c", "s")


def test_render_chat_array(spark):
    df = spark.createDataFrame([([("user", "hi")],)], f"m {MSG}")
    got = df.select(render_chat("m", add_generation_prompt=True)).first()[0]
    assert got == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"


def test_label_sentences_mapping(spark):
    df = spark.createDataFrame([(0, "a", 0), (1, "b", 1), (2, "c", 2), (3, "d", None), (4, "e", 7)], "id int, sentence string, label int")
    out = {r.id: r for r in render.label_sentences(df, keep=["id"]).collect()}
    assert [out[i].sentiment for i in range(5)] == ["negative", "neutral", "positive", "positive", "positive"]
    assert out[1].confidence == 0.6 and out[0].confidence == 0.75
    assert all(r.source == "phrasebank" for r in out.values())
    capped = render.label_sentences(df, keep=["id"], max_n=2, order_by=["id"]).collect()
    assert [r.id for r in capped] == [0, 1]


def test_assemble_modes(spark):
    real = render.label_sentences(spark.createDataFrame([(0, "a", 0)], "id int, sentence string, label int"), keep=["id"])
    assert render.assemble_examples(spark, real, "mixed").count() == 4
    assert render.assemble_examples(spark, real, "real").count() == 1
    assert render.assemble_examples(spark, real, "synthetic").count() == 3
    empty = real.limit(0)
    assert render.assemble_examples(spark, empty, "real").count() == 3
    synth = render.assemble_examples(spark, None, "synthetic").collect()
    assert all(r.source is None for r in synth)


def test_format_sft_text(spark):
    df = spark.createDataFrame([("news", "why", "positive", 0.75)], "text string, reasoning string, sentiment string, confidence double")
    row = render.format_sft(df).first()
    assistant = "<REASONING>why</REASONING>\n<SENTIMENT>positive</SENTIMENT>\n<CONFIDENCE>0.75</CONFIDENCE>"
    assert row.text.endswith("<|im_start|>assistant\n" + assistant + "<|im_end|>\n")
    assert K.NEWS_PREFIX + "news" in row.text
    assert row.token_len == max(1, len(row.text) // 4)


def test_format_rl_keeps_gold(spark):
    df = spark.createDataFrame([("news",)], "text string")
    row = render.format_rl(df).first()
    assert row.gold_text == "news" and row.prompt.endswith("<|im_start|>assistant\n")


def test_format_chart_answers(spark):
    df = spark.createDataFrame(
        [("i1", "q1", ["a", "b"]), ("i2", "q2", [])], "image string, query string, label array<string>"
    )
    rows = render.format_chart(df).collect()
    assert rows[0].images == ["i1"]
    assert rows[0].messages[2].content[0].text == "a"
    assert rows[1].messages[2].content[0].text is None
    assert rows[0].messages[1].content[0].image == "i1" and rows[0].messages[1].content[1].text == "q1"
    s = spark.createDataFrame([("i", "q", "yes")], "image string, query string, label string")
    assert render.format_chart(s).first().messages[2].content[0].text == "yes"


def test_flatten_turns_matches_array_form(spark):
    from gradewell.plans import fixtures as X
    from conftest import SF_SMALL

    turns = X.table(spark, SF_SMALL, "conversations")
    chats = X.chat_rows(spark, SF_SMALL)
    array_form = {r.conv_id: r.p for r in chats.select("conv_id", flatten_chat("messages", chats.schema["messages"].dataType).alias("p")).collect()}
    for bucket in (1, 3, 256):
        table_form = {r.conv_id: r.prompt for r in normalize.flatten_turns(turns, bucket_turns=bucket).collect()}
        assert table_form == array_form


def test_preview_rows_first_five(spark):
    from gradewell.operators.compare import preview_rows

    df = spark.createDataFrame([(i, "b" * 200, "l") for i in range(9)], "k int, base_output string, lora_output string")
    rows = preview_rows(df, "k").collect()
    assert [r.k for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0].base_output_preview == "b" * 160 + "…" and rows[0].lora_output_preview == "l"


def test_non_list_chat_field_is_skipped(spark):
    df = spark.createDataFrame([("{\"role\": \"user\"}", "ctx")], "messages string, context string")
    assert normalize.to_prompt_reference(df).first().prompt == "ctx"


def test_completion_text_from_map(spark):
    df = spark.createDataFrame([({"text": "t"},), ({"content": "c", "text": "t"},), ({},)], "m map<string,string>")
    got = [r[0] for r in df.select(completion_text("m", df.schema["m"].dataType)).collect()]
    assert got == ["t", "c", ""]
