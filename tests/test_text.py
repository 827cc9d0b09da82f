"""Golden rows FIXTURES D1 and D4, and the string helpers."""

import pytest
from pyspark.sql import functions as F

from gradewell.functions.text import (
    PY_SPACE_CHARS,
    extract_answer,
    extract_number,
    normalize_text,
    preview,
    py_strip,
)
from gradewell.operators.rewards import verifiable_reward

D1 = [
    ("42", "42", 1.8),
    ("Final answer: 42", "#### 42", 1.0),
    ("  The  CAT ", "the cat", 1.2),
    ("As an AI, I cannot answer - sorry", None, 0.1),
    ("", "x", 0.2),
    ("", "", 0.2),
    ("x = 5.0", "5", 0.2),
    ("total 1,234", "1234", 0.2),
    ("range 3-5", "-5", 0.8),
    ("It is 7.", "7", 0.2),
    ("a" * 1027, None, 0.2),
    ("a" * 1028, None, 0.1),
    ("a" * 2051, None, 0.1),
    ("a" * 2052, None, -0.2),
]


def test_verifiable_reward_golden(spark):
    df = spark.createDataFrame(D1, "completion string, reference string, expected double")
    rows = df.select("expected", F.round(verifiable_reward("completion", "reference"), 9).alias("got")).collect()
    for r, (c, ref, _) in zip(rows, D1):
        assert r.got == pytest.approx(r.expected), (c[:30], ref)


def test_verifiable_reward_without_references(spark):
    df = spark.createDataFrame([("Answer: 3",)], "completion string")
    assert df.select(verifiable_reward("completion")).first()[0] == pytest.approx(0.4)


@pytest.mark.parametrize(
    "text,number",
    [("total 1,234", "234"), ("range 3-5", "-5"), ("It is 7.", None), ("#### 42", "42"),
     ("x = 5.0", "5.0"), ("12345", "12345"), ("1.2.3", "2.3"), ("", None), (None, None), ("42 \n ", "42")],
)
def test_extract_number(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extract_number("t")).first()[0] == number


D4 = [
    ("User: q\nAssistant: 42", "42"),
    ("a Assistant: b Assistant: c", "c"),
    ("line1\nline2 ", "line2"),
    ("Assistant: Yes<|im_end|>", "Yes"),
    ("the value was 42 in the year of our lord two thousand", "the value was 42 in"),
    ("a b c d e f g h i j k", "a"),
    ("a b c d e f g h i j", "a b c d e f g h i j"),
    ("", ""),
]


def test_extract_answer_golden(spark):
    df = spark.createDataFrame(D4, "raw string, expected string")
    for r in df.select("expected", extract_answer("raw").alias("got")).collect():
        assert r.got == r.expected


def test_strip_matches_python(spark):
    samples = [w + "a b" + w for w in PY_SPACE_CHARS] + ["　x\x1c", " \t\n", "plain", "\x85y "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_normalize_text(spark):
    samples = ["  The  CAT ", "a　　B\tc", None, "X\x1cY"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(normalize_text("s")).collect()]
    assert got == ["the cat", "a b c", "", "x y"]


def test_preview(spark):
    long = "x" * 150 + "\n" + "y" * 20
    df = spark.createDataFrame([(long,), ("short\ntext",), ("z" * 160,)], "s string")
    got = [r[0] for r in df.select(preview("s")).collect()]
    assert got[0] == ("x" * 150 + " " + "y" * 9) + "…"
    assert got[1] == "short text"
    assert got[2] == "z" * 160
