"""Golden rows FIXTURES D2, D3, D6 and reward properties."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.numeric import parse_python_float, softmax
from gradewell.functions.text import extract_tagged
from gradewell.operators import rewards
from gradewell.plans import fixtures as X

from conftest import SF_SMALL

SFT_EXAMPLE = (
    "Revenue growth is strong but margins compressed due to higher input costs; guidance is cautious, "
    "suggesting near-term volatility. Therefore, outlook is balanced with upside from new products."
)
D2 = [
    (K.SYNTHETIC_EXAMPLES[0][1], "positive", "0.75", 0.55, 0.5, 0.8, 0.585, 0.9975, 1.0, 0.74075),
    (K.SYNTHETIC_EXAMPLES[1][1], "negative", "0.80", 0.433333, 0.5, 0.0, 0.366667, 0.51, 0.0, 0.228667),
    (K.SYNTHETIC_EXAMPLES[2][1], "neutral", "0.65", 0.0, 0.7, 0.0, 0.21, 0.7975, 0.0, 0.282),
    (SFT_EXAMPLE, "neutral", "0.72", 0.70, 1.0, 0.6, 0.77, 0.7296, 0.0, 0.40842),
]


def _tagged(r, s, c):
    return f"<REASONING>{r}</REASONING>\n<SENTIMENT>{s}</SENTIMENT>\n<CONFIDENCE>{c}</CONFIDENCE>"


def _teacher(spark, probs=(0.1, 0.2, 0.7)):
    logits = [math.log(p) for p in probs]
    return rewards.teacher_probabilities(
        spark.createDataFrame([(1, "news", logits)], "prompt_id long, text string, logits array<double>"), "prompt_id"
    )


def test_finance_golden_rows(spark):
    rows = [(i, 1, _tagged(r, s, c)) for i, (r, s, c, *_rest) in enumerate(D2)]
    gens = spark.createDataFrame(rows, "gen_id int, prompt_id long, completion string")
    out = rewards.finance_reward(gens, _teacher(spark), "prompt_id").orderBy("gen_id").collect()
    for got, (_r, _s, _c, q, lg, ctx, b, cal, d, total) in zip(out, D2):
        assert got.gate == 1.0
        assert got.quality == pytest.approx(q, abs=1e-6)
        assert got.logic == pytest.approx(lg, abs=1e-6)
        assert got.context == pytest.approx(ctx, abs=1e-6)
        assert got.bundle == pytest.approx(b, abs=1e-6)
        assert got.calibration == pytest.approx(cal, abs=1e-6)
        assert got.direction == d
        assert got.finance_reward == pytest.approx(total, abs=1e-6)


D3 = [
    (_tagged("r", "positive", "0.5"), 1.0),
    ("<REASONING>r\n<SENTIMENT>positive</SENTIMENT>\n<CONFIDENCE>0.5</CONFIDENCE>", 0.0),
    ("<REASONING><REASONING>r</REASONING>" + "<SENTIMENT>p</SENTIMENT><CONFIDENCE>1</CONFIDENCE>", 0.0),
    ("<reasoning>r</reasoning><sentiment>p</sentiment><confidence>1</confidence>", 0.0),
    ("</REASONING> x <REASONING><SENTIMENT>p</SENTIMENT><CONFIDENCE>1</CONFIDENCE>", 1.0),
    ("<CONFIDENCE>1</CONFIDENCE><SENTIMENT>p</SENTIMENT><REASONING>r</REASONING>", 1.0),
]


def test_format_gate_golden(spark):
    df = spark.createDataFrame(D3, "c string, expected double")
    for r in df.select("expected", rewards.format_gate("c").alias("got")).collect():
        assert r.got == r.expected


def test_extraction_case_insensitive_and_reversed_tags(spark):
    df = spark.createDataFrame(
        [("<reasoning> Up </reasoning><SENTIMENT> POSITIVE </SENTIMENT>",), ("</REASONING> x <REASONING>",)], "completion string"
    )
    out = rewards.extract_components(df).collect()
    assert (out[0].reasoning, out[0].sentiment) == ("Up", "positive")
    assert out[1].reasoning == ""


@pytest.mark.parametrize(
    "text,value",
    [("abc", 0.0), ("", 0.0), ("0.8%", 0.0), ("7", 7.0), ("1.0d", 0.0), ("0x1p3", 0.0), ("+1e-1", 0.1),
     (" 0.9 ", 0.9), ("5.", 5.0), (".5", 0.5), ("inf", math.inf), ("-Infinity", -math.inf), ("1_0", 0.0)],
)
def test_confidence_parsing(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(parse_python_float("t")).first()[0]
    assert got == value


@pytest.mark.parametrize("text", ["nan", "-nan", "+NaN"])
def test_confidence_nan_gives_zero_calibration(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(parse_python_float("t").alias("c"))
    row = df.select("c", rewards.calibration(F.lit(0.7), F.col("c")).alias("cal")).first()
    assert math.isnan(row.c) and row.cal == 0.0


def test_softmax_golden(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    got = df.select(softmax("x")).first()[0]
    assert got == pytest.approx([0.0900306, 0.2447285, 0.6652410], abs=1e-7)
    blank = spark.createDataFrame([(1, "", [5.0, 0.0, 0.0])], "prompt_id long, text string, logits array<double>")
    probs = rewards.teacher_probabilities(blank, "prompt_id").first().probs
    assert probs == pytest.approx([1 / 3, 1 / 3, 1 / 3])


def test_unknown_sentiment_aligns_to_zero(spark):
    gens = spark.createDataFrame([(1, _tagged("up", "bullish", "0.9"))], "prompt_id long, completion string")
    row = rewards.finance_reward(gens, _teacher(spark), "prompt_id").first()
    assert row.p_teacher == 0.0 and row.direction == 0.0


def test_finance_reward_properties(spark):
    gens = X.finance_completions(spark, SF_SMALL)
    teacher = rewards.teacher_probabilities(X.teacher_table(spark, SF_SMALL), "prompt_id")
    scored = rewards.finance_reward(gens, teacher, "prompt_id")
    stats = scored.agg(
        F.min("finance_reward"), F.max("finance_reward"),
        F.max(F.when(F.col("gate") == 0, F.abs("finance_reward"))), F.count(F.lit(1)),
    ).first()
    assert stats[0] >= 0.0 and stats[1] <= 0.95 + 1e-12
    assert stats[2] in (None, 0.0)
    assert stats[3] == gens.count()


def test_verifiable_reward_range(spark):
    comps, refs = X.verifiable_inputs(spark, SF_SMALL)
    scored = rewards.score_verifiable(comps, refs, ["conv_id", "turn"])
    lo, hi, n = scored.agg(F.min("reward"), F.max("reward"), F.count(F.lit(1))).first()
    assert -0.5 - 1e-12 <= lo and hi <= 2.0 + 1e-12
    assert n == comps.count()


def test_score_teacher_predicts_each_distinct_text_once(spark):
    texts = spark.createDataFrame([("good",), ("good",), ("bad news " * 300,), ("",), (None,)], "news string")

    def factory():
        def predict(batch):
            # deterministic toy model: length-based logits
            return [[0.1, 0.2, 0.7] if len(t) <= 1024 else [0.7, 0.2, 0.1] for t in batch]

        return predict

    long_text = "bad news " * 300
    seen = rewards.score_teacher(texts, "news", factory)
    assert seen.count() == 2  # good and long
    out = [(r.news, r.probs) for r in rewards.with_teacher(texts, "news", seen).collect()]
    assert len(out) == 5
    got = dict(out)
    assert got["good"][2] == pytest.approx(0.7)
    assert got[long_text][0] == pytest.approx(0.7)  # the whole text is read
    assert got[""][1] == pytest.approx(1 / 3) and got[None][1] == pytest.approx(1 / 3)
    window = rewards.score_teacher(texts, "news", factory, max_chars=1024)
    assert dict((r.news, r.probs) for r in rewards.with_teacher(texts, "news", window).collect())[long_text][0] == pytest.approx(0.1)


def test_extraction_folds_like_python_re(spark):
    import re

    texts = ["<REAſONING>x</reasonıng>", "<REASONİNG>y</REASONING>", "<reasoning>z</REASONING>", "<REASONING>w"]
    df = spark.createDataFrame([(t,) for t in texts], "completion string")
    got = [r.reasoning for r in rewards.extract_components(df).collect()]
    expected = []
    for t in texts:
        m = re.search(r"<REASONING>(.*?)</REASONING>", t, re.I | re.S)
        expected.append(m.group(1).strip() if m else "")
    assert got == expected == ["x", "y", "z", ""]


def _logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_keys_go_through_the_join_with_the_documents(spark):
    plan = _logical(X.finance_completions(spark, SF_SMALL)).splitlines()
    joins = [line for line in plan if "Join " in line]
    assert "LeftOuter" not in joins[0] and "LeftOuter" in joins[1]  # the texts come above the documents


def test_a_term_of_several_rules_is_looked_for_once(spark):
    rows = spark.createDataFrame([("x", "positive")], "reasoning string, sentiment string").repartition(1)
    plan = _logical(rewards.score_reasoning(rows, with_direction=True))
    for term in ("growth", "profit", "long-term", "therefore", "down"):
        assert len(re.findall(rf"Contains\([^ ]*, {term}\)", plan)) == 1


def test_gate_counts_tags_of_other_alphabets_and_repeats(spark):
    once = "\u00e9<REASONING>\U0001f600</REASONING><SENTIMENT>p</SENTIMENT><CONFIDENCE>1</CONFIDENCE>\u00e9"
    rows = [(once, 1.0), (once + "<SENTIMENT>", 0.0), (once + once, 0.0), (None, 0.0), ("", 0.0), (once + "<SENTIMENT", 1.0)]
    got = spark.createDataFrame(rows, "c string, want double").select("want", rewards.format_gate("c").alias("gate")).collect()
    assert [r.gate for r in got] == [r.want for r in got]


def test_gate_and_tags_on_odd_texts(spark):
    """The gate scans a text once; what is between two tags may hold anything."""
    tags = [t for pair in K.TAG_PAIRS for t in pair]
    whole = "".join(tags)
    rows = [
        (whole, 1.0, ""),
        ("<" + "<".join(reversed(tags)) + "<", 1.0, ""),
        (whole.lower(), 0.0, ""),
        (whole + tags[0], 0.0, ""),
        (whole.replace(tags[1], ""), 0.0, ""),
        (None, 0.0, ""),
        ("", 0.0, ""),
        ("<REASONING> a<b </reasonin> <</REAſONıNG> c</REASONING>", 0.0, "a<b </reasonin> <"),
        ("</REASONING><reasoning>x\n <REASONING>y</REASONING>", 0.0, "x\n <REASONING>y"),
        ("<REASONING>" * 3 + "no end <", 0.0, ""),
    ]
    df = spark.createDataFrame(rows, "c string, gate double, reasoning string")
    gate = rewards.format_gate("c")
    for r in rewards.extract_components(df.withColumn("got", gate).withColumnRenamed("reasoning", "want"), "c").collect():
        assert (r.got, r.reasoning) == (r.gate, r.want), r.c
    assert str(gate).count("coalesce") == 1
    same = [("[", "i"), ("I", "]")]
    text = spark.createDataFrame([("x[abı I] ]",)], "c string")
    assert [text.select(extract_tagged("c", a, b)).first()[0] for a, b in same] == ["ab", "I"]
