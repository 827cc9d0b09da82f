"""Inputs built from the driver tables (FIXTURES.md section C).

Raw driver text exercises almost no branch of the scoring rules, so these
builders derive completions, chats, teacher predictions and logs from the
given tables. Every builder reads whole tables; modulo arithmetic only
assigns shapes to rows (no row is dropped to make anything cheaper), and the
literal template tables are small fixed relations joined by broadcast.
The oracle SQL in ``oracle.py`` builds the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.chat import render_messages
from ..functions.literal import literal_table
from ..operators.compare import next_turn_pairs
from ..sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ C1 / C4

PAIR_KEY = ["conv_id", "turn"]
VARIANT_PAD = {6: 1027, 7: 1028, 8: 2051, 9: 2052}
BOILERPLATE_COMPLETION = "As an AI, I cannot verify that claim."


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1: user turn + the next assistant turn of the same conversation."""
    return next_turn_pairs(table(spark, sf_dir, "conversations"))


def verifiable_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """C4: (completions, references) keyed by (conv_id, turn).

    With ``k = conv_id * 1000 + turn``, the reference ends in ``n = k % 97``
    for even conversations and in ``n + 1`` for odd ones; it is null when
    ``k % 13 = 0``, empty when ``k % 17 = 0``, and there is no reference row
    when ``k % 19 = 0``. The completion shape is ``(conv_id * 3 + turn) % 10``.
    """
    p = pairs(spark, sf_dir)
    k = F.col("conv_id") * 1000 + F.col("turn")
    n = k % 97
    ref_num = F.when(F.col("conv_id") % 2 == 0, n).otherwise(n + 1)
    full_ref = F.concat(F.col("reference"), F.lit(" "), ref_num.cast("string"))
    base = p.select(
        *PAIR_KEY,
        ((F.col("conv_id") * 3 + F.col("turn")) % 10).cast("int").alias("variant"),
        n.alias("n"),
        full_ref.alias("full_ref"),
    )
    v = F.col("variant")
    ref = F.col("full_ref")
    completion = (
        F.when(v == 0, ref)
        .when(v == 1, F.upper(F.replace(ref, F.lit(" "), F.lit("  "))))
        .when(v == 2, F.concat(F.lit("Final answer: "), F.col("n").cast("string")))
        .when(v == 3, F.concat(F.lit("#### "), F.col("n").cast("string")))
        .when(v == 4, F.lit(BOILERPLATE_COMPLETION))
        .when(v == 5, F.lit(""))
    )
    for variant, width in VARIANT_PAD.items():
        completion = completion.when(v == variant, F.rpad(ref, width, "."))
    completions = base.select(*PAIR_KEY, "variant", completion.alias("completion"))
    references = base.filter(k % 19 != 0).select(
        *PAIR_KEY,
        F.when(k % 13 == 0, F.lit(None).cast("string")).when(k % 17 == 0, F.lit("")).otherwise(ref).alias("reference"),
    )
    return completions, references


# ------------------------------------------------------------------ C2

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


def chat_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 in the shapes of other chat datasets, a column each: ``from`` /
    ``value`` structs, plain strings, maps without a role, typed parts, and
    structs that have neither field name."""
    d = table(spark, sf_dir, "documents")
    text, lang = F.col("text"), F.col("lang")
    part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    return d.select(
        "doc_id",
        F.array(
            F.struct(F.lit("human").alias("from"), text.alias("value")),
            F.struct(F.lit(None).cast("string").alias("from"), lang.alias("value")),
        ).alias("sharegpt"),
        F.array(text, F.lit(None).cast("string"), lang).alias("strings"),
        F.array(F.create_map(F.lit("content"), text), F.create_map(F.lit("role"), lang)).alias("maps"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(part(text), part(lang)).alias("content"))).alias("typed"),
        F.array(F.struct(text.alias("body"))).alias("other"),
    )


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: one row per conversation, ``messages`` sorted by turn.

    ``collect_list`` is combined per task before the shuffle; a conversation
    is one output row by definition, so its messages are one array.
    """
    conv = table(spark, sf_dir, "conversations")
    collected = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_m")
    )
    return collected.select(
        "conv_id",
        F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias(
            "messages"
        ),
    )


def _json(value) -> "F.Column":
    """A string as a JSON string."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def mixed_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 as JSON lines (value) whose ``messages`` have eight shapes."""
    conv, shape, turn = table(spark, sf_dir, "conversations"), F.col("conv_id") % 8, F.col("turn")
    text, role = _json(F.coalesce("text", F.lit(""))), _json("role")
    message = F.concat(F.lit('{"role":'), role, F.lit(',"content":'), text, F.lit("}"))
    parts = F.concat(
        F.lit('{"content":[{"type":"text","text":'), text, F.lit('},{"type":"image"},"end"],"role":'), role, F.lit("}")
    )
    own = (
        F.when(shape == 1, parts)
        .when(shape == 2, text)
        .when(shape == 3, F.when(turn % 2 == 1, message).otherwise(text))
        .when(shape == 5, F.when(turn % 2 == 1, F.lit('{"content":null}')).otherwise(F.lit('{"role":null}')))
        .when(shape == 7, F.when(turn % 3 == 0, F.lit("true")).otherwise(turn.cast("string")))
        .otherwise(message)
    )
    lines = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", own.alias("m")))).alias("_m"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("_m", lambda m: m["m"]), ","), F.lit("]"))
    msgs = F.when(shape == 4, F.lit('"no list"')).when(shape == 6, F.lit("[]")).otherwise(listed)
    return lines.select(F.concat(F.lit('{"conv_id":'), F.col("conv_id"), F.lit(',"messages":'), msgs, F.lit("}")).alias("value"))


def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 as JSON lines (value) of six shapes without a common schema."""
    d = table(spark, sf_dir, "documents")
    shape, text, n = F.col("doc_id") % 6, _json(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")
    own = (
        F.when(shape == 0, F.concat(F.lit('"prompt":'), text))
        .when(shape == 1, F.concat(F.lit('"question":"","messages":[{"content":['), text, F.lit(']},7],"gold":1.5')))
        .when(shape == 2, F.concat(F.lit('"messages":['), text, F.lit(","), _json("lang"), F.lit('],"reference":null,"answer":'), _json("source")))
        .when(shape == 3, F.concat(F.lit('"instruction":"   ","input":'), n, F.lit(',"output":""')))
        .when(shape == 4, F.concat(F.lit('"prompt":false,"messages":{"role":"user"},"context":'), text, F.lit(',"response":true')))
        .otherwise(F.concat(F.lit('"other":{"b":[1,"x"],"a":'), n, F.lit("}")))
    )
    return d.select(F.concat(F.lit('{"doc_id":'), n, F.lit(","), own, F.lit("}")).alias("value"))


def mixed_completions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """C1 as JSON lines (value): the completion is text, a list of messages, a
    message, an object with a text, or a list of strings."""
    completions, references = verifiable_inputs(spark, sf_dir)
    text = _json(F.coalesce("completion", F.lit("")))
    shape = (F.col("conv_id") + F.col("turn") + F.col("variant")) % 5
    own = (
        F.when(shape == 1, F.concat(F.lit('[{"role":"assistant","content":'), text, F.lit("}]")))
        .when(shape == 2, F.concat(F.lit('{"content":'), text, F.lit("}")))
        .when(shape == 3, F.concat(F.lit('{"text":'), text, F.lit("}")))
        .when(shape == 4, F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
    )
    keys = [F.concat(F.lit(f'"{k}":'), F.col(k), F.lit(",")) for k in (*PAIR_KEY, "variant")]
    return completions.select(F.concat(F.lit("{"), *keys, F.lit('"completion":'), own, F.lit("}")).alias("value")), references


# ------------------------------------------------------------------ C3


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: documents spread over the generic instruction/chat columns."""
    d = table(spark, sf_dir, "documents")
    m8 = F.col("doc_id") % 8
    m4 = F.col("doc_id") % 4
    text = F.col("text")
    null = F.lit(None).cast("string")
    msgs_type = T.ArrayType(MESSAGE)
    chat = F.array(
        F.struct(F.lit("user").alias("role"), text.alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("lang").alias("content")),
    )
    return d.select(
        "doc_id",
        "lang",
        F.when(m8 == 0, text).when(m8.isin(5, 6), F.lit("")).when(m8 == 7, F.lit("   ")).otherwise(null).alias("prompt"),
        F.when(m8 == 1, text).when(m8 == 3, F.lit("What is the topic?")).otherwise(null).alias("question"),
        F.when(m8 == 2, F.lit("Summarize the document.")).when(m8 == 6, F.lit("")).otherwise(null).alias("instruction"),
        F.when(m8 == 2, text).otherwise(null).alias("input"),
        F.when(m8 == 3, text).otherwise(null).alias("context"),
        F.when(m8.isin(5, 7), text).otherwise(null).alias("text"),
        F.when(m8 == 4, chat).when(m8 == 6, F.array().cast(msgs_type)).otherwise(F.lit(None).cast(msgs_type)).alias("messages"),
        F.when(m4 == 1, F.lit("")).otherwise(null).alias("reference"),
        F.when(m4 == 0, F.col("source")).otherwise(null).alias("answer"),
        F.when(m4 == 3, F.col("lang")).otherwise(null).alias("chosen"),
        F.when(m4 == 3, F.lit("n/a")).otherwise(null).alias("rejected"),
    )


# ------------------------------------------------------------------ labels


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents LEFT JOIN labels; class label = quality + 2 * toxic (null when unlabelled)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sentence"))
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("label")
    )
    return d.join(lab, "doc_id", "left")


# ------------------------------------------------------------------ C5 / C6

GEN_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def _tagged(reasoning: str, sentiment: str, confidence: str) -> str:
    return (
        f"{K.REASONING_START}{reasoning}{K.REASONING_END}\n"
        f"{K.SENTIMENT_START}{sentiment}{K.SENTIMENT_END}\n"
        f"{K.CONFIDENCE_START}{confidence}{K.CONFIDENCE_END}"
    )


_MIXED_REASONING = (
    "Higher shipping costs hurt the quarter, although orders from two new ports rise. "
    "Therefore the debt looks manageable, but the outlook stays uncertain."
)
_PLAIN = "Revenue growth is strong while debt is down; market trend supports the sector."

# Completion templates (our fixture): each covers a golden row of FIXTURES D2 / D3.
FINANCE_TEMPLATES: tuple[str, ...] = (
    _tagged(K.SYNTHETIC_EXAMPLES[0][1], "positive", "0.75"),
    _tagged(K.SYNTHETIC_EXAMPLES[1][1], "negative", "0.80"),
    _tagged(K.SYNTHETIC_EXAMPLES[2][1], "neutral", "0.65"),
    _tagged(_MIXED_REASONING, "neutral", "0.72"),
    f"{K.REASONING_START}{_PLAIN}\n{K.SENTIMENT_START}positive{K.SENTIMENT_END}\n{K.CONFIDENCE_START}0.9{K.CONFIDENCE_END}",
    f"{K.REASONING_START}{K.REASONING_START}{_PLAIN}{K.REASONING_END}\n{K.SENTIMENT_START}positive{K.SENTIMENT_END}\n{K.CONFIDENCE_START}0.9{K.CONFIDENCE_END}",
    "<reasoning>Profit and cash improve.</reasoning>\n<sentiment>positive</sentiment>\n<confidence>0.7</confidence>",
    f"{K.REASONING_END} weak demand {K.REASONING_START}\n{K.SENTIMENT_START}negative{K.SENTIMENT_END}\n{K.CONFIDENCE_START}0.6{K.CONFIDENCE_END}",
    _tagged(_PLAIN, "positive", "abc"),
    _tagged(_PLAIN, "positive", ""),
    _tagged(_PLAIN, "positive", "0.8%"),
    _tagged(_PLAIN, "positive", "nan"),
    _tagged(_PLAIN, "positive", "7"),
    _tagged(_PLAIN, "positive", "1.0d"),
    _tagged(_PLAIN, "positive", "0x1p3"),
    _tagged("Margins expand because of cash discipline; however, macro risk persists.", "bullish", "0.9"),
    f"{K.CONFIDENCE_START}0.55{K.CONFIDENCE_END}\n{K.SENTIMENT_START}neutral{K.SENTIMENT_END}\n"
    f"{K.REASONING_START}Supply enthusiasm is mixed although guidance holds; thus lower costs offset higher rates.{K.REASONING_END}",
    _tagged("Growth in revenue and a steady dividend; outlook uncertain.", " POSITIVE ", " 0.9 "),
    _tagged("Profit turned to a loss on weak pricing; future capex cut and industry decline.", "negative", "inf"),
    _tagged("Short-term market and sector trend look worse, despite cash from the environment.", "negative", "+1e-1"),
)


def news_text(key) -> "F.Column":
    """News line of an order (derived from its key)."""
    return F.concat(F.lit("Quarterly update for order "), key.cast("string"), F.lit(": shipments and pricing reviewed."))


def finance_templates(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        [(i, t) for i, t in enumerate(FINANCE_TEMPLATES)],
        T.StructType([T.StructField("template_id", T.IntegerType()), T.StructField("completion", T.StringType())]),
    )


def finance_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5: every lineitem row is one generation of prompt group ``l_orderkey``.

    The template is ``(l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 20``;
    the 20-row template table is a fixed literal, broadcast. The first sentence
    of document ``l_partkey``, where there is one, ends the reasoning, so that
    texts are many. Keys alone go through the join with the documents.
    """
    li = table(spark, sf_dir, "lineitem").select(*GEN_KEY)
    tid = ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_linenumber")) % 20).cast("int")
    gens = li.select(*GEN_KEY, F.col("l_orderkey").alias("prompt_id"), tid.alias("template_id"))
    said = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("l_partkey"),
        F.concat(F.lit(" "), F.substring_index("text", ".", 1), F.lit(K.REASONING_END)).alias("_gw_said"),
    )
    with_text = gens.join(said, "l_partkey", "left").join(F.broadcast(finance_templates(spark)), "template_id")
    ending = F.replace("completion", F.lit(K.REASONING_END), F.coalesce("_gw_said", F.lit(K.REASONING_END)))
    return with_text.select(*GEN_KEY, "prompt_id", ending.alias("completion"))


def timed_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 with an event time: order k was scored 10 k minutes after the epoch."""
    return finance_completions(spark, sf_dir).withColumn("scored_at", F.timestamp_seconds(F.col("l_orderkey") * 600))


def finance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of C5 alone."""
    return table(spark, sf_dir, "lineitem").select(*GEN_KEY, F.col("l_orderkey").alias("prompt_id"))


def finance_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RL prompt of every order: system + user news line, open for generation."""
    o = table(spark, sf_dir, "orders")
    prompt = render_messages(
        [("system", K.SYSTEM_FINANCIAL_RL), ("user", F.concat(F.lit(K.NEWS_PREFIX), news_text(F.col("o_orderkey"))))],
        add_generation_prompt=True,
    )
    return o.select(F.col("o_orderkey").alias("prompt_id"), prompt.alias("prompt"))


def teacher_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6: logits ``((k%7)/2, (k%5)/2, (k%3)/2)`` per order; no row at all when
    ``k % 11 = 0``, no prediction (null logits) when ``k % 17 = 0``; the text is
    blank when ``k % 13 = 0`` and null when ``k % 19 = 0``."""
    k = F.col("o_orderkey")
    logits = F.array(((k % 7) / 2.0), ((k % 5) / 2.0), ((k % 3) / 2.0))
    return table(spark, sf_dir, "orders").filter(k % 11 != 0).select(
        k.alias("prompt_id"),
        F.when(k % 13 == 0, F.lit("")).when(k % 19 != 0, news_text(k)).alias("text"),
        F.when(k % 17 == 0, F.lit(None).cast("array<double>")).otherwise(logits).alias("logits"),
    )


def model_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 with the prompt of each generation. Orders with ``k % 13 = 0`` have a
    prompt without news, those with ``k % 19 = 0`` have none."""
    k = F.col("prompt_id")
    prompts = finance_prompts(spark, sf_dir).select(
        "prompt_id", F.when(k % 13 == 0, F.lit("no news today")).when(k % 19 != 0, F.col("prompt")).alias("prompt")
    )
    return finance_completions(spark, sf_dir).join(prompts, "prompt_id", "left")


# ------------------------------------------------------------------ C7

CHART_IMAGE_PREFIX = "charts/"


def chart_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7: chart questions with raw generations in the D4 shapes.

    ``image_path`` is null (unresolvable, skipped) when ``doc_id % 23 = 0``;
    generation failed when ``doc_id % 19 = 0``.
    """
    d = table(spark, sf_dir, "documents")
    m7 = F.col("doc_id") % 7
    question = F.concat(F.lit("Which language is document "), F.col("doc_id").cast("string"), F.lit(" written in?"))
    raw = (
        F.when(m7 == 0, F.concat(F.lit("User: "), question, F.lit("\nAssistant: "), F.col("lang")))
        .when(m7 == 1, F.concat(F.lit("a Assistant: b Assistant: "), F.upper(F.col("lang"))))
        .when(m7 == 2, F.col("text"))
        .when(m7 == 3, F.concat(F.lit("Assistant: "), F.col("lang"), F.lit("<|im_end|>")))
        .when(
            m7 == 4,
            F.concat(F.lit("the value was "), (F.col("doc_id") % 100).cast("string"), F.lit(" in the year of our lord two thousand")),
        )
        .when(m7 == 5, F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
        .otherwise(F.lit(""))
    )
    failed = F.col("doc_id") % 19 == 0
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 23 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(CHART_IMAGE_PREFIX), F.col("doc_id").cast("string"), F.lit(".png")))
        .alias("image_path"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).alias(
            "original_image_url"
        ),
        question.alias("question"),
        F.array(F.col("lang")).alias("ground_truth"),
        raw.alias("raw_output"),
        F.when(failed, F.lit("error")).otherwise(F.lit("success")).alias("processing_status"),
        F.when(failed, F.lit("generation failed")).alias("error_message"),
    )


# ------------------------------------------------------------------ C8


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8: events as training-log rows (sparse metrics)."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("step"),
        F.when(et != "error", F.col("value")).alias("loss"),
        F.when(et == "purchase", F.col("value")).alias("reward"),
        F.when(et == "view", F.col("value")).alias("kl"),
        F.when(et == "signup", F.col("value")).alias("eval_loss"),
    )


# ------------------------------------------------------------------ C9


def variant_outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """C9: base output = text; tuned output = upper(text) when ``doc_id % 3 = 0``,
    else text; the tuned pass has no row for ``doc_id % 17 = 0``."""
    d = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("Summarize document "), F.col("doc_id").cast("string"))
    base = d.select("doc_id", prompt.alias("prompt"), F.col("text").alias("base_output"))
    tuned = d.filter(F.col("doc_id") % 17 != 0).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")).alias("lora_output")
    )
    return base, tuned


# ------------------------------------------------------------------ O-33 stand-in model


def length_logit_predictor():
    """A deterministic stand-in for a sentiment model (built once per task):
    logits ``((n % 7) / 2, (n % 5) / 2, (n % 3) / 2)`` from the text length n,
    softmaxed with numpy over the whole Arrow batch."""
    import numpy as np

    def predict(texts: list[str]) -> list[list[float]]:
        n = np.array([len(t) for t in texts], dtype=np.int64)
        logits = np.stack([(n % 7) / 2.0, (n % 5) / 2.0, (n % 3) / 2.0], axis=1)
        top = logits.max(axis=1, keepdims=True)
        e = np.exp(logits - top)
        return (e / e.sum(axis=1, keepdims=True)).tolist()

    return predict


def drifting_examples(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """JSON lines of documents in three folders whose fields drift: ``old``
    has every field, ``new`` no lang and n_chars as text for every fifth id,
    ``mixed`` n_chars with a fraction, and every seventh line cut short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    part, keep = F.col("doc_id") % 3, {"ignoreNullFields": "false"}
    old = F.to_json(F.struct("doc_id", "lang", "n_chars"), keep)
    as_text = F.to_json(F.struct("doc_id", F.col("n_chars").cast("string").alias("n_chars")), keep)
    new = F.when(F.col("doc_id") % 5 == 0, as_text).otherwise(F.to_json(F.struct("doc_id", "n_chars"), keep))
    half = F.to_json(F.struct("doc_id", "lang", (F.col("n_chars") + F.lit(0.5).cast("double")).alias("n_chars")), keep)
    mixed = F.when(F.col("doc_id") % 7 == 0, F.lit('{"doc_id": ')).otherwise(half)
    lines = {"old": old, "new": new, "mixed": mixed}
    return {name: docs.filter(part == i).select(line.alias("value")) for i, (name, line) in enumerate(lines.items())}


def lines_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of documents: every tenth is cut short, every eleventh has
    text for a number."""
    docs = table(spark, sf_dir, "documents")
    number, chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    whole = F.concat(F.lit('{"doc_id":'), number, F.lit(',"n_chars":'), chars, F.lit("}"))
    short = F.concat(F.lit('{"doc_id":'), number, F.lit(',"n_chars"'))
    typed = F.concat(F.lit('{"doc_id":'), number, F.lit(',"n_chars":"many"}'))
    line = F.when(F.col("doc_id") % 10 == 0, short).when(F.col("doc_id") % 11 == 0, typed).otherwise(whole)
    return docs.select(line.alias("value"))
