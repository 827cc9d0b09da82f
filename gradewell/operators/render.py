"""O-2, O-3, O-15..O-19: labelled sentences, example assembly, training-row rendering."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.chat import CHATML, ChatTemplate, render_messages, token_length
from ..functions.literal import literal_table

log = logging.getLogger(__name__)

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def label_sentences(
    df: DataFrame,
    sentence: str = "sentence",
    label: str = "label",
    keep: list[str] | None = None,
    max_n: int | None = None,
    order_by: list[str] | None = None,
) -> DataFrame:
    """O-2: class label -> (reasoning, sentiment, confidence), source='phrasebank'.

    0 -> negative, 1 -> neutral, anything else (null included) -> positive.
    ``max_n`` keeps the first n rows by ``order_by`` (TakeOrderedAndProject).
    """
    lab = F.col(label)
    neg, neu, pos = K.LABEL_NEGATIVE, K.LABEL_NEUTRAL, K.LABEL_POSITIVE

    def pick(i: int) -> Column:
        return (
            F.when(lab == 0, F.lit(neg[i]))
            .when(lab == 1, F.lit(neu[i]))
            .otherwise(F.lit(pos[i]))
        )

    out = df.select(
        *[F.col(k) for k in (keep or [])],
        F.col(sentence).alias("text"),
        pick(0).alias("reasoning"),
        pick(1).alias("sentiment"),
        pick(2).cast("double").alias("confidence"),
        F.lit(K.LABEL_SOURCE).alias("source"),
    )
    if max_n is not None and max_n > 0:
        out = out.orderBy(*(order_by or keep or ["text"])).limit(max_n)
    return out


def synthetic_examples(spark: SparkSession) -> DataFrame:
    """The three built-in examples (a fixed 3-row relation); ``source`` is null (Q-22)."""
    schema = T.StructType(EXAMPLE_SCHEMA.fields + [T.StructField("source", T.StringType())])
    return literal_table(spark, [row + (None,) for row in K.SYNTHETIC_EXAMPLES], schema)


def assemble_examples(
    spark: SparkSession,
    real: DataFrame | None,
    mode: str = "mixed",
    min_total: int = K.MIN_TOTAL_EXAMPLES,
    check_size: bool = False,
) -> DataFrame:
    """O-3: ``mixed`` = real then synthetic, ``real``, ``synthetic``.

    Synthetic rows are also used when no real row is loaded. Real rows come
    first in the union; synthetic rows carry a null ``source`` (Q-22).
    ``check_size`` runs the two cheap actions (emptiness, count) that the
    reference's warning needs; it only logs.
    """
    if mode not in ("mixed", "real", "synthetic"):
        raise ValueError(f"unknown data mode {mode!r}")
    parts: list[DataFrame] = []
    if mode in ("mixed", "real") and real is not None:
        parts.append(real)
    use_synthetic = mode in ("mixed", "synthetic")
    if not use_synthetic and (not parts or parts[0].isEmpty()):
        use_synthetic = True
    if use_synthetic:
        parts.append(synthetic_examples(spark))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if check_size:
        n = out.count()
        if n < min_total:
            log.warning("only %d examples; below min_total_examples=%d", n, min_total)
    return out


def _user_message(text: Column) -> Column:
    return F.concat(F.lit(K.NEWS_PREFIX), text)


def _assistant_message(reasoning: Column, sentiment: Column, confidence: Column) -> Column:
    return F.concat(
        F.lit(K.REASONING_START), reasoning, F.lit(K.REASONING_END + "\n"),
        F.lit(K.SENTIMENT_START), sentiment, F.lit(K.SENTIMENT_END + "\n"),
        F.lit(K.CONFIDENCE_START), confidence.cast("string"), F.lit(K.CONFIDENCE_END),
    )


def format_sft(
    df: DataFrame,
    template: ChatTemplate = CHATML,
    keep: list[str] | None = None,
    token_len: str | None = None,
) -> DataFrame:
    """O-15: system + user + assistant rendered to one ``text``; ``token_len``."""
    text = render_messages(
        [
            ("system", K.SYSTEM_FINANCIAL_SFT),
            ("user", _user_message(F.col("text"))),
            ("assistant", _assistant_message(F.col("reasoning"), F.col("sentiment"), F.col("confidence"))),
        ],
        template,
    )
    keep = list(keep or [])
    has_given = bool(token_len) and token_len in df.columns
    given = [F.col(token_len).alias("_given_len")] if has_given else []
    rendered = df.select(*[F.col(k) for k in keep], text.alias("text"), *given)
    return rendered.select(
        *[F.col(k) for k in keep],
        token_length("text", "_given_len" if has_given else None).alias("token_len"),
        F.col("text"),
    )


def format_rl(df: DataFrame, template: ChatTemplate = CHATML, keep: list[str] | None = None) -> DataFrame:
    """O-16: system + user, open for generation; ``gold_text`` and ``full_len`` kept
    (``full_len`` is never used to filter)."""
    prompt = render_messages(
        [("system", K.SYSTEM_FINANCIAL_RL), ("user", _user_message(F.col("text")))],
        template,
        add_generation_prompt=True,
    )
    return df.select(
        *[F.col(k) for k in (keep or [])],
        prompt.alias("prompt"),
        F.col("text").alias("gold_text"),
    ).select(
        *[F.col(k) for k in (keep or [])],
        F.col("prompt"),
        token_length("prompt").alias("full_len"),
        F.col("gold_text"),
    )


CHART_PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("image", T.StringType()),
    ]
)


def format_chart(df: DataFrame, image: str = "image", query: str = "query", label: str = "label",
                 keep: list[str] | None = None) -> DataFrame:
    """O-19: chart question -> ``images`` + three-message chat with typed parts.

    The answer is the first label when ``label`` is a list (null for an empty
    list), else the label. Images stay references (path or bytes), never decoded.
    """
    label_type = df.schema[label].dataType
    answer = F.get(F.col(label), 0) if isinstance(label_type, T.ArrayType) else F.col(label).cast("string")
    img = F.col(image)

    def part(kind: str, text: Column | None = None, picture: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            (text if text is not None else F.lit(None).cast("string")).alias("text"),
            (picture if picture is not None else F.lit(None).cast(img_type)).alias("image"),
        )

    img_type = df.schema[image].dataType

    def message(role: str, parts: list[Column]) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    messages = F.array(
        message("system", [part("text", F.lit(K.CHART_SYSTEM_MESSAGE))]),
        message("user", [part("image", picture=img), part("text", F.col(query).cast("string"))]),
        message("assistant", [part("text", answer)]),
    )
    return df.select(*[F.col(k) for k in (keep or [])], F.array(img).alias("images"), messages.alias("messages"))
