"""O-43..O-46, O-56: keyed joins that replace the reference's positional zips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import preview
from .sample import number_rows


def next_turn_pairs(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    prompt_role: str = "user",
    answer_role: str = "assistant",
    bucket_turns: int = 256,
) -> DataFrame:
    """Pair each ``prompt_role`` turn with the next turn when that one is an
    ``answer_role`` turn: (conv, turn, prompt, reference), keyed by (conv, turn).

    The next turn is the one with the next larger number, whether or not
    numbers are missing between them; turns of one number follow each other
    by role and text. It is looked up by ``lead`` in stretches of
    ``bucket_turns`` numbers, so a huge conversation spreads over many tasks;
    the last turn of a stretch takes the first turn of the next stretch,
    found over one row per stretch.
    """
    rows = turns.select(
        F.col(conv),
        F.floor(F.col(turn) / bucket_turns).alias("_gw_b"),
        F.struct(F.col(turn).alias("n"), F.col(role).alias("role"), F.col(text).alias("text")).alias("_gw_m"),
    )
    inside = Window.partitionBy(conv, "_gw_b").orderBy("_gw_m")
    firsts = rows.groupBy(conv, "_gw_b").agg(F.min("_gw_m").alias("_gw_first"))
    after = firsts.select(
        F.col(conv).alias("_gw_conv"),
        F.col("_gw_b").alias("_gw_bucket"),
        F.lead("_gw_first").over(Window.partitionBy(conv).orderBy("_gw_b")).alias("_gw_after"),
    )
    led = rows.withColumn("_gw_next", F.lead("_gw_m").over(inside))
    same = F.col(conv).eqNullSafe(F.col("_gw_conv")) & F.col("_gw_b").eqNullSafe(F.col("_gw_bucket"))
    paired = led.join(after, same, "left").withColumn("_gw_next", F.coalesce("_gw_next", "_gw_after"))
    return paired.filter((F.col("_gw_m.role") == prompt_role) & (F.col("_gw_next.role") == answer_role)).select(
        F.col(conv),
        F.col("_gw_m.n").alias(turn),
        F.col("_gw_m.text").alias("prompt"),
        F.col("_gw_next.text").alias("reference"),
    )


def attach_prompts(completions: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """O-43: completions INNER JOIN prompts on the prompt key (the reference
    zips two lists and cuts to the shorter; here rows meet by key)."""
    return completions.join(prompts, key, "inner")


def compare_variants(
    base: DataFrame,
    tuned: DataFrame,
    key: str,
    prompt: str = "prompt",
    base_output: str = "base_output",
    tuned_output: str = "lora_output",
    how: str = "inner",
) -> DataFrame:
    """O-46: outputs of two model variants on the same prompts, joined by key.

    ``how='inner'`` matches the reference (zip over prompts both passes
    answered); ``how='full'`` also reports prompts missing on one side.
    """
    b = base.select(F.col(key), F.col(prompt).alias("prompt"), F.col(base_output).alias("base_output"))
    t = tuned.select(F.col(key), F.col(tuned_output).alias("lora_output"))
    if how == "inner":
        return b.join(t, key, how)
    joined = b.withColumn("_gw_b", F.lit(True)).join(t.withColumn("_gw_t", F.lit(True)), key, how)
    return joined.select(
        key, "prompt", "base_output", "lora_output",
        F.coalesce("_gw_b", F.lit(False)).alias("in_base"),
        F.coalesce("_gw_t", F.lit(False)).alias("in_lora"),
    )


def with_previews(df: DataFrame, cols=("base_output", "lora_output"), n: int = K.PREVIEW_CHARS) -> DataFrame:
    """O-29 on each output column."""
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_preview", preview(c, n))
    return out


def preview_rows(df: DataFrame, key: str, n: int = K.PREVIEW_ROWS, cols=("base_output", "lora_output")) -> DataFrame:
    """O-29 as the reference shows it: previews of the first n prompts by key
    (a top-n report; the limit is the feature)."""
    return with_previews(df, cols).orderBy(key).limit(n)


def number_results(
    outputs: DataFrame,
    order_by: list[str],
    resolvable: str = "image_path",
    status: str = "processing_status",
    answer: str = "model_answer",
    error: str = "error_message",
    max_samples: int | None = None,
) -> DataFrame:
    """O-56: ``dataset_index`` = position among all samples, ``sample_id`` =
    position among samples whose image resolved (skipped ones take no
    number); error rows keep their number and carry ``ERROR: message``.

    ``order_by`` is the sample key; it may repeat or be null. Both positions come
    from one range sort of keys and row hashes; rows are joined to them once.
    ``max_samples`` stops after that many processed samples (skipped ones do
    not count), as the evaluation's sample limit does.
    """
    resolved = F.col(resolvable).isNotNull()
    numbered, _ = number_rows(outputs, order_by, "dataset_index", resolved, "sample_id")
    numbered = numbered.filter(F.col("sample_id").isNotNull())
    if max_samples is not None:
        numbered = numbered.filter(F.col("sample_id") < max_samples)
    is_error = F.col(status) == "error"
    return numbered.withColumn(
        answer,
        F.when(is_error, F.concat(F.lit(K.ERROR_PREFIX), F.coalesce(F.col(error), F.lit("")))).otherwise(F.col(answer)),
    )


def skipped_samples(outputs: DataFrame, resolvable: str = "image_path") -> DataFrame:
    """Samples whose image did not resolve (reported, never numbered)."""
    return outputs.filter(F.col(resolvable).isNull())
