"""The query catalogue: ``q_*(spark, sf_dir) -> DataFrame``.

Each query runs the library operators over whole driver tables. Doubles are
rounded to 6 places for comparison with the DuckDB oracle; column names
match ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.chat import completion_text, flatten_chat, render_chat, token_length
from ..functions.numeric import round6
from ..functions.text import extract_answer, extract_number, news_from_prompt
from ..operators import analyze, compare, normalize, predictions, render, rewards, sample, skew
from ..session import shared_path, shuffles_removed
from ..sinks import one_file, writers
from ..sources import readers
from ..streaming import quarantine, streams, tracking
from . import fixtures as X

GEN_KEY = X.GEN_KEY
ROWS_PER_FILE = 100_000


# ------------------------------------------------------------- verifiable reward


def q_verifiable_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    completions, references = X.verifiable_inputs(spark, sf_dir)
    scored = rewards.score_verifiable(completions, references, X.PAIR_KEY)
    return scored.select(*X.PAIR_KEY, "variant", round6("reward").alias("reward"))


def q_verifiable_reward_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-30 over chat-shaped completions (a list of messages), through O-13."""
    completions, references = X.verifiable_inputs(spark, sf_dir)
    message = F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content"))
    chats = completions.withColumn("completion", F.array(message))
    scored = rewards.score_verifiable(chats, references, X.PAIR_KEY)
    return scored.select(*X.PAIR_KEY, "variant", round6("reward").alias("reward"))


def q_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44 over hot keys: order lines of which a third share one key and some
    have none, joined to the orders with the keys named by a sketch salted."""
    lines = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    number = F.col("l_linenumber")
    key = F.when(number <= 2, F.lit(1).cast("bigint")).when(number != 7, F.col("l_orderkey"))
    keyed = lines.withColumn("key", key)
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    return skew.salted_join(keyed, orders, "key", skew.hot_keys(keyed, "key"))


def q_extract_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-27 on both sides of the completion/reference join."""
    completions, references = X.verifiable_inputs(spark, sf_dir)
    joined = completions.join(references, X.PAIR_KEY, "left")
    return joined.select(
        *X.PAIR_KEY,
        extract_number("completion").alias("completion_number"),
        extract_number("reference").alias("reference_number"),
    )


def q_reward_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: mean / min / max verifiable reward per completion shape."""
    completions, references = X.verifiable_inputs(spark, sf_dir)
    scored = rewards.score_verifiable(completions, references, X.PAIR_KEY)
    return scored.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"),
        round6(F.avg("reward")).alias("mean_reward"),
        round6(F.min("reward")).alias("min_reward"),
        round6(F.max("reward")).alias("max_reward"),
    )


# ------------------------------------------------------------- normalising


def q_flatten_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = X.chat_rows(spark, sf_dir)
    return chats.select("conv_id", flatten_chat("messages", chats.schema["messages"].dataType).alias("prompt"))


def q_flatten_chat_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10 over the message shapes of other datasets."""
    rows = X.chat_shapes(spark, sf_dir)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "doc_id",
        flatten_chat("sharegpt", kind["sharegpt"]).alias("unnamed"),
        flatten_chat("sharegpt", kind["sharegpt"], "from", "value").alias("named"),
        *[flatten_chat(c, kind[c]).alias(c) for c in ("strings", "maps", "typed", "other")],
    )


def _json_lines(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = shared_path(spark, name)
    rows.write.text(path)
    return path


def q_flatten_mixed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10 over one column that mixes all shapes, message by message."""
    path = _json_lines(spark, X.mixed_chats(spark, sf_dir), "mixed-chats")
    chats = readers.read_examples(spark, path, ["messages"], schema="conv_id bigint, messages variant")
    return chats.select("conv_id", flatten_chat("messages", chats.schema["messages"].dataType).alias("prompt"))


def q_mixed_prompt_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11, O-12 and O-14 over JSON lines without a common schema."""
    path = _json_lines(spark, X.mixed_rows(spark, sf_dir), "mixed-rows")
    found = normalize.variant_prompt_reference(readers.read_variant_rows(spark, path), keep=["doc_id"])
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def q_verifiable_reward_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-30 over completions of five shapes in one column, through O-13."""
    lines, references = X.mixed_completions(spark, sf_dir)
    path = _json_lines(spark, lines, "mixed-completions")
    kind = "conv_id bigint, turn bigint, variant int, completion variant"
    scored = rewards.score_verifiable(readers.read_examples(spark, path, schema=kind), references, X.PAIR_KEY)
    return scored.select(*X.PAIR_KEY, "variant", round6("reward").alias("reward"))


def q_render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-17 over the array of typed parts that O-19 makes."""
    rows = render.format_chart(_chart_questions(spark, sf_dir), keep=["doc_id"])
    text = render_chat("messages", msgs_type=rows.schema["messages"].dataType)
    return rows.select("doc_id", text.alias("text"))


def q_flatten_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10 in table form: the same text as ``q_flatten_chat`` without
    gathering a conversation's messages into one array first."""
    return normalize.flatten_turns(X.table(spark, sf_dir, "conversations"))


def q_completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = X.chat_rows(spark, sf_dir)
    text = completion_text("messages", chats.schema["messages"].dataType)
    return chats.select("conv_id", text.alias("completion_text"))


def q_prompt_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.to_prompt_reference(X.raw_examples(spark, sf_dir), keep=["doc_id"])


# ------------------------------------------------------------- rendering


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.label_sentences(X.labelled_documents(spark, sf_dir), keep=["doc_id"])


def q_label_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).withColumn("confidence", round6("confidence"))


def q_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render.assemble_examples(spark, _sentences(spark, sf_dir), mode="mixed")
    return out.select("doc_id", "text", "sentiment", round6("confidence").alias("confidence"), "source")


def q_format_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.format_sft(_sentences(spark, sf_dir), keep=["doc_id"])


def q_format_rl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.format_rl(_sentences(spark, sf_dir), keep=["doc_id"])


def q_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    sft = render.format_sft(_sentences(spark, sf_dir), keep=["doc_id"])
    return sample.filter_token_len(sft, K.MAX_PROMPT_TOKENS).select("doc_id", "token_len")


def _chart_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit(X.CHART_IMAGE_PREFIX), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"),
        F.concat(F.lit("Which language is document "), F.col("doc_id").cast("string"), F.lit(" written in?")).alias("query"),
        F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.col("lang"), F.col("source")))
        .alias("label"),
    )


def q_format_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.format_chart(_chart_questions(spark, sf_dir), keep=["doc_id"])
    m = F.col("messages")
    return rows.select(
        "doc_id",
        F.get("images", 0).alias("image"),
        F.size(m).alias("n_messages"),
        m[1]["content"][0]["image"].alias("user_image"),
        m[1]["content"][1]["text"].alias("user_text"),
        m[2]["content"][0]["text"].alias("answer"),
        m[0]["role"].alias("first_role"),
    )


# ------------------------------------------------------------- sampling


def q_shuffle_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sample.shuffle_sample(docs, K.SAMPLE_ROWS, "doc_id", K.DEFAULT_SEED)


def q_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rl = render.format_rl(_sentences(spark, sf_dir), keep=["doc_id"])
    return sample.cap(rl, K.MAX_REAL_EXAMPLES, ["doc_id"]).select("doc_id", "full_len")


def q_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-21 beyond what one task orders: the first 20,000 lines by price, found
    by pivots with a small task size."""
    lines = X.table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return sample.first_rows(lines, 20_000, ["l_extendedprice", "l_orderkey", "l_linenumber"], task_rows=500)


def q_first_rows_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-21 over a key that is often null and mostly repeated: the first 30,000
    rows, counted by key."""
    lines = X.table(spark, sf_dir, "lineitem")
    keyed = lines.select(F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("l_returnflag"))
    first = sample.first_rows(keyed, 30_000, ["l_returnflag"], task_rows=500)
    return first.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def q_take_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id")
    return sample.take_skip_split(docs, ["doc_id"]).select("doc_id", "row_index", "split")


def q_take_skip_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-23 over a key that many rows share and some lack: rows by split and
    key, each row numbered once."""
    docs = X.table(spark, sf_dir, "documents")
    keyed = docs.select(F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), "source")
    parts = sample.take_skip_split(keyed, ["lang"])
    return parts.groupBy("lang", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("row_index").alias("numbers"),
        F.min("row_index").alias("first"),
        F.max("row_index").alias("last"),
    )


def q_take_skip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-23 over a table whose row count is no multiple of 5."""
    turns = X.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return sample.take_skip_split(turns, ["conv_id", "turn"])


def q_three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-23 in full: documents as train rows, benchmark items as the ``val`` split."""
    train = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    held_out = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    return sample.three_way_split(train, held_out, ["id"])


def q_slice_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.table(spark, sf_dir, "documents").select("doc_id")
    slices = {"train": "train[:80%]", "validation": "train[80%:]"}
    return sample.split_by_slices(docs, slices, ["doc_id"]).select("doc_id", "row_index", "split")


# ------------------------------------------------------------- financial rewards


def _finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = X.finance_completions(spark, sf_dir)
    teacher = rewards.teacher_probabilities(X.teacher_table(spark, sf_dir), "prompt_id")
    return rewards.finance_reward(gens, teacher, "prompt_id")


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = rewards.extract_components(X.finance_completions(spark, sf_dir))
    return gens.select(*GEN_KEY, "reasoning", "sentiment", "confidence_text")


def q_format_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = X.finance_completions(spark, sf_dir)
    return gens.select(*GEN_KEY, rewards.format_gate("completion").alias("gate"))


def q_news_from_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-26 once per prompt; only the news meets the generations (O-43)."""
    news = X.finance_prompts(spark, sf_dir).select("prompt_id", news_from_prompt("prompt").alias("news"))
    gens = X.finance_keys(spark, sf_dir)
    return compare.attach_prompts(gens, news, "prompt_id").select(*GEN_KEY, "news")


def q_prompt_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43: each generation meets its prompt by key; the prompt's length is
    taken once per prompt."""
    lengths = X.finance_prompts(spark, sf_dir).select("prompt_id", token_length("prompt").alias("prompt_tokens"))
    gens = X.finance_keys(spark, sf_dir)
    return compare.attach_prompts(gens, lengths, "prompt_id").select(*GEN_KEY, "prompt_id", "prompt_tokens")


def q_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = rewards.teacher_probabilities(X.teacher_table(spark, sf_dir), "prompt_id")
    return probs.select(
        "prompt_id", *[round6(F.get("probs", i)).alias(f"p_{label}") for i, label in enumerate(K.TEACHER_LABELS)]
    )


def q_score_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-33: a user model over every distinct news text (Arrow batches through
    mapInPandas), joined back to the prompts by digest; blank and null texts
    are never sent."""
    teacher = X.teacher_table(spark, sf_dir).select("prompt_id", "text")
    scored = rewards.score_teacher(teacher, "text", X.length_logit_predictor)
    joined = rewards.with_teacher(teacher, "text", scored)
    return joined.select(
        "prompt_id", *[round6(F.get("probs", i)).alias(f"p_{label}") for i, label in enumerate(K.TEACHER_LABELS)]
    )


def q_finance_reward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41 end to end: prompt -> news -> model -> reward."""
    scored = rewards.finance_reward_by_news(X.model_generations(spark, sf_dir), X.length_logit_predictor)
    return scored.select(*GEN_KEY, round6("p_teacher").alias("p_teacher"), round6("finance_reward").alias("finance_reward"))


def q_teacher_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finance(spark, sf_dir).select(*GEN_KEY, "sentiment", round6("p_teacher").alias("p_teacher"))


def q_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rewards.score_reasoning(rewards.extract_components(X.finance_completions(spark, sf_dir)))
    return scored.select(*GEN_KEY, *[round6(c).alias(c) for c in ("quality", "logic", "context", "bundle")])


def q_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finance(spark, sf_dir).select(*GEN_KEY, round6("calibration").alias("calibration"))


def q_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    gens = rewards.extract_components(X.finance_completions(spark, sf_dir))
    return gens.select(*GEN_KEY, rewards.directional("reasoning", "sentiment").alias("direction"))


def q_finance_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finance(spark, sf_dir).select(*GEN_KEY, round6("finance_reward").alias("finance_reward"))


def q_total_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42 as a list of named rewards, as the trainer takes them."""
    both = [
        rewards.NamedReward("format_reward", lambda df: F.col("gate")),
        rewards.NamedReward("reasoning_reward", lambda df: F.col("finance_reward")),
    ]
    scored = rewards.apply_rewards(_finance(spark, sf_dir), both)
    return scored.select(
        *GEN_KEY,
        "gate",
        round6("finance_reward").alias("finance_reward"),
        round6("total_reward").alias("total_reward"),
    )


def q_group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _finance(spark, sf_dir).select(*GEN_KEY, "prompt_id", "finance_reward")
    adv = analyze.group_advantage(scored, "prompt_id", "finance_reward", materialize=True)
    return adv.select(*GEN_KEY, round6("finance_reward").alias("finance_reward"), round6("advantage").alias("advantage"))


def q_best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _finance(spark, sf_dir).select(*GEN_KEY, "prompt_id", "finance_reward")
    best = analyze.best_of_group(scored, "prompt_id", "finance_reward", GEN_KEY[1:])
    return best.select(
        "prompt_id", *GEN_KEY[1:], round6("finance_reward").alias("finance_reward"), "n_generations"
    )


def q_reward_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _finance(spark, sf_dir)
    return analyze.reward_summary(
        scored, ["sentiment"], "finance_reward", ["quality", "logic", "context", "calibration", "direction"]
    )


def q_reward_summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-50 with ``cube`` over sentiment and gate (every combination + total)."""
    scored = _finance(spark, sf_dir)
    return analyze.reward_summary(scored, ["sentiment", "gate"], "finance_reward", ["calibration"], grouping="cube")


# ------------------------------------------------------------- comparison / evaluation


def q_compare_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, tuned = X.variant_outputs(spark, sf_dir)
    joined = compare.compare_variants(base, tuned, "doc_id")
    return joined.withColumn("changed", F.col("base_output") != F.col("lora_output"))


def q_compare_variants_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-46, full outer form: which prompts a variant did not answer."""
    base, tuned = X.variant_outputs(spark, sf_dir)
    return compare.compare_variants(base, tuned, "doc_id", how="full").select("doc_id", "in_base", "in_lora")


def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, tuned = X.variant_outputs(spark, sf_dir)
    joined = compare.with_previews(compare.compare_variants(base, tuned, "doc_id"))
    return joined.select("doc_id", "base_output_preview", "lora_output_preview")


def q_extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = X.chart_outputs(spark, sf_dir)
    return outs.select("doc_id", extract_answer("raw_output").alias("model_answer"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    outs = X.chart_outputs(spark, sf_dir).withColumn("model_answer", extract_answer("raw_output"))
    return compare.number_results(outs, ["doc_id"])


def q_number_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select(
        "sample_id", "dataset_index", "image_path", "question", "model_answer", "processing_status"
    )


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that O-56 numbers, without their numbers."""
    outs = X.chart_outputs(spark, sf_dir).filter(F.col("image_path").isNotNull())
    return outs.withColumn("model_answer", extract_answer("raw_output"))


def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.accuracy(_answered(spark, sf_dir))


def q_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.status_counts(_answered(spark, sf_dir))


def q_training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.training_curve(X.train_log(spark, sf_dir))


def q_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.best_checkpoint(X.train_log(spark, sf_dir))


def q_last_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoints a total limit of 3 keeps (top-k by step; the limit is the feature)."""
    return analyze.last_checkpoints(X.train_log(spark, sf_dir), 3).select("step", "eval_loss")


# ------------------------------------------------------------- files and streams

# Each writes what it derives from whole tables to the shared folder and reads
# it back with the operator in question.


def q_read_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1: example files as JSON lines, with the required fields checked."""
    path = shared_path(spark, "examples")
    _sentences(spark, sf_dir).write.json(path)
    read = readers.read_examples(spark, path, readers.SFT_REQUIRED)
    return read.select("doc_id", "text", "reasoning", "sentiment", round6("confidence").alias("confidence"))


def q_schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1: fields that are missing or change their type, named by folder
    before a job reads the files."""
    path = shared_path(spark, "drift")
    for name, rows in X.drifting_examples(spark, sf_dir).items():
        rows.write.text(f"{path}/{name}")
    problems = readers.schema_problems(readers.json_fields(spark, f"{path}/*", by="folder"), ["doc_id", "lang", "n_chars"])
    return problems.withColumn("unit", F.substring_index("unit", "/", -1))


def q_load_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-4 and O-5: split folders, picked by name and normalised."""
    path = shared_path(spark, "splits")
    m = F.col("doc_id") % 10
    name = F.when(m < 6, F.lit("train_sft")).when(m < 8, F.lit("test")).when(m == 8, F.lit("validation")).otherwise(F.lit("gen"))
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), F.col("lang").alias("answer"))
    for split in ("train_sft", "test", "validation", "gen"):
        docs.filter(name == split).write.parquet(f"{path}/{split}")
    train, held_out, train_name, held_out_name = readers.load_splits(spark, path, keep=["doc_id"])
    return train.withColumn("split", F.lit(train_name)).unionByName(held_out.withColumn("split", F.lit(held_out_name)))


def q_load_splits_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-5 over one table with a split column."""
    path = shared_path(spark, "split-column")
    docs = X.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 7 == 0, F.lit("validation")).otherwise(F.lit("train"))
    docs.select("doc_id", F.col("text").alias("prompt"), "source", name.alias("split")).write.partitionBy("split").parquet(path)
    train, held_out, _, _ = readers.load_splits_by_column(spark, path, keep=["doc_id"])
    return train.withColumn("split", F.lit("train")).unionByName(held_out.withColumn("split", F.lit("validation")))


def q_read_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-6: literal prompts, then the non-blank lines of a prompt file in order."""
    path = shared_path(spark, "prompts")
    line = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("  Summarize document "), F.col("doc_id").cast("string"), F.lit(" "))
    )
    docs = X.table(spark, sf_dir, "documents").select("doc_id", line.alias("value"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return readers.read_prompts(spark, ["first prompt"], path)


def q_resolve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-7: pages as the listing of files; every third sample names none."""
    pages = X.table(spark, sf_dir, "pages")
    page = F.col("page_id").cast("string")
    files = pages.select(F.concat(F.lit("file:/pages/"), page).alias("path"), F.encode("html", "UTF-8").alias("content"))
    name = F.when(F.col("page_id") % 3 == 0, F.lit("/nowhere/")).when(F.col("page_id") % 3 == 1, F.lit("file:///pages/"))
    samples = pages.select("page_id", F.concat(name.otherwise(F.lit("/pages/")), page).alias("image_path"))
    resolved, skipped = readers.resolve_images(samples, files)
    found = resolved.select("page_id", F.length("image").cast("long").alias("image_size"))
    return found.unionByName(skipped.select("page_id", F.lit(None).cast("long").alias("image_size")))


def q_write_comparison_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-53: written as CSV and read back, multi-line fields included."""
    path = shared_path(spark, "comparison")
    base, tuned = X.variant_outputs(spark, sf_dir)
    writers.write_comparison_csv(compare.compare_variants(base, tuned, "doc_id"), path)
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def q_write_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-54: the eight result fields as JSON lines, read back."""
    path = shared_path(spark, "results")
    numbered = _numbered(spark, sf_dir)
    writers.write_results_json(numbered, path)
    return spark.read.schema(numbered.select(*writers.RESULT_FIELDS).schema).json(path).withColumn(
        "ground_truth", F.array_join("ground_truth", ",")
    )


def q_write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-55: the lines of the written summary, each with its count."""
    path = shared_path(spark, "summary")
    writers.write_summary(_numbered(spark, sf_dir), path, "base-model", "adapter", "results")
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def q_write_summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-55: the summary as one file, its lines numbered as they stand in it."""
    path = f"{shared_path(spark, 'summary')}.txt"
    one_file.write_summary_file(_numbered(spark, sf_dir), path, "base-model", "adapter", "results")
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")
    )
    return sample.with_row_index(lines, ["at", "n"], "place", count=False)[0].select("place", "line")


def _streamed(spark: SparkSession, rows: DataFrame, start) -> DataFrame:
    """``rows`` as arriving JSON files (O-8) through a streaming job that ends
    when they are done; what it wrote."""
    source, sink, state = (shared_path(spark, f"stream-{x}") for x in ("source", "sink", "state"))
    rows.write.json(source)
    start(readers.stream_examples(spark, source, rows.schema), sink, state).awaitTermination()
    return spark.read.parquet(sink)


def q_stream_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8 and O-57: arriving generic rows as (prompt, reference)."""
    rows = X.raw_examples(spark, sf_dir)
    return _streamed(
        spark, rows, lambda s, out, state: streams.stream_normalise(s, out, state, keep=["doc_id"], available_now=True)
    )


def q_stream_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-58: arriving completions scored against the static references."""
    completions, references = X.verifiable_inputs(spark, sf_dir)
    scored = _streamed(
        spark,
        completions,
        lambda s, out, state: streams.stream_verifiable_rewards(s, references, X.PAIR_KEY, out, state, available_now=True),
    )
    return scored.select(*X.PAIR_KEY, "variant", round6("reward").alias("reward"))


def q_stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-8 and O-57: arriving lines, some broken or of another type: good rows
    and quarantined lines, each line once."""
    source, good, bad, state = (shared_path(spark, f"quarantine-{x}") for x in ("source", "good", "bad", "state"))
    X.lines_with_faults(spark, sf_dir).repartition(4).write.text(source)
    kind = "doc_id bigint, n_chars bigint"
    quarantine.stream_quarantine(
        spark, source, kind, good, bad, state, files_per_batch=2, available_now=True
    ).awaitTermination()
    rows, lines = quarantine.read_quarantine(spark, good, bad, kind)
    return rows.withColumn("line", F.lit(None).cast("string")).unionByName(
        lines.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_chars"), "line")
    )


def q_track_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-58: arriving generations scored and tracked by week and line number,
    over several micro-batches; nothing is late under this watermark."""
    rows = X.timed_completions(spark, sf_dir)
    source, sink, state = (shared_path(spark, f"track-{x}") for x in ("source", "sink", "state"))
    groups = ["l_linenumber"]
    with shuffles_removed(spark):
        # every task writes its own rows, compressed, as plain JSON takes most of the job's disk; one task reads a
        # gzip file, so files stay short; four files at least, half of all files a batch
        most = min(-(-X.table(spark, sf_dir, "lineitem").count() // 4), ROWS_PER_FILE)
        rows.write.option("maxRecordsPerFile", max(most, 1)).json(source, compression="gzip")
        files = len(spark.read.text(source).inputFiles())
        arriving = readers.stream_examples(spark, source, rows.schema, files_per_batch=max(1, -(-files // 2)))
        probs = rewards.teacher_probabilities(X.teacher_table(spark, sf_dir), "prompt_id")
        scored = rewards.finance_reward(arriving, probs, "prompt_id")
        job = tracking.track_rewards(
            scored, sink, state, "scored_at", groups, window="7 days", watermark="100000 days", available_now=True
        )
    job.await_all()
    late = tracking.late_rows(spark, sink, groups)
    found = tracking.current_rewards(spark, sink, groups).join(late, groups)
    return found.select(
        F.unix_timestamp("window_start").alias("week"),
        "l_linenumber",
        "n",
        round6("mean_reward").alias("mean_reward"),
        round6("min_reward").alias("min_reward"),
        round6("max_reward").alias("max_reward"),
        round6("gate_rate").alias("gate_rate"),
        "seen",
        "late",
    )


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, predictions.PredictionStore]:
    """Two runs over one store: half of the prompts, then all of them."""
    teacher = X.teacher_table(spark, sf_dir).select("prompt_id", "text")
    store = predictions.PredictionStore(spark, shared_path(spark, "predictions"), "length-logits")
    for rows in (teacher.filter(F.col("prompt_id") % 2 == 0), teacher):
        store.update(rows, "text", X.length_logit_predictor)
    return teacher, store


def q_prediction_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-33 through a store that two runs filled, joined back to the prompts."""
    teacher, store = _predicted(spark, sf_dir)
    joined = rewards.with_teacher(teacher, "text", store.read())
    return joined.select(
        "prompt_id", *[round6(F.get("probs", i)).alias(f"p_{label}") for i, label in enumerate(K.TEACHER_LABELS)]
    )


def q_prediction_store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-33: how many texts each run sent to the model; the second only unseen ones."""
    return _predicted(spark, sf_dir)[1].history()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
