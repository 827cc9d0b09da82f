"""O-47..O-52: accuracy, group-relative advantage, best-of-group, summaries, logs.

Group statistics are aggregations (partial per task, then final), joined
back by key: a prompt group holding a third of all rows is pre-aggregated on
every task instead of being buffered whole by one window task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import round6
from ..session import reliable_checkpoint
from ..functions.text import normalize_text


def is_correct(answer: Column | str, truth: Column | str, truth_type: T.DataType) -> Column:
    """Exact match after O-9 normalisation; a list of truths matches any element (Q-27)."""
    a = normalize_text(F.col(answer) if isinstance(answer, str) else answer)
    t = F.col(truth) if isinstance(truth, str) else truth
    if isinstance(truth_type, T.ArrayType):
        return F.coalesce(F.exists(t, lambda g: normalize_text(g.cast("string")) == a), F.lit(False))
    return normalize_text(t.cast("string")) == a


def accuracy(
    results: DataFrame,
    answer: str = "model_answer",
    truth: str = "ground_truth",
    status: str = "processing_status",
) -> DataFrame:
    """O-47: one row: samples, per-status counts, correct answers, accuracy over all samples."""
    ok = F.col(status) == "success"
    correct = ok & is_correct(answer, truth, results.schema[truth].dataType)
    return results.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count(F.when(ok, 1)).alias("n_success"),
        F.count(F.when(F.col(status) == "error", 1)).alias("n_error"),
        F.count(F.when(correct, 1)).alias("n_correct"),
    ).withColumn(
        "accuracy", F.when(F.col("n_samples") > 0, round6(F.col("n_correct") / F.col("n_samples")))
    )


def status_counts(results: DataFrame, status: str = "processing_status") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def group_advantage(
    scores: DataFrame,
    group: str,
    reward: str = "reward",
    out: str = "advantage",
    eps: float = 1e-4,
    materialize: bool = False,
) -> DataFrame:
    """O-48: ``(r - mean) / (std + eps)`` within each prompt group (sample std);
    0 for a group of one or whose rewards are all equal.

    The statistics are an aggregation joined back by group key (skew-safe).
    The scores feed both sides, so with ``materialize=True`` they are first
    written once to the reliable checkpoint folder (pass a narrow frame: keys
    and reward) instead of being computed twice.
    """
    if materialize:
        scores = reliable_checkpoint(scores)
    stats = scores.groupBy(group).agg(
        F.avg(reward).alias("_gw_mean"),
        (F.stddev_samp(reward) + F.lit(eps)).alias("_gw_den"),
        ((F.count(F.lit(1)) <= 1) | (F.min(reward) == F.max(reward))).alias("_gw_flat"),
    )
    # narrow stats side (key, mean, std + eps, flag): broadcast while it fits
    adv = (F.col(reward) - F.col("_gw_mean")) / F.col("_gw_den")
    return (
        scores.join(stats, group, "inner")
        .withColumn(out, F.when(F.col("_gw_flat"), F.lit(0.0)).otherwise(adv))
        .drop("_gw_mean", "_gw_den", "_gw_flat")
    )


def best_of_group(
    scores: DataFrame,
    group: str,
    reward: str,
    tie_keys: list[str],
    carry: list[str] | None = None,
) -> DataFrame:
    """O-49: the top completion per group: highest reward, compared exactly
    (null last), ties to the smallest ``tie_keys`` in order (any orderable
    type).

    One ``min(struct)`` aggregation: each task reduces its own rows before the
    shuffle, so a group with a third of all rows sends one row per task. No
    group is buffered whole.
    """
    carry = list(carry or [])
    rank = F.struct(
        F.col(reward).isNull().alias("_null"),
        (-F.col(reward)).alias("_r"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(tie_keys)],
        *[F.col(c).alias(f"_c_{c}") for c in [reward] + carry],
    )
    best = scores.groupBy(group).agg(F.min(rank).alias("_gw_best"), F.count(F.lit(1)).alias("n_generations"))
    return best.select(
        F.col(group),
        *[F.col(f"_gw_best._k{i}").alias(k) for i, k in enumerate(tie_keys)],
        *[F.col(f"_gw_best._c_{c}").alias(c) for c in carry],
        F.col(f"_gw_best._c_{reward}").alias(reward),
        F.col("n_generations"),
    )


def reward_summary(
    scored: DataFrame,
    by: list[str],
    reward: str,
    components: list[str],
    gate: str = "gate",
    grouping: str = "rollup",
) -> DataFrame:
    """O-50: count, mean/min/max reward, gate pass rate and mean of each component,
    per group and in total. ``grouping`` is ``rollup`` (hierarchy + total) or
    ``cube`` (every combination of ``by``); ``is_total`` is the grouping id
    (0 for the finest groups)."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        round6(F.avg(reward)).alias("mean_reward"),
        round6(F.min(reward)).alias("min_reward"),
        round6(F.max(reward)).alias("max_reward"),
        round6(F.avg(F.col(gate))).alias("gate_rate"),
        *[round6(F.avg(c)).alias(f"mean_{c}") for c in components],
        F.grouping_id().cast("int").alias("is_total"),
    ]
    if grouping == "cube":
        return scored.cube(*by).agg(*aggs)
    if grouping == "rollup":
        return scored.rollup(*by).agg(*aggs)
    raise ValueError(f"unknown grouping {grouping!r}")


def training_curve(log: DataFrame, step: str = "step", loss: str = "loss", extra=("reward", "kl")) -> DataFrame:
    """O-51: log rows with both step and loss; reward and kl may be null.
    Log order is a column of the input (nothing is sorted)."""
    present = [c for c in extra if c in log.columns]
    position = [c for c in ("log_position",) if c in log.columns]
    return log.filter(F.col(step).isNotNull() & F.col(loss).isNotNull()).select(
        *position, F.col(step), F.col(loss), *[F.col(c) for c in present]
    )


def best_checkpoint(log: DataFrame, step: str = "step", metric: str = "eval_loss") -> DataFrame:
    """O-52: least ``eval_loss``, ties to the lowest step, as one row."""
    evals = log.filter(F.col(metric).isNotNull() & ~F.isnan(F.col(metric)))
    best = F.min(F.struct(F.col(metric).alias("m"), F.col(step).alias("s")))
    return evals.agg(
        best.alias("_gw_best"),
        F.count(F.lit(1)).alias("n_evaluations"),
        F.max(step).alias("last_eval_step"),
    ).select(
        F.col("_gw_best.s").alias("best_step"),
        F.col("_gw_best.m").alias("best_eval_loss"),
        "n_evaluations",
        "last_eval_step",
    )


def last_checkpoints(log: DataFrame, n: int = 3, step: str = "step", metric: str = "eval_loss") -> DataFrame:
    """Checkpoints kept by a total limit of n: the n latest evaluated steps (top-k)."""
    return log.filter(F.col(metric).isNotNull()).orderBy(F.col(step).desc()).limit(n)
