"""O-58: rewards watched while they are scored.

One streaming job keeps running sums per event-time window and group (stateful
aggregation under a watermark, update mode): each micro-batch appends the
windows that it changed, in a folder of its own, so a batch that runs again
after a failure replaces what it had written. The current figures are the
latest row of each window. A second, narrow job counts every row by group
without a watermark: what it has beyond the windows' rows came too late.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WINDOWS, SEEN = "windows", "seen"


@dataclass
class Tracking:
    """The two jobs, and the folder that they append to."""

    path: str
    queries: tuple[StreamingQuery, StreamingQuery]

    def await_all(self) -> None:
        for q in self.queries:
            q.awaitTermination()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def _append_batches(updates: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def running_rewards(
    scored: DataFrame, event_time: str, groups: list[str], reward: str, gate: str, window: str
) -> DataFrame:
    """Sums per window and group: rows, rewards that are not null, their sum,
    least and greatest, and rows whose gate is above 0. A batch or a stream."""
    own = F.window(event_time, window)
    return scored.groupBy(own.alias("window"), *groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(reward).alias("n_rewards"),
        F.sum(reward).alias("reward_sum"),
        F.min(reward).alias("min_reward"),
        F.max(reward).alias("max_reward"),
        F.count_if(F.col(gate) > 0).alias("passed"),
    )


def figures(sums: DataFrame, groups: list[str]) -> DataFrame:
    """(window_start, window_end, groups, n, mean_reward, min_reward,
    max_reward, gate_rate) of :func:`running_rewards`."""
    return sums.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *groups,
        "n",
        (F.col("reward_sum") / F.nullif("n_rewards", F.lit(0))).alias("mean_reward"),
        "min_reward",
        "max_reward",
        (F.col("passed") / F.col("n")).alias("gate_rate"),
    )


def track_rewards(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    event_time: str,
    groups: list[str],
    reward: str = "finance_reward",
    gate: str = "gate",
    window: str = "1 hour",
    watermark: str = "1 day",
    available_now: bool = False,
) -> Tracking:
    """Start the two jobs over a stream of scored rows (a stream from
    :func:`streams.stream_transform`'s operators, before its sink).

    State is a row per open window and group; a window closes when the
    greatest event time seen is ``watermark`` past its end, and rows that come
    for it later are counted by :func:`late_rows`. Rows without an event time
    belong to no window and are late, too. ``path`` and ``checkpoint`` must be
    on shared storage.
    """
    sums = running_rewards(scored.withWatermark(event_time, watermark), event_time, groups, reward, gate, window)
    seen = scored.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return Tracking(
        path,
        (
            _append_batches(sums, f"{path}/{WINDOWS}", f"{checkpoint}/{WINDOWS}", available_now),
            _append_batches(seen, f"{path}/{SEEN}", f"{checkpoint}/{SEEN}", available_now),
        ),
    )


def _latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row that the batches wrote for each key."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_gw_last"))
    return last.select(*keys, *[F.col(f"_gw_last.{c}").alias(c) for c in rest])


def current_rewards(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """The figures as of the last batch, a row per window and group."""
    return figures(_latest(spark, f"{path}/{WINDOWS}", ["window", *groups]), groups)


def reward_history(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """The figures as each batch left them, for a curve over time: a row per
    batch and window that it changed."""
    rows = spark.read.option("basePath", f"{path}/{WINDOWS}").parquet(f"{path}/{WINDOWS}")
    return figures(rows, ["batch", *groups])


def late_rows(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """(groups, seen, late): all rows of each group, and those in no window.
    Right once both jobs have read the same files."""
    kept = _latest(spark, f"{path}/{WINDOWS}", ["window", *groups]).groupBy(*groups).agg(F.sum("n").alias("_gw_kept"))
    all_rows = _latest(spark, f"{path}/{SEEN}", groups).select(*groups, F.col("n").alias("seen"))
    same: Column = F.lit(True)
    for g in groups:
        same = same & all_rows[g].eqNullSafe(kept[g])
    joined = all_rows.join(kept, same, "left")
    return joined.select(*[all_rows[g] for g in groups], "seen", (F.col("seen") - F.coalesce("_gw_kept", F.lit(0))).alias("late"))
