"""O-57, O-58: the batch operators on arriving files (Structured Streaming).

Both jobs are stateless per row (projection, stream-static join), so they
run in append mode without watermarks; progress and exactly-once output live
in the checkpoint location, which must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import to_prompt_reference
from ..operators.rewards import finance_reward, score_verifiable


def _start(df: DataFrame, sink_path: str, checkpoint: str, fmt: str, available_now: bool, query_name: str | None):
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink_path)


def stream_transform(
    stream: DataFrame,
    transform,
    sink_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """Any per-row batch operator (DataFrame -> DataFrame: projections,
    filters, stream-static joins) applied to arriving files, e.g.
    ``render.format_chart`` for chart training rows (O-57)."""
    return _start(transform(stream), sink_path, checkpoint, fmt, available_now, query_name)


def stream_normalise(
    stream: DataFrame,
    sink_path: str,
    checkpoint: str,
    keep: list[str] | None = None,
    fmt: str = "parquet",
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """O-57: arriving generic rows -> (prompt, reference) files.

    The same plan-time field probing as the batch operator: the stream's
    schema is fixed when it is declared.
    """
    return _start(to_prompt_reference(stream, keep=keep), sink_path, checkpoint, fmt, available_now, query_name)


def stream_verifiable_rewards(
    completions: DataFrame,
    references: DataFrame,
    key: str | list[str],
    sink_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """O-58 (verifiable): arriving completions LEFT JOIN a static reference
    table, scored per row (stream-static join, append)."""
    scored = score_verifiable(completions, references, key)
    return _start(scored, sink_path, checkpoint, fmt, available_now, query_name)


def stream_finance_rewards(
    completions: DataFrame,
    teacher_probs: DataFrame,
    key: str,
    sink_path: str,
    checkpoint: str,
    fmt: str = "parquet",
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """O-58 (financial): arriving completions scored against a static
    teacher-probability table."""
    scored = finance_reward(completions, teacher_probs, key)
    return _start(scored, sink_path, checkpoint, fmt, available_now, query_name)
