"""O-8, O-57 with bad lines: good rows to one sink, malformed lines to another.

Each micro-batch has a folder of its own in both sinks, named by its number. A
batch that is tried again after a failure overwrites what the failed try left;
the folder of the bad lines is written last, and its success marker makes the
batch count in both. So after any restart each line is in exactly one sink, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import CORRUPT, stream_examples

BAD_SCHEMA = "file string, line string"


def _folder(sink: str, number: int) -> str:
    return f"{sink.rstrip('/')}/batch={number:012d}"


def _committed(spark: SparkSession, bad: str) -> list[int]:
    """Numbers of the batches that count, from one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{bad.rstrip('/')}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def stream_quarantine(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    good: str,
    bad: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int | None = None,
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """Arriving JSON lines: rows that fit ``schema`` go through ``transform``
    (any batch operator, :func:`normalize.to_prompt_reference` for example) to
    ``good``; lines that are no JSON object, or hold a value of another type,
    go unchanged to ``bad`` with the name of their file. Blank lines are
    skipped. Read both with :func:`read_quarantine`.

    ``good``, ``bad`` and ``checkpoint`` belong together: sinks that already
    hold batches are refused with a checkpoint that does not know them.
    """
    if _committed(spark, bad) and not _exists(spark, f"{checkpoint.rstrip('/')}/offsets"):
        raise ValueError(f"{bad} holds batches of another checkpoint than {checkpoint}")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    lines = stream_examples(spark, path, "value string", fmt="text", files_per_batch=files_per_batch)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    row = F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    parsed = lines.withColumn("row", row)
    fits = F.col("row").isNotNull() & F.col(f"row.{CORRUPT}").isNull()

    def put(batch: DataFrame, number: int) -> None:
        if number in _committed(batch.sparkSession, bad):
            return  # written whole by a try that was lost before its progress was noted
        rows = batch.filter(fits).select("row.*").drop(CORRUPT)
        (transform(rows) if transform else rows).write.mode("overwrite").parquet(_folder(good, number))
        batch.filter(~fits).select("file", "line").write.mode("overwrite").parquet(_folder(bad, number))

    writer = parsed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_quarantine(
    spark: SparkSession, good: str, bad: str, good_schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of all batches that count; ``good_schema`` is that
    of the transformed rows."""
    numbers = _committed(spark, bad)
    if not numbers:
        return spark.createDataFrame([], good_schema), spark.createDataFrame([], BAD_SCHEMA)
    return (
        spark.read.schema(good_schema).parquet(*[_folder(good, n) for n in numbers]),
        spark.read.schema(BAD_SCHEMA).parquet(*[_folder(bad, n) for n in numbers]),
    )
