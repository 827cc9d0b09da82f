"""Helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
import uuid
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.session import ensure_checkpoint_dir

# Rows a Python worker gets at once, and rows the ORC reader holds. Documents
# are a few KB on average and some are very long, so batches of Spark's default
# 10,000 and 4,096 rows can be large.
BATCH_ROWS = 256
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.orc.columnarReaderBatchSize")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to ``BATCH_ROWS``."""
    for key in BATCHES:
        if int(spark.conf.get(key)) > BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: the rows
    are computed once, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession, value: Any) -> Broadcast:
    """``value`` as a broadcast of bytes. Classes of this package go with it, so
    workers need not have the package; ``received`` reads it there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(docs: DataFrame) -> Column:
    """A hash of a row's values; maps and variants by their JSON."""
    odd = (T.MapType, T.VariantType)
    return F.xxhash64(
        *[F.to_json(F.struct(F.col(f.name))) if isinstance(f.dataType, odd) else F.col(f.name) for f in docs.schema.fields]
    )


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal doc_id; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
