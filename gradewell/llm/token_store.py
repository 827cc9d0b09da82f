"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom
filters on doc_id, stripes that are read in parallel."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.llm.byte_tokens import encoded, read_spec, shared_encoder
from gradewell.llm.common import small_batches

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) in global order of doc_id: nulls first,
    rows of one doc_id by a hash of their text."""
    keys = ["doc_id", F.xxhash64("text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (part, doc_id, part_start, n_tokens, ids) in order of doc_id.

    ``end_id`` closes every document. ``part`` numbers the ordered partitions,
    ``part_start`` counts the ids before the document in its partition.
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast({"spec": read_spec(tokenizer_path)})
    names = ["part", "doc_id", "part_start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, end = TaskContext.get().partitionId(), 0, np.uint32(end_id).tobytes()
        encoder = shared_encoder(spec)
        for batch, raw in encoded(encoder, batches):
            raw = [x + end for x in raw]
            sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"))
            )
            columns = [
                pa.array(np.full(len(raw), part, np.int32)),
                batch.column("doc_id"),
                pa.array(at + offsets[:-1]),
                pa.array(sizes),
                ids,
            ]
            at += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return in_order(docs).mapInArrow(
        run, f"part int, doc_id {id_type}, part_start long, n_tokens long, ids array<int>"
    )


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode ``docs`` and write the ids as ORC, one file a partition, in
    ascending doc_id order. Null texts are empty documents (the end id alone);
    an empty table gives a folder without rows; other columns are ignored."""
    encode_ids(docs, tokenizer_path, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids); ``start`` counts all ids before the
    document. With ``doc_ids``, the filter reaches ORC, where row indexes and
    Bloom filters skip stripes and row groups; ``start`` stays global.

    The prefix sum over partitions needs one number per file, from the two
    narrow columns alone; these numbers (16 bytes a file) are broadcast.
    """
    rows = spark.read.orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by ids_crc32: crc32 of the ids as little-endian
    unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            offsets = ids.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            own = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
