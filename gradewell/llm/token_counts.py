"""Token counts by a separator scan of flat token files.

A flat file holds ids of a fixed width and nothing else: no index, no lengths,
no document ids. Each block is searched for the end-of-document id with
numpy; prefix sums over blocks, then over files, give every block its place,
and a prefix maximum gives it the end of the document before its first one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.llm.byte_tokens import encoded, read_spec, shared_encoder
from gradewell.llm.common import small_batches, stored
from gradewell.llm.token_store import in_order

# Ids as big-endian unsigned 16-bit integers. The end-of-document id is beyond
# the vocabulary (50,257 ids), so no text yields it, and its two bytes are a
# character of UTF-8 that Spark's text writer can add.
KIND = ">u2"
END_ID = 0xC580
BLOCK_IDS = 1 << 20
# Blocks a task reads from one file in a row, and the most such tasks at once.
RANGE_BLOCKS, MOST_TASKS = 32, 100_000
# Subfolders of a written folder: the flat files, and which document stands where.
PART, FLAT, SIDE = "part", "flat", "documents"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def check_width(spec: str, end_id: int, kind: str) -> None:
    """Raise ``ValueError`` if an id of the tokenizers file ``spec`` does not
    fit ``kind``, or if it is the end id, which would split documents."""
    read = json.loads(spec)
    vocab = read["model"]["vocab"]  # a list of (token, score) in unigram files
    ids = set(vocab.values()) if isinstance(vocab, dict) else set(range(len(vocab)))
    ids |= {added["id"] for added in read.get("added_tokens") or ()}
    most = np.iinfo(kind).max
    if end_id > most or max(ids, default=0) > most:
        raise ValueError(f"ids to {max(ids, default=0)} and end id {end_id} do not fit {np.dtype(kind).itemsize} bytes")
    if end_id in ids:
        raise ValueError(f"end id {end_id} is in the vocabulary")


def write_flat(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    kind: str = KIND,
    ordered: bool = False,
    compression: str = "none",
) -> None:
    """Ids of every text as flat files, each document closed by ``end_id``,
    whose bytes must be valid UTF-8. Null texts are the end id alone. A
    vocabulary that ``kind`` does not hold, or that has ``end_id``, is refused.

    Spark's text writer does the writing: a document's bytes are a line, the
    end id is the line separator. Documents are in the order of the rows, or
    with ``ordered`` ascending by doc_id, which shuffles the texts.
    ``compression`` is none or gzip, of each file as a whole.

    The same tasks write a side table: a line (place in the file, doc_id) for
    each document, in a file of the same name in another subfolder. Both files
    of a task are open at once, so that nothing is sorted.
    """
    closing = np.array(end_id, kind).tobytes().decode()
    text = read_spec(tokenizer_path)
    check_width(text, end_id, kind)
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast({"spec": text})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = shared_encoder(spec, special=False), 0
        for batch, each in encoded(encoder, batches):
            raw = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in each]
            ids = batch.column("doc_id").to_pylist()
            raw += [f"{place + k} {'' if i is None else i}".encode() for k, i in enumerate(ids)]
            place += len(ids)
            parts = [FLAT] * len(ids) + [SIDE] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(parts)], ["value", PART])

    spark = docs.sparkSession
    kept = (in_order(docs) if ordered else docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    rows = kept.mapInArrow(run, f"value binary, {PART} string").select(F.col("value").cast("string"), PART)
    before = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, "2")
    try:
        rows.write.partitionBy(PART).option("lineSep", closing).text(path, compression=compression)
    finally:
        spark.conf.set(WRITERS, before)


def read_places(spark: SparkSession, path: str, id_type: str, end_id: int = END_ID, kind: str = KIND) -> DataFrame:
    """The side table of a written folder: (name, place, doc_id), the name of
    the flat file and the place of the document in it, 0 first."""
    closing = np.array(end_id, kind).tobytes().decode()
    lines = spark.read.option("lineSep", closing).text(path)
    if PART in lines.columns:  # else no document was written
        lines = lines.where(F.col(PART) == SIDE)
    own = F.split("value", " ", 2)
    return lines.select(
        F.substring_index("_metadata.file_path", "/", -1).alias("name"),
        own[0].cast("long").alias("place"),
        F.when(own[1] != "", own[1]).cast(id_type).alias("doc_id"),
    )


def open_file(path: str, packed: bool) -> pa.NativeFile:
    """``path`` opened by pyarrow: a mounted folder, HDFS or an object store. A
    packed file opens as a stream of its unpacked bytes."""
    if path.startswith(("file:", "/")):
        store, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, place = fs.FileSystem.from_uri(path)
    return store.open_input_stream(place, compression="gzip") if packed else store.open_input_file(place)


def pieces(stream: BinaryIO, size: int, most: int | None = None) -> Iterator[bytes]:
    """The next ``most`` pieces (None: all) of ``size`` bytes, the last one
    shorter where the stream ends."""
    while most is None or most > 0:
        held = stream.read(size)
        while len(held) < size and (more := stream.read(size - len(held))):
            held += more
        if held:
            yield held
        if len(held) < size:
            return
        most = None if most is None else most - 1


def scan_blocks(
    spark: SparkSession, path: str, end_id: int = END_ID, kind: str = KIND, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """One row per block: (file, block, size, ends), ``ends`` the places of the
    end id in the block.

    Spark lists the files with their lengths; each range of ``RANGE_BLOCKS``
    blocks of a file is a row, and the rows are dealt evenly to tasks, which
    open the files themselves (``open_file``) and hold one block at a time. So a
    file of any length is read by many tasks. A gzip file cannot be entered in
    its middle: it is one range, unpacked block by block.
    """
    width = np.dtype(kind).itemsize
    step = block_ids * width
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int64()))]
    )
    most = RANGE_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                packed = name.endswith(".gz")
                with open_file(name, packed) as stream:
                    if not packed:
                        stream.seek(first * step)
                    for k, raw in enumerate(pieces(stream, step, None if packed else most)):
                        part = np.frombuffer(raw, kind, count=len(raw) // width)
                        row = {"file": name, "block": first + k, "size": len(part)}
                        row["ends"] = np.flatnonzero(part == end_id)
                        yield pa.RecordBatch.from_pylist([row], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if PART in files.columns:
        files = files.where(F.col(PART) == FLAT)
    last = F.when(F.col("path").endswith(".gz"), F.lit(0)).otherwise(F.floor((F.col("length") - 1) / (step * most)))
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("n"))
    ranges = ranges.select("path", (F.col("n") * most).alias("first"))
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks).mapInArrow(run, "file string, block long, size long, ends array<long>")


def count_tokens(
    spark: SparkSession, path: str, end_id: int = END_ID, kind: str = KIND, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """One row per document: doc_index (0 first), start (ids before it) and
    n_tokens (with its end id), over all files in order of their names.
    """
    return scan_documents(spark, path, end_id, kind, block_ids).select("doc_index", "start", "n_tokens")


def count_documents(spark: SparkSession, path: str, id_type: str = "long", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document of a folder that ``write_flat`` wrote: doc_id,
    doc_index, start and n_tokens.

    Scanned counts get their doc_id by file and place. doc_index and start are
    those of the documents in order of doc_id, nulls first, then n_tokens, so
    they do not depend on the files the rows came to. Only numbers are shuffled.
    """
    scanned = scan_documents(spark, path, block_ids=block_ids).where("place is not null")
    counts = scanned.select(F.substring_index("file", "/", -1).alias("name"), "place", "n_tokens")
    named = counts.join(read_places(spark, path, id_type), ["name", "place"]).select("doc_id", "n_tokens")
    ordered = named.repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens")
    rows = stored(ordered.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("n")), "document-counts")
    rows = rows.withColumn("range", F.shiftright("n", 33))
    past = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("range").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("size"))
    bases = totals.select(
        "range",
        F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("size").over(past), F.lit(0)).alias("size_before"),
    )
    earlier = Window.partitionBy("range").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return within.join(bases, "range").select(
        "doc_id",
        (F.col("rows_before") + F.col("n").bitwiseAND((1 << 33) - 1)).alias("doc_index"),
        (F.col("size_before") + F.col("earlier")).alias("start"),
        "n_tokens",
    )


def scan_documents(
    spark: SparkSession, path: str, end_id: int = END_ID, kind: str = KIND, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """One row per document: doc_index, start and n_tokens, and the file and
    place in it of its end (null for a document without end).

    The files are one stream, so a document may cross blocks and files. Ids
    after the last end id are a document without end; an empty folder gives
    no rows. Only block totals go through the windows, a few numbers for each
    block, and one row per file through the last one; the places of the ends
    are joined to their block afterwards.
    """
    blocks = stored(scan_blocks(spark, path, end_id, kind, block_ids), "token-blocks")
    narrow = blocks.select(
        "file", "block", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last_end")
    )
    files = narrow.groupBy("file").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    past = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select(
        "file",
        F.coalesce(F.sum("size").over(past), F.lit(0)).alias("file_at"),
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("file_index"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.join(bases, "file").select(
        "file",
        "block",
        "n",
        "last_end",
        (F.col("file_at") + F.coalesce(F.sum("size").over(earlier), F.lit(0))).alias("at"),
        (F.col("file_index") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("index"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("file_place"),
        "size",
    )
    # the last end before a block: in its file, else in the files before it
    last = placed.withColumn("last", F.col("at") + F.col("last_end") + 1)
    per_file = last.groupBy("file").agg(F.max("last").alias("file_last"), F.max(F.col("at") + F.col("size")).alias("file_end"))
    before = per_file.select(
        "file", F.coalesce(F.max("file_last").over(past), F.lit(0)).alias("before")
    )
    ready = last.join(before, "file").select(
        "file",
        "block",
        "file_place",
        "at",
        "index",
        F.greatest(F.coalesce(F.max("last").over(earlier), F.lit(0)), "before").alias("open_at"),
    )
    each = ready.join(blocks.select("file", "block", "ends"), ["file", "block"]).select("file", "file_place", "at", "index", "open_at", "ends", F.posexplode("ends").alias("k", "end"))
    whole = each.select(
        (F.col("index") + F.col("k")).alias("doc_index"),
        F.when(F.col("k") == 0, F.col("open_at"))
        .otherwise(F.col("at") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
        .alias("start"),
        (F.col("at") + F.col("end") + 1).alias("stop"),
        "file",
        (F.col("file_place") + F.col("k")).alias("place"),
    ).select("doc_index", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "file", "place")
    totals = last.agg(
        F.coalesce(F.max("last"), F.lit(0)).alias("start"),
        F.max(F.col("at") + F.col("size")).alias("stop"),
        F.sum("n").alias("doc_index"),
    )
    tail = totals.where("stop > start").select("doc_index", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
    return whole.unionByName(tail, allowMissingColumns=True)
