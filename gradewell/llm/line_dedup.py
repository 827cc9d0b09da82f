"""Line dedup with two Bloom filters.

One filter holds the line hashes seen once, the other those seen again. Tasks
send only 8-byte hashes to build them; the seen-again filter, of fixed size,
goes to all tasks. Lines that hit it are suspects, and only their digests are
shuffled to count documents exactly and to choose the one that keeps the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import free_names, small_batches, stored

SPACE = b" \t\n\x0b\x0c\r"
# Size of each filter: 2^27 bits in 64 blocks of 256 KB; a hash picks a block
# and two bits in it. More lines than bits only make more suspects.
BLOCK_BITS, BLOCKS = 21, 64
FLUSH = 500_000  # hashes a task gathers before it sends them


def line_keys(text: str | None, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """(place, key) of the lines whose key has ``min_chars`` code points."""
    for i, line in enumerate((text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            yield i, key


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    return (h & mask).astype(np.int64), (h >> np.uint64(BLOCK_BITS) & mask).astype(np.int64)


def _blocks(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64)


def _sent(once: set[int], again: set[int]) -> Iterator[pa.RecordBatch]:
    for seen_again, hashes in ((False, once - again), (True, again)):
        h = np.sort(np.fromiter(hashes, np.uint64, len(hashes)))
        cuts = np.searchsorted(_blocks(h), np.arange(BLOCKS + 1)).tolist()
        full = [b for b in range(BLOCKS) if cuts[b] < cuts[b + 1]]
        columns = [
            pa.array(full, pa.int32()),
            pa.array([seen_again] * len(full), pa.bool_()),
            pa.array([h[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["block", "again", "hashes"])


def seen_again(docs: DataFrame, min_chars: int) -> bytes:
    """Bits of the seen-again filter over all lines of all documents (16 MB)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[int] = set()
        again: set[int] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = {xxhash.xxh64_intdigest(k) for _, k in line_keys(text, min_chars)}
                again |= once & own
                once |= own
            if len(once) > FLUSH:
                yield from _sent(once, again)
                once, again = set(), set()
        yield from _sent(once, again)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, known, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if block not in filters:
                    filters[block] = np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
                once, again = filters[block]
                a, b = _places(np.frombuffer(raw, np.uint64))
                hit = np.ones(len(a), bool) if known else once[a] & once[b]
                again[a[hit]] = again[b[hit]] = True
                once[a] = once[b] = True
        rows = [(k, np.packbits(again, bitorder="little").tobytes()) for k, (_, again) in filters.items()]
        columns = [pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "bits"])

    sent = docs.select("text").mapInArrow(gather, "block int, again boolean, hashes binary")
    merged = sent.repartition(BLOCKS, "block").mapInArrow(merge, "block int, bits binary")
    empty = bytes((1 << BLOCK_BITS) // 8)
    bits = {r.block: bytes(r.bits) for r in merged.collect()}  # bounded: BLOCKS rows of 256 KB
    return b"".join(bits.get(b, empty) for b in range(BLOCKS))


def unnamed() -> Column:
    """Tells rows without a doc_id apart, so that they are no hot key."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def suspects(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct (digest, doc_id, row) of the lines that hit the seen-again
    filter; the digest is the 128-bit xxh3 hash of the line's key, ``row`` a
    hash of the text where the doc_id is null, else null."""
    bits = docs.sparkSession.sparkContext.broadcast(seen_again(docs, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = np.frombuffer(bits.value, np.uint8)

        def has(at: np.ndarray) -> np.ndarray:
            return again[at >> 3] >> (at & 7).astype(np.uint8) & 1

        for batch in batches:
            row, keys = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {k for _, k in line_keys(text, min_chars)}
                keys += own
                row += [i] * len(own)
            h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
            a, b = _places(h)
            base = _blocks(h) << BLOCK_BITS
            hit = np.flatnonzero(has(base + a) & has(base + b)).tolist()
            digests = pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit], pa.binary())
            at = pa.array([row[i] for i in hit], pa.int64())
            own = [batch.column(c).take(at) for c in ("doc_id", "row")]
            yield pa.RecordBatch.from_arrays([digests, *own], ["digest", "doc_id", "row"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", "text", unnamed().alias("row"))
    found = named.mapInArrow(run, f"digest binary, doc_id {id_type}, row long")
    return found.distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: str = "last") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the columns
    n_lines (before) and n_dropped (columns of these names are replaced).

    A line's key is the line stripped of ASCII white space, with A-Z in lower
    case. A key of at least ``min_chars`` code points in at least ``min_docs``
    documents stays only in the document with the largest doc_id (``keep``
    "first": the smallest), there with all its repeats. Rows with one doc_id
    are one document. Null doc_ids are one document that is never chosen. A
    null text is one empty line and comes back as the empty text. The order
    of lines stays; an empty table stays empty. Columns of other names stay as
    they are.
    """
    small_batches(docs.sparkSession)
    held = stored(suspects(docs, min_chars), "line-suspects")
    choose = F.max if keep == "last" else F.min
    found_in = F.count("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    common = held.groupBy("digest").agg(found_in.alias("n"), choose("doc_id").alias("keeper"))
    common = stored(common.where(F.col("n") >= min_docs).select("digest", "keeper"), "line-repeats")
    lost = held.join(common, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # bounded by the document's own lines
    lost_id, lost_row, gone, left = free_names(docs, "lost_id", "lost_row", "gone", "left")
    lists = lost.groupBy(F.col("doc_id").alias(lost_id), F.col("row").alias(lost_row)).agg(F.collect_list("digest").alias(gone))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, dropped in batches:
            out = []
            for text, gone in zip(texts, dropped):
                text = text or ""
                if gone is None:
                    out.append((text, 0))
                    continue
                gone = set(map(bytes, gone))
                drop = {i for i, k in line_keys(text, min_chars) if xxhash.xxh3_128_digest(k) in gone}
                out.append(("\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop]), len(drop)))
            yield pd.DataFrame(out, columns=["text", "n_dropped"])

    same = F.col("doc_id").eqNullSafe(F.col(lost_id)) & unnamed().eqNullSafe(F.col(lost_row))
    joined = docs.join(lists, same, "left")
    before = F.coalesce(F.col("text"), F.lit(""))
    lines = F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1
    done = joined.withColumn(left, F.pandas_udf(run, "text string, n_dropped long")(F.col("text"), F.col(gone)))
    columns = [F.col(f"{left}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*columns, lines.cast("long").alias("n_lines"), F.col(f"{left}.n_dropped").alias("n_dropped"))
