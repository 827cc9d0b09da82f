"""SimHash near-duplicates with bit-sliced comparison.

Two fingerprints within the radius agree in whole pieces of their bits, so
each fingerprint goes to the buckets of its pieces. In a bucket, bit planes
are stored vertically: a word holds one bit of 64 fingerprints. A fingerprint
is compared with 64 others at once by adding the differing planes in
carry-save counters, and a word is given up when all its lanes are too far.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import discard, free_names, row_hash, small_batches, stored
from gradewell.llm.components import components

SEED = 42
BITS = 64
BUCKET = 2048  # members a bucket may have; a larger one is cut into chunks
SLICE = 1 << 15  # words compared at once
ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = (ends - sizes)[:n].tolist()
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        each = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])]
        h = np.array(each, "<u8").view(np.uint8)
        counts += np.unpackbits(h, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", F.pandas_udf(run, "long")(F.col("text")).alias("fp"))


def pieces(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Tables of (first bit, bits) pieces, so that fingerprints within
    ``radius`` agree in all pieces of some table.

    With ``radius + c`` pieces, c of them are free of differing bits; a table
    is a choice of c pieces. c is the least that makes buckets of ``n``
    evenly spread fingerprints small.
    """
    chosen = 1
    while chosen < 5 and n / 2 ** (BITS * chosen // (radius + chosen)) > BUCKET / 4:
        chosen += 1
    count = radius + chosen
    cuts = [BITS * k // count for k in range(count + 1)]
    each = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(each, chosen)]


def bucketed(distinct: DataFrame, radius: int) -> DataFrame:
    """(table, key, i, j, fp): what is compared together. A bucket of more
    than ``BUCKET`` is cut into chunks by hash, and each pair (i, j) of chunks
    is a group; so no pair of members is lost and no group is unbounded."""
    tables = []
    for t, chosen in enumerate(pieces(distinct.count(), radius)):
        key, at = F.lit(0).cast("long"), 0
        for first, bits in chosen:
            part = F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)
            key, at = key.bitwiseOR(F.shiftleft(part, at)), at + bits
        tables.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    keyed = distinct.select("fp", F.inline(F.array(*tables)))
    sizes = keyed.groupBy("table", "key").count().where(F.col("count") > BUCKET)
    large = stored(sizes.select("table", "key", F.ceil(F.col("count") / BUCKET).cast("int").alias("k")), "large-buckets")
    cut = keyed.join(large, ["table", "key"], "left").withColumn("c", F.expr("pmod(xxhash64(fp), k)").cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("c"))
    groups = F.when(F.col("k").isNull(), F.array(F.lit(-1))).otherwise(others)
    paired = cut.select("table", "key", "fp", "c", F.explode(groups).alias("o"))
    return paired.select(
        "table",
        "key",
        F.coalesce(F.least("c", "o"), F.lit(0)).alias("i"),
        F.coalesce(F.greatest("c", "o"), F.lit(0)).alias("j"),
        "fp",
    )


def _add(counters: list[np.ndarray], plane: np.ndarray, at: int) -> None:
    """Add a plane of weight 2**at; the last counter stays set."""
    for k in range(at, len(counters) - 1):
        carry = counters[k] & plane
        counters[k] ^= plane
        plane = carry
    counters[-1] |= plane


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``."""
    over, equal = counters[-1].copy(), ~counters[-1]
    for k in reversed(range(len(counters) - 1)):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def close_words(fp: np.ndarray, planes: np.ndarray, lanes: np.ndarray, word: np.ndarray, radius: int):
    """Compare fp[x] with the 64 lanes of word[x]; ``lanes`` masks those that
    count. Yields (x, hits) for the x that have any."""
    alive = np.arange(len(fp))
    counters = [np.zeros(len(fp), np.uint64) for _ in range((radius + 1).bit_length() + 1)]
    for first in range(0, BITS, 8):
        differ = []
        for b in range(first, first + 8):
            differ.append(planes[b][word] ^ (np.uint64(0) - (fp >> np.uint64(b) & ONE)))
        for k in (0, 3):
            x, y, z = differ[k : k + 3]
            half = x ^ y
            _add(counters, half ^ z, 0)
            _add(counters, x & y | half & z, 1)
        x, y = differ[6:]
        _add(counters, x ^ y, 0)
        _add(counters, x & y, 1)
        near = lanes & ~_beyond(counters, radius)
        go = near != 0
        if not go.all():
            alive, fp, lanes, word, near = alive[go], fp[go], lanes[go], word[go], near[go]
            counters = [c[go] for c in counters]
        if not len(alive):
            return alive, near
    return alive, near


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``root`` with the sets of each u, v joined; a root is its own least."""
    while True:
        u, v = root[u], root[v]
        low, high = np.minimum(u, v), np.maximum(u, v)
        apart = low != high
        if not apart.any():
            return root
        u, v = low[apart], high[apart]
        np.minimum.at(root, v, u)
        while (shorter := root[root]).tolist() != root.tolist():
            root = shorter


def links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) that join all members of a group which are connected by
    steps of at most ``radius`` bits. Members of a group are adjacent."""
    n = len(fp)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, size)
    words = -(-size // 64)
    base = np.cumsum(words) - words
    word = np.repeat(base, size) + place // 64
    lane = (place % 64).astype(np.uint64)
    heads = np.flatnonzero(place % 64 == 0)
    planes = np.empty((BITS, int(words.sum())), np.uint64)
    for b in range(BITS):
        planes[b] = np.bitwise_or.reduceat((fp >> np.uint64(b) & ONE) << lane, heads)
    full = np.bitwise_or.reduceat(ONE << lane, heads)
    later = full[word] & ~((ONE << lane) | ((ONE << lane) - ONE))
    last = np.repeat(base + words - 1, size)

    count = last - word + 1
    ends = np.cumsum(count)
    total = int(ends[-1])
    root = np.arange(n)
    for at in range(0, total, SLICE):
        item = np.arange(at, min(at + SLICE, total))
        row = np.searchsorted(ends, item, "right")
        other = word[row] + item - (ends[row] - count[row])
        lanes = np.where(other == word[row], later[row], full[other])
        x, hits = close_words(fp[row], planes, lanes, other, radius)
        if len(x):
            at_x, bit = np.nonzero(np.unpackbits(hits.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
            root = _union(root, row[x[at_x]], heads[other[x[at_x]]] + bit)
    moved = np.flatnonzero(root != np.arange(n))
    return fp[moved], fp[root[moved]]


def linked(groups: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) over all groups of ``bucketed``."""
    keys = ["table", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            a, b = links(rows[:, 4].astype(np.uint64), np.concatenate([[0], np.cumsum(change)]), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            held.append(rows)
            size += len(rows)
            if size >= 1 << 15:
                rows = np.concatenate(held)
                # the last group may go on in the next batch
                whole = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
                cut = int(whole[-1]) + 1 if len(whole) else 0
                if cut:
                    yield solved(rows[:cut])
                held, size = [rows[cut:]], len(rows) - cut
        if size:
            yield solved(np.concatenate(held))

    ordered = groups.repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64 bits) and
    component_id, the least doc_id that is reached over links of at most
    ``radius`` differing bits, the row's own included.

    Words are runs without ASCII white space, A-Z in lower case; a text of
    fewer words than ``shingle`` is one shingle; null and blank texts have
    fingerprint 0 and are linked like any other. Rows with a null doc_id link
    too; a component of such rows alone has a null component_id.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = linked(bucketed(distinct.select("fp"), radius), radius)
    label = F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("fp").alias("node"))
    found = components(edges, distinct.select(F.col("fp").alias("node"), label.alias("label")))
    found = found.select(F.col("node").alias("fp"), F.col("label.least").alias("reached"))
    named = stored(
        distinct.join(found, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")),
        "components",
    )
    discard(distinct)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the least
    doc_id, null ids last, then the least hash of its text and of its row. Rows
    that are equal altogether are one document. All columns stay, whatever
    their names."""
    own, owner = free_names(docs, "own", "owner")
    chosen = F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"), row_hash(docs).alias("row")
    )
    named = docs.withColumn(own, chosen)
    found = near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), shingle, radius)
    # part by part, as a null within a struct equals none in a join
    parts = ["none", "id", "text", "row"]
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(owner)).distinct()
    same = F.lit(True)
    for part in parts:
        same = same & F.col(f"{own}.{part}").eqNullSafe(F.col(f"{owner}.{part}"))
    return named.join(keep, same, "left_semi").dropDuplicates([own]).drop(own)
