"""Periodic runs of words, found in tiles of each period octave.

A run is a stretch of words with smallest period q, long enough to be counted,
that no neighbouring word extends. Periods are searched by octave, P to 2P - 1.
Every multiple of P is a boundary; a run of three periods holds a boundary b
with the two periods from b on, so a Z-function forward from b and one backward
from it give the stretch of that period around b, as far as a window of 2P
words before b and 5P behind it reaches.

Boundaries with two equal periods behind, by a rolling hash, are candidates
where a document has nearly a whole run behind one; documents are exploded into tiles, overlapping slices of
the words around the candidates of an octave. Tiles are shuffled and solved on
their own. What they find are fragments of runs: fragments of one document and
period that share a period's worth of words are one run, so they are shuffled by
document and period and stitched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import small_batches, stored

LEAST_WORDS = 24  # of a run
LEAST_PERIODS = 3
TILE_WORDS = 4096  # at least; a tile of a long period is eight of it
BEFORE, BEHIND = 2, 5  # window around a boundary, in P
MULTIPLIER = 0x9E3779B97F4A7C15


def scattered(ids: np.ndarray) -> np.ndarray:
    """64-bit numbers that tell ids apart when they are added up."""
    x = ids.astype(np.uint64) * np.uint64(MULTIPLIER)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of every stretch of some ids, by prefix sums. Equal stretches
    have equal hashes; equal hashes of different ones only cost work, as the
    Z-functions decide."""

    def __init__(self, ids: np.ndarray):
        factors = np.full(len(ids) + 1, MULTIPLIER, np.uint64)
        factors[0] = 1
        self.power = np.multiply.accumulate(factors)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(scattered(ids) * self.power[:-1], out=self.sums[1:])

    def same(self, at: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Are the ``size`` items from ``at`` the ones that stand ``q`` later?"""
        here = self.sums[at + size] - self.sums[at]
        return here * self.power[q] == self.sums[at + q + size] - self.sums[at + q]


def candidates(
    flat: np.ndarray, starts: np.ndarray, longest: int, least_words: int, least_periods: int
) -> Iterator[tuple[int, np.ndarray]]:
    """(P, boundaries) of each octave over some texts in a row, whose
    separators occur once and whose first items are ``starts``.

    A boundary is one where two periods follow, by hashes. Of a run that
    counts, the first boundary has nearly all of it behind: texts without such
    a boundary for a period have no run of it.
    """
    rolling, hashes, p = Rolling(flat), scattered(flat), 1
    factor = MULTIPLIER
    while least_periods * p <= longest:
        rows = -(-len(hashes) // p)
        grid = np.zeros(rows * p, np.uint64)
        grid[: len(hashes)] = hashes
        grid = grid.reshape(rows, p)
        row, more = np.nonzero(grid[1:] == grid[:-1, :1])
        at, q = row * p, more + p
        inside = at + 2 * q <= len(flat)
        at, q = at[inside], q[inside]
        twice = rolling.same(at, q, q)
        at, q = at[twice], q[twice]
        key = (np.searchsorted(starts, at, "right") - 1) * p + q - p
        most = np.maximum(least_words, least_periods * q) - p + 1 - q
        whole = at + q + most <= len(flat)
        whole[whole] = rolling.same(at[whole], q[whole], most[whole])
        yield p, np.unique(at[np.isin(key, key[whole])])
        if len(hashes) <= p:
            return
        hashes = hashes[:-p] * np.uint64(factor) + hashes[p:]
        factor, p = factor * factor % 2**64, 2 * p


def z_values(s: list[int], reach: int) -> list[int]:
    """Z-function: how many items from i on equal the first ones, for the i
    from 1 up to ``reach``."""
    n = len(s)
    z = [0] * reach
    left = right = 0
    for i in range(1, reach):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[i + k] == s[k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments_at(s: list[int], b: int, p: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches around boundary b whose smallest
    period is one of the octave, at least two periods from b on."""
    first, last = max(0, b - BEFORE * p), min(len(s), b + BEHIND * p)
    top = min(2 * p, last - b)
    forward = z_values(s[b:last], top)
    passed = [q for q in range(p, top) if forward[q] >= q]
    if not passed:
        return
    # the smallest period of the first q words: the least i with i + z[i] >= q
    reach, most = [0] * top, 0
    for i in range(1, top):
        most = reach[i] = max(most, i + forward[i])
    passed = [q for q in passed if (d := bisect_left(reach, q, 1, q)) >= q or q % d]
    if not passed:
        return
    before = s[first:b][::-1]
    around = s[first : b + top - 1][::-1]  # item j is word b + top - 2 - j
    backward = z_values([*before, -1, *around], len(before) + 1 + top)
    for q in passed:
        back = backward[len(before) + top - q] if before else 0
        yield q, b - back, b + q + forward[q]


def merged(spans: list[tuple[int, int]], q: int) -> Iterator[tuple[int, int]]:
    """Stretches of one period, those that share q words or more made one."""
    start, end = None, None
    for a, b in sorted(spans):
        if start is not None and a <= end - q:
            end = max(end, b)
            continue
        if start is not None:
            yield start, end
        start, end = a, b
    if start is not None:
        yield start, end


def solve(ids: np.ndarray, boundaries: np.ndarray, p: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of a tile's fragments, places in the tile."""
    s = ids.tolist()
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for b in boundaries.tolist():
        for q, start, end in fragments_at(s, b, p):
            found[q].append((start, end))
    for q, spans in found.items():
        for start, end in merged(spans, q):
            yield q, start, end


def explode(docs: DataFrame, least_words: int, least_periods: int) -> DataFrame:
    """One row per document (key, doc_id, n_words, text with one space between
    words, tiled) and one per tile (key, octave, first, ids, boundaries)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            split = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in split])
            number: dict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            # each text is followed by a number of its own
            starts = np.cumsum(sizes + 1) - sizes - 1
            flat = np.empty(int((sizes + 1).sum()), np.int64)
            for at, own in zip(starts.tolist(), split):
                flat[at : at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            flat[starts + sizes] = -1 - np.arange(len(split))
            tiles = []
            for p, at in candidates(flat, starts, int(sizes.max(initial=0)), least_words, least_periods):
                owner = np.searchsorted(starts, at, "right") - 1
                place = at - starts[owner]
                tile = place // max(TILE_WORDS, 8 * p)
                cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(tile) != 0)) + 1
                for k, b in zip(owner[np.append(0, cuts)] if len(at) else (), np.split(place, cuts)):
                    first = max(0, int(b[0]) - BEFORE * p)
                    last = min(int(sizes[k]), int(b[-1]) + BEHIND * p)
                    ids = flat[starts[k] + first : starts[k] + last].astype("<i4")
                    tiles.append((int(k), p, first, ids.tobytes(), (b - first).astype("<i8").tobytes()))
            n, more = len(split), len(tiles)
            tiled = np.zeros(n, bool)
            tiled[[t[0] for t in tiles]] = True
            own = list(zip(*tiles)) if tiles else [()] * 5
            nulls = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*range(key, key + n), *(key + k for k in own[0])], pa.int64()),
                    pa.concat_arrays([batch.column("doc_id"), nulls(more, batch.column("doc_id").type)]),
                    pa.concat_arrays([pa.array(sizes, pa.int64()), nulls(more, pa.int64())]),
                    pa.array([*(b" ".join(x).decode("utf-8", "surrogatepass") for x in split), *[None] * more], pa.string()),
                    pa.array([*tiled.tolist(), *[None] * more], pa.bool_()),
                    *(pa.array([None] * n + list(x), kind) for x, kind in zip(own[1:], (pa.int64(), pa.int64(), pa.binary(), pa.binary()))),
                ],
                ["key", "doc_id", "n_words", "text", "tiled", "octave", "first", "ids", "boundaries"],
            )
            key += n

    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"key long, doc_id {id_type}, n_words long, text string, tiled boolean"
    kind += ", octave long, first long, ids binary, boundaries binary"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def fragments(tiles: DataFrame) -> DataFrame:
    """(key, period, start, end) of every tile's fragments, places in the
    document. Tiles are dealt out, so that a long document's are many tasks'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "period", "start", "end"]
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                ids, at = np.frombuffer(row["ids"], "<i4"), np.frombuffer(row["boundaries"], "<i8")
                for q, start, end in solve(ids, at, row["octave"]):
                    found.append((row["key"], q, row["first"] + start, row["first"] + end))
            columns = list(zip(*found)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    dealt = tiles.select("key", "octave", "first", "ids", "boundaries").repartition("key", "octave", "first")
    return dealt.mapInArrow(run, "key long, period long, start long, end long")


def stitch(found: DataFrame, least_words: int, least_periods: int) -> DataFrame:
    """(key, start, length, period) of the runs that the fragments make up."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True))
    group = F.sum(F.col("apart").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = (
        found.withColumn("apart", apart)
        .withColumn("run", group)
        .groupBy("key", "period", "run")
        .agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    )
    least = F.greatest(F.lit(least_words), least_periods * F.col("period"))
    return whole.where(F.col("length") >= least).select("key", "start", "length", "period")


def collapse(text: str, runs: list[dict]) -> str:
    """The text without the words that a run holds after its first period."""
    words = np.array(text.split(" "), object)
    kept = np.ones(len(words), bool)
    for r in runs:
        kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return " ".join(words[kept])


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start,
    length and period of each run, by start, then period) and text, the words
    no run holds after its first period, joined by one space.

    Words are what ASCII white space separates. Null, empty and blank texts have
    no words and no runs, and an empty text. Rows that repeat a doc_id, a null
    one too, are a row each. Other columns are left out, whatever their names;
    an empty table gives no rows. ``least_periods`` must be 3 or more.
    """
    if least_periods < LEAST_PERIODS:
        raise ValueError(f"runs of fewer than {LEAST_PERIODS} periods are not all found")
    rows = stored(explode(docs, least_words, least_periods), "run-tiles", compression="zstd")
    runs = stitch(fragments(rows.where("octave is not null")), least_words, least_periods)
    listed = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    listed = listed.select("key", F.expr(f"cast(transform(runs, r -> struct(r.start, r.length, r.period)) as {kind})").alias("runs"))
    none = F.array().cast(kind)
    with_tiles = rows.where("tiled").select("key", "doc_id", "n_words", "text").join(listed, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [
                collapse(t, r) if r else t for t, r in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())
            ]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(left, pa.string()))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "runs", "text"]
    cut = with_tiles.select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "text")
    cut = cut.mapInArrow(run, f"doc_id {id_type}, n_words long, runs {kind}, text string")
    plain = rows.where("not tiled").select("doc_id", "n_words", none.alias("runs"), "text")
    return plain.select(names).union(cut.select(names))
