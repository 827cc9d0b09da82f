"""Benchmark decontamination by latent semantic retrieval.

Texts become passages of hashed words with TF-IDF weights. A randomised SVD
gives a latent space in which a few hundred benchmark items and all passages
are spread; more items get more spaces. Passages whose cosine with an
item there is high, measured against the share of the item that the space
holds, are candidates. Items that a space holds badly, and items of a few words,
whose cosine with a whole passage is low, are looked up by their words instead:
stretches with enough of them to pass the check. A candidate is a leak if the longest common subsequence of words covers most of
the item, or covers less of it but nearly all of its answer.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import free_names, received, shipped, small_batches, stored

BUCKETS = 1 << 14  # hashed words
STRIDE = 16  # words; a passage is two strides, and they overlap by one
CHUNK = 64  # words of an item that make one query vector
RANK, EXTRA = 64, 16  # dimensions of the latent space; more while it is sought
SEED = 7
FIT_TASKS = 2  # for each core, when the space is fitted
SLICE = 512  # passages multiplied at once
RARE = 4  # occurrences of a word in a slice
SLABS = 64  # parts of the product that are added on their own
LEAST_COSINE = 0.36  # of a passage and an item, times the share of the item that the space holds
LEAST_SHARE = 0.4  # an item of which the space holds less is looked up by its words
LEAST_WORDS = 12  # and so is one of fewer words
NEAR_COSINE = 0.22  # of a passage and an item by their own weights
COVERED = 0.8  # of the item: a leak
PARAPHRASED, ANSWERED = 0.6, 0.8  # of the item and of its answer: a leak too
VERBATIM = 4  # words; an item of as many is a candidate wherever it stands word for word
ITEMS = 200  # items of one space, about
PRESENT = 1 << 20  # slots of the table that tells most other words from those of items
SLAB = 1 << 22  # postings and counters handled at once, about
CACHED = 500_000
# ASCII that is no letter or digit separates words
SPLIT = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()


def numbers(own: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    """32-bit hashes of words; the low bits are the bucket."""
    for w in set(own).difference(memo):
        memo[w] = zlib.crc32(w)
    return np.fromiter(map(memo.__getitem__, own), "<u4", len(own))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the word hashes of each whole text, written once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            raw = [numbers(words(t), memo).tobytes() for t in batch.column("text").to_pylist()]
            if len(memo) > CACHED:
                memo = {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "words"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, words binary"), "word-hashes")


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint32(BUCKETS - 1)).astype(np.int64)


def inverse_frequency(hashed: DataFrame) -> np.ndarray:
    """log(documents / documents with the bucket), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            each = [buckets(np.frombuffer(x.as_buffer(), "<u4")) for x in batch.column("words")]
            for at in range(0, len(each), 64):
                mark = np.zeros((64, BUCKETS), bool)
                for k, b in enumerate(each[at : at + 64]):
                    mark[k, b] = True
                held += mark.sum(0, dtype=np.uint8)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], ["bucket", "n"])

    counts = hashed.select("words").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = np.zeros(BUCKETS)
    for r in counts.collect():  # a row per bucket at most
        n[r["bucket"]] = r["n"]
    return np.log((1 + hashed.count()) / (1 + n)) + 0.01


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray  # hashes
    answer: np.ndarray


def answer_of(text: str) -> str:
    """The answer of an item without an answer column: its last sentence of
    three or more words, or the whole text."""
    parts = [p for p in re.split(r"[.!?\n]+\s*", text) if len(words(p)) >= 3]
    return parts[-1] if parts else text


def read_items(benchmark: DataFrame, block: int, blocks: int) -> list[Item]:
    """Items of one block, in order of item_id; those without a word are left
    out. Items with a null id are searched unless their text has an id too. An
    ``answer`` column is used if there is one."""
    spread = F.xxhash64("item_id", "text")
    own = benchmark.where(F.pmod(spread, F.lit(blocks)) == block)
    named = benchmark.where("item_id is not null").select("text").distinct()
    own = own.where("item_id is not null").unionByName(own.where("item_id is null").join(named, "text", "left_anti"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    memo: dict[bytes, int] = {}
    out = []
    for r in own.select("item_id", "text", answer.alias("answer")).orderBy("item_id", "text").collect():
        w = words(r["text"])
        if w:
            out.append(Item(r["item_id"], numbers(w, memo), numbers(words(r["answer"] or answer_of(r["text"])), memo)))
    return out


def chunked(items: list[Item]) -> tuple[list[np.ndarray], np.ndarray]:
    """Query texts of at most about CHUNK words, and the item of each."""
    texts, owner = [], []
    for k, item in enumerate(items):
        n = max(1, round(len(item.words) / CHUNK))
        texts += [buckets(x) for x in np.array_split(item.words, n)]
        owner += [k] * n
    return texts, np.array(owner)


def in_strides(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strides of some bucket arrays, padded with ``BUCKETS``; the first stride
    of each array, and the array of each stride."""
    strides = np.array([-(-len(b) // STRIDE) for b in each], np.int64)
    flat = np.full((int(strides.sum()), STRIDE), BUCKETS, np.int64)
    first = np.cumsum(strides) - strides
    line = flat.reshape(-1)
    for at, b in zip((first * STRIDE).tolist(), each):
        line[at : at + len(b)] = b
    return flat, first, np.repeat(np.arange(len(each)), strides)


def stride_sums(strides: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the table's rows of each stride's words."""
    sums = table.take(strides[:, 0], axis=0)
    for k in range(1, STRIDE):
        sums += table.take(strides[:, k], axis=0)
    return sums


def repeats(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the words that a row of buckets repeats add to its squared length:
    a word's n occurrences count n * n, so each pair of them counts twice."""
    rows = np.sort(rows, axis=1)
    out = np.zeros(len(rows))
    for back in range(1, rows.shape[1]):
        row, at = np.nonzero((rows[:, back:] == rows[:, :-back]) & (rows[:, back:] < BUCKETS))
        if not len(row):
            break
        out += 2 * np.bincount(row, weights[rows[row, at]], len(rows))
    return out


def add_rows(words: np.ndarray, given: np.ndarray, total: np.ndarray) -> None:
    """Add the row of each stride to the rows of its words. Rarer words are
    added by their first, second ... occurrence, frequent ones by a matrix of
    their counts."""
    order = np.argsort(words.reshape(-1), kind="stable")
    words = words.reshape(-1)[order]
    row = order // STRIDE
    starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    many = np.diff(np.append(starts, len(words)))
    rare = starts[many <= RARE]
    for place in range(RARE):
        at = rare[many[many <= RARE] > place] + place
        total[words[at]] += given[row[at]]
    often = np.flatnonzero(many > RARE)
    n = many[often]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[often], n)
    cell = np.repeat(np.arange(len(often)), n) * len(given) + row[at]
    counts = np.bincount(cell, minlength=len(often) * len(given)).reshape(len(often), -1)
    total[words[starts[often]]] += counts.astype(np.float32) @ given


def add_products(each: list[np.ndarray], table: np.ndarray, weights: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` what the passages of some bucket arrays give: for each
    word of each passage, the passage's projection by ``table`` over its
    squared length. The last row of all three is no word."""
    flat, _, text = in_strides(each)
    flat = flat.astype(np.int16)
    whole = np.append(text[1:] == text[:-1], False)[: len(text)]  # the passage has a second stride
    for at in range(0, len(flat), SLICE):
        two = whole[at : at + SLICE, None]
        n = len(two)
        own = flat[at : at + n + 1]
        if len(own) == n:
            own = np.concatenate([own, np.full((1, STRIDE), BUCKETS, np.int16)])
        sums = stride_sums(own, table)
        square = weights[own].sum(1)
        square = square[:-1] + two[:, 0] * square[1:]
        square = square + repeats(np.concatenate([own[:-1], np.where(two, own[1:], np.int16(BUCKETS))], axis=1), weights)
        passage = (sums[:-1] + two * sums[1:]) / np.maximum(square, 1e-9).astype(np.float32)[:, None]
        given = np.zeros_like(sums)
        given[:-1] = passage
        given[1:] += two * passage
        add_rows(own, given, total)


def passages_times(hashed: DataFrame, space: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A times ``space``, over the TF-IDF rows A of all passages. A task keeps
    a sum of a fixed size (5 MB when sent); the sums are added slab by slab."""
    spark = hashed.sparkSession
    width = space.shape[1]
    given = spark.sparkContext.broadcast((space.astype(np.float32), idf.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        space, idf = given.value
        table = np.zeros((BUCKETS + 1, width), np.float32)
        table[:-1] = space * idf[:, None]
        weights = np.append(idf**2, np.float32(0))
        total, part = np.zeros((BUCKETS + 1, width)), np.zeros((BUCKETS + 1, width), np.float32)
        for batch in batches:
            texts = [buckets(np.frombuffer(x.as_buffer(), "<u4")) for x in batch.column("words")]
            part[:] = 0
            add_products([x for x in texts if len(x)], table, weights, part)
            total += part
        total = (total[:-1] * idf[:, None]).astype(np.float32).reshape(SLABS, -1)
        full = np.flatnonzero(total.any(1))
        columns = [
            pa.array(full, pa.int64()),
            pa.array(np.full(len(full), TaskContext.get().partitionId()), pa.int64()),
            pa.array([total[k].tobytes() for k in full], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["slab", "task", "part"])

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values("task")["part"]
        part = sum(np.frombuffer(x, np.float32).astype(float) for x in parts).tobytes()
        return pd.DataFrame({"slab": group["slab"].iloc[:1], "part": [part]})

    few = hashed.select("words").coalesce(FIT_TASKS * spark.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "slab long, task long, part binary").groupBy("slab")
    out = np.zeros((SLABS, BUCKETS // SLABS * width))
    for r in parts.applyInPandas(add_up, "slab long, part binary").collect():  # 10 MB in all
        out[r["slab"]] = np.frombuffer(r["part"])
    return out.reshape(BUCKETS, width)


def fit_space(hashed: DataFrame, passages: int, queries: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Basis (BUCKETS x RANK) of the main right singular space of the TF-IDF
    rows of the queries and all passages (``passages`` in number).

    Queries weigh as much as the passages in total, so that the space tells
    them apart. The main space of the queries alone, which are few, is found
    first; one pass of all passages multiplies it, and the product gives the
    space of both by a Nystroem approximation.
    """
    rows = []
    for q in queries:
        b, tf = np.unique(q, return_counts=True)
        a = tf * idf[b]
        rows.append((b, a / (np.linalg.norm(a) or 1.0)))

    def own(space: np.ndarray) -> np.ndarray:
        total = np.zeros_like(space)
        for b, a in rows:
            total[b] += np.outer(a, a @ space[b])
        return total

    start = np.random.default_rng(SEED).standard_normal((BUCKETS, RANK + EXTRA))
    for _ in range(3):
        start = np.linalg.qr(own(start))[0]
    product = passages_times(hashed, start, idf) + max(1.0, passages / max(len(queries), 1)) * own(start)
    core = start.T @ product
    values, turn = np.linalg.eigh((core + core.T) / 2)
    sure = values > 1e-6 * max(values[-1], 1e-9)
    basis, long, _ = np.linalg.svd(product @ (turn[:, sure] / np.sqrt(values[sure])), full_matrices=False)
    return basis[:, np.argsort(-long)[:RANK]]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := masks.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


class Shared:
    """Which items have enough words in common with a stretch of a text.

    The check asks for ``PARAPHRASED`` of an item's words. Up to half of that
    may be words left out here, the most frequent ones; then the rest must be
    among the others. Nothing that the check would pass is lost, for items of
    one size class: a window holds any passage of its middle with twice the
    words that the check looks at.
    """

    def __init__(self, items: list[Item], chosen: list[int], size: int, idf: np.ndarray):
        self.step = 2 * size + 2 * STRIDE  # words; a window is two steps, and they overlap by one
        self.chosen = np.array(chosen)
        word, place, times, self.need = [], [], [], np.zeros(len(chosen))
        for k, i in enumerate(chosen):
            w, tf = np.unique(items[i].words, return_counts=True)
            order = np.argsort(idf[buckets(w)], kind="stable")
            w, tf = w[order], tf[order]
            least = PARAPHRASED * len(items[i].words)
            out = int(np.searchsorted(np.cumsum(tf), least / 2, "right"))
            self.need[k] = least - tf[:out].sum() - 1e-9
            word.append(w[out:])
            place.append(np.full(len(w) - out, k))
            times.append(tf[out:])
        word, place, times = map(np.concatenate, (word, place, times))
        order = np.argsort(word, kind="stable")
        self.words, self.first = np.unique(word[order], return_index=True)
        self.many = np.diff(np.append(self.first, len(word)))
        self.place, self.times = place[order], times[order].astype(float)

    def pairs(self, flat: np.ndarray, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, window, item) over some words: hash, text and place of each."""
        own = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        hit = self.words[own] == flat
        own, text, step = own[hit], text[hit], at[hit] // self.step
        if not len(own):
            return
        wide = int(step.max()) + 1
        window = text * wide + step
        back = step > 0
        key = np.unique(np.concatenate([window, window[back] - 1]) * len(self.words) + np.concatenate([own, own[back]]))
        windows, window = np.unique(key // len(self.words), return_inverse=True)
        own = key % len(self.words)
        # windows whose postings are about SLAB in all
        ends = np.cumsum(np.bincount(window, self.many[own], len(windows)))
        a = 0
        while a < len(windows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLAB, "right")))
            lo, hi = np.searchsorted(window, [a, b])
            n = self.many[own[lo:hi]]
            flat_at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[own[lo:hi]], n)
            cell = np.repeat(window[lo:hi], n) * len(self.need) + self.place[flat_at]
            # only the (window, item) that share a word
            cell, back = np.unique(cell, return_inverse=True)
            shared = np.bincount(back, self.times[flat_at], len(cell))
            for c in cell[shared >= self.need[cell % len(self.need)]].tolist():
                r, k = divmod(c, len(self.need))
                yield (*divmod(int(windows[r]), wide), int(self.chosen[k]))
            a = b


class Search:
    """Cosine search of passages and the check of candidates."""

    def __init__(self, items: list[Item], basis: np.ndarray, idf: np.ndarray):
        self.items = items
        texts, self.owner = chunked(items)
        # the last column sums the squared weights; the last row is no word
        table = np.zeros((BUCKETS + 1, basis.shape[1] + 1), np.float32)
        table[:-1, :-1] = basis * idf[:, None]
        table[:-1, -1] = idf**2
        self.table = table
        queries = np.stack([table[t].sum(0)[:-1] for t in texts])
        whole = [np.unique(t, return_counts=True) for t in texts]
        whole = np.array([np.linalg.norm(tf * idf[b]) for b, tf in whole])
        share = np.linalg.norm(queries, axis=1) / np.maximum(whole, 1e-9)
        self.least = (LEAST_COSINE * share).astype(np.float32)
        held = np.full(len(items), np.inf)
        np.minimum.at(held, self.owner, share)
        self.queries = (queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)).T.copy()
        self.idf = idf
        classes: dict[int, list[int]] = {}
        for k, item in enumerate(items):
            if held[k] >= LEAST_SHARE and len(item.words) >= LEAST_WORDS:
                continue
            classes.setdefault(max(STRIDE, 1 << (len(item.words) - 1).bit_length()), []).append(k)
        self.shared = [Shared(items, chosen, size, idf) for size, chosen in sorted(classes.items())]
        self.present = np.zeros(PRESENT, bool)
        for each in self.shared:
            self.present[each.words & np.uint32(PRESENT - 1)] = True

    def near(self, own: np.ndarray, item: Item, first: int, last: int) -> Iterator[tuple[int, float]]:
        """(passage, cosine) of the passages from first to last that are near
        the item by their TF-IDF weights, in no space, or hold its copy."""
        part = own[first * STRIDE : (last + 2) * STRIDE]
        b = buckets(part)
        starts = np.arange(0, len(part), STRIDE)
        best = np.zeros(len(starts))
        square = np.add.reduceat(self.idf[b] ** 2, starts)
        square[:-1] += square[1:].copy()
        for q in chunked([item])[0]:
            words, tf = np.unique(q, return_counts=True)
            weights = tf * self.idf[words]
            at = np.minimum(np.searchsorted(words, b), len(words) - 1)
            product = np.add.reduceat(np.where(words[at] == b, weights[at] * self.idf[b], 0.0), starts)
            product[:-1] += product[1:].copy()
            best = np.maximum(best, product / np.sqrt(np.maximum(square, 1e-9)) / max(np.linalg.norm(weights), 1e-9))
        found = best >= NEAR_COSINE
        if len(item.words) >= VERBATIM:
            raw, copy = part.tobytes(), item.words.tobytes()
            at = raw.find(copy)
            while at >= 0:
                if at % 4 == 0:
                    found[at // 4 // STRIDE] = True
                at = raw.find(copy, at + 1)
        for p in np.flatnonzero(found[: last - first + 1]).tolist():
            yield first + p, float(min(best[p], 1.0))

    def by_words(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, item, cosine) of candidates found by their words."""
        flat = np.concatenate(texts)
        some = np.flatnonzero(self.present[flat & np.uint32(PRESENT - 1)]) if self.shared else np.zeros(0, int)
        sizes = np.array([len(x) for x in texts])
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, some, "right")
        flat, at = flat[some], some - (ends - sizes)[text]
        out = []
        for each in self.shared:
            for t, window, k in each.pairs(flat, text, at):
                first, last = window * each.step // STRIDE, (window + 2) * each.step // STRIDE - 1
                out += [(t, p, k, c) for p, c in self.near(texts[t], self.items[k], first, last)]
        t, p, k, c = zip(*out) if out else ((), (), (), ())
        return np.array(t, int), np.array(p, int), np.array(k, int), np.array(c, float)

    def candidates(self, each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, chunk, cosine) with a high cosine, over the bucket
        arrays of some texts."""
        flat, first, text = in_strides(each)
        sums = np.empty((len(flat), self.table.shape[1]), np.float32)
        for at in range(0, len(flat), 512):
            sums[at : at + 512] = stride_sums(flat[at : at + 512], self.table)
        # a passage is a stride and the next one of the same text
        joined = text[1:] == text[:-1]
        sums[:-1][joined] += sums[1:][joined]
        norm = np.sqrt(np.maximum(sums[:, -1:], 1e-9))
        out = []
        for at in range(0, len(sums), 4096):
            cosine = (sums[at : at + 4096, :-1] @ self.queries) / norm[at : at + 4096]
            p, q = np.nonzero(cosine >= np.maximum(self.least, 1e-6))
            out.append((p + at, q, cosine[p, q]))
        p, q, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return text[p], p - first[text[p]], q, c

    def check(self, own: np.ndarray, item: Item, first: int, last: int) -> tuple[float, float]:
        """Shares of the item and of its answer that the passages from first
        to last hold in order, with as many words around as the item has."""
        n = len(item.words)
        window = own[max(0, first * STRIDE - n) : (last + 2) * STRIDE + n]
        there = set(window.tolist())
        if sum(map(there.__contains__, item.words.tolist())) < PARAPHRASED * n:
            return 0.0, 0.0  # a common subsequence has no more words than that
        covered = common_length(item.words, window) / n
        answered = 0.0
        if PARAPHRASED <= covered < COVERED and len(item.answer):
            answered = common_length(item.answer, window) / len(item.answer)
        return covered, answered

    def leaks(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item_id, cosine, covered, answered) of the leaks."""
        t, p, q, c = self.candidates([buckets(x) for x in texts])
        owner = self.owner[q]
        t, p, owner, c = map(np.concatenate, zip((t, p, owner, c), self.by_words(texts)))
        order = np.lexsort((p, owner, t))
        t, p, owner, c = t[order], p[order], owner[order], c[order]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        at = 0
        while at < len(t):
            # passages near each other are checked as one stretch
            to = at + 1
            while to < len(t) and t[to] == t[at] and owner[to] == owner[at] and p[to] - p[to - 1] <= 2:
                to += 1
            item = self.items[owner[at]]
            covered, answered = self.check(texts[t[at]], item, int(p[at]), int(p[to - 1]))
            if covered >= COVERED or (covered >= PARAPHRASED and answered >= ANSWERED):
                key, found = (int(t[at]), item.item_id), (float(c[at:to].max()), covered, answered)
                best[key] = max(best.get(key, found), found, key=lambda x: x[1])
            at = to
        for (text, item_id), found in best.items():
            yield (text, item_id, *found)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, cosine, covered (share of the
    item's words found in order) and answered (of its answer's, 0 where it was
    not needed).

    Every passage of every whole text is searched. Null and blank texts leak
    nothing, nor do items without a word; either table may be empty. Rows that
    repeat a doc_id give a row each, a null doc_id too. Items without an id give
    a row of a null item_id, one for all of them in a block. The benchmark is a
    query set: blocks of about ``ITEMS`` items have a space each, fitted with
    all passages, so that what is broadcast is bounded. The word hashes are
    multiplied and searched once for each block.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {id_type}, item_id long, cosine double, covered double, answered double"
    hashed = numbered(docs)
    idf = inverse_frequency(hashed)
    found = spark.createDataFrame([], kind)
    blocks = -(-benchmark.count() // ITEMS)
    passages = hashed.select(F.sum(F.ceil(F.length("words") / (4 * STRIDE)))).first()[0] or 0
    for block in range(blocks):
        items = read_items(benchmark, block, blocks)
        if not items:
            continue
        basis = fit_space(hashed, passages, chunked(items)[0], idf)
        shared = shipped(spark, Search(items, basis, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = received(shared)
            names = ["doc_id", "item_id", "cosine", "covered", "answered"]
            for batch in batches:
                texts = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("words")]
                full = [i for i, x in enumerate(texts) if len(x)]
                rows = list(search.leaks([texts[i] for i in full])) if full else []
                ids = batch.column("doc_id").take(pa.array([full[r[0]] for r in rows], pa.int64()))
                rest = [pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.float64()) for k in range(1, 5)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names)

        found = found.unionByName(hashed.mapInArrow(run, kind))
    return found


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; all columns stay. Rows are
    told apart by doc_id and a hash of the text, nulls included."""
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), benchmark)
    gone_id, gone_hash = free_names(docs, "gone_id", "gone_hash")
    gone = leaks.select(F.col("doc_id.doc_id").alias(gone_id), F.col("doc_id.hash").alias(gone_hash)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_hash))
    return docs.join(stored(gone, "leaks"), same, "left_anti")
