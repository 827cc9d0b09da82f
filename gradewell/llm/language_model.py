"""Interpolated modified Kneser-Ney model of word n-grams.

Counting: tasks count the n-grams of their own texts, and arrays of n-grams and
counts are shuffled by hash, a bucket for each range of hashes. From the highest
order down, a bucket adds up its counts and gives the next lower order its
share: how many different words stand before an n-gram (its adjusted count) and
what follows it as a context. An n-gram that begins a text keeps its raw count.

Storage: each bucket writes one flat file per column, sorted by hash, into a
shared folder. Workers map the files into memory and search them for sorted
hashes, so a worker reads the pages that its texts need.

Scoring: a document's log10 probability, with its end, under the model.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import discard, shared_path, small_batches, stored

ORDER = 2
BUCKET_BYTES = 32 << 20  # of text, per bucket
CHUNK = 1 << 18  # tokens handled at once
HELD = 1 << 22  # counted n-grams that a task holds before it passes them on
END = b" end"  # no word has a space in it
STATS = ("adjusted", "total", "ones", "twos", "more")  # of an n-gram below the highest order


def local_folder(path: str) -> str:
    """The path that workers open; files are mapped, so it must be mounted."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the model's folder must be a mounted path, so that its files can be mapped: {path}")
    return unquote(parts.path)


def scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_keys(ids: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams from the numbers of their words."""
    key = np.zeros(len(ids[0]), np.uint64)
    for own in ids:
        key = scattered((key + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95) + own.astype(np.uint64))
    return key


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Different keys in order, sums of the columns, and a place of each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    sums = [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]
    return keys[first], sums, order[first]


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Tokens as numbers of this call, the token of each number, and how many
    tokens each text has. The end is number 0."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[END]
    each = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(x) + 1 for x in each], np.int64)
    flat = np.zeros(int(sizes.sum()), np.int64)
    at = 0
    for own in each:
        flat[at : at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
        at += len(own) + 1
    return flat, list(number), sizes


def grams(flat: np.ndarray, sizes: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The words of the n-gram that ends at each token; ``start`` stands for
    what would be before the text."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for back in range(order - 1, 0, -1):
        own = np.full(len(flat), start, np.int64)
        own[back:] = flat[:-back] if back else flat
        own[place < back] = start
        out.append(own)
    return [*out, flat]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, about CHUNK tokens each; a text is never cut."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= 6 * CHUNK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Arrays:
    """Sorted hash arrays of one table, mapped bucket by bucket as needed."""

    def __init__(self, folder: str, sizes: np.ndarray, bits: int, columns: dict[str, str]):
        self.folder, self.sizes, self.bits, self.columns = folder, sizes, bits, columns
        self.open: dict[int, list[np.ndarray]] = {}

    def mapped(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self.open:
            kinds = {"key": "<u8", **self.columns}
            self.open[bucket] = [np.memmap(f"{self.folder}/{bucket}.{c}", kind, "r") for c, kind in kinds.items()]
        return self.open[bucket]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Place of each key in its bucket (-1: not there), and its columns (0:
        not there), for keys in order."""
        place = np.full(len(keys), -1, np.int64)
        out = [np.zeros(len(keys), np.int64) for _ in self.columns]
        buckets = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if lo == hi or not self.sizes[buckets[lo]]:
                continue
            own, *columns = self.mapped(int(buckets[lo]))
            at = np.minimum(np.searchsorted(own, keys[lo:hi]), len(own) - 1)
            hit = own[at] == keys[lo:hi]
            place[lo:hi][hit] = at[hit]
            for values, column in zip(out, columns):
                values[lo:hi][hit] = column[at[hit]]
        return place, out

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """``find`` for keys in any order."""
        each, back = np.unique(keys, return_inverse=True)
        place, columns = self.find(each)
        return place[back], [c[back] for c in columns]


class Words:
    """Numbers of words: their place among all hashes. The start of a text is
    the number after the last word, an unknown word the next one."""

    def __init__(self, model: dict):
        self.bits, self.n = model["bits"], model["vocabulary"]
        self.base = np.cumsum(model["words"]) - model["words"]
        self.arrays = Arrays(f"{model['folder']}/words", model["words"], self.bits, {"count": "<u8"})

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        place, (count,) = self.arrays.look(keys)
        number = self.base[(keys >> np.uint64(64 - self.bits)).astype(np.int64)] + place
        return np.where(place < 0, self.n + 1, number), count


def put(folder: str, bucket: int, columns: dict[str, np.ndarray]) -> None:
    """Files of a bucket, each there whole or not at all, so that a task can
    run again."""
    os.makedirs(folder, exist_ok=True)
    for name, values in columns.items():
        part = f"{folder}/.{bucket}.{name}.{uuid.uuid4().hex}"
        values.tofile(part)
        os.replace(part, f"{folder}/{bucket}.{name}")


def dealt(keys: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, columns) of rows in order of their keys."""
    buckets = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if hi > lo:
            yield int(buckets[lo]), [c[lo:hi].tobytes() for c in columns]


def count_words(docs: DataFrame, folder: str, bits: int) -> DataFrame:
    """(bucket, n, tokens) of the words' files, which it writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            rows = [(b, *c) for b, c in dealt(keys, [keys, counts.astype("<u4")], bits)]
            own = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds)], ["bucket", "keys", "counts"])

        for part in chunks(batches):
            flat, words, _ = tokenised(part.column("text").to_pylist())
            own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            n = np.bincount(flat, minlength=len(words))
            keys, (counts,), _ = summed(np.concatenate([keys, own[n > 0]]), [np.concatenate([counts, n[n > 0]])])
            if len(keys) > HELD:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    def write(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iat[0])
        keys = np.frombuffer(b"".join(group["keys"]), "<u8")
        counts = np.frombuffer(b"".join(group["counts"]), "<u4").astype(np.int64)
        keys, (counts,), _ = summed(keys, [counts])
        put(folder, bucket, {"key": keys, "count": counts.astype("<u8")})
        return pd.DataFrame({"bucket": [bucket], "n": [len(keys)], "tokens": [int(counts.sum())]})

    parts = docs.select("text").mapInArrow(run, "bucket long, keys binary, counts binary")
    return parts.groupBy("bucket").applyInPandas(write, "bucket long, n long, tokens long")


def count_grams(docs: DataFrame, model: dict, order: int) -> DataFrame:
    """(bucket, ids, counts): n-grams of the texts, counted task by task."""
    bits, kind = model["bits"], model["kind"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        keys, counts, ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * order

        def out() -> pa.RecordBatch:
            rows = [(b, b"".join(c[1:]), c[0]) for b, c in dealt(keys, [counts.astype("<u4"), *(x.astype(kind) for x in ids)], bits)]
            own = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds)], ["bucket", "ids", "counts"])

        for part in chunks(batches):
            flat, each, sizes = tokenised(part.column("text").to_pylist())
            own = grams(words.look(each)[0][flat], sizes, order, words.n)
            more, (n,), at = summed(gram_keys(own), [np.ones(len(flat), np.int64)])
            both = [np.concatenate([a, b[at]]) for a, b in zip(ids, own)]
            keys, (counts,), at = summed(np.concatenate([keys, more]), [np.concatenate([counts, n])])
            ids = [x[at] for x in both]
            if len(keys) > HELD:
                yield out()
                keys, counts, ids = keys[:0], counts[:0], [x[:0] for x in ids]
        yield out()

    return docs.select("text").mapInArrow(run, "bucket long, ids binary, counts binary")


def lower_order(model: dict, order: int, folder: str, top: bool):
    """Adds up a bucket of n-grams, writes its files, and gives its rows of the
    next lower order and its sums (a row without a bucket)."""
    bits, kind, start = model["bits"], model["kind"], model["vocabulary"]
    columns = ("counts",) if top else STATS

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iat[0])
        parts = [np.frombuffer(x, kind).reshape(order, -1) for x in group["ids"]]
        ids = np.concatenate(parts, axis=1)
        given = [np.concatenate([np.frombuffer(x, "<u4") for x in group[c]]).astype(np.int64) for c in columns]
        keys, given, at = summed(gram_keys(list(ids)), given)
        ids, count = ids[:, at], given[0]
        names = ("adjusted",) if top else STATS
        put(folder, bucket, {"key": keys, **{n: c.astype("<u8") for n, c in zip(names, given)}})
        seen = count > 0
        ids, count = ids[:, seen], count[seen]
        sums = [len(keys), int(count.sum()), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count >= 3).sum())]
        rows = [(-1, b"", *[b""] * 5, sums)]
        if order > 1:
            before, zero = ids[1], np.zeros(len(count), np.int64)
            # what follows the start of a text has no other word before it
            own = np.where(before == start, count, 1) if order > 2 else np.ones(len(count), np.int64)
            pairs = [
                (list(ids[1:]), [own, zero, zero, zero, zero]),
                (list(ids[:-1]), [zero, count, *((count == k).astype(np.int64) for k in (1, 2)), (count >= 3).astype(np.int64)]),
            ]
            lower = [np.concatenate(x) for x in zip(*(p[0] for p in pairs))]
            stats = [np.concatenate(x) for x in zip(*(p[1] for p in pairs))]
            lower_keys, stats, at = summed(gram_keys(lower), stats)
            packed = [x[at].astype(kind) for x in lower] + [x.astype("<u4") for x in stats]
            for b, c in dealt(lower_keys, packed, bits):
                rows.append((b, b"".join(c[: order - 1]), *c[order - 1 :], None))
        return pd.DataFrame(rows, columns=["bucket", "ids", *STATS, "sums"]).assign(given=bucket)

    return run


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from how many n-grams have a count
    of 1, 2, 3 and 4. Where the counts give none, half a count is."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and y else 0.5
        out.append(min(max(d, 0.0), float(k)) or 0.5)
    return out


def fit(docs: DataFrame, order: int = ORDER, folder: str | None = None) -> dict:
    """The model of ``docs`` (text): what its files are and a few sums.

    Null texts are empty ones, whose only token is the end. The files are in
    ``folder``, or a new one of the shared folder; ``remove`` deletes them.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = docs.sparkSession
    small_batches(spark)
    folder = local_folder(folder or shared_path(spark, "language-model"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, (size // BUCKET_BYTES).bit_length())
    model = {"folder": folder, "order": order, "bits": bits, "words": np.zeros(1 << bits, np.int64), "sizes": []}
    tokens = 0
    for r in count_words(docs, f"{folder}/words", bits).collect():  # a row per bucket
        model["words"][r["bucket"]] = r["n"]
        tokens += r["tokens"]
    model["tokens"], model["vocabulary"] = tokens, int(model["words"].sum())
    model["kind"] = "<u4" if model["vocabulary"] + 2 < 1 << 32 else "<u8"
    rows, sums, sizes = count_grams(docs, model, order), {}, {}
    kind = "bucket long, ids binary, " + ", ".join(f"{c} binary" for c in STATS) + ", sums array<long>, given long"
    held = None
    for k in range(order, 0, -1):
        step = lower_order(model, k, f"{folder}/order{k}", k == order)
        done = stored(rows.groupBy("bucket").applyInPandas(step, kind), f"grams-{k}")
        sizes[k] = np.zeros(1 << bits, np.int64)
        total = np.zeros(6, np.int64)
        for r in done.where("bucket = -1").select("given", "sums").collect():
            sizes[k][r["given"]] = r["sums"][0]
            total += np.array(r["sums"][1:])
        sums[k] = total.tolist()
        if held is not None:
            discard(held)
        held, rows = done, done.where("bucket >= 0").drop("sums", "given")
    discard(held)
    model["sizes"] = [sizes[k] for k in range(1, order + 1)]
    model["discounts"] = [discounts(sums[k][1:5]) for k in range(1, order + 1)]
    # what follows no word at all: total, and how many counts are 1, 2, 3 or more
    one = sums[1]
    model["root"] = [one[0], one[1], one[2], one[5]]
    return model


def remove(spark, model: dict) -> None:
    """Delete the model's files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{model['folder']}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Reader:
    """Probabilities from the mapped files of a model."""

    def __init__(self, model: dict):
        self.model, self.words = model, Words(model)
        order = model["order"]
        self.orders = []
        for k, sizes in enumerate(model["sizes"], 1):
            columns = {c: "<u8" for c in (STATS[:1] if k == order else STATS)}
            self.orders.append(Arrays(f"{model['folder']}/order{k}", sizes, model["bits"], columns))

    def left(self, count: np.ndarray, discount: list[float]) -> np.ndarray:
        """Counts without their discounts."""
        return np.maximum(count - np.array([0.0, *discount])[np.minimum(count, 3)], 0.0)

    def probabilities(self, ids: list[np.ndarray]) -> np.ndarray:
        """Of the last word of each n-gram after the others."""
        order, n = self.model["order"], self.model["vocabulary"]
        total, *kinds = self.model["root"]
        looked = []
        for k in range(1, order + 1):
            looked.append(self.orders[k - 1].look(gram_keys(ids[order - k :]))[1][0])
        p = np.full(len(ids[0]), 1 / (n + 1))
        if total:
            spare = np.dot(self.model["discounts"][0], kinds) / total
            p = self.left(looked[0], self.model["discounts"][0]) / total + spare * p
        for k in range(2, order + 1):
            context = self.orders[k - 2].look(gram_keys(ids[order - k : -1]))[1]
            total, kinds = np.maximum(context[1], 1), context[2:]
            spare = sum(d * x for d, x in zip(self.model["discounts"][k - 1], kinds)) / total
            p = np.where(context[1] > 0, self.left(looked[k - 1], self.model["discounts"][k - 1]) / total + spare * p, p)
        return p


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens (with the
    end), n_known (tokens that the training texts have), train_tokens,
    base_score and score.

    base_score is the log10 probability under half-added counts of single
    tokens, score that under the model. Null, empty and blank texts are the end
    alone. Rows that repeat an id are a row each; an empty table gives no rows,
    and a model of no text gives every token the probability 1. Other columns
    are left out, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = Reader(shared.value), shared.value
        all_tokens, n = model["tokens"], model["vocabulary"]
        for part in chunks(batches):
            flat, words, sizes = tokenised(part.column("text").to_pylist())
            number, count = reader.words.look(words)
            text = np.repeat(np.arange(len(sizes)), sizes)
            base = np.log10((count + 0.5) / (all_tokens + 0.5 * (n + 1)))[flat]
            each, back = different(grams(flat, sizes, model["order"], len(words)))
            given = np.append(number, n)
            p = np.log10(reader.probabilities([given[x] for x in each]))[back]
            sums = [np.bincount(text, x, len(sizes)) for x in ((count > 0)[flat], base, p)]
            arrays = [
                part.column("doc_id").combine_chunks(),
                pa.array(sizes),
                pa.array(sums[0].astype(np.int64)),
                pa.array(np.full(len(sizes), all_tokens)),
                pa.array(sums[1]),
                pa.array(sums[2]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def different(ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each n-gram once, and where every given one is."""
    key = ids[0]
    for own in ids[1:]:
        # numbered anew for each word, so that the codes stay small
        key = np.unique(key, return_inverse=True)[1] * (int(own.max(initial=0)) + 1) + own
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return [x[first] for x in ids], back
