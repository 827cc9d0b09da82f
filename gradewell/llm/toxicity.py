"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other text is unlabelled and
may hold toxic documents too. The risk of a linear model on hashed words and
their character n-grams is corrected by the class prior; where the estimated
risk of the negatives falls below zero, the step goes back, as in non-negative
PU learning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import discard, received, shipped, small_batches, stored

WORD = re.compile(r"\w+")
GRAMS = (4, 5)  # character n-grams of a word with its ends marked
BUCKETS = 1 << 20
POSITIVES = 4_000  # training documents of each kind, at most about
UNLABELLED = 12_000
SAMPLE_TASKS = 8
LEAST_USE = 5  # positives that must hold a feature
LEAST_Z = 4.0  # by how many standard errors it must be more frequent in positives
MOST_NEGATIVE = 0.25  # its rate in negatives, as a share of that in positives
FEATURES = 20_000  # features kept, the strongest first
ROUNDS = 200
RATE = 0.1
DECAY = 0.02
CACHED = 400_000


def features(word: str) -> set[int]:
    """Buckets of a word: the word itself and its n-grams."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    own = {zlib.crc32(marked)}
    text = f"<{word}>"
    for n in GRAMS:
        own.update(zlib.crc32(text[i : i + n].encode("utf-8", "surrogatepass")) for i in range(len(text) - n + 1))
    return {x & (BUCKETS - 1) for x in own}


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


class Memo:
    """The features of words, as places in the model's list of features."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.place = None if chosen is None else dict(zip(chosen.tolist(), range(len(chosen))))
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> set[int]:
        own: set[int] = set()
        known, place = self.known, self.place
        if len(known) > CACHED:
            known.clear()
        for w in words(text):
            f = known.get(w)
            if f is None:
                f = features(w)
                f = known[w] = tuple(f) if place is None else tuple(place[x] for x in f if x in place)
            if f:
                own.update(f)
        return own


@dataclass
class Model:
    features: np.ndarray  # buckets
    weight: np.ndarray
    bias: float

    def score(self, places: set[int]) -> float:
        z = sum(self.weight[i] for i in sorted(places)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias from each row's places of features: full-batch Adam on
    the non-negative risk with the (bounded) sigmoid loss."""
    w, bias = np.zeros(size), -np.log(1 / prior - 1)
    pos = positive.astype(bool)
    if not size or not pos.any() or pos.all():
        return w, float(bias)
    flat = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.where(pos, 1 / pos.sum(), 1 / (~pos).sum())
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, w[flat], len(rows)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = share * np.where(pos, -prior, 1.0)
        slope = as_negative * p * (1 - p)
        if (as_negative * p).sum() < 0:
            slope = -slope
        else:
            slope = slope - np.where(pos, prior * share * p * (1 - p), 0.0)
        grad = np.append(np.bincount(flat, slope[row], size) + DECAY * prior * w / size, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """Rows (positive, text) and the class prior.

    Both kinds are chosen by a hash of doc_id, about as many as asked for. The
    ids of the positives, so bounded, are broadcast.
    """
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = rated.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()

    def place(kind: str):
        return F.pmod(F.xxhash64("doc_id", F.lit(kind)), F.lit(1 << 30)) / (1 << 30)

    chosen = rated.where((F.col("toxic") == 1) & (place("positive") < positives / max(total["toxic"], 1)))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.lit(True).alias("positive"))
    other = place("unlabelled") < unlabelled / max(docs.count(), 1)
    marked = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", other.alias("_other"))
    rows = marked.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").where("_other or positive")
    rows = rows.select(F.coalesce("positive", F.lit(False)).alias("positive"), "text")
    return rows, min(max(total["toxic"] / max(total["n"], 1), 1e-3), 0.5)


def choose(rows: DataFrame, n_pos: int, n_all: int, prior: float) -> np.ndarray:
    """Buckets that the positives hold significantly more often, and negatives
    rarely: unlabelled rows are positives at the rate of the class prior."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, sums = Memo(), [np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)]
        for batch in batches:
            for positive, text in zip(batch["positive"], batch["text"]):
                own = memo.of(text)
                sums[bool(positive)][np.fromiter(own, np.int64, len(own))] += 1
        held = np.flatnonzero(sums[1])  # no positive here holds the others
        rest = np.flatnonzero((sums[1] == 0) & (sums[0] > 0))
        for part in (held, rest):
            yield pd.DataFrame({"bucket": part, "p": sums[1][part], "u": sums[0][part]})

    each = rows.mapInPandas(counted, "bucket long, p long, u long")
    use = each.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST_USE)
    p, u = F.col("p") / n_pos, F.col("u") / (n_all - n_pos)
    both = (F.col("p") + F.col("u")) / n_all
    z = (p - u) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / (n_all - n_pos)) + 1e-12)
    negative = (u - prior * p) / (1 - prior)
    best = use.where(negative <= MOST_NEGATIVE * p).select("bucket", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES)
    return np.array(sorted(r["bucket"] for r in best.collect()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Learns from documents with toxic = 1 and from others taken as unlabelled;
    the class prior is the share of toxic rows in ``labels``. The samples are
    bounded by the parameters. Null ids and null labels are left out. Without
    positives the model is the prior alone.
    """
    small_batches(docs.sparkSession)
    rows, prior = sample(docs, labels, positives, unlabelled)
    rows = stored(rows.repartition(SAMPLE_TASKS), "toxicity-sample")
    sizes = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    n_pos, n_all = sizes.get(True, 0), sum(sizes.values())
    chosen = choose(rows, n_pos, n_all, prior) if 0 < n_pos < n_all else np.zeros(0, np.int64)

    def used(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(chosen)
        for batch in batches:
            raw = [np.array(sorted(memo.of(t)), "<i4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"positive": batch["positive"], "places": raw})

    got = rows.mapInPandas(used, "positive boolean, places binary").toPandas().sort_values(["positive", "places"])
    discard(rows)
    places = [np.frombuffer(r, "<i4") for r in got["places"]]
    weight, bias = train(places, got["positive"].to_numpy(bool), prior, len(chosen))
    return Model(chosen, weight, bias)


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``into`` from 0 to 1; only the text is
    used. Null and empty texts get the score of no word at all. The model (at
    most ``FEATURES`` weights) is broadcast. Other columns stay."""
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = received(shared)
        memo = Memo(model.features)
        for texts in batches:
            yield pd.Series([model.score(memo.of(t)) for t in texts], dtype="float64")

    return docs.withColumn(into, F.pandas_udf(run, "double")(F.col("text")))
