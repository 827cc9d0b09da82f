"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import received, shipped, small_batches

UNKNOWN = "und"
BUCKETS = 4096  # hashed byte trigrams
CENTROIDS = 4  # clusters per language
PER_LANGUAGE = 600  # training documents per language, at most about
TEXTS = 64 * PER_LANGUAGE  # training documents, at most about; many languages share them
LEAST_TEXTS = 20  # of a language, if there are as many; so many languages are learned as have room for these
SHARPNESS = 20.0  # of the softmax over languages that gives the score
LOW = 0.02  # quantile of the cosines of left-out texts of one size class
ENOUGH = 50  # left-out texts of a size class; with fewer it takes a class near it
SLACK = 0.65  # a text is rejected under this share of that quantile
GUARD = 40  # trigrams; the distance of a shorter text says too little
MULTIPLIER = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the whole text in lower case."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * MULTIPLIER
    return np.bincount(code >> np.uint32(20), minlength=BUCKETS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # BUCKETS
    centroids: np.ndarray  # languages * CENTROIDS, BUCKETS; unit rows
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # per power of two of the trigrams: low cosine of left-out texts

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / (np.linalg.norm(v) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the distance rejects it."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = trigram_counts(text)
        cosine = np.full(len(self.languages), -1.0)
        np.maximum.at(cosine, self.owner, self.centroids @ self.vector(counts))
        best = int(cosine.argmax())
        share = np.exp(SHARPNESS * (cosine - cosine[best]))
        n = counts.sum()
        far = n >= GUARD and cosine[best] < SLACK * self.least[size_class(n)]
        return self.languages[best], float(1 / share.sum()), bool(far)


def size_class(n: int) -> int:
    return min(int(n).bit_length(), 31)


def clusters(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from each other."""
    centers = rows[:1]
    while len(centers) < min(k, len(rows)):
        centers = np.concatenate([centers, rows[(rows @ centers.T).max(1).argmin()][None]])
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(1)
        sums = np.stack([rows[own == c].sum(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows (lang, text) of every language, chosen by a
    hash of doc_id and text; fewer of each if all have more than ``TEXTS``."""
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TEXTS // LEAST_TEXTS).collect()
    if not sizes:
        return known.where(F.lit(False)).select("lang", "text")
    per_language = min(per_language, TEXTS // len(sizes))
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    return known.where(place < shares[F.col("lang")]).select("lang", "text")


def low_cosines(x: np.ndarray, lang: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per size class, the ``LOW`` quantile of the cosine of a text with the
    centroids of its language, fitted on the other half of the texts.

    A class with few texts takes the nearest smaller one with enough, or the
    nearest larger one, whose cosines are higher by about the root of the size.
    None asks for more than the same quantile of all texts beyond the guard:
    long texts of one word are far from the others of their size.
    """
    best, place = np.full(len(x), np.nan), np.zeros(len(x), int)
    for name in set(lang):
        own = np.flatnonzero(lang == name)
        place[own] = np.arange(len(own)) % 2
        for half in (0, 1):
            fitted, left = own[place[own] != half], own[place[own] == half]
            if len(fitted):
                best[left] = (x[left] @ clusters(x[fitted], CENTROIDS).T).max(1)
    known = np.isfinite(best)
    low = {}
    for s in range(32):
        cosines = best[known & (sizes == s)]
        if len(cosines) >= ENOUGH:
            low[s] = np.quantile(cosines, LOW, method="higher")
    if not low:  # too few texts for classes
        low = {int(np.median(sizes)): np.quantile(best[known], LOW, method="higher") if known.any() else 0.0}
    guarded = best[known & (sizes >= size_class(GUARD))]
    most = np.quantile(guarded, LOW, method="higher") if len(guarded) else 1.0
    least = np.zeros(32)
    for s in range(32):
        smaller = [k for k in low if k <= s]
        least[s] = low[max(smaller)] if smaller else low[min(low)] * 2.0 ** ((s - min(low)) / 2)
    return np.minimum(least, most)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model from the rows of ``docs`` (doc_id, text, lang) with a language.

    The sample is bounded: ``PER_LANGUAGE`` texts of each language and about
    ``TEXTS`` of all. Every language is learned, or where ``lang`` holds noise,
    its ``TEXTS // LEAST_TEXTS`` (1,920) most frequent values; texts of the
    others are predicted as the nearest of these. Tasks send only their n-gram counts.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            raw = [np.minimum(trigram_counts(t), 65535).astype("<u2").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "counts": raw})

    rows = sample(docs, per_language).mapInPandas(counted, "lang string, counts binary").toPandas()
    rows = rows.sort_values(["lang", "counts"], ignore_index=True)
    counts = np.stack([np.frombuffer(r, "<u2") for r in rows["counts"]]) if len(rows) else np.zeros((0, BUCKETS))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    model = Model(sorted(set(rows["lang"])), idf, np.zeros((0, BUCKETS)), np.zeros(0, int), np.ones(32))
    if not len(rows):
        return model
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    lang = rows["lang"].to_numpy()
    each = [clusters(x[lang == name], CENTROIDS) for name in model.languages]
    model.centroids = np.concatenate(each).astype(np.float32)
    model.owner = np.repeat(np.arange(len(each)), [len(c) for c in each])
    model.least = low_cosines(x, lang, np.array([size_class(n) for n in counts.sum(1)]))
    return model


def identify(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang_pred, score, rejected.

    Only the text is used. A text that is null or has no letter is ``und``
    with score 0 and rejected; so is every text if nothing was learned. The
    model (a few MB, ``CENTROIDS`` rows of 16 KB a language) is broadcast.
    Other columns stay; one named ``into`` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = received(shared).predict
        for texts in batches:
            yield pd.DataFrame([predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    kind = "lang_pred string, score double, rejected boolean"
    return docs.withColumn(into, F.pandas_udf(run, kind)(F.col("text")))
