"""Quality rules: base counts, and divergence from language references.

Each document gives a histogram of character classes and one of common words.
All is learned from the table: the languages are the values of ``lang`` with
enough documents, their common words the most frequent ones of all their
texts, their references the mean histograms of their documents. Some documents
are held back from the references; their distances set the cutoffs. A document
fails if its Jensen-Shannon distance from every reference is beyond that
language's cutoff; histograms of too few characters or words give no verdict.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.llm.common import received, shipped, small_batches, stored

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "line", "punctuation", "symbol", "letter beyond ASCII", "other")
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules
GUARD_CHARS, GUARD_WORDS = 200, 50  # fewer give no verdict
LEAST_DOCS = 20  # of a language with a reference
COMMON_WORDS = 32  # of a language
HELD_BACK = 10  # one document in as many adds to no reference
HIGH, SLACK = 0.75, 2.2  # a cutoff is this quantile of the held-back distances, times this: a share of junk does not move it
LEAST_CUTOFF = 0.1
HELD_WORDS = 1 << 20  # different words that a task counts, or sums of shares, before it passes them on
COMPARED = 1 << 18  # pairs of a document and a language compared at once, about


def class_table() -> np.ndarray:
    """Class of each byte; the later bytes of a character have none (9)."""
    t = np.full(256, 8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    t[[9, 32]], t[[10, 11, 12, 13]] = 3, 4
    t[list(PUNCTUATION)], t[list(SYMBOLS)] = 5, 6
    t[0xC0:], t[0x80:0xC0] = 7, 9
    return t


def histograms(data: bytes, table: np.ndarray, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Character-class counts, and common-word counts with all others last."""
    classes = np.bincount(table[np.frombuffer(data, np.uint8)], minlength=10)[:9]
    plain = plain_words(data)
    found = np.fromiter(map(place.get, plain, repeat(len(place))), np.int64, len(plain))
    return classes, np.bincount(found, minlength=len(place) + 1)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # pairs are numbered anew, so that the codes stay small for any text
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, back, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def plain_words(data: bytes) -> list[bytes]:
    return data.lower().translate(None, PUNCTUATION + SYMBOLS).split()


def languages(docs: DataFrame) -> list[str]:
    """The languages that get a reference: all with ``LEAST_DOCS`` documents."""
    sizes = docs.where(F.col("lang").isNotNull()).groupBy("lang").count().where(F.col("count") >= LEAST_DOCS)
    return sorted(r["lang"] for r in sizes.select("lang").collect())


def common_words(docs: DataFrame, known: list[str]) -> list[bytes]:
    """The most frequent words of each language, counted over all its texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items()]
            columns = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.string(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts[lang].update(plain_words((text or "").encode("utf-8", "surrogatepass")))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield out()
                counts.clear()
        yield out()

    own = docs.where(F.col("lang").isin(known)).select("lang", "text")
    parts = own.mapInArrow(run, "lang string, word binary, n long")
    totals = parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = totals.withColumn("place", place).where(F.col("place") <= COMMON_WORDS)
    return sorted({bytes(r["word"]) for r in top.select("word").collect()})  # COMMON_WORDS a language at most


def measure(docs: DataFrame, common: list[bytes]) -> DataFrame:
    """Base counts and both histograms of every row's whole text; of the
    common words only those that are there, and all others as the last place."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, place = class_table(), dict(zip(common, range(len(common))))
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                classes, found = histograms(data, table, place)
                blank = len(data) - len(data.translate(None, WHITE))
                symbols = len(data) - len(data.translate(None, SYMBOLS))
                there = np.flatnonzero(found)
                rows.append(
                    (len(words), len(text) - blank, symbols, repeated_lines(data), repeated_words(words))
                    + (classes, there, found[there])
                )
            yield pd.DataFrame(rows, columns=names)

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = [*counts, "classes", "places", "common"]
    kind = ", ".join(f"{c} long" for c in counts) + ", classes array<int>, places array<int>, common array<int>"
    held_back = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_BACK)) == 0
    return docs.select("doc_id", "lang", held_back.alias("held_back"), F.pandas_udf(run, kind)(F.col("text")).alias("m")).select(
        "doc_id", "lang", "held_back", "m.*"
    )


def unpacked(classes: pd.Series, places: pd.Series, common: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both histograms of some rows."""
    own = np.zeros((len(classes), len(CLASSES)))
    words = np.zeros((len(classes), size + 1))
    for i, (c, p, n) in enumerate(zip(classes, places, common)):
        own[i] = c
        words[i, p] = n
    return own, words


@dataclass
class Reference:
    """Mean shares of the classes, and of the common words that are there."""

    classes: np.ndarray
    places: np.ndarray
    shares: np.ndarray
    size: int

    def __getitem__(self, k: int) -> np.ndarray:
        """Shares of the classes (0), or of all common words and the others (1)."""
        if k == 0:
            return self.classes
        if k != 1:
            raise IndexError(k)
        out = np.zeros(self.size + 1)
        out[self.places] = self.shares
        return out


def references(measured: DataFrame, known: list[str], size: int) -> dict[str, Reference]:
    """Mean share of each class and common word, per language, of the documents
    with enough text that are not held back. Tasks send a row a language, of
    the words it has."""

    def packed(lang: str, classes: np.ndarray, common: np.ndarray) -> tuple[str, bytes, bytes, bytes]:
        there = np.flatnonzero(common)
        return lang, classes.tobytes(), there.tobytes(), common[there].tobytes()

    def out(sums: dict[str, list[np.ndarray]]) -> pd.DataFrame:
        return pd.DataFrame([packed(lang, *own) for lang, own in sums.items()], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {}
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                at = sums.setdefault(lang, [np.zeros(len(CLASSES) + 1), np.zeros(size + 2)])
                pairs = zip(unpacked(own["classes"], own["places"], own["common"], size), (GUARD_CHARS, GUARD_WORDS))
                for k, (counts, least) in enumerate(pairs):
                    counts = counts[counts.sum(1) >= least]
                    at[k][:-1] += (counts / counts.sum(1, keepdims=True)).sum(0)
                    at[k][-1] += len(counts)
                if len(sums) * size > HELD_WORDS:
                    yield out(sums)
                    sums = {}
        yield out(sums)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        classes, common = np.zeros(len(CLASSES) + 1), np.zeros(size + 2)
        for own, places, shares in zip(group["classes"], group["places"], group["shares"]):
            classes += np.frombuffer(own)
            common[np.frombuffer(places, np.int64)] += np.frombuffer(shares)
        return pd.DataFrame([packed(group["lang"].iat[0], classes, common)], columns=names)

    names = ["lang", "classes", "places", "shares"]
    kind = "lang string, classes binary, places binary, shares binary"
    rows = measured.where(F.col("lang").isin(known) & ~F.col("held_back")).select("lang", "classes", "places", "common")
    found = {}
    for r in rows.mapInPandas(run, kind).groupBy("lang").applyInPandas(add, kind).collect():
        classes, places, shares = np.frombuffer(r["classes"]), np.frombuffer(r["places"], np.int64), np.frombuffer(r["shares"])
        n = shares[-1] if len(places) and places[-1] == size + 1 else 0  # documents, in the last place
        word = places <= size
        found[r["lang"]] = Reference(classes[:-1] / max(classes[-1], 1), places[word], shares[word] / max(n, 1), size)
    return dict(sorted(found.items()))


def distances(counts: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of each row of counts from each
    row of ``models``; infinite from an empty one."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    out = np.full((len(p), len(models)), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, q in enumerate(models):
            if not q.sum():
                continue
            q = q / q.sum()
            m = (p + q) / 2
            left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
            right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
            out[:, k] = np.sqrt(np.clip((left + right) / 2, 0, 1))
    return out


class WordReferences:
    """Word shares of many languages by place, so that a document meets only
    the languages that have its words."""

    def __init__(self, refs: list[Reference], size: int):
        self.empty = np.array([not len(r.places) for r in refs], bool)
        place = np.concatenate([np.zeros(0, np.int64), *[r.places for r in refs]])
        share = np.concatenate([np.zeros(0), *[r.shares / r.shares.sum() for r in refs if len(r.places)]])
        order = np.argsort(place, kind="stable")
        self.lang = np.repeat(np.arange(len(refs)), [len(r.places) for r in refs])[order]
        self.share = share[order]
        self.many = np.bincount(place, minlength=size + 1)
        self.first = np.cumsum(self.many) - self.many

    def distances(self, counts: np.ndarray) -> np.ndarray:
        """As :func:`distances`: where only one side has a word, it adds its share."""
        out = np.empty((len(counts), len(self.empty)))
        step = max(1, COMPARED // max(len(self.empty), 1))
        for at in range(0, len(counts), step):
            own = counts[at : at + step]
            row, place = np.nonzero(own)
            p = own[row, place] / own.sum(1)[row]
            n = self.many[place]
            found = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[place], n)
            p, q = np.repeat(p, n), self.share[found]
            m = (p + q) / 2
            both = p * np.log2(p / m) + q * np.log2(q / m) - p - q
            cell = np.repeat(row, n) * out.shape[1] + self.lang[found]
            far = 2 + np.bincount(cell, both, len(own) * out.shape[1]).reshape(len(own), -1)
            out[at : at + step] = np.sqrt(np.clip(far / 2, 0, 1))
        out[:, self.empty] = np.inf
        return out


def cutoffs(measured: DataFrame, refs: dict[str, Reference], size: int) -> np.ndarray:
    """(language, histogram): how far a document may be. ``SLACK`` times
    the ``HIGH`` quantile of the held-back documents of the language; without any, 1."""
    known = list(refs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = unpacked(batch["classes"], batch["places"], batch["common"], size)
            far = []
            for k, (counts, least) in enumerate(zip(pairs, (GUARD_CHARS, GUARD_WORDS))):
                each = np.empty(len(counts))
                for lang, at in batch.groupby("lang").indices.items():
                    own = counts[at]
                    each[at] = (distances(own, refs[lang][0][None]) if k == 0 else WordReferences([refs[lang]], size).distances(own))[:, 0]
                each[counts.sum(1) < least] = np.nan
                far.append(pd.Series(each).astype(object).where(np.isfinite(each), None))
            yield pd.DataFrame({"lang": batch["lang"].to_numpy(), "a": far[0], "b": far[1]})

    out = np.ones((len(known), 2))
    if known:
        rows = measured.where(F.col("lang").isin(known) & F.col("held_back")).select("lang", "classes", "places", "common")
        found = rows.mapInPandas(run, "lang string, a double, b double").groupBy("lang")
        quantiles = [F.percentile_approx(c, HIGH, 10_000).alias(c) for c in ("a", "b")]
        for r in found.agg(*quantiles).collect():
            for k, c in enumerate(("a", "b")):
                if r[c] is not None:
                    out[known.index(r["lang"]), k] = min(1.0, max(LEAST_CUTOFF, SLACK * r[c]))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the base counts,
    base_failed, class_distance, word_distance and kept.

    A null text has no words. A document is compared with every reference, and
    a distance is that from the reference that is nearest for its cutoff. It is
    null, and keeps the document, where the guard holds it back, and where
    ``lang`` names a language without a reference (fewer than ``LEAST_DOCS``
    documents), as there is nothing to compare the document with. A null ``lang`` is compared with all.
    Words are what white space separates; a language written without any has
    few long ones, and its word histogram is all "others". An empty table gives
    no rows.
    """
    known = languages(docs)
    common = common_words(docs, known) if known else []
    size = len(common)
    measured = stored(measure(docs, common), "quality-counts")
    refs = references(measured, known, size)
    known = list(refs)
    most = cutoffs(measured, refs, size)
    classes = np.stack([refs[lang][0] for lang in known]) if known else np.zeros((0, len(CLASSES)))
    shared = shipped(docs.sparkSession, (classes, WordReferences([refs[lang] for lang in known], size)))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        models, words = received(shared)
        for lang, classes, places, own in batches:
            comparable = (lang.isna() | lang.isin(known)).to_numpy() if known else np.zeros(len(lang), bool)
            out = {}
            for k, (counts, least) in enumerate(zip(unpacked(classes, places, own, size), (GUARD_CHARS, GUARD_WORDS))):
                far = np.full(len(counts), np.nan)
                fine = np.ones(len(counts), bool)
                judged = np.flatnonzero(comparable & (counts.sum(1) >= least))
                if len(judged):
                    each = distances(counts[judged], models) if k == 0 else words.distances(counts[judged])
                    nearest = (each / most[:, k]).argmin(1)
                    far[judged] = each[np.arange(len(judged)), nearest]
                    fine[judged] = far[judged] <= most[nearest, k]
                far[~np.isfinite(far)] = np.nan
                out[("class_distance", "word_distance")[k]] = pd.Series(far).astype(object).where(~np.isnan(far), None)
                out[("class_fine", "word_fine")[k]] = fine
            yield pd.DataFrame(out)

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kind = "class_distance double, class_fine boolean, word_distance double, word_fine boolean"
    far = F.pandas_udf(run, kind)(*[F.col(c) for c in ("lang", "classes", "places", "common")])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.select("doc_id", *counts, failed.alias("base_failed"), far.alias("d")).select(
        "doc_id",
        *counts,
        "base_failed",
        "d.class_distance",
        "d.word_distance",
        (~F.col("base_failed") & F.col("d.class_fine") & F.col("d.word_fine")).alias("kept"),
    )
