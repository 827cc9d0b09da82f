import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import language_model, queries

START, END, UNKNOWN = "<start>", "<end>", "<unknown>"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in low.encode("utf-8", "surrogatepass").split()] + [END]


class Brute:
    """Counts in dictionaries, the formula written out."""

    def __init__(self, texts, order):
        self.order, self.raw = order, Counter()
        counts = Counter()
        for t in texts:
            own = tokens(t)
            self.raw.update(own)
            padded = [START] * (order - 1) + own
            counts.update(tuple(padded[i : i + order]) for i in range(len(own)))
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):
            lower = Counter()
            for gram, c in self.counts[k + 1].items():
                lower[gram[1:]] += c if gram[1] == START else 1
            self.counts[k] = lower
        self.discounts, self.followers = {}, {}
        for k, counts in self.counts.items():
            n = [sum(c == x for c in counts.values()) for x in (1, 2, 3, 4)]
            self.discounts[k] = language_model.discounts(n)
            after = defaultdict(list)
            for gram, c in counts.items():
                after[gram[:-1]].append(c)
            self.followers[k] = after

    def discount(self, k, c):
        return self.discounts[k][min(c, 3) - 1] if c else 0.0

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.raw) + 1)
        lower = self.p(gram[1:])
        after = self.followers[k].get(gram[:-1])
        if not after:
            return lower
        c = self.counts[k].get(gram, 0)
        spare = sum(self.discount(k, x) for x in after)
        return (max(c - self.discount(k, c), 0) + spare * lower) / sum(after)

    def row(self, text):
        own = tokens(text)
        padded = [START] * (self.order - 1) + [w if w in self.raw else UNKNOWN for w in own]
        n, v = sum(self.raw.values()), len(self.raw)
        base = sum(math.log10((self.raw[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        score = sum(math.log10(self.p(tuple(padded[i : i + self.order]))) for i in range(len(own)))
        return len(own), sum(self.raw[w] > 0 for w in own), n, base, score


def prose(n, seed):
    rng = random.Random(seed)
    words = [f"W{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def same(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a[:3] == b[:3]
        assert a[3:] == pytest.approx(b[3:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_brute_force(spark, documents, order, monkeypatch):
    monkeypatch.setattr(language_model, "BUCKET_BYTES", 4000)
    rows = prose(150, order) + [(500, None), (501, ""), (502, "never seen words here W1 W1")]
    docs = documents(rows)
    model = language_model.fit(docs.where("doc_id % 4 != 0 and doc_id < 500"), order)
    assert model["bits"] > 1
    got = language_model.score(docs, model).orderBy("doc_id").collect()
    brute = Brute([t for i, t in rows if i % 4 and i < 500], order)
    same([tuple(r)[1:] for r in got], [brute.row(t) for _, t in rows])
    language_model.remove(spark, model)


def test_probabilities_add_up(spark, documents):
    rows = prose(80, 9)
    model = language_model.fit(documents(rows), 3)
    reader, n = language_model.Reader(model), model["vocabulary"]
    every = np.r_[np.arange(n), n + 1]  # words, and an unknown one
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, n + 2, 2)
        p = reader.probabilities([np.full(n + 1, a), np.full(n + 1, b), every])
        assert p.sum() == pytest.approx(1) and (p > 0).all()


def test_lower_than_half_added_counts_on_text_like_it(spark, documents):
    rng = random.Random(1)
    sentences = ["the cat sat on the mat", "a dog ran to the park", "we read the book at home"]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(8))) for i in range(60)]
    model = language_model.fit(documents(rows[:40]))
    for r in language_model.score(documents(rows[40:]), model).collect():
        assert r.score > r.base_score


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    model = language_model.fit(docs)
    brute = Brute([t for _, t in odd_rows], 2)
    key = lambda r: (str(r[0]), r[1], r[-1])
    got = sorted(map(tuple, language_model.score(docs, model).collect()), key=key)
    expected = sorted(((i, *brute.row(t)) for i, t in odd_rows), key=key)
    same([r[1:] for r in got], [r[1:] for r in expected])
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("bucket", "ids", "score", "sums", "from", "counts")])
    assert sorted(map(tuple, language_model.score(clash, language_model.fit(clash)).collect()), key=key) == got
    assert language_model.score(docs.limit(0), model).collect() == []
    nothing = language_model.fit(docs.limit(0))
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(docs, nothing).collect()} == {(0, 0, 0, 0)}


def test_folder_must_be_mounted(spark, documents):
    with pytest.raises(ValueError):
        language_model.fit(documents([(1, "a")]), folder="hdfs://there/model")


def test_query_equals_brute_force(spark, documents, tables):
    rows = prose(120, 5) + [(1000, None)]
    got = queries.op11_language_model(spark, tables(documents=documents(rows))).orderBy("doc_id").collect()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    brute = Brute([t for i, t in rows if not held[i]], language_model.ORDER)
    assert [r.held_out for r in got] == [held[i] for i, _ in rows]
    same([tuple(r)[2:] for r in got], [brute.row(t) for _, t in rows])
