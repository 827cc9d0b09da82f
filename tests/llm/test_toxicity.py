import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import queries, toxicity


def corpus(n=400, seed=4):
    rnd = np.random.default_rng(seed)
    plain = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("rt", "ln", "sk", "mp")]
    bad = ["grrnasty", "grrfoul", "grrvile", "hatefulish"]
    texts, toxic = [], []
    for i in range(n):
        words = list(rnd.choice(plain, rnd.integers(20, 200)))
        if i % 5 == 0:
            for _ in range(1 + len(words) // 40):
                words.insert(int(rnd.integers(len(words))), str(rnd.choice(bad)))
        texts.append(" ".join(words))
        toxic.append(int(i % 5 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def learned(spark, documents):
    texts, toxic = corpus()
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i < 300], "doc_id long, toxic int")
    return toxicity.fit(documents(texts), labels)


def test_separates_held_out_rows(documents, learned):
    texts, toxic = corpus(n=200, seed=99)
    rows = toxicity.score(documents(texts), learned).collect()
    right = sum((r["toxicity"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in rows)
    assert right / len(rows) > 0.97
    assert all(0 <= r["toxicity"] <= 1 for r in rows)


def test_odd_rows(documents, odd_rows, learned):
    rows = toxicity.score(documents(odd_rows).withColumnRenamed("lang", "toxicity"), learned).collect()
    assert len(rows) == len(odd_rows)
    empty = {r["toxicity"] for r in rows if not (r["text"] or "").strip()}
    assert len(empty) == 1
    assert max(empty) < 0.5


def test_scores_like_the_definition(documents, learned):
    texts, _ = corpus(n=12, seed=5)
    place = {b: i for i, b in enumerate(learned.features.tolist())}
    for r in toxicity.score(documents(texts), learned).collect():
        used = set()
        for word in set(r["text"].split()):
            marked = f"<{word}>"
            grams = {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
            used |= {zlib.crc32(g.encode()) & (toxicity.BUCKETS - 1) for g in grams}
        z = sum(learned.weight[place[b]] for b in used if b in place) + learned.bias
        assert r["toxicity"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_without_positives(spark, documents):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(documents(["a b c", "d e f"]), labels)
    rows = toxicity.score(documents(["a", None]), model).collect()
    assert all(0 <= r["toxicity"] < 0.5 for r in rows)
    none = toxicity.fit(documents([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(documents([]), none).count() == 0


def test_negative_risk_goes_back():
    """Where positives alone make the negative risk negative, it is not pushed further."""
    rows = [np.array([0], np.int32)] * 20 + [np.array([1], np.int32)] * 20
    positive = np.array([True] * 20 + [False] * 20)
    weight, bias = toxicity.train(rows, positive, 0.5, 2)
    assert weight[0] + bias > 0 > weight[1] + bias
    p = 1 / (1 + np.exp(-(weight[1] + bias)))
    assert p < 0.5


def test_held_out_rows_are_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    pairs = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect()]
    held = [(x["score"], t) for x, t in pairs if x["held_out"]]
    low = [s for s, t in held if not t]
    # a random toxic document scores over a random other one
    better = [sum(s > x for x in low) + sum(s == x for x in low) / 2 for s, t in held if t]
    assert sum(better) / len(better) / len(low) > 0.8


def test_repeated_labels_and_ids(spark, documents):
    texts, toxic = corpus(60)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] * 3, "doc_id long, toxic int")
    model = toxicity.fit(documents(texts), labels.withColumn("text", F.lit("clash")))
    assert np.isfinite(model.weight).all()


def slow_buckets(text):
    out = set()
    for word in set(toxicity.WORD.findall((text or "").lower())):
        marked = f"<{word}>"
        grams = {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
        out |= {zlib.crc32(g.encode()) % toxicity.BUCKETS for g in grams}
    return out


def slow_fit(rows, prior):
    """Features, weights and bias from (text, positive), by a dense matrix: the
    positives' risk and the negatives' share of the unlabelled risk, which is
    climbed instead where it is below zero."""
    held = [(slow_buckets(t), p) for t, p in rows]
    n_pos = sum(p for _, p in held)
    n_other = len(held) - n_pos
    in_pos, in_other = Counter(), Counter()
    for own, p in held:
        (in_pos if p else in_other).update(own)
    chosen = []
    for bucket, uses in in_pos.items():
        p, u = uses / n_pos, in_other[bucket] / n_other
        both = (uses + in_other[bucket]) / len(held)
        z = (p - u) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_other) + 1e-12)
        if uses >= toxicity.LEAST_USE and (u - prior * p) / (1 - prior) <= toxicity.MOST_NEGATIVE * p and z >= toxicity.LEAST_Z:
            chosen.append(bucket)
    chosen.sort()
    assert 0 < len(chosen) < toxicity.FEATURES
    x = np.array([[b in own for b in chosen] for own, _ in held], float)
    pos = np.array([p for _, p in held], bool)
    w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, toxicity.ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        steep = (p * (1 - p))[:, None] * np.hstack([x, np.ones((len(x), 1))])
        negative_risk = p[~pos].mean() - prior * p[pos].mean()
        of_negatives = steep[~pos].mean(axis=0) - prior * steep[pos].mean(axis=0)
        grad = -of_negatives if negative_risk < 0 else of_negatives - prior * steep[pos].mean(axis=0)
        grad[:-1] += toxicity.DECAY * prior * w / len(chosen)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = toxicity.RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return chosen, w, bias


def test_query_like_a_slow_version(spark):
    """The table is smaller than the samples asked for, so that all training
    rows are learned from and nothing depends on how rows are drawn."""
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    toxic = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0:
            toxic[r["doc_id"]] = max(r["toxic"], toxic.get(r["doc_id"], 0))
    prior = min(max(sum(toxic.values()) / len(toxic), 1e-3), 0.5)
    assert len(docs) < toxicity.UNLABELLED
    learn = [(t, toxic.get(i) == 1) for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 0]
    chosen, w, bias = slow_fit(learn, prior)
    weight = dict(zip(chosen, w))
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        z = sum(weight.get(b, 0.0) for b in slow_buckets(t)) + bias
        want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-4)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
