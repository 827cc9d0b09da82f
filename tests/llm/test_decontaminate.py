import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import decontaminate, queries

VOCABULARY = [f"{a}{b}{c}" for a in ("sta", "pre", "mor", "lin", "gua", "ther") for b in ("bo", "ce", "di", "fu") for c in "xyzklmnoprst"]
COMMON = "the of and to in a is that it for was on are as with".split()


def prose(rnd, n):
    return [rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(VOCABULARY) + rnd.choice("aeiou") for _ in range(n)]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.fixture(scope="module")
def planted(spark, documents):
    rnd = random.Random(11)
    items = {i: prose(rnd, rnd.choice([15, 20, 30, 45, 70, 150])) for i in range(40)}
    rows, leaks = [], set()
    for d in range(300):
        words = prose(rnd, rnd.choice([30, 200, 900]))
        if d % 3 == 0:
            item = d % 40
            copied = list(items[item])
            if d % 2:  # some words of the copy are others
                for k in rnd.sample(range(len(copied)), len(copied) // 8):
                    copied[k] = "swapped"
            at = rnd.randrange(len(words))
            words[at:at] = copied
            leaks.add((d, item))
        rows.append((d, " ".join(words).capitalize() + ".\n"))
    bench = spark.createDataFrame([(i, " ".join(w).capitalize() + "?") for i, w in items.items()], "item_id long, text string")
    return documents(rows), bench, rows, items, leaks


def test_finds_copies_and_paraphrases_only(planted):
    docs, bench, _, _, leaks = planted
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == leaks


def test_recall_against_brute_force(planted):
    """Of all pairs whose common subsequence covers the item, the search
    finds at least 0.9 as candidates."""
    docs, bench, rows, items, _ = planted
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = set()
    for d, text in rows[::5]:
        own = decontaminate.words(text)
        for i, words in items.items():
            item = [w.encode() for w in words]
            n = len(item)
            spans = (own[a : a + 2 * n] for a in range(0, len(own), n))
            if set(item) & set(own) and any(slow_common(item, s) >= 0.8 * n for s in spans if len(set(item) & set(s)) > n / 2):
                want.add((d, i))
    assert want
    assert len(want & got) >= 0.9 * len(want)


def test_common_length_like_definition():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        assert decontaminate.common_length(np.array(a), np.array(b)) == slow_common(a, b)


def test_answer_of_a_paraphrase(spark, documents):
    question = "when the great river of stone floods the valley of seven mills near the old bridge who"
    answer = "captain marlow opens the northern sluice gate"
    item = spark.createDataFrame([(1, f"{question}? {answer}.")], "item_id long, text string")
    altered = question.replace("great", "x").replace("stone", "y").replace("seven", "z").replace("old", "w").replace("valley", "q").replace("floods", "p")
    other = "someone else entirely shuts another quiet thing"
    filler = " ".join(f"filler{i}" for i in range(60))
    rows = [(1, f"{filler} {altered} {answer} {filler}"), (2, f"{filler} {altered} {other} {filler}"), (3, filler)]
    got = {r["doc_id"]: r["answered"] for r in decontaminate.find_leaks(documents(rows), item).collect()}
    assert got == {1: 1.0}
    given = item.withColumn("answer", F.lit("never said in any of them"))
    assert decontaminate.find_leaks(documents(rows), given).count() == 0


def test_odd_rows(spark, documents, odd_rows):
    leak = "the very long answer to the question of the day was found in a small box under the bed"
    bench = spark.createDataFrame([(1, leak), (2, None), (3, ""), (None, leak), (1, leak)], "item_id long, text string")
    rows = odd_rows + [(50, leak), (None, leak.upper())]
    docs = documents(rows).withColumnRenamed("source", "item_id")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [("50", 1), ("None", 1)]
    kept = decontaminate.remove_leaks(docs, bench)
    assert kept.count() == len(odd_rows)
    assert kept.columns == docs.columns


def test_items_without_id_are_searched(spark, documents, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    leak = "the very long answer to the question of the day was found in a small box under the bed"
    other = "seven quiet millers carry yellow lanterns over the frozen river before the winter market opens"
    bench = spark.createDataFrame([(1, leak), (None, other), (None, leak), (2, None), (None, None)], "item_id long, text string")
    docs = documents([(1, leak), (2, other), (3, "nothing of it stands here at all, only some other words")])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, None)}
    assert [r["doc_id"] for r in decontaminate.remove_leaks(docs, bench).collect()] == [3]


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents(["some text"]), bench).count() == 0
    one = spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string")
    assert decontaminate.find_leaks(documents([]), one).count() == 0


def test_blocks_of_items(planted, monkeypatch):
    docs, bench, _, _, leaks = planted
    monkeypatch.setattr(decontaminate, "ITEMS", 15)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == leaks


@pytest.mark.parametrize("many, short, long", [(1_000, 15, 59), (5_000, 15, 59), (20_000, 15, 59), (1_000, 5, 9)])
def test_recall_does_not_fall_with_the_number_of_items(many, short, long):
    """Items copied word for word, or with a tenth of the words exchanged, are
    found however badly the space holds them: here it holds next to nothing."""
    rnd = random.Random(many)
    vocabulary = [*VOCABULARY, *[f"{w}{v}" for w in VOCABULARY for v in "aeiou"]]
    memo = {}

    def some(n):
        return [rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(n)]

    def hashes(own):
        return decontaminate.numbers([w.encode() for w in own], memo)

    texts = [some(rnd.randrange(short, long + 1)) for _ in range(many)]
    items = [decontaminate.Item(i, hashes(x), hashes(x[-5:])) for i, x in enumerate(texts)]
    docs, want = [], set()
    for d, i in enumerate(range(0, many, many // 100)):
        copied = [w if d % 2 or k % 10 else "swapped" for k, w in enumerate(texts[i])]
        docs.append(hashes(some(rnd.randrange(300)) + copied + some(300)))
        want.add((d, i))
    n = np.zeros(decontaminate.BUCKETS)
    for x in [*docs, *[i.words for i in items]]:
        n[np.unique(decontaminate.buckets(x))] += 1
    idf = np.log((1 + len(docs) + many) / (1 + n)) + 0.01
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((decontaminate.BUCKETS, 8)))[0]
    search = decontaminate.Search(items, basis, idf)
    search.queries[:] = 0
    got = {(t, i) for t, i, *_ in search.leaks(docs)}
    assert got >= want
    assert short < 15 or len(got - want) <= 2  # 4 of 5 words meet by chance


def test_recall_of_the_latent_search_alone(spark, documents, monkeypatch):
    """1,000 items in five spaces, no lookup by words: copies word for word and
    with a tenth of the words exchanged."""
    monkeypatch.setattr(decontaminate, "LEAST_SHARE", 0.0)
    monkeypatch.setattr(decontaminate, "LEAST_WORDS", 0)
    rnd = random.Random(6)
    vocabulary = [f"{w}{v}" for w in VOCABULARY for v in ("", "an", "er", "is", "on", "um", "et", "al", "ix", "os")]

    def some(n):
        return [rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(n)]

    items = [some(rnd.randrange(15, 60)) for _ in range(1000)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    copied = [[w if d % 2 or k % 10 else "swapped" for k, w in enumerate(items[d * 3])] for d in range(300)]
    rows = [(d, " ".join(some(100) + own + some(100))) for d, own in enumerate(copied)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    want = {(d, d * 3) for d in range(300)}
    assert len(got & want) >= 0.9 * len(want)
    assert not got - want


def test_recall_of_many_items(spark, documents):
    """Copies of 2,000 short items with a space that is fitted on them."""
    rnd = random.Random(4)
    vocabulary = [f"{w}{v}" for w in VOCABULARY for v in ("", "an", "er", "is", "on", "um", "et", "al", "ix", "os")]

    def some(n):
        return [rnd.choice(COMMON) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(n)]

    items = [some(rnd.randrange(15, 60)) for _ in range(2000)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = [(d, " ".join(some(100) + items[d * 5] + some(100))) for d in range(400)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    assert got >= {(d, d * 5) for d in range(400)}


def test_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: b" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: b" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontaminate(spark, sf).collect()}
    assert want
    assert got == want


def test_space_is_fitted_with_every_passage(spark, documents, monkeypatch):
    """The product that the space comes from, over all passages of all texts."""
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    rnd = random.Random(4)
    texts = [" ".join(prose(rnd, n)) for n in (1, 15, 16, 17, 32, 33, 400)] + ["x " * 50, "", None, "a b a"]
    hashed = decontaminate.numbered(documents(list(enumerate(texts))))
    gen = np.random.default_rng(1)
    idf, space = gen.random(decontaminate.BUCKETS) + 0.1, gen.standard_normal((decontaminate.BUCKETS, 5))
    want = np.zeros_like(space)
    for text in texts:
        b = decontaminate.buckets(decontaminate.numbers(decontaminate.words(text), {}))
        for at in range(0, len(b), 16):
            own, tf = np.unique(b[at : at + 32], return_counts=True)
            a = tf * idf[own]
            a /= np.linalg.norm(a)
            want[own] += np.outer(a, a @ space[own])
    assert np.allclose(decontaminate.passages_times(hashed, space, idf), want, atol=1e-4)
    # a text that a sample could miss shapes the space
    item = [decontaminate.buckets(decontaminate.numbers(decontaminate.words("one two three four"), {}))]
    basis = decontaminate.fit_space(hashed, 100, item, idf)
    assert basis.shape[0] == decontaminate.BUCKETS and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)
