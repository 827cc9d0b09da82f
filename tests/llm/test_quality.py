import re
from collections import Counter

import numpy as np
import pytest

from gradewell.llm import quality, queries

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


EXTRA = [
    "a b c a b c",
    "a b c x a b c",
    "a a a a a a",
    "a b a b a",
    "line\nline\n\n\nline \n line",
    "one two three",
    "# * $ % & | < > é#",
    "no break\xa0space \x1c sep \x85 nel x",
]


def test_base_like_brute_force(documents, odd_rows):
    rows = odd_rows + [(500 + i, t) for i, t in enumerate(EXTRA)]
    got = quality.judge(documents(rows).withColumnRenamed("source", "n_words")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert sorted(((r["doc_id"], *[r[c] for c in COUNTS]) for r in got), key=key) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_query_over_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in queries.op9_quality(spark, sf).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in rows}


def slow_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2

    def kl(a):
        return sum(x * np.log2(x / y) for x, y in zip(a, m) if x)

    return np.sqrt((kl(p) + kl(q)) / 2)


def test_distance_like_definition():
    rnd = np.random.default_rng(2)
    counts, models = rnd.integers(0, 9, (20, 6)).astype(float), rnd.random((3, 6))
    counts[:, 0] += 1
    got = quality.distances(counts, models)
    assert np.allclose(got, [[slow_distance(c, m) for m in models] for c in counts])
    assert quality.distances(counts[:1], counts[:1])[0, 0] == pytest.approx(0, abs=1e-6)
    assert np.isinf(quality.distances(counts, np.zeros((1, 6)))).all()


WORDS = {
    "en": "the of and to in a is that it for was on are as with".split(),
    "ru": "и в не на я он что с это как по но из за у".split(),
    "el": "και το να η του ο την που με για από τα δεν θα σε".split(),
}


def prose(rnd, lang, n=120):
    """Common words of a language between words of its own letters."""
    letters = {"en": "abcdefghijklmnoprstuvw", "ru": "абвгдежзиклмнопрсту", "el": "αβγδεζηθικλμνοπρστυ"}[lang]
    own = ["".join(rnd.choice(list(letters), 6)) for _ in range(n)]
    return " ".join(rnd.choice(WORDS[lang]) if rnd.random() < 0.5 else w for w in own) + "."


def corpus(rnd, each=60):
    names = list(WORDS)
    return [(i, prose(rnd, names[i % 3]), names[i % 3]) for i in range(3 * each)]


def test_common_words_are_learned_by_language(documents):
    rows = corpus(np.random.default_rng(5))
    assert quality.languages(documents(rows)) == ["el", "en", "ru"]
    common = quality.common_words(documents(rows), ["el", "en", "ru"])
    assert {w.encode() for own in WORDS.values() for w in own} <= set(common)
    count = Counter(w for _, t, lang in rows if lang == "ru" for w in quality.plain_words(t.encode()))
    first = sorted(count, key=lambda w: (-count[w], w))[: quality.COMMON_WORDS]
    assert quality.common_words(documents(rows), ["ru"]) == sorted(first)


def test_references_are_means(documents):
    rows = corpus(np.random.default_rng(6), 20) + [(900, "x", "en"), (901, None, None)]
    common = [w.encode() for w in WORDS["en"]]
    measured = quality.measure(documents(rows), common)
    held = {r["doc_id"] for r in measured.where("held_back").select("doc_id").collect()}
    refs = quality.references(measured, ["en"], len(common))
    place = {w: i for i, w in enumerate(common)}
    own = [t for i, t, lang in rows if lang == "en" and i not in held and i < 900]
    each = [quality.histograms(t.encode(), quality.class_table(), place) for t in own]
    assert set(refs) == {"en"}
    assert np.allclose(refs["en"][0], np.mean([c / c.sum() for c, _ in each], axis=0))
    assert np.allclose(refs["en"][1], np.mean([w / w.sum() for _, w in each], axis=0))


def test_clean_documents_of_every_language_are_kept_and_both_histograms_reject(documents):
    rnd = np.random.default_rng(7)
    rows = corpus(rnd)
    clean = prose(rnd, "en", 150)
    symbols = " ".join(f"{w}{i}$$$ ###{i}" for i, w in enumerate(clean.split()))
    bare = " ".join("".join(rnd.choice(list("abcdefghijklmnoprstuvw"), 6)) for _ in range(120)) + "."
    some = [(1000, clean, "ru"), (1001, clean, None), (1002, symbols, "en"), (1003, symbols, None), (1004, bare, "en"), (1005, symbols, "xx")]
    got = {r["doc_id"]: r for r in quality.judge(documents(rows[:]).unionByName(documents([r for r in some if r[2]])).unionByName(
        documents([(i, t) for i, t, lang in some if not lang]).selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"))).collect()}
    assert sum(got[i]["kept"] for i, _, _ in rows) == len(rows)
    assert got[1000]["kept"] and got[1001]["kept"]
    assert not got[1002]["kept"] and not got[1003]["kept"] and got[1002]["class_distance"] > 0.2
    # nothing but the missing common words tells it from prose
    assert not got[1004]["kept"] and got[1004]["class_distance"] < 0.1 < got[1004]["word_distance"]
    # no reference for the language: no verdict
    assert got[1005]["kept"] and got[1005]["class_distance"] is None


def test_clean_documents_of_the_table_are_kept(spark):
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows]) > 0.95


def test_guards_give_no_verdict(documents):
    got = quality.judge(documents([(1, "$ " * 60, "xx"), (2, "a " * 10, "en")])).collect()
    assert all(r["class_distance"] is None and r["word_distance"] is None for r in got)
    assert quality.judge(documents([])).count() == 0


def test_word_distances_of_many_languages_like_the_dense_ones():
    rnd = np.random.default_rng(5)
    counts = rnd.integers(0, 5, (30, 12)).astype(float)
    counts[:, 0] += 1
    models = rnd.random((40, 12)) * (rnd.random((40, 12)) < 0.4)
    models[3] = 0
    refs = [quality.Reference(np.zeros(9), np.flatnonzero(m), m[m > 0], 11) for m in models]
    got = quality.WordReferences(refs, 11).distances(counts)
    assert np.allclose(got, quality.distances(counts, models), atol=1e-7)


def test_every_language_gets_a_reference(spark):
    """Seventy languages of as many documents; the junk of each one is told."""
    rows = []
    for k in range(70):
        own = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "abcdefghijklmnop"]
        rnd = np.random.default_rng(k)
        rows += [(100 * k + i, " ".join(rnd.choice(own, 80)), f"lang{k:02}") for i in range(24)]
        rows.append((100 * k + 99, " ".join(rnd.choice(list("#$%&"), 300)), f"lang{k:02}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert len(quality.languages(docs)) == 70
    assert all(r["class_distance"] is not None for r in got.values())
    assert all(r["word_distance"] is not None for i, r in got.items() if i % 100 != 99)
    assert all(got[100 * k + 99]["class_distance"] > 0.5 for k in range(70))
