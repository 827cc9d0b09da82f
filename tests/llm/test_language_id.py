import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import language_id, queries
from gradewell.llm.common import id_crc

TEXTS = {
    "en": "the cat and the dog were in the house of the old man with a hat and they had a good time",
    "de": "der Hund und die Katze waren in dem Haus von dem alten Mann mit einem Hut und sie hatten Zeit",
    "fr": "le chien et le chat étaient dans la maison du vieil homme avec un chapeau et ils avaient le temps",
}


def corpus(n=60):
    out = []
    for k, (lang, text) in enumerate(TEXTS.items()):
        words = text.split()
        for i in range(n):
            turn = i % len(words)
            out.append((k * 1000 + i, " ".join(words[turn:] + words[: turn + 1] + [words[i * 7 % len(words)]] * 3), lang))
    return out


@pytest.fixture(scope="module")
def model(documents):
    return language_id.fit(documents(corpus()))


def test_learns_and_scores(documents, model):
    assert model.languages == ["de", "en", "fr"]
    rows = language_id.identify(documents(corpus()), model).select("lang", "language.*").collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 and not r["rejected"] for r in rows)


def test_slow_cosine(model):
    """The prediction is the language of the nearest centroid."""
    for _, text, _ in corpus(5):
        counts = {}
        raw = f" {text.lower()} ".encode()
        for i in range(len(raw) - 2):
            code = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % 2**32 >> 20
            counts[code] = counts.get(code, 0) + 1
        v = np.zeros(language_id.BUCKETS)
        for c, n in counts.items():
            v[c] = np.log1p(n) * model.idf[c]
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert model.predict(text)[0] == model.languages[model.owner[cosine.argmax()]]


def test_odd_rows(documents, odd_rows, model):
    rows = language_id.identify(documents(odd_rows).withColumn("language", F.lit(1)), model)
    got = rows.select("doc_id", "text", "language.*").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["score"] == 0 and r["rejected"])


@pytest.mark.parametrize("text", ["12345 67890 " * 20, "", None, "!!! ???", "½ ²"])
def test_no_letter(model, text):
    assert model.predict(text) == ("und", 0.0, True)


def test_far_texts_are_rejected(model):
    assert model.predict("Где находится библиотека и сколько времени занимает дорога " * 3)[2]
    assert not model.predict("short")[2]


def test_real_model_rejects_what_is_no_language_of_it(spark):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rnd = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["".join(rnd.choice(list(a), 2000)) for a in (letters, "0123456789abcdef", letters + letters.upper() + "0123456789+/")]
    polish = "Gdzie znajduje się biblioteka i ile czasu zajmuje droga do niej z dworca, skoro wszystkie ulice są zamknięte. "
    finnish = "Missä kirjasto sijaitsee ja kuinka kauan sinne kestää kävellä rautatieasemalta, kun kadut ovat suljettuina. "
    russian = "Где находится библиотека и сколько времени занимает дорога до неё от вокзала. "
    chinese = "图书馆在哪里从火车站走到那里需要多长时间因为所有的街道都关闭了"
    for text in [*made, "12345 67890 " * 100 + "a", polish, finnish, russian, chinese, polish * 5, russian * 5]:
        assert model.predict(text)[2], text[:40]


def test_one_outlier_does_not_set_the_cutoff(documents, model):
    """One text of noise with a language barely moves the least cosines."""
    noise = " ".join(f"{i * 7919 % 9973:x}q" for i in range(40))
    other = language_id.fit(documents([*corpus(), (9999, noise, "en")]))
    assert (other.least > 0.8 * model.least).all()
    assert not other.predict(TEXTS["fr"])[2]


def test_every_language_is_learned(documents, monkeypatch):
    rows = [(k * 10 + i, f"wort{k}abc satz{k}xyz dies{k} und{k} " * 4 + str(i), f"l{k:02}") for k in range(70) for i in range(3)]
    many = language_id.fit(documents(rows))
    assert many.languages == [f"l{k:02}" for k in range(70)]
    assert {many.predict(t)[0] for _, t, _ in rows} == set(many.languages)
    monkeypatch.setattr(language_id, "TEXTS", 60 * language_id.LEAST_TEXTS)
    # more values than have room: the most frequent ones, here the first of equals
    noisy = [*rows, *((2000 + i, f"wort69abc satz69xyz dies69 und69 {i}", "l69") for i in range(3))]
    assert language_id.fit(documents(noisy)).languages == [f"l{k:02}" for k in [*range(59), 69]]


def test_nothing_to_learn(documents):
    nothing = language_id.fit(documents([(1, "text", None), (2, None, "en"), (3, "12", "de")]))
    assert language_id.fit(documents([])).predict("some text") == ("und", 0.0, True)
    assert nothing.predict("some text")[0] == "und"
    assert language_id.identify(documents([]), nothing).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in got) == 0


def test_only_training_rows_matter(spark, documents):
    """Held-out rows, and language columns of any row, do not move scores."""
    rows = corpus()
    docs = documents(rows).withColumn("held", id_crc() % 4 == 2)
    one = language_id.fit(docs.where("not held"))
    two = language_id.fit(docs.withColumn("text", F.when(F.col("held"), F.lit("xx yy")).otherwise(F.col("text"))).where("not held"))
    assert np.array_equal(one.centroids, two.centroids)


def test_clusters_are_unit_rows():
    rows = np.abs(np.random.default_rng(1).standard_normal((30, 8)))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    got = language_id.clusters(rows, 4)
    assert got.shape == (4, 8)
    assert np.allclose(np.linalg.norm(got, axis=1), 1)
    assert len(language_id.clusters(rows[:2], 4)) == 2
