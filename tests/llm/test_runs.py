import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.llm import queries, runs


def brute(words, least_words=24, least_periods=3):
    """Every period at every place."""
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for i, j in edges.reshape(-1, 2).tolist():
            stretch = ids[i : j + q]
            if len(stretch) >= max(least_words, least_periods * q):
                if not any((stretch[d:] == stretch[:-d]).all() for d in range(1, q)):
                    out.append((i, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, n, letters):
    words = [str(rng.randrange(letters)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(n)
        p, end = 1 + rng.randrange(max(1, (n - a) // 3)), rng.randint(a, n)
        for i in range(a, end):
            words[i] = words[a + (i - a) % p]
    return words


def results(frame):
    return sorted(
        (str(r.doc_id), r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.text) for r in frame.collect()
    )


def expected(rows, **least):
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        found = brute(words, **least)
        out.append((str(i), len(words), tuple(found), collapsed(words, found)))
    return sorted(out)


def test_equals_brute_force(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(periodic(rng, rng.randint(1, 260), rng.choice([1, 2, 3, 40])))) for i in range(250)]
    assert results(runs.find_runs(documents(rows))) == expected(rows)


def test_runs_across_tiles(spark, documents, monkeypatch):
    monkeypatch.setattr(runs, "TILE_WORDS", 16)
    rng = random.Random(4)
    rows = [(i, " ".join(periodic(rng, rng.randint(200, 900), rng.choice([1, 2, 60])))) for i in range(25)]
    assert results(runs.find_runs(documents(rows))) == expected(rows)


def test_runs_longer_than_a_tile(spark, documents):
    unit = [f"w{i}" for i in range(700)]
    rows = [(1, " ".join(["x"] * 20_000)), (2, " ".join(["start", *unit * 25, "end"])), (3, " ".join([*unit[:5], *["a", "b"] * 9000]))]
    got = {r[0]: (r[2], r[3]) for r in results(runs.find_runs(documents(rows)))}
    assert got["1"] == (((0, 20_000, 1),), "x")
    assert got["2"] == (((1, 17_500, 700),), " ".join(["start", *unit, "end"]))
    assert got["3"] == (((5, 18_000, 2),), " ".join([*unit[:5], "a", "b"]))


def test_bounds(spark, documents):
    rows = [(1, "a " * 23), (2, "a " * 24), (3, "a b " * 12), (4, " ".join(["a b c d e f g h i"] * 2 + ["a b c d e f g h"])), (5, " ".join(["a b c d e f g h i"] * 3))]
    assert [len(r[2]) for r in results(runs.find_runs(documents(rows)))] == [0, 1, 1, 0, 1]
    assert results(runs.find_runs(documents(rows), least_words=9, least_periods=4)) == expected(rows, least_words=9, least_periods=4)
    with pytest.raises(ValueError):
        runs.find_runs(documents(rows), least_periods=2)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    assert results(runs.find_runs(docs)) == expected(odd_rows)
    assert runs.find_runs(docs.limit(0)).collect() == []
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("key", "octave", "runs", "tiled", "start", "period", "n_words")])
    assert results(runs.find_runs(clash)) == expected(odd_rows)


def contract(i, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if i is None else str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    left = collapsed([w.decode() for w in words], found)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (str(i), len(found), *map(str, row), *(hashlib.sha256(x.encode()).hexdigest() for x in (told, left)))


def test_query_equals_brute_force(spark, documents, tables, odd_rows):
    rng = random.Random(5)
    rows = [(i, " ".join(periodic(rng, rng.randint(1, 150), 30))) for i in range(300)]
    rows += [(1000 + i, t[:3000] if t else t) for i, t in odd_rows if i is not None] + [(None, "a b c d " * 9)]
    got = queries.op13_periodic_runs(spark, tables(documents=documents(rows))).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, contract(*r))) for r in rows)
