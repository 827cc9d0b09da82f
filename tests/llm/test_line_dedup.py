import hashlib
from collections import defaultdict

import pytest

from gradewell.llm import line_dedup, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5, keep=max):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(key(line), ())
            chosen = keep((x for x in ids if x is not None), default=None)
            if len(ids) < min_docs or i == chosen:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of(frame):
    return [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in frame.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.fixture()
def shared_lines(odd_rows):
    long = "This line stands in many of the documents, again and again."
    odd = "  \tÉtat de la ligne, répétée dans beaucoup de documents.\x0b"
    edge = "e" * 40
    rows = list(odd_rows)
    rows += [(100 + i, f"own {i}\n{long}\nshort line\n{odd if i % 2 else odd.strip()}") for i in range(9)]
    rows += [(200 + i, f"{long.upper()}\n{long}\n\n{edge}") for i in range(4)]
    rows += [(300, edge + "\r"), (301, "é" * 39), (302, "é" * 40), (None, long), (7, "second row of seven\n" + long)]
    rows += [(400 + i, "é" * 40) for i in range(4)]
    return rows


@pytest.mark.parametrize(("keep", "choose"), [("last", max), ("first", min)])
def test_like_brute_force(documents, shared_lines, keep, choose):
    frame = documents(shared_lines).withColumnRenamed("source", "n_dropped")
    got = rows_of(line_dedup.dedup_lines(frame, keep=keep))
    assert sorted(got, key=key) == sorted(brute(shared_lines, keep=choose), key=key)


def test_full_filters_stay_exact(documents, shared_lines, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_BITS", 3)
    monkeypatch.setattr(line_dedup, "FLUSH", 3)
    got = rows_of(line_dedup.dedup_lines(documents(shared_lines)))
    assert sorted(got, key=key) == sorted(brute(shared_lines), key=key)


def test_only_repeats_are_suspects(documents):
    rows = [(i, f"line number {i} that nobody else has in his document\n{'shared line ' * 5}") for i in range(300)]
    found = line_dedup.suspects(documents(rows), 40)
    assert 300 <= found.count() <= 310


def test_query_over_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op4_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute([tuple(r) for r in rows])}
    assert got == want


def test_empty_table(documents):
    done = line_dedup.dedup_lines(documents([]))
    assert done.count() == 0
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
