import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradewell.llm import bpe, queries
from gradewell.llm.queries import WORD_BPE

LIBRARY = Tokenizer.from_file(WORD_BPE)
LIBRARY.no_truncation()
LIBRARY.no_padding()
CODEC = bpe.Codec(bpe.load_spec(WORD_BPE))


def by_library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def expected(text):
    ids, decoded = by_library(text)
    listed = " ".join(map(str, ids)).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_like_library(documents, odd_rows):
    got = [tuple(r) for r in bpe.digests(documents(odd_rows), WORD_BPE).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(((i, *expected(t)) for i, t in odd_rows), key=key)


def test_encode_and_decode(spark, documents, odd_rows):
    coded = bpe.encode(documents(odd_rows).withColumnRenamed("lang", "bpe"), WORD_BPE)
    rows = coded.withColumn("again", bpe.decode(F.col("bpe.ids"), WORD_BPE, spark)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (list(r["bpe"]["ids"]), r["bpe"]["decoded"]) == by_library(r["text"])
        assert r["again"] == r["bpe"]["decoded"]


def test_query_over_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op3_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in rows}


def test_empty_table(documents):
    assert bpe.digests(documents([]), WORD_BPE).count() == 0


def test_speculation_and_merging_agree():
    rnd = random.Random(5)
    words = ["".join(rnd.choices("etaoinshr'", k=rnd.randint(1, 70))) for _ in range(3000)]
    for word, ids in zip(words, CODEC.encode_words(words)):
        raw = np.frombuffer(word.encode(), np.uint8).astype(int)
        raw[-1] += 256
        single = CODEC.base[raw].tolist()
        assert ids == CODEC.merge_exactly(list(single)) == CODEC._merge_by_heap(list(single))


def test_some_words_pass_and_some_fail():
    words = ["the", "running", "thouheen", "bleerthouner"]
    flat = np.concatenate([np.frombuffer(w.encode(), np.uint8).astype(int) for w in words])
    ends = np.cumsum([len(w) for w in words])
    flat[ends - 1] += 256
    token, word = CODEC.propose(flat, np.append(0, ends[:-1]), ends)
    assert set(word.tolist()) == {0, 1, 2, 3}
    assert [by_library(w)[0] for w in words] == CODEC.encode_words(words)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids, decoded = next(bpe.Memo(CODEC).of([text]))
    want, text_back = by_library(text)
    assert ids == " ".join(map(str, want))
    assert decoded == text_back


@pytest.mark.parametrize("rows", [1, 7])
def test_memo_is_bounded(monkeypatch, rows):
    monkeypatch.setattr(bpe, "CACHED", 5)
    memo = bpe.Memo(CODEC)
    texts = [f"alpha{i} beta{i} gamma{i}" for i in range(20)]
    got = [x for at in range(0, 20, rows) for x in memo.of(texts[at : at + rows])]
    assert [g[0] for g in got] == [" ".join(map(str, by_library(t)[0])) for t in texts]
