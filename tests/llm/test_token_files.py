import gzip
import io
import json
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradewell.llm import queries, token_counts, token_store
from gradewell.llm.byte_tokens import Encoder, read_spec
from gradewell.llm.queries import BYTE_BPE


def library(special):
    t = Tokenizer.from_file(BYTE_BPE)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = not special
    return t


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("special", [True, False])
def test_encoder_like_library(odd_rows, special):
    texts = [t for _, t in odd_rows] + [
        "a  b", "a b ", " a", "\n a", "a\n b c\n\n d", "It's 'tis the dog's. x.. y,, z'' (a) ###", "one.two three!four 5%",
        "tail \xa0 nbsp\xa0 x", "a\x1c b", "<|endoftext|> x<|endoftext|>y", "x <|endoftext|>", "é. ñ! ́. ½. ²,",
    ]
    encoder = Encoder(read_spec(BYTE_BPE), special)
    want = [x.ids for x in library(special).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from the memo
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_encoder_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("gradewell.llm.byte_tokens.CACHED", 4)
    encoder, texts = Encoder(read_spec(BYTE_BPE)), [f"some word{i} other{i}." for i in range(30)]
    got = [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts]
    assert got == [library(True).encode(t, add_special_tokens=False).ids for t in texts]


def test_store_round_trip(spark, documents, odd_rows):
    path = f"{tempfile.mkdtemp()}/ids"
    token_store.write_tokens(documents(odd_rows).withColumnRenamed("lang", "ids"), path, BYTE_BPE, 2)
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    texts = ordered(odd_rows)
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    tokenizer = library(True)
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in rows)
    assert got == sorted((i or -1, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in texts)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_store_prunes_by_id(spark, documents):
    path = f"{tempfile.mkdtemp()}/ids"
    token_store.write_tokens(documents([(i, f"text number {i}") for i in range(500)]), path, BYTE_BPE, 2)
    everything = {r["doc_id"]: tuple(r) for r in token_store.read_tokens(spark, path).collect()}
    some = token_store.read_tokens(spark, path, [3, 77, 400])
    assert {r["doc_id"]: tuple(r) for r in some.collect()} == {i: everything[i] for i in (3, 77, 400)}
    assert "PushedFilters: [In(doc_id, [3,400,77])]" in some._jdf.queryExecution().executedPlan().toString() or "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def test_store_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    at, want = 0, {}
    for r, e in zip(rows, library(True).encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)):
        ids = e.ids + [2]
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op5_token_store(spark, sf).collect()} == want


def test_store_of_empty_table(spark, documents):
    path = f"{tempfile.mkdtemp()}/ids"
    token_store.write_tokens(documents([]), path, BYTE_BPE, 2)
    assert token_store.checksums(token_store.read_tokens(spark, path)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
@pytest.mark.parametrize("block", [3, 7, 1000])
def test_counts_over_blocks(spark, documents, odd_rows, block, compression):
    path = f"{tempfile.mkdtemp()}/flat"
    small = [(i, t) for i, t in odd_rows if len(t or "") < 1000]
    token_counts.write_flat(documents(small), path, BYTE_BPE, ordered=True, compression=compression)
    got = token_counts.count_tokens(spark, path, block_ids=block).orderBy("doc_index").collect()
    tokenizer = library(False)
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ordered(small)]
    assert [r["doc_index"] for r in got] == list(range(len(small)))
    assert sorted(r["n_tokens"] for r in got) == sorted(sizes)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


@pytest.mark.parametrize("block", [2, 5, 64])
@pytest.mark.parametrize("cuts", [[], [4], [1, 4, 9, 10], [0, 12]])
def test_scan_of_given_files(spark, block, cuts):
    """Documents cross blocks and files; the last one has no end."""
    ids = np.array([5, 6, 0, 0, 7, 8, 9, 1, 1, 0, 4, 4], "<u4")
    folder = tempfile.mkdtemp()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(ids)])):
        with open(f"{folder}/part-{k:05}", "wb") as f:
            f.write(ids[a:b].tobytes())
    got = [tuple(r) for r in token_counts.count_tokens(spark, folder, 0, "<u4", block).orderBy("doc_index").collect()]
    assert got == [(0, 0, 3), (1, 3, 1), (2, 4, 6), (3, 10, 2)]


def test_counts_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sizes = [len(x.ids) + 1 for x in library(False).encode_batch(texts, add_special_tokens=False)]
    got = [tuple(r) for r in queries.op8_token_counts(spark, sf).orderBy("doc_index").collect()]
    assert sorted(n for _, _, n in got) == sorted(sizes)
    starts = np.cumsum([0] + [n for _, _, n in got])[:-1].tolist()
    assert [(k, at) for k, at, _ in got] == list(enumerate(starts))


def test_counts_in_order_of_ids(spark, documents):
    rows = [(i * 7919 % 997, "token " * (i % 13)) for i in range(300)]
    path = f"{tempfile.mkdtemp()}/flat"
    token_counts.write_flat(documents(rows), path, BYTE_BPE, ordered=True)
    got = [r["n_tokens"] for r in token_counts.count_tokens(spark, path).orderBy("doc_index").collect()]
    tokenizer = library(False)
    assert got == [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in sorted(rows)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_counts_carry_ids_however_rows_are_dealt(spark, documents, odd_rows, compression):
    rows = [(i * 7919 % 997, "token " * (i % 13)) for i in range(300)] + [(2000 + (i or 0), t) for i, t in odd_rows]
    rows.append((None, "a null id"))
    docs, tokenizer = documents(rows), library(False)
    sizes = [(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows]
    want, at = [], 0
    for k, (i, n) in enumerate(sorted(sizes, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        want.append((i, k, at, n))
        at += n
    for dealt in (docs.coalesce(1), docs.repartition(5, "text")):
        path = f"{tempfile.mkdtemp()}/flat"
        token_counts.write_flat(dealt, path, BYTE_BPE, compression=compression)
        got = token_counts.count_documents(spark, path, block_ids=1000).orderBy("doc_index").collect()
        assert [(r["doc_id"], r["doc_index"], r["start"], r["n_tokens"]) for r in got] == want


def test_counts_query_names_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: len(x.ids) + 1 for r, x in zip(rows, library(False).encode_batch([r["text"] or "" for r in rows], add_special_tokens=False))}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op8_token_counts(spark, sf).collect()} == want


def test_counts_of_empty_table(spark, documents):
    path = f"{tempfile.mkdtemp()}/flat"
    token_counts.write_flat(documents([]), path, BYTE_BPE)
    assert token_counts.count_tokens(spark, path).count() == 0


def test_counts_with_ids_of_empty_table(spark, documents):
    path = f"{tempfile.mkdtemp()}/flat"
    token_counts.write_flat(documents([]), path, BYTE_BPE)
    assert token_counts.count_documents(spark, path).count() == 0


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_pieces_of_packed_files(size, tmp_path):
    raw = np.random.default_rng(1).integers(0, 9, 5000).astype("<u4").tobytes()
    (tmp_path / "a b#c").write_bytes(raw)
    (tmp_path / "a b#c.gz").write_bytes(gzip.compress(raw))
    for name, packed in (("a b#c", False), ("a b#c.gz", True)):
        with token_counts.open_file(f"file:{tmp_path}/{name}", packed) as stream:
            got = list(token_counts.pieces(stream, size))
        assert b"".join(got) == raw
        assert all(len(x) == size for x in got[:-1])


@pytest.mark.parametrize(("most", "want"), [(1, ["abc"]), (2, ["abc", "def"]), (3, ["abc", "def", "g"]), (9, ["abc", "def", "g"])])
def test_pieces_of_a_range(most, want):
    assert list(token_counts.pieces(io.BytesIO(b"abcdefg"), 3, most)) == [x.encode() for x in want]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    """Ranges of one file go to tasks of their own; documents cross them."""
    ids = np.random.default_rng(2).integers(0, 40, 50_000).astype("<u4")
    (tmp_path / "part-00000").write_bytes(ids.tobytes())
    blocks = token_counts.scan_blocks(spark, str(tmp_path), 0, "<u4", 100)
    assert blocks.rdd.getNumPartitions() == -(-50_000 // (100 * token_counts.RANGE_BLOCKS))
    tasks = {r[0] for r in blocks.select(F.spark_partition_id()).distinct().collect()}
    assert len(tasks) > 10
    got = token_counts.count_tokens(spark, str(tmp_path), 0, "<u4", 100).orderBy("doc_index").collect()
    stops = [*(np.flatnonzero(ids == 0) + 1).tolist(), *([len(ids)] if ids[-1] else [])]
    starts = [0, *stops[:-1]]
    assert [tuple(r) for r in got] == [(k, a, b - a) for k, (a, b) in enumerate(zip(starts, stops))]


def test_ids_that_do_not_fit_and_a_known_end_id_are_refused(documents):
    def spec(*ids):
        return json.dumps({"model": {"vocab": {f"t{i}": i for i in ids}}, "added_tokens": [{"id": 7, "content": "x"}]})

    token_counts.check_width(spec(0, 65_535), 0xC580, ">u2")
    token_counts.check_width(spec(0, 116_096), 0xC580, ">u4")
    with pytest.raises(ValueError, match="do not fit"):
        token_counts.check_width(spec(0, 116_096), 0xC580, ">u2")
    for known in (0xC580, 7):
        with pytest.raises(ValueError, match="in the vocabulary"):
            token_counts.check_width(spec(0, 0xC580), known, ">u2")
    with pytest.raises(ValueError, match="in the vocabulary"):
        token_counts.write_flat(documents([(1, "a")]), f"{tempfile.mkdtemp()}/flat", BYTE_BPE, end_id=2)


def test_encoder_takes_known_chunks_over_from_a_full_memo(monkeypatch):
    monkeypatch.setattr("gradewell.llm.byte_tokens.CACHED", 12)
    encoder = Encoder(read_spec(BYTE_BPE))
    seen, ids = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: seen.extend(texts) or ids(texts))
    texts = ["a often words", "b often new1 new2 new3 new4", "c often new5 new6 new7 new8", "d often, \n x", "e often new9"]
    want = [library(True).encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encoder.encode([t])[0], "<u4").tolist() for t in texts] == want
    assert sum("often" in t.split(" ") for t in seen) == 1
    assert len(encoder.known) <= 12 + 5 and len(encoder.before) <= 12 + 5


def test_tasks_share_the_encoder_of_a_process(spark):
    """The encoder stays in the broadcast's value from task to task."""
    from gradewell.llm.byte_tokens import shared_encoder

    spec = spark.sparkContext.broadcast({"spec": read_spec(BYTE_BPE)})

    def run(batches):
        import os

        import pyarrow as pa

        had = True in spec.value
        shared_encoder(spec)
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([had]), pa.array([n])], ["pid", "had", "n"])

    rows = spark.range(0, 64, 1, 32).mapInArrow(run, "pid long, had boolean, n long").collect()
    assert sum(r["n"] for r in rows) == 64
    # one construction a process at most, whatever the number of tasks
    assert sum(not r["had"] for r in rows) == len({r["pid"] for r in rows})
