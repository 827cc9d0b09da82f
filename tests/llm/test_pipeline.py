import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gradewell.llm import decontaminate, language_id
from gradewell.llm.common import id_crc
from .test_bpe import by_library
from .test_line_dedup import brute as slow_lines
from .test_simhash import slow as slow_groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def staged(rows, items, predict):
    """Brute-force version of the stages, over (doc_id, text) with unique ids."""
    rows = [(i, t) for i, t in rows if not predict(t)[2]]
    rows = [(i, t) for i, _, _, t in slow_lines(rows)]
    keep = {c for _, _, c in slow_groups(rows)}
    rows = [(i, t) for i, t in rows if i in keep]
    joined = [b" ".join(decontaminate.words(x)) for x in items]
    rows = [(i, t) for i, t in rows if not any(x and x in b" ".join(decontaminate.words(t)) for x in joined)]
    return {i: by_library(t)[0] for i, t in rows}


def test_run_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = language_id.fit(docs.where(id_crc() % 4 != 2))
    want = staged(plain(docs.collect()), items, model.predict)
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0 < len(want) < docs.count()


def test_stage_shape():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", range(4))
def test_stages_return_the_columns(spark, documents, odd_rows, stage):
    docs = documents(odd_rows)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == COLUMNS
    assert out.dtypes == docs.dtypes
    assert 0 < out.count() <= len(odd_rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables_and_more_columns(spark, documents, odd_rows, stage):
    name, f = corpus_pipeline.STAGES[stage]
    assert f(spark, documents([]), SF).count() == 0
    clash = documents(odd_rows).withColumns({c: F.lit("x") for c in ("score", "fp", "item_id", "n_lines", "ids")})
    out = f(spark, clash, SF)
    assert out.count() > 0
    if stage < 4:
        assert out.columns == clash.columns


HELPERS = "language lost_id lost_row gone left own owner own_n_lines n_lines n_dropped gone_id gone_hash fp component_id row digest keeper _language".split()


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_their_helpers_names(spark, documents, stage):
    line = "a line that many documents share, and all but one lose"
    rows = [(i, f"The own text of document {i} with words enough to tell what it says\n{line}") for i in range(8)]
    docs = documents(rows).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in HELPERS})
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert got
    for r in got:
        assert [r[c] for c in HELPERS] == [f"{c} {r['doc_id']}" for c in HELPERS]


def test_near_duplicate_stage_leaves_one_row_of_each_component(spark, documents):
    a = "one text that stands here more than once in the table " * 3
    b = "something else altogether with no word of the other one " * 3
    rows = [(1, a), (1, b), (2, a), (None, b), (None, "alone and without an id, but with words " * 3), (3, a), (1, a)]
    got = corpus_pipeline.STAGES[2][1](spark, documents(rows), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", a), ("1", b), ("None", rows[4][1])])


def test_language_stage_drops_texts_without_a_letter(spark, documents, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents([(10**6, "12 34"), (10**6 + 1, None)]))
    ids = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert len(ids) == docs.count() - 2
    assert not ids & {10**6, 10**6 + 1}


def test_lengths_follow_the_text(spark, documents):
    line = "a line that many documents share, and all but one lose"
    rows = [(i, f"own text {i}\n{line}") for i in range(8)]
    for r in corpus_pipeline.STAGES[1][1](spark, documents(rows), SF).collect():
        assert r["n_chars"] == len(r["text"])


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


@pytest.mark.parametrize("name", ["op2_secret_scan", "op4_line_dedup", "op12_manifest"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    frame = entry.queries()[name](spark, SF)
    sql = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in frame.collect())
