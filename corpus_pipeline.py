"""The corpus pipeline: stages that each apply one operator to all rows the
stage before kept. Every stage but the last returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import bpe, decontaminate, language_id, line_dedup, simhash
from gradewell.llm.common import discard, free_names, id_crc, stored, table
from gradewell.llm.queries import WORD_BPE

# No stage but the line dedup can be said in SQL; the stages are tested
# against brute-force versions.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no letter, or far from every
    language learned from the labelled documents."""
    model = language_id.fit(docs.where(id_crc() % 4 != 2))
    (into,) = free_names(docs, "language")
    found = language_id.identify(docs, model, into=into)
    return found.where(~F.col(f"{into}.rejected")).drop(into)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    # a document's own columns of the operator's names are put aside
    names = [c for c in ("n_lines", "n_dropped") if c in docs.columns]
    aside = dict(zip(names, free_names(docs, *(f"own_{c}" for c in names))))
    done = line_dedup.dedup_lines(docs.withColumnsRenamed(aside)).drop("n_lines", "n_dropped")
    own = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumnsRenamed({v: k for k, v in aside.items()}).withColumns(own).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, and a digest of what they decode to."""
    coded = bpe.encode(docs.select("doc_id", "text"), WORD_BPE)
    return coded.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.col("bpe.ids").alias("ids"),
        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the
    shared folder and read back as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
            if k:
                discard(before)
    return docs
