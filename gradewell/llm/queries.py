"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import bpe, decontaminate, language_id, language_model, line_dedup, manifest, quality, runs, secret_scan, simhash, token_counts, token_store, toxicity
from gradewell.llm.common import id_crc, shared_path, table
from gradewell.llm.oracle import ORACLE  # noqa: F401 - the entry reads it here

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
STORE_END_ID = 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, BYTE_BPE, STORE_END_ID)
    return token_store.checksums(token_store.read_tokens(spark, path))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "flat-tokens")
    token_counts.write_flat(docs, path, BYTE_BPE)
    # doc_index is the rank by doc_id; count_documents has it as a column
    return token_counts.count_documents(spark, path, docs.schema["doc_id"].dataType.simpleString()).select(
        "doc_id", "start", "n_tokens"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc() % 5 == 0
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model, "score")
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc() % 5 == 1
    model = language_model.fit(docs.where(~held_out))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lowered if f == "text" else F.col(f) for f in manifest.FIELDS]
    found = manifest.manifest(docs, {"tampered": F.when(id_crc() % 3 == 0, manifest.leaf_digest(*fields))})
    given = found.withColumn("given", F.coalesce("tampered", "leaf")).withColumn("folded_root", manifest.folded_root("given"))
    digits = F.lower(F.hex("proof")).cast("binary")
    return given.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(digits, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as the contract of op13 has them: texts of a
    tenth of the ids repeat some of their words from a word on to the end."""
    h = id_crc()
    g = F.floor(h / 10)
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice(words, a.cast("int") + 1, p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted_runs(table(spark, sf_dir, "documents")))
    # runs come by start, then period, so that the first of equals stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b.length * a.period > a.length * b.period, b).otherwise(a))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_bpe": op3_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_store": op5_token_store,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_language_model": op11_language_model,
    "op12_manifest": op12_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
