"""O-53..O-55: comparison CSV, evaluation results as JSON lines, text summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def comparison_rows(df: DataFrame) -> DataFrame:
    return df.select("prompt", "base_output", "lora_output")


def write_csv_parts(rows: DataFrame, path: str, mode: str, header: bool) -> None:
    (
        rows.write.mode(mode)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        # Spark would trim the texts otherwise
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_comparison_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """O-53: ``prompt, base_output, lora_output`` as UTF-8 CSV with a header;
    quotes are doubled. Multi-line fields stay quoted (read back with
    ``multiLine``). ``single_file`` writes through one task: for a report of
    at most some thousand rows, as the reference makes. For a larger one there
    is ``one_file.write_comparison_file``."""
    out = comparison_rows(df)
    write_csv_parts(out.coalesce(1) if single_file else out, path, mode, header=True)


RESULT_FIELDS = (
    "sample_id",
    "dataset_index",
    "image_path",
    "original_image_url",
    "question",
    "ground_truth",
    "model_answer",
    "processing_status",
)


def write_results_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """O-54: one JSON object per line with the eight result fields; non-ASCII
    text is written as is. A frame without one of them is an error."""
    missing = [c for c in RESULT_FIELDS if c not in df.columns]
    if missing:
        raise ValueError(f"results lack the fields {missing}")
    df.select(*RESULT_FIELDS).write.mode(mode).option("ignoreNullFields", False).json(path)


def summary_order() -> list[Column]:
    """The header, samples without an id, then the others; equal ones by their text."""
    return [F.coalesce("_gw_order", F.lit(-1)), F.col("_gw_order").isNull(), F.col("value")]


def summary_lines(
    results: DataFrame, model: str, adapter: str, output_dir: str, title: str = K.SUMMARY_TITLE
) -> DataFrame:
    """O-55 as a frame of (order, text): a header with the sample count, then
    one block per sample numbered ``sample_id + 1`` with two digits. A null
    field reads ``None``, so every sample keeps its block."""
    total = results.agg(F.count(F.lit(1)).alias("n"))
    header = total.select(
        F.lit(-1).cast("long").alias("_gw_order"),
        F.concat(
            F.lit(f"{title}\n{K.SUMMARY_RULE}\n\n{K.SUMMARY_HEADER[0]}{model}\n{K.SUMMARY_HEADER[1]}{adapter}\n"),
            F.lit(K.SUMMARY_HEADER[2]),
            F.col("n").cast("string"),
            F.lit(f"\n{K.SUMMARY_HEADER[3]}{output_dir}\n"),
        ).alias("value"),
    )
    truth = results.schema["ground_truth"].dataType.simpleString() if "ground_truth" in results.columns else ""
    gt = (
        F.concat(F.lit("['"), F.array_join("ground_truth", "', '"), F.lit("']"))
        if truth.startswith("array")
        else F.col("ground_truth").cast("string")
    )
    none = F.lit("None")
    number = F.format_string(K.SAMPLE_HEADER, F.col("sample_id") + 1)
    number = F.when(F.col("sample_id").isNull(), F.lit(K.SAMPLE_HEADER.replace("%02d", "None"))).otherwise(number)
    values = [F.col("image_path"), F.col("question"), gt, F.col("model_answer"), F.col("processing_status")]
    lines = [F.concat(F.lit(k), F.coalesce(v, none), F.lit("\n")) for k, v in zip(K.SAMPLE_FIELDS, values)]
    blocks = results.select(
        F.col("sample_id").cast("long").alias("_gw_order"),
        F.concat(number, F.lit(K.SAMPLE_RULE + "\n"), *lines).alias("value"),
    )
    return header.unionByName(blocks)


def write_summary(
    results: DataFrame,
    path: str,
    model: str,
    adapter: str,
    output_dir: str,
    mode: str = "overwrite",
    title: str = K.SUMMARY_TITLE,
) -> None:
    """O-55: the summary as text, header first, blocks in sample order
    (range-partitioned sort, so files are in order without one task)."""
    lines = summary_lines(results, model, adapter, output_dir, title)
    rows = lines.repartitionByRange(*summary_order()).sortWithinPartitions(*summary_order())
    rows.select("value").write.mode(mode).option("lineSep", "\n").text(path)
