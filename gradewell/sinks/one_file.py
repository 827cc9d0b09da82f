"""O-53, O-55 as one ordered file, written by many tasks.

Tasks write ordered parts; the parts become one file without passing through
one task or the driver. On a mounted path every part is copied to its own
offset of the new file by a task; on a store that joins files by name (HDFS)
the join is an operation on names. The finished file is renamed to its place,
so a reader sees the old file or the new one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .writers import comparison_rows, summary_lines, summary_order, write_csv_parts

CHUNK = 8 << 20  # bytes a task holds while it copies
STRETCH = 256 << 20  # bytes of a part that one task copies


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, length) of the written parts that hold anything, by their number."""
    fs, where = _file_system(spark, folder)
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(where)]
    named = [(p, n) for p, n in found if p.rsplit("/", 1)[-1].startswith("part-") and n]
    return sorted(named, key=lambda x: int(x[0].rsplit("/", 1)[-1].split("-")[1].split(".")[0]))


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def _copied(source: str, skip: int, at: int, size: int, target: str) -> int:
    """Copy ``size`` bytes from ``skip`` of ``source`` to ``at`` of ``target``.
    A second try writes the same bytes to the same place."""
    done = 0
    with open(source, "rb") as src, open(target, "r+b") as out:
        src.seek(skip)
        out.seek(at)
        while done < size and (chunk := src.read(min(CHUNK, size - done))):
            out.write(chunk)
            done += len(chunk)
        out.flush()
        os.fsync(out.fileno())
    return done


def _join_mounted(spark: SparkSession, header: bytes, parts: list[tuple[str, int]], target: str) -> None:
    rows, at = [], len(header)
    for path, size in parts:
        rows += [(_local(path), k, at + k, min(STRETCH, size - k)) for k in range(0, size, STRETCH)]
        at += size
    with open(target, "wb") as out:
        out.write(header)
        out.truncate(at)
    if not rows:
        return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [_copied(*row, target) for row in batch.itertuples(index=False)]})

    plan = spark.createDataFrame(rows, "source string, skip long, at long, size long")
    copied = plan.repartition(len(rows)).mapInPandas(run, "n long").agg(F.sum("n")).first()[0]
    if copied != at - len(header):
        raise OSError(f"{copied} of {at - len(header)} bytes were copied to {target}")


def _join_by_name(fs, spark: SparkSession, header: bytes, parts: list[tuple[str, int]], folder: str, target) -> None:
    """The store's own join of files: ``target`` takes the parts over."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    first = path(f"{folder}/_header")
    out = fs.create(first, True)
    out.write(bytearray(header))
    out.close()
    fs.create(target, True).close()
    names = ([first] if header else []) + [path(p) for p, _ in parts]
    array = spark._sc._gateway.new_array(path, len(names))
    for i, name in enumerate(names):
        array[i] = name
    if names:
        fs.concat(target, array)


def write_one_file(spark: SparkSession, write: Callable[[str], None], path: str, header: str = "") -> None:
    """One file ``path``: ``header``, then the parts that ``write(folder)``
    writes as text files in order. A file at ``path`` is replaced at the end;
    after a failure it is as it was and the parts are gone.

    ``path`` is on a mounted folder that every worker shares, or on a store whose
    Hadoop file system joins files (``concat``); others raise an error.
    """
    fs, target = _file_system(spark, path)
    target = fs.makeQualified(target)
    path = target.toString()
    folder = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    try:
        write(folder)
        parts, raw = _parts(spark, folder), header.encode()
        whole = f"{folder}/_whole"
        if fs.getScheme() == "file":
            _join_mounted(spark, raw, parts, _local(whole))
            old = os.path.split(_local(path))
            if os.path.exists(f"{old[0]}/.{old[1]}.crc"):  # checksums of the file that goes
                os.remove(f"{old[0]}/.{old[1]}.crc")
            os.replace(_local(whole), _local(path))
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(whole)
            _join_by_name(fs, spark, raw, parts, folder, hadoop)
            if fs.exists(target):
                fs.delete(target, False)
            if not fs.rename(hadoop, target):
                raise OSError(f"{whole} was not renamed to {path}")
    finally:
        fs.delete(_file_system(spark, folder)[1], True)


def ordered(df: DataFrame, order_by: list[str] | list[Column]) -> DataFrame:
    """``df`` in order over its partitions, by a range shuffle."""
    return df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)


def write_comparison_file(df: DataFrame, path: str, order_by: list[str]) -> None:
    """O-53 as one CSV file: the header once, then the rows by ``order_by``,
    which decides the order alone where its values differ; an empty frame is
    the header. The bytes are those of ``write_comparison_csv`` by one task."""
    rows = comparison_rows(ordered(df, order_by))
    header = ",".join(rows.columns) + "\n"
    write_one_file(df.sparkSession, lambda folder: write_csv_parts(rows, folder, "error", header=False), path, header)


def write_summary_file(
    results: DataFrame, path: str, model: str, adapter: str, output_dir: str, title: str = K.SUMMARY_TITLE
) -> None:
    """O-55 as one text file: the header, the samples without a ``sample_id``,
    the others by it. Empty results are the header with a count of 0."""
    lines = summary_lines(results, model, adapter, output_dir, title)
    rows = ordered(lines, summary_order()).select("value")
    write_one_file(results.sparkSession, lambda folder: rows.write.option("lineSep", "\n").text(folder), path)
