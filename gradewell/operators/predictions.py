"""O-33: teacher predictions kept between runs.

A store is a folder of Parquet parts, one per run, keyed by the digest of the
text. A run asks the model only for texts that no committed run holds. Its part
counts only once its entry in the manifest folder is there, and that entry is
written last, so a run that fails leaves nothing that a reader sees.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rewards import Predictor, score_teacher, text_key

PARTS, MANIFEST = "parts", "manifest"
KIND = "text_key string, probs array<double>"


class PredictionStore:
    """A growing table of (text_key, probs) under ``path`` on shared storage.

    ``fingerprint`` names the model and its settings: a store of another model
    is refused. Runs may overlap; a text that two of them predicted counts once.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprint: str = "model"):
        if "/" in fingerprint:
            raise ValueError("the fingerprint is part of a file name")
        self.spark, self.path, self.fingerprint = spark, path.rstrip("/"), fingerprint
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> list[tuple[int, str, str]]:
        """(number, part, model) of the committed runs, in order: a few bytes a run."""
        folder = self._path(f"{self.path}/{MANIFEST}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        entries = (n.split(".", 2) for n in names if n[0].isdigit())
        return sorted((int(number), part, model) for number, part, model in entries)

    def _commit(self, part: str) -> int:
        """Enter the part after those committed before. The entry is an empty
        file whose name says all, so it is there whole or not at all; runs that
        overlap may share a number, and part names order them."""
        number = max((n for n, _, _ in self._manifest()), default=-1) + 1
        entry = self._path(f"{self.path}/{MANIFEST}/{number:012d}.{part}.{self.fingerprint}")
        self._fs.create(entry, False).close()
        return number

    def runs(self) -> list[str]:
        return [part for _, part, _ in self._manifest()]

    def read(self) -> DataFrame:
        """All committed predictions, each text once."""
        entries = self._manifest()
        others = {model for _, _, model in entries} - {self.fingerprint}
        if others:
            raise ValueError(f"{self.path} holds predictions of {', '.join(sorted(others))}, not of {self.fingerprint}")
        if not entries:
            return self.spark.createDataFrame([], KIND)
        parts = self.spark.read.schema(KIND).parquet(*[f"{self.path}/{PARTS}/{part}" for _, part, _ in entries])
        return parts.dropDuplicates(["text_key"])

    def history(self) -> DataFrame:
        """(run, n): the predictions of each committed run, by its place in order."""
        out = self.spark.createDataFrame([], "run int, n bigint")
        for place, (_, part, _) in enumerate(self._manifest()):
            rows = self.spark.read.schema(KIND).parquet(f"{self.path}/{PARTS}/{part}")
            out = out.unionByName(rows.agg(F.lit(place).alias("run"), F.count(F.lit(1)).alias("n")))
        return out

    def update(self, df: DataFrame, text: str, predictor_factory: Callable[[], Predictor], **teacher) -> DataFrame:
        """Predict the texts of ``df`` that are not in the store yet, add them
        as one part, and return the whole store (:func:`rewards.with_teacher`
        takes it). Null and blank texts are never sent.

        Digests of the new texts are compared with the stored ones by an
        anti-join on the digest, so only unseen texts are shuffled with their
        text to the model. A run without any adds no part.
        """
        known = self.read().select(F.col("text_key").alias("_gw_key"))
        named = df.select(F.col(text).alias("text")).filter(F.col("text") != "")
        unseen = named.join(known, text_key("text") == F.col("_gw_key"), "left_anti")
        part = uuid.uuid4().hex
        folder = f"{self.path}/{PARTS}/{part}"
        try:
            score_teacher(unseen, "text", predictor_factory, **teacher).write.parquet(folder)
            empty = self.spark.read.schema(KIND).parquet(folder).isEmpty()
        except Exception:
            self._fs.delete(self._path(folder), True)
            raise
        if empty:
            self._fs.delete(self._path(folder), True)
        else:
            self._commit(part)
        return self.read()

    def clean(self) -> int:
        """Delete parts that no run committed, such as those of a driver that
        was lost. Call it when no run is going on. Returns how many went."""
        folder = self._path(f"{self.path}/{PARTS}")
        if not self._fs.exists(folder):
            return 0
        kept, gone = set(self.runs()), 0
        for status in self._fs.listStatus(folder):
            if status.getPath().getName() not in kept:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone
