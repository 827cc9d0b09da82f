"""Small fixed tables built inside the JVM (no Python RDD behind them)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sql_literal(value, dtype: T.DataType) -> str:
    """A Python value as a typed Spark SQL literal."""
    if value is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        text = f"'{escaped}'"
    elif isinstance(value, bool):
        text = "TRUE" if value else "FALSE"
    elif isinstance(value, float):
        text = f"{value!r}D"
    else:
        text = str(value)
    return f"CAST({text} AS {dtype.simpleString()})"


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """A fixed, small relation as ``inline(array(named_struct(...)))`` over one row.

    Built from one SQL expression (one call from Python) and planned as a JVM
    generator; its size is the literal's size, so broadcasting it is always safe.
    """
    structs = []
    for row in rows:
        fields = ", ".join(f"'{f.name}', {sql_literal(v, f.dataType)}" for v, f in zip(row, schema.fields))
        structs.append(f"named_struct({fields})")
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.expr(f"inline(array({', '.join(structs)}))"))
