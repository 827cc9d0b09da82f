"""O-44, O-45: joins on prompt keys of which a few hold a large part of the rows.

Adaptive execution splits skewed partitions of a batch sort-merge join. Where it
does not (stream-static joins, joins by hash), the hot keys are named first, by
a sketch over an earlier table, and only their rows are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
_SALT = "_gw_salt"


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in keys])


def hot_keys(df: DataFrame, key: str | list[str], share: float = 0.01) -> list[int]:
    """Hashes of the keys that hold about ``share`` of the rows or more.

    One aggregation of frequent-items sketches, merged from all tasks; 2 / share
    hashes at most reach the driver. A key a little under the share may be
    named too, which costs only copies of its one reference row.
    """
    if not 0.001 <= share <= 1:
        raise ValueError(f"share {share}: 0.001 to 1")
    keys = [key] if isinstance(key, str) else list(key)
    most, tracked = int(2 / share), int(16 / share)
    sketch = F.expr(f"approx_top_k(_gw_h, {most}, {tracked})")
    found = df.select(_key_hash(keys).alias("_gw_h")).agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return sorted(r["item"] for r in found["top"] or () if r["count"] >= share * found["n"])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    hot: list[int],
    how: str = "left",
    salts: int = SALTS,
    spread: Column | None = None,
) -> DataFrame:
    """``left.join(right, key, how)`` (left or inner) with the rows of the
    ``hot`` keys (of :func:`hot_keys`) dealt over ``salts`` tasks.

    A row's salt is a hash of ``spread``, by default of all its columns, so a
    task that runs again deals its rows alike; rows equal in it stay together.
    Rows of ``right`` with a hot key are copied once a salt, all others are left
    as they are. Null keys meet no row; they are spread when null keys are hot.
    Rows and columns are those of the plain join.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how {how!r}: left or inner")
    keys = [key] if isinstance(key, str) else list(key)
    if not hot:
        return left.join(right, keys, how)
    is_hot = _key_hash(keys).isin(hot)
    dealt = F.xxhash64(*[F.col(c) for c in left.columns]) if spread is None else F.xxhash64(spread)
    salted = left.withColumn(_SALT, F.when(is_hot, F.pmod(dealt, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.withColumn(_SALT, F.explode(copies))
    return salted.join(copied, [*keys, _SALT], how).drop(_SALT)
