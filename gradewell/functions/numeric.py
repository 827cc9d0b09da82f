"""Numeric column functions: softmax, Python-compatible float parsing, calibration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import py_strip

# What Python's float() accepts (underscores aside): optional sign, a decimal
# with optional exponent, or nan / inf / infinity in any case.
PY_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_python_float(c: Column | str, default: float = 0.0) -> Column:
    """Text -> double as Python's ``float()`` would read it; anything else -> default.

    Spark's cast alone would accept ``1.0d`` and ``0x1p3`` and reject a
    signed ``nan``; the pattern guard fixes both (Q-6).
    """
    s = py_strip(F.coalesce(_col(c), F.lit("")))
    unsigned_nan = F.regexp_replace(s, r"^[+-]([nN][aA][nN])$", "$1")
    return F.when(s.rlike(PY_FLOAT), unsigned_nan.try_cast("double")).otherwise(F.lit(default))


def softmax(logits: Column | str) -> Column:
    """O-32: ``exp(x - max) / sum`` over an array of doubles."""
    arr = _col(logits)
    top = F.array_max(arr)
    exps = F.transform(arr, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def label_probabilities(probs: Column | str, labels=K.TEACHER_LABELS) -> Column:
    """Probability array -> ``map<label, probability>``."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), _col(probs))


def uniform_probabilities(labels=K.TEACHER_LABELS) -> Column:
    return F.array(*[F.lit(1.0 / len(labels)) for _ in labels])


def calibration(p_teacher: Column | str, confidence: Column | str) -> Column:
    """O-39: ``max(0, 1 - (confidence - p)^2)``; NaN -> 0 as Python's max gives."""
    gap = _col(confidence) - _col(p_teacher)
    value = F.lit(1.0) - gap * gap
    return F.when(F.isnan(value) | value.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), value))


def round6(c: Column | str) -> Column:
    """Round to 6 places and fold -0.0 into 0.0 (for stable comparison)."""
    return F.round(_col(c), 6) + F.lit(0.0)
