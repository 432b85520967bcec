"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` where null equals null, as it does in a ``groupBy``.

    For inner, left, semi and anti joins; the keys are those of ``left``.
    """
    names = [f"_right_{i}" for i in range(len(keys))]
    renamed = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    return left.join(renamed, same, how).drop(*names)
