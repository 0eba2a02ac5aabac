"""Vector functions as column expressions, and a deterministic embedder that needs no model."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def slot_of(token: str, dim: int = DIM) -> int:
    """The vector position that a token counts in."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
