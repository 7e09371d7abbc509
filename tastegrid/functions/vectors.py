"""Expressions on array columns and seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a norm of zero counts as in a division.
TINY_NORM = 1e-10


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def safe_norm(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.lit(TINY_NORM)).otherwise(n)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone; any engine with MD5 gives the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def augment(features: Column, length: Column, largest: Column) -> Column:
    """One more dimension, sqrt(largest^2 - length^2): the largest inner product becomes the largest cosine."""
    rest = F.greatest(F.lit(0.0), largest * largest - length * length)
    return F.concat(F.transform(features, lambda x: x.cast("double")), F.array(F.sqrt(rest)))


def has_nan(features: Column) -> Column:
    return F.exists(features, lambda x: F.isnan(x))
