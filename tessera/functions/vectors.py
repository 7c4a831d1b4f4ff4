"""Arithmetic of arrays: softmax, cosine similarity, frames of windows. All in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column, index: int) -> Column:
    """The share of one of some logits. The largest is taken off first, so none overflows; null without that index."""
    own = F.transform(logits, lambda v: F.exp(v.cast("double") - F.array_max(logits).cast("double")))
    return F.get(own, F.lit(index)) / _sum(own)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of one length; null if either is all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def frames_of(starts: Column, length: int) -> Column:
    """The frames of windows of length from starts, in order, each once."""
    each = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + length - 1)))
    return F.array_sort(F.array_distinct(each))


def both_orders(a: Column, b: Column, sep: str = "_") -> Column:
    return F.array(F.concat_ws(sep, a, b), F.concat_ws(sep, b, a))
