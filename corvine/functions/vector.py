"""Column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and inside whatever lambda the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    divided = lambda v, n: F.transform(v, lambda x: x.cast("double") / n)
    return let(a, lambda v: let(norm(v), lambda n: let(F.when(n > 0, n).otherwise(1.0), lambda by: divided(v, by))))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalize(a), normalize(b))


def quantize(a: Column, bits: int = 8) -> Column:
    """struct(scale, codes): symmetric whole numbers of ``bits`` bits, the largest component at the end of the range."""
    top = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = lambda t: F.when(t > 0, t / (2 ** (bits - 1) - 1)).otherwise(1.0)
    codes = lambda v, by: F.struct(by.alias("scale"), F.transform(v, lambda x: F.round(x.cast("double") / by).cast("int")).alias("codes"))
    return let(a, lambda v: let(top(v), lambda t: let(scale(t), lambda by: codes(v, by))))
