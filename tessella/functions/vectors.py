"""Vector expressions over array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def conform(a: Column, dims: int) -> Column:
    """First `dims` components at unit length; a zero vector stays, a shorter one raises."""
    head = F.slice(a, 1, dims)
    n = norm(head)
    unit = F.when(n == 0, F.transform(head, lambda x: x.cast("double"))).otherwise(F.transform(head, lambda x: x.cast("double") / n))
    short = F.raise_error(F.concat(F.lit("vector is shorter than "), F.lit(str(dims)))).cast("array<double>")
    return F.when(F.size(a) < dims, short).otherwise(unit)


def hash_embedding(text: Column, dims: int) -> Column:
    """Deterministic stand-in for an embedding model: counts of words hashed into `dims` cells."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))
    hist = F.aggregate(cells, F.array_repeat(F.lit(0.0), dims), lambda s, c: F.concat(F.slice(s, F.lit(1), c), F.array(F.element_at(s, c + 1) + 1.0), F.slice(s, c + 2, F.lit(dims))))
    return hist
