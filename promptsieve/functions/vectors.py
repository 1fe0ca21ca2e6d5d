"""Column expressions over dense vectors held as arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: Sequence, kind: str = "double") -> Column:
    """A constant array, built by one call whatever its length.

    Splitting a constant is folded into a plain literal by the optimiser, so tasks
    neither parse nor build anything.
    """
    if kind == "string":
        return F.split(F.lit("\uffff".join(values)), "\uffff")
    return F.split(F.lit(",".join(repr(float(v) if kind == "double" else int(v)) for v in values)), ",").cast(f"array<{kind}>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def divide(a: Column, by: Column) -> Column:
    """Every element over one number of the row.

    The divisor is an argument, not a reference inside the lambda: the optimiser may
    inline the expression behind such a reference and then evaluate it per element.
    """
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, s: x.cast("double") / s)


def normalise(a: Column, floor: float = 1e-8) -> Column:
    """Unit vector; a norm below the floor is replaced by the floor."""
    return divide(a, F.greatest(norm(a), F.lit(floor)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)),
        F.lit(0.0), lambda s, v: s + v,
    ))


def softmax(values: Column) -> Column:
    peaks = F.array_repeat(F.array_max(values), F.size(values))
    lifted = F.zip_with(values, peaks, lambda v, m: F.exp(v - m))
    return divide(lifted, F.aggregate(lifted, F.lit(0.0), lambda s, v: s + v))


def sparse(size: int, ids: Column, values: Column) -> Column:
    """An ML sparse vector from parallel arrays of positions and values, inside the JVM."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    body = F.struct(
        F.lit(0).alias("type"), F.lit(size).alias("size"), ids.alias("indices"), values.alias("values")
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(body.alias("v"))), schema)["v"]
