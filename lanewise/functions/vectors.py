"""Linear heads, softmax, pooling and losses over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def linear_head(vector: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """A logit for each row of weights."""
    own = [dot(vector, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(bias[i] if bias else 0.0)) for i, row in enumerate(weights)]
    return F.array(*own)


def argmax(values: Column) -> Column:
    """Place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    exps = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / _total(exps))


def unit(vector: Column) -> Column:
    """The vector over its norm, the norm at least 1e-6."""
    norm = F.greatest(F.sqrt(_total(F.transform(vector, lambda x: x.cast("double") * x.cast("double")))), F.lit(1e-6))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def cross_entropy(probability: Column, target: Column, ignore: int = -100) -> Column:
    """Aggregate: mean of -ln p over rows whose target counts; 0 if there is none."""
    return F.coalesce(F.avg(F.when(target != ignore, -F.ln(probability))), F.lit(0.0))
