"""Heads over sequences of vectors kept as rows (sequence, position, vector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors


def pooled(rows: DataFrame, key: str, pos: str, vector: str, query: list[float], last: Column) -> DataFrame:
    """key, pooled: the mean of a sequence's vectors up to `last`, weighted by the softmax of their scores over sqrt(width)."""
    scored = rows.where(F.col(pos) <= last).withColumn("score", vectors.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query])) / F.sqrt(F.size(vector).cast("double")))
    scored = scored.withColumn("weight", F.exp(F.col("score") - F.max("score").over(Window.partitionBy(key))))
    each = scored.select(key, "weight", F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(key, "i").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("mean"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("pooled"))


def gain(vector: Column, weights: list[float]) -> Column:
    """One and what the gate head reads from a control vector."""
    return 1 + vectors.dot(vector, F.array(*[F.lit(float(x)) for x in weights]))


def routed(logits: Column, n_ops: int, span_fail: Column, refused: Column) -> Column:
    """struct(op_index, mass): the best operation, and 1 if the best class of all is one and nothing forbids it."""
    fires = vectors.argmax(logits) < n_ops
    return F.struct(vectors.argmax(F.slice(logits, 1, n_ops)).alias("op_index"), (fires & ~span_fail & ~refused).cast("int").alias("mass"))


def read_operand(rows: DataFrame, lanes: DataFrame, key: str, pos: str, logits: str, lane: str) -> DataFrame:
    """key, place, digit: the digit that each lane's position shows; a lane of -1 shows 0."""
    each = lanes.select(key, F.posexplode(lane).alias("place", "at"))
    read = rows.select(F.col(key).alias("__key"), F.col(pos).alias("__pos"), vectors.argmax(F.slice(logits, 1, 10)).alias("digit"))
    out = each.join(read, (F.col(key) == F.col("__key")) & (F.col("at") == F.col("__pos")), "left")
    return out.select(key, "place", F.when(F.col("at") < 0, 0).otherwise(F.col("digit")).alias("digit"))


def scattered(deltas: DataFrame, spine: DataFrame, key: str, pos: str, target: str, value: str) -> DataFrame:
    """spine(key, pos) with the sum of the deltas that go there, 0 where none does; a target of -1 goes nowhere."""
    sums = deltas.where(F.col(target) >= 0).groupBy(key, F.col(target).alias(pos)).agg(F.sum(value).alias("sum"))
    return spine.join(sums, [key, pos], "left").select(key, pos, F.coalesce("sum", F.lit(0)).alias("sum"))


def total_loss(losses: dict[str, tuple[Column, float]]) -> list[Column]:
    """Aggregates: each loss, and their weighted sum."""
    whole = F.lit(0.0)
    for loss, weight in losses.values():
        whole = whole + weight * loss
    return [*[loss.alias(name) for name, (loss, _) in losses.items()], whole.alias("loss")]


def compared(gold: DataFrame, predicted: DataFrame, key: str, answer: str) -> DataFrame:
    """Gold rows with whether a recorded prediction of their key gives their answer; a missing one doesn't."""
    own = predicted.select(key, F.col(answer).alias("__got"))
    return gold.join(own, key, "left").withColumn("right", F.coalesce(F.col("__got") == F.col(answer), F.lit(False))).drop("__got")
