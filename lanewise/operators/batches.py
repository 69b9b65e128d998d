"""Aligned arrays for training: tokens by character, operand lanes, labels, answer lanes, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corpus as C
from ..functions.calc import OPS
from ..functions.lanes import digits_lsd, lanes_lsd
from ..functions.locate import characters, digit_runs

IGNORE = -100


def _run_of(role: str) -> Column:
    zipped = F.arrays_zip(F.col("roles").alias("role"), F.col("runs").alias("run"))
    return F.get(F.filter(zipped, lambda x: x["role"] == role), F.lit(0))["run"]


def build(problems: DataFrame, dmax: int = 16, ops: tuple[str, ...] = OPS) -> DataFrame:
    """A row for each problem with its lanes and labels. An operand or answer too wide gives `refused` and null lanes."""
    rows = problems.withColumn("runs", digit_runs(F.col("prompt")))
    rows = rows.withColumn("a_run", _run_of("a")).withColumn("b_run", _run_of("b"))
    none = F.array_repeat(F.lit(-1), dmax)
    located = F.col("a_run").isNotNull()
    p0 = F.length("prompt")
    answer = F.regexp_extract("completion", "[0-9]+", 0)
    n, lead = F.length(answer), F.instr("completion", answer) - 1

    def lanes(run: str) -> Column:
        return F.when(located, lanes_lsd(F.col(f"{run}.start"), F.col(f"{run}.len"), dmax)).otherwise(none)

    def digits(run: str, pos: str) -> Column:
        own = digits_lsd(F.col(f"{run}.run"), dmax)
        targets = F.zip_with(F.col(pos), own, lambda p, d: F.when(p < 0, IGNORE).otherwise(d.cast("int")))
        return F.when(located, targets).otherwise(F.array_repeat(F.lit(IGNORE), dmax))

    def label(j: Column) -> Column:
        inside = lambda r: (j >= F.col(f"{r}.start")) & (j < F.col(f"{r}.start") + F.col(f"{r}.len"))
        return F.when(~located, IGNORE).when(inside("a_run"), 1).when(inside("b_run"), 2).otherwise(0)

    place = F.sequence(F.lit(0), F.lit(2 * dmax - 1))
    rows = rows.withColumn("a_pos", lanes("a_run")).withColumn("b_pos", lanes("b_run"))
    return rows.select(
        "seq", "op", C.op_label(F.col("op"), ops).alias("op_label"), "a_pos", "b_pos", digits("a_run", "a_pos").alias("a_dig"), digits("b_run", "b_pos").alias("b_dig"),
        # one before the digit: where it is predicted
        F.transform(place, lambda k: F.when(k < n, p0 + lead + n - 2 - k).otherwise(-1)).alias("w_pos"),
        F.transform(place, lambda k: F.when(k < n, F.substring(answer, n - k, F.lit(1)).cast("int")).otherwise(IGNORE)).alias("w_tok"),
        (p0 - 1).alias("ctl_pos"), p0.alias("p0"),
        F.when(p0 > 0, F.transform(F.sequence(F.lit(0), p0 - 1), label)).otherwise(F.array().cast("array<int>")).alias("span_labels"),
        F.concat(characters(F.col("prompt")), characters(F.col("completion"))).alias("tokens"),
        (F.col("a_pos").isNull() | F.col("b_pos").isNull() | (n > 2 * dmax)).alias("refused"),
    )


def padded_to_longest(rows: DataFrame, batch: str = "batch", pad: str = "") -> DataFrame:
    """Tokens, span labels and an attention mask, all as long as the batch's longest row."""
    rows = rows.withColumn("width", F.max(F.size("tokens")).over(Window.partitionBy(batch)))
    fill = lambda c, value: F.concat(F.col(c), F.array_repeat(value, F.col("width") - F.size(c)))
    mask = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: (i < F.size("tokens")).cast("int"))
    return rows.withColumn("mask", mask).withColumn("span_labels", fill("span_labels", F.lit(IGNORE))).withColumn("tokens", fill("tokens", F.lit(pad)))
