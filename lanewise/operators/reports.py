"""Accuracy of recorded predictions: by operation and cell, in total, and the first rows that are wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.locate import leading_answer

MEASURES = ("host", "block", "span", "calc")


def _rate(hit: Column) -> Column:
    return F.count_if(hit) / F.greatest(F.lit(1), F.count("*"))


def by_cell(rows: DataFrame) -> DataFrame:
    """rows(op, cell, host, block, route, span, calc): n and rates by operation and cell."""
    return rows.groupBy("op", "cell").agg(F.count("*").alias("n"), *[_rate(F.col(m)).alias(m) for m in (*MEASURES, "route")])


def total(rows: DataFrame) -> DataFrame:
    """Rates over all arithmetic rows, route over all rows, and how often anything fired on the others."""
    arithmetic = F.col("op") != "off"
    n = F.greatest(F.lit(1), F.count_if(arithmetic))
    fired = F.count_if(~arithmetic & F.col("fired")) / F.greatest(F.lit(1), F.count_if(~arithmetic))
    return rows.agg(F.count_if(arithmetic).alias("n_arithmetic"), F.count_if(~arithmetic).alias("n_off"), *[(F.count_if(arithmetic & F.col(m)) / n).alias(m) for m in MEASURES], _rate(F.col("route")).alias("route"), fired.alias("fired_off"))


def held_out_cells(rows: DataFrame, trained: DataFrame) -> DataFrame:
    """Cells that no training row has."""
    return rows.where("cell <> ''").select("cell").distinct().join(trained.select("cell").distinct(), "cell", "left_anti")


def first_wrong(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows, by seq, that the block got wrong."""
    return rows.where("op <> 'off' AND NOT block").orderBy("seq").limit(n)


def first_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each operation and cell."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("op", "cell").orderBy("seq"))).where(F.col("rank") <= n)


def all_match(gold: Column, predicted: Column) -> Column:
    """Whether two arrays agree in every place; false where either is null or they differ in length."""
    same = F.forall(F.zip_with(gold, predicted, lambda a, b: a.eqNullSafe(b)), lambda x: x)
    return F.coalesce(same & (F.size(gold) == F.size(predicted)), F.lit(False))


def in_order(report: DataFrame, ops: tuple[str, ...]) -> DataFrame:
    """A report by operation and cell with each row's place: by operation as given, then by the operands' widths."""
    parts = F.split("cell", "x")
    rank = F.array_position(F.array(*map(F.lit, ops)), F.col("op"))
    # a row for each operation and cell: one task's worth
    order = Window.orderBy(rank, F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int"))
    return report.withColumn("place", F.row_number().over(order))


def greedy(rows: DataFrame) -> DataFrame:
    """rows(op, cell, answer, host_decoded, block_decoded, fired): rates of right free-running answers by operation and cell; of rows without an operation how often the block fired."""
    right = lambda c: F.coalesce(leading_answer(F.col(c)) == F.col("answer"), F.lit(False))
    off = F.col("op") == "off"
    rate = lambda hit: F.when(F.first("op") != "off", _rate(hit))
    return rows.groupBy("op", "cell").agg(F.count("*").alias("n"), rate(right("host_decoded")).alias("host_greedy"), rate(right("block_decoded")).alias("block_greedy"), F.when(F.first("op") == "off", _rate(off & F.col("fired"))).alias("fire_on_off"))


def off_sample(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows without an operation, by seq."""
    return rows.where("op = 'off'").orderBy("seq").limit(n)


def all_stopped(rows: DataFrame, key: str, done: Column) -> DataFrame:
    """Whether every sequence of a batch has ended."""
    return rows.groupBy(key).agg(F.bool_and(done).alias("stopped"))


def parameter_count(weights: DataFrame) -> DataFrame:
    """weights(layer, unit, weights): parameters of each layer."""
    return weights.groupBy("layer").agg(F.sum(F.size("weights")).alias("parameters"))
