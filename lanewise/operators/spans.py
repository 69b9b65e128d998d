"""Runs of equal classes in a sequence, and the longest of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lanes import lanes_lsd, let


def longest_run(text: Column, pattern: str) -> Column:
    """struct(start, len) of the longest run of characters of a class, the earliest of equals; null where there is none. Inside the row: starts follow from the lengths of runs and of what lies between."""
    runs, gaps = F.regexp_extract_all(text, F.lit(f"{pattern}+"), 0), F.split(text, f"{pattern}+")

    def over(both: Column) -> Column:
        none = F.expr("named_struct('at', 0, 'i', 0, 'start', -1, 'len', 0)")

        def step(state: Column, run: Column) -> Column:
            start, n = state["at"] + F.length(F.get(both["gaps"], state["i"])), F.length(run)
            better = n > state["len"]
            return F.struct((start + n).alias("at"), (state["i"] + 1).alias("i"), F.when(better, start).otherwise(state["start"]).alias("start"), F.greatest(n, state["len"]).alias("len"))

        return F.aggregate(both["runs"], none, step, lambda s: F.when(s["len"] > 0, F.struct(s["start"].alias("start"), s["len"].alias("len"))))

    return let(F.struct(runs.alias("runs"), gaps.alias("gaps")), over)


def tagged_characters(texts: DataFrame, key: str, text: str, classes: dict[int, str]) -> DataFrame:
    """key, pos, cls for every character; cls is the first class whose pattern matches, else 0."""
    cls = F.lit(0)
    for number, pattern in reversed(classes.items()):
        cls = F.when(F.col("char").rlike(pattern), number).otherwise(cls)
    filled = texts.where(F.length(text) > 0)
    return filled.select(key, F.posexplode(F.split(text, "")).alias("pos", "char")).select(key, "pos", cls.alias("cls"))


def islands(tags: DataFrame, key: str) -> DataFrame:
    """key, cls, start, len of every maximal run of a class other than 0."""
    own = tags.where("cls > 0")
    group = F.col("pos") - F.row_number().over(Window.partitionBy(key, "cls").orderBy("pos"))
    return own.withColumn("island", group).groupBy(key, "cls", "island").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len")).drop("island")


def longest(runs: DataFrame, key: str) -> DataFrame:
    """The longest run of each class; the earliest of equals."""
    best = F.max(F.struct("len", (-F.col("start")).alias("back"))).alias("best")
    return runs.groupBy(key, "cls").agg(best).select(key, "cls", (-F.col("best.back")).alias("start"), F.col("best.len").alias("len"))


def spans_from_tags(tags: DataFrame, key: str, p0: Column, dmax: int) -> DataFrame:
    """Lanes of the longest run of class 1 and of class 2 before p0; `fail` where either is missing or wider than dmax."""
    top = longest(islands(tags.where(F.col("pos") < p0), key), key)
    by = lambda cls: F.max(F.when(F.col("cls") == cls, F.struct("start", "len")))
    rows = tags.select(key).distinct().join(top.groupBy(key).agg(by(1).alias("one"), by(2).alias("two")), key, "left")
    lanes = lambda c: lanes_lsd(F.col(f"{c}.start"), F.col(f"{c}.len"), dmax)
    fail = lanes("one").isNull() | lanes("two").isNull()
    none = F.array_repeat(F.lit(-1), dmax)
    return rows.select(key, F.when(fail, none).otherwise(lanes("one")).alias("a_pos"), F.when(fail, none).otherwise(lanes("two")).alias("b_pos"), fail.alias("fail"))
