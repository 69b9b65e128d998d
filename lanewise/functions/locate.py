"""Numbers in text: maximal runs of ASCII digits, with their places and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = "[0-9]+"


def characters(text: Column) -> Column:
    """One token per character."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def digit_tokens(text: Column) -> Column:
    """One token per digit, and one per stretch between digits."""
    return F.regexp_extract_all(text, F.lit("([0-9]|[^0-9]+)"), 1)


def is_digit(token: Column) -> Column:
    return token.rlike("^[0-9]$")


def run_values(text: Column) -> Column:
    """The runs themselves, in order."""
    return F.regexp_extract_all(text, F.lit(RUN), 0)


def digit_runs(text: Column) -> Column:
    """Array of struct(start, len, run): starts follow from the lengths of the runs and of what lies between."""
    runs, gaps = run_values(text), F.split(text, RUN)
    empty = F.expr("named_struct('at', 0, 'i', 0, 'runs', cast(array() as array<struct<start:int,len:int,run:string>>))")

    def step(state: Column, run: Column) -> Column:
        start = state["at"] + F.length(F.get(gaps, state["i"]))
        found = F.struct(start.alias("start"), F.length(run).alias("len"), run.alias("run"))
        return F.struct((start + F.length(run)).alias("at"), (state["i"] + 1).alias("i"), F.concat(state["runs"], F.array(found)).alias("runs"))

    return F.aggregate(runs, empty, step, lambda s: s["runs"])


def leading_answer(text: Column) -> Column:
    """Digits of the first number of a decoded answer: what precedes is skipped, the first non-digit stops."""
    return F.regexp_extract(text, "^[^0-9]*([0-9]*)", 1)
