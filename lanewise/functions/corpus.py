"""Templated arithmetic problems: templates, roles, splits and hash-driven numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The templates of the corpus.
TEMPLATES = {
    "add": [
        "The depot received {a} bolts on Monday and {b} bolts on Tuesday, so the running total is",
        "A survey counted {a} households in the eastern ward and {b} in the western ward; taken together that is",
        "Adding {a} to {b} gives",
        "Of the {d1} forms filed that season, {a} were approved in the first round and {b} in the second, for a combined",
        "Two batches left the plant, one of {a} units and one of {b} units, while {d1} units stayed behind; the two shipped batches come to",
        "The northern branch banked {b} kroner and the southern branch banked {a} kroner, which sums to",
    ],
    "sub": [
        "The vault held {a} coins before {b} were withdrawn, leaving",
        "Subtract {b} from {a} to get",
        "From {a} subtract {b}, which leaves",
        "{b} of the {a} seats had already been sold, so the number still free is",
        "After {b} litres evaporated from a tank of {a} litres, what remains is",
        "The archive listed {d1} crates in all; of the {a} that were catalogued, {b} have since been returned, leaving",
    ],
    "mul": [
        "Each of the {a} trays holds {b} seedlings, so the nursery holds",
        "Multiply {a} by {b} to obtain",
        "The rate is {b} grams per sample and there are {a} samples, giving a mass of",
        "A grid of {a} rows by {b} columns contains",
        "Ignoring the {d1} spoiled cases, the plant packs {a} boxes of {b} jars each, which is",
        "The product of {a} and {b} equals",
    ],
    "off": [
        "The report numbered {d1} and the memo numbered {d2} were both filed by the clerk whose surname was",
        "Between kilometre {d1} and kilometre {d2} the road stayed closed, and the contractor responsible was",
        "Shelf {d1} of the reading room held the bound volumes, while shelf {d2} was reserved for the atlas of",
        "The inspector signed form {d1} in the morning and form {d2} that evening, in the town of",
        "Of the {d1} delegates and the {d2} observers, the only one to speak twice was the representative from",
        "Ticket {d1} was issued at the gate and ticket {d2} at the counter, both printed on paper supplied by",
    ],
}
TRAIN_CELLS = ("4x4", "6x6", "8x8", "8x4")
EVAL_CELLS = ("4x4", "6x6", "8x8", "8x4", "5x5", "6x3")


def roles_of(template: Column) -> Column:
    """a, b or d for each slot, in the order of the text."""
    return F.transform(F.regexp_extract_all(template, F.lit(r"\{(a|b|d1|d2)\}"), 1), lambda x: F.substring(x, 1, 1))


def render(template: Column, **fills: Column) -> Column:
    for name, value in fills.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def completion(answer: Column) -> Column:
    return F.concat(F.lit(" "), answer.cast("string"), F.lit("\n"))


def cell_widths(cell: Column) -> tuple[Column, Column]:
    parts = F.split(cell, "x")
    return F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")


def op_label(op: Column, ops: tuple[str, ...]) -> Column:
    """Number of the operation; one past the last for any other."""
    at = F.array_position(F.array(*map(F.lit, ops)), op) - 1
    return F.when(at < 0, len(ops)).otherwise(at).cast("int")


def hash_number(key: Column, hex_digits: int = 15) -> Column:
    """The leading hex digits of a key's md5 as a number."""
    return F.conv(F.substring(F.md5(key), 1, hex_digits), 16, 10).cast("bigint")


def split_of(op: Column, a: Column, b: Column) -> Column:
    """train, val or test by the problem, never by the row."""
    h = hash_number(F.concat_ws(":", op, a.cast("string"), b.cast("string")), 8) % 100
    return F.when(h < 80, "train").when(h < 90, "val").otherwise("test")


def sample_width(width: Column, key: Column) -> Column:
    """A number of exactly `width` digits (up to 16), drawn by hash."""
    low = F.rpad(F.lit("1"), width, "0").cast("bigint")
    return low + hash_number(key) % (9 * low)
