"""Exact column arithmetic: sums by place, then one pass of carries and borrows.

Up to 18 digits a place is a limb of nine decimal digits in a bigint; digits are parted only where
asked for. Beyond that places are digits in arrays. What several expressions read is computed once a
row by `let`: copies of it would grow past what the JVM compiles.

A result that can't be written in 2 * dmax places without a sign is refused, with the reason:
`operand too wide`, `negative`, `too wide`, or `no operand`.  Digits of refused rows are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lanes import WIDEST, as_digits, let, padded

OPS = ("add", "sub", "mul")


def place_columns(a: Column, b: Column, op: str, dmax: int) -> Column:
    """Digit arrays of up to dmax places -> 2 * dmax sums by place, no carry made yet."""
    if op in ("add", "sub"):
        sign = 1 if op == "add" else -1
        both = F.zip_with(padded(a, dmax), padded(b, dmax), lambda x, y: x + y * F.lit(sign).cast("bigint"))
        return F.concat(both, F.array_repeat(F.lit(0).cast("bigint"), dmax))
    if op != "mul":
        raise ValueError(f"unknown operation {op!r}; there are {', '.join(OPS)}")

    def product(d: Column) -> Column:
        a, b = d["a"], d["b"]  # b the other way round

        def place(k: Column) -> Column:
            # digit i of a meets digit k - i of b
            low = F.greatest(F.lit(0), k - F.size(b) + 1)
            n = F.least(k, F.size(a) - 1) - low + 1
            meet = F.zip_with(F.slice(a, low + 1, n), F.slice(b, F.size(b) - k + low, n), lambda x, y: x * y)
            return F.aggregate(meet, F.lit(0).cast("bigint"), lambda z, x: z + x)

        return F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), place)

    return padded(let(F.struct(a.alias("a"), F.reverse(b).alias("b")), product), 2 * dmax)


def _carried(columns: Column) -> Column:
    """Sums by place -> struct(text, carry), text the digits as they are written."""
    start = F.expr("named_struct('text', '', 'carry', 0L)")

    def step(state: Column, s: Column) -> Column:
        t = s + state["carry"]
        digit = F.pmod(t, F.lit(10).cast("bigint"))
        return F.struct(F.concat(digit.cast("string"), state["text"]).alias("text"), F.floor((t - digit) / 10).alias("carry"))

    return F.aggregate(columns, start, step)


def resolve_carry(columns: Column) -> Column:
    """Sums by place -> struct(digits, carry). Division rounds down, so negative sums borrow; the carry left over is returned."""
    return let(_carried(columns), lambda s: F.struct(_places(s["text"]).alias("digits"), s["carry"].alias("carry")))


def exact_answer(a: Column, b: Column, op: str) -> Column:
    """The result as a native decimal; for operands and results of up to 38 digits."""
    a, b = a.cast(WIDEST), b.cast(WIDEST)
    return {"add": a + b, "sub": a - b, "mul": a * b}[op].cast(WIDEST)


def _places(digits: Column) -> Column:
    return F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("bigint"))


LIMB, LIMB_DIGITS = 10**9, 9


def _limb_sums(s: Column, op: str) -> list[Column]:
    """Sums by limb, the lowest first, no carry made yet."""
    a0, a1, b0, b1 = (s[k] for k in ("a0", "a1", "b0", "b1"))
    if op == "add":
        return [a0 + b0, a1 + b1]
    if op == "sub":
        return [a0 - b0, a1 - b1]
    return [a0 * b0, a0 * b1 + a1 * b0, a1 * b1, F.lit(0).cast("bigint")]


def _calculated(a: Column, b: Column, op: str, dmax: int, digits: bool) -> Column:
    """calculate() by limbs; nulls of operands that are refused run through."""
    limb = F.lit(LIMB).cast("bigint")

    def limbs(d: Column) -> Column:
        x, y = d["x"], d["y"]
        wide = (F.length(x) > dmax) | (F.length(y) > dmax)
        lower = lambda v: F.substring(v, -LIMB_DIGITS, LIMB_DIGITS).cast("bigint")
        upper = lambda v: F.when(F.length(v) <= LIMB_DIGITS, F.lit(0).cast("bigint")).otherwise(F.left(v, F.length(v) - LIMB_DIGITS).cast("bigint"))
        first = F.when(x.isNull() | y.isNull(), "no operand").when(wide, "operand too wide")
        own = F.struct(lower(x).alias("a0"), upper(x).alias("a1"), lower(y).alias("b0"), upper(y).alias("b1"))
        return F.struct(F.when(first.isNull(), own).alias("of"), first.alias("reason"))

    def whole(d: Column) -> Column:
        carry, text = F.lit(0).cast("bigint"), []
        for s in _limb_sums(d["of"], op):
            t = s + carry
            text.append(F.lpad(F.pmod(t, limb).cast("string"), LIMB_DIGITS, "0"))
            # a difference borrows one at most
            carry = F.shiftright(t, 63) if op == "sub" else F.call_function("div", t, limb)
        text.append(F.when(carry > 0, carry.cast("string")).otherwise(""))
        return F.struct(F.regexp_replace(F.concat(*reversed(text)), "^0+(?=.)", "").alias("text"), carry.alias("carry"), d["reason"].alias("reason"))

    def finished(d: Column) -> Column:
        reason = F.coalesce(d["reason"], F.when(d["carry"] < 0, "negative").when(F.length(d["text"]) > 2 * dmax, "too wide"))
        return F.struct(F.when(reason.isNull(), d["text"]).alias("result"), reason.alias("reason"))

    def answer(d: Column) -> Column:
        places = [_places(F.lpad(d["result"], 2 * dmax, "0")).alias("digits")] * digits
        return F.struct(d["result"].alias("result"), *places, d["reason"].isNotNull().alias("refused"), d["reason"].alias("reason"))

    return let(let(let(let(F.struct(as_digits(a).alias("x"), as_digits(b).alias("y")), limbs), whole), finished), answer)


def calculate(a: Column, b: Column, op: str, dmax: int = 16, digits: bool = True) -> Column:
    """Two integers -> struct(result string, digits, refused, reason), by place; the digits only if asked for."""
    if op not in OPS:
        raise ValueError(f"unknown operation {op!r}; there are {', '.join(OPS)}")
    return _calculated(a, b, op, dmax, digits) if dmax <= 2 * LIMB_DIGITS else calculate_by_digit(a, b, op, dmax)


def calculate_by_digit(a: Column, b: Column, op: str, dmax: int = 16) -> Column:
    """calculate() with a place for each digit, for operands of any width."""

    def finished(t: Column) -> Column:
        text = F.when(t["reason"].isNull(), t["state"]["text"])
        return F.struct(F.regexp_replace(text, "^0+(?=.)", "").alias("result"), _places(text).alias("digits"), t["reason"].isNotNull().alias("refused"), t["reason"].alias("reason"))

    def reasoned(t: Column) -> Column:
        reason = F.coalesce(t["reason"], F.when(t["state"]["carry"] < 0, "negative").when(t["state"]["carry"] > 0, "too wide"))
        return F.struct(t["state"].alias("state"), reason.alias("reason"))

    def computed(s: Column) -> Column:
        reason = F.when(s["a"].isNull() | s["b"].isNull(), "no operand").when((F.length(s["a"]) > dmax) | (F.length(s["b"]) > dmax), "operand too wide")
        state = let(F.struct(_places(s["a"]).alias("a"), _places(s["b"]).alias("b")), lambda d: _carried(place_columns(d["a"], d["b"], op, dmax)))
        return F.struct(F.when(reason.isNull(), state).alias("state"), reason.alias("reason"))

    return let(let(let(F.struct(as_digits(a).alias("a"), as_digits(b).alias("b")), computed), reasoned), finished)


def calculate_native(a: Column, b: Column, op: str, dmax: int = 16) -> Column:
    """What calculate() gives, but for the digits, by native decimals: inside generated code, for dmax up to 18."""
    if dmax > 18:
        raise ValueError("native decimals hold results of operands of up to 18 digits")
    x, y = a.try_cast(WIDEST), b.try_cast(WIDEST)
    limit, most = F.lit(10**dmax).cast(WIDEST), F.lit("9" * (2 * dmax)).cast(WIDEST)
    # a run of digits beyond decimals is too wide, all else that is no number has no operand
    missing = lambda own, v: F.when(v.isNull(), F.when(own.cast("string").rlike("^[0-9]+$"), "operand too wide").otherwise("no operand")).when(v < 0, "no operand").when(v >= limit, "operand too wide")
    first = F.when(x.isNull() | (x < 0), missing(a, x)).when(y.isNull() | (y < 0), missing(b, y)).when((x >= limit) | (y >= limit), "operand too wide")
    fits = (x >= 0) & (y >= 0) & (x < limit) & (y < limit)
    value = exact_answer(F.when(fits, x), F.when(fits, y), op)
    reason = F.coalesce(first, F.when(value < 0, "negative").when(value > most, "too wide"))
    return F.struct(F.when(reason.isNull(), value.cast("string")).alias("result"), reason.isNotNull().alias("refused"), reason.alias("reason"))


def by_operation(op: Column, each: dict[str, Column]) -> Column:
    """The column of the row's operation; only that one is computed."""
    out = None
    for name, value in each.items():
        out = F.when(op == name, value) if out is None else out.when(op == name, value)
    return out
