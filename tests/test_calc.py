import random

import pytest
from pyspark.sql import functions as F

from lanewise.functions import calc, lanes

PY = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}
EDGES = [("add", 999999999999999, 1), ("sub", 10**15, 1), ("sub", 10, 3), ("sub", 5, 5), ("mul", 10**16 - 1, 10**16 - 1), ("mul", 1, 1), ("add", 10**15, 10**15), ("add", 0, 0), ("mul", 0, 7), ("sub", 7, 0)]


def cases():
    rng = random.Random(0)
    out = list(EDGES)
    for _ in range(120):
        op = rng.choice(calc.OPS)
        a, b = (rng.randrange(10 ** (d - 1), 10**d) for d in (rng.randint(1, 16), rng.randint(1, 16)))
        out.append((op, a, b))
    return out


@pytest.mark.parametrize("f", [calc.calculate, calc.calculate_by_digit, calc.calculate_native])
def test_matches_python_integers(spark, f):
    rows = [(i, op, str(a), str(b)) for i, (op, a, b) in enumerate(cases())]
    df = spark.createDataFrame(rows, "i int, op string, a string, b string")
    for op in calc.OPS:
        got = {r.i: r for r in df.where(F.col("op") == op).withColumn("c", f(F.col("a"), F.col("b"), op)).select("i", "c.result", "c.refused", "c.reason").collect()}
        for i, o, a, b in rows:
            if o == op:
                want = PY[op](int(a), int(b))
                assert (got[i].result, got[i].refused, got[i].reason) == ((None, True, "negative") if want < 0 else (str(want), False, None))


@pytest.mark.parametrize("f", [calc.calculate, calc.calculate_by_digit, calc.calculate_native])
def test_refusals(spark, f):
    df = spark.createDataFrame([("3", "10"), ("10", "3"), ("12345", "1"), (None, "1"), ("x", "1"), ("007", "1"), ("1" * 50, "1")], "a string, b string")
    got = [r[0] for r in df.select(f(F.col("a"), F.col("b"), "sub", 4)["reason"]).collect()]
    assert got == ["negative", None, "operand too wide", "no operand", "no operand", None, "operand too wide"]


def test_carries(spark):
    df = spark.createDataFrame([([9, 9],), ([1, 0],), ([99, 99],), ([-3, 1],), ([12, 11, 2, 0, 0, 0, 0, 0],), ([-1, 0],)], "s array<bigint>")
    got = [(list(r.c.digits), r.c.carry) for r in df.select(calc.resolve_carry(F.col("s")).alias("c")).collect()]
    assert got == [([9, 9], 0), ([1, 0], 0), ([9, 8], 10), ([7, 0], 0), ([2, 2, 3, 0, 0, 0, 0, 0], 0), ([9, 9], -1)]


def test_places_are_schoolbook(spark):
    row = spark.range(1).select(calc.place_columns(F.array(*[F.lit(x).cast("bigint") for x in (3, 2)]), F.array(*[F.lit(x).cast("bigint") for x in (4, 1)]), "mul", 4)).first()
    assert row[0] == [12, 11, 2, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError, match="unknown operation"):
        calc.place_columns(F.lit(None), F.lit(None), "div", 4)


def test_lanes(spark):
    row = spark.range(1).select(
        lanes.digits_lsd(F.lit(472), 5), lanes.digits_lsd(F.lit(472), 2), lanes.digits_lsd(F.lit(-1), 2), lanes.lanes_lsd(F.lit(33), F.lit(3), 5), lanes.lanes_lsd(F.lit(1), F.lit(6), 5),
        lanes.hard_digits(F.array(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.9)))),
    ).first()
    assert list(row) == [[2, 7, 4, 0, 0], None, None, [35, 34, 33, -1, -1], None, [1]]


def test_digits_by_limb_and_by_digit(spark):
    rows = [(str(a), str(b)) for _, a, b in cases()]
    df = spark.createDataFrame(rows, "a string, b string")
    for op in calc.OPS:
        one, other = ([tuple(r) for r in df.select(f(F.col("a"), F.col("b"), op).alias("c")).select("c.digits", "c.reason").collect()] for f in (calc.calculate, calc.calculate_by_digit))
        assert one == other
