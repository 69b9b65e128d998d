"""Generation of problems without rejection loops: candidates by hash, filters, the first that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corpus as C
from ..functions.calc import OPS, by_operation, exact_answer
from ..functions.lanes import WIDEST

CANDIDATES = 64
COLUMNS = ("seq", "op", "a", "b", "ans", "prompt", "completion", "roles", "cell", "tmpl")


def template_table(spark: SparkSession) -> DataFrame:
    """op, tmpl, template, roles: one row for each template."""
    rows = [(op, i, t) for op, own in C.TEMPLATES.items() for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "op string, tmpl int, template string").withColumn("roles", C.roles_of(F.col("template")))


def _check_cells(cells: tuple[str, ...], ops: tuple[str, ...]) -> None:
    for cell in cells:
        da, db = map(int, cell.split("x"))
        if not (1 <= da <= 16 and 1 <= db <= 16):
            raise ValueError(f"{cell}: widths are 1 to 16")
        if "sub" in ops and da < db:
            raise ValueError(f"{cell}: no difference of {da} and {db} digits is sure to be positive")


def arithmetic(spark: SparkSession, split: str, cells: tuple[str, ...], ops: tuple[str, ...] = OPS, per_cell: int = 100, seed: int = 0) -> DataFrame:
    """per_cell problems for each operation and cell, all of the split, each with distractors that are neither operand nor answer.

    Of a slot's candidates the first that lies in the split is kept; a slot without one would be
    an error of about 1e-6 for the smallest split and shows as a missing row."""
    _check_cells(cells, ops)
    grid = spark.createDataFrame([(o, c, i * len(cells) + j) for i, o in enumerate(ops) for j, c in enumerate(cells)], "op string, cell string, place int")
    slots = spark.range(per_cell).withColumnRenamed("id", "slot").join(F.broadcast(grid))  # a row of the grid for each slot: the plan's own size
    da, db = C.cell_widths(F.col("cell"))
    key = F.concat_ws(":", F.lit(split), F.lit(seed), "op", "cell", "slot")
    tries = slots.withColumn("key", key).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES * (2 if split != "train" else 1) - 1))))
    tries = tries.withColumn("x", C.sample_width(da, F.concat_ws(":", "key", "try", F.lit("a")))).withColumn("y", C.sample_width(db, F.concat_ws(":", "key", "try", F.lit("b"))))
    swap = (F.col("op") == "sub") & (F.col("x") < F.col("y")) & (da == db)
    tries = tries.withColumn("a", F.when(swap, F.col("y")).otherwise(F.col("x"))).withColumn("b", F.when(swap, F.col("x")).otherwise(F.col("y")))
    fits = (C.split_of(F.col("op"), F.col("a"), F.col("b")) == split) & ((F.col("op") != "sub") | (F.col("a") >= F.col("b")))
    chosen = tries.where(fits).groupBy("op", "cell", "place", "slot", "key").agg(F.min(F.struct("try", "a", "b")).alias("first")).select("op", "cell", "place", "slot", "key", "first.a", "first.b")
    chosen = chosen.withColumn("ans", by_operation(F.col("op"), {o: exact_answer(F.col("a"), F.col("b"), o) for o in ops}))
    chosen = chosen.withColumn("tmpl", (C.hash_number(F.concat_ws(":", "key", F.lit("t"))) % 6).cast("int"))

    def distractor(n: int, used: list) -> F.Column:
        own = [C.sample_width((C.hash_number(F.concat_ws(":", "key", F.lit(f"w{n}"), F.lit(i))) % 6 + 1).cast("int"), F.concat_ws(":", "key", F.lit(f"d{n}"), F.lit(i))) for i in range(6)]
        return F.filter(F.array(*own), lambda d: ~F.array_contains(F.array(*[F.col(u).cast(WIDEST) for u in used]), d.cast(WIDEST)))[0]

    chosen = chosen.withColumn("d1", distractor(1, ["a", "b", "ans"])).withColumn("d2", distractor(2, ["a", "b", "ans", "d1"]))
    rows = chosen.join(F.broadcast(template_table(spark)), ["op", "tmpl"])  # 24 templates
    return rows.select(
        (F.col("place").cast("bigint") * per_cell + F.col("slot")).alias("seq"), "op", F.col("a").cast(WIDEST).alias("a"), F.col("b").cast(WIDEST).alias("b"), "ans",
        C.render(F.col("template"), a=F.col("a"), b=F.col("b"), d1=F.col("d1"), d2=F.col("d2")).alias("prompt"), C.completion(F.col("ans")).alias("completion"), "roles", "cell", "tmpl",
    )


def off_rows(spark: SparkSession, split: str, n: int, seed: int = 0, first: int = 0) -> DataFrame:
    """Prose with numbers and no arithmetic."""
    key = F.concat_ws(":", F.lit(split), F.lit(seed), F.lit("off"), F.col("id").cast("string"))
    number = lambda i: C.sample_width((C.hash_number(F.concat_ws(":", "key", F.lit(f"w{i}"))) % 8 + 1).cast("int"), F.concat_ws(":", "key", F.lit(f"d{i}")))
    rows = spark.range(n).withColumn("key", key).withColumn("tmpl", (C.hash_number(F.concat_ws(":", "key", F.lit("t"))) % 6).cast("int"))
    rows = rows.withColumn("d1", number(1)).withColumn("d2", number(2)).join(F.broadcast(template_table(spark).where("op = 'off'")), "tmpl")
    zero = F.lit(0).cast(WIDEST)
    return rows.select(
        (F.col("id") + first).alias("seq"), "op", zero.alias("a"), zero.alias("b"), zero.alias("ans"),
        C.render(F.col("template"), d1=F.col("d1"), d2=F.col("d2")).alias("prompt"), F.lit("").alias("completion"), "roles", F.lit("").alias("cell"), "tmpl",
    )


def generate(spark: SparkSession, split: str, cells: tuple[str, ...], ops: tuple[str, ...] = OPS, per_cell: int = 100, n_off: int = 0, seed: int = 0) -> DataFrame:
    """Arithmetic and off rows together."""
    total = per_cell * len(cells) * len(ops)
    return arithmetic(spark, split, cells, ops, per_cell, seed).unionByName(off_rows(spark, split, n_off, seed, total)).select(*COLUMNS)


def planned(spark: SparkSession, per_cell: dict[str, int], off_share: float = 0.25, train_cells: tuple[str, ...] = C.TRAIN_CELLS, eval_cells: tuple[str, ...] = C.EVAL_CELLS, ops: tuple[str, ...] = OPS, seed: int = 0) -> DataFrame:
    """The corpus of several splits with their name in `split`: `per_cell` problems for each operation and cell, and a share of that many off rows."""
    out = None
    for split, n in per_cell.items():
        cells = train_cells if split == "train" else eval_cells
        rows = generate(spark, split, cells, ops, n, int(off_share * n * len(cells) * len(ops)), seed).withColumn("split", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    return out


def violations(problems: DataFrame) -> DataFrame:
    """Rows whose prompt's numbers don't match their roles and operands, with the reason."""
    runs = F.regexp_extract_all("prompt", F.lit("[0-9]+"), 0)
    value = lambda role: F.get(F.filter(F.arrays_zip(F.col("roles").alias("r"), runs.alias("v")), lambda x: x["r"] == role)["v"], F.lit(0)).cast(WIDEST)
    reason = (
        F.when(F.size(runs) != F.size("roles"), "numbers and roles differ in count")
        .when((F.col("op") != "off") & (value("a") != F.col("a")), "a is not where its role is")
        .when((F.col("op") != "off") & (value("b") != F.col("b")), "b is not where its role is")
        .when((F.col("op") == "sub") & (F.col("a") < F.col("b")), "negative")
    )
    return problems.withColumn("reason", reason).where("reason IS NOT NULL")


def epoch(problems: DataFrame, seed: int, number: int, size: int) -> DataFrame:
    """Rows in an epoch's order with their batch; an incomplete last batch is left out.

    Batches come from ranks within 4096 hash buckets and the buckets' totals, so no task orders all rows."""
    from pyspark.sql import Window

    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit(number), "seq"))
    rows = problems.withColumn("order_key", key).withColumn("bucket", F.conv(F.substring("order_key", 1, 3), 16, 10).cast("int"))
    totals = rows.groupBy("bucket").agg(F.count("*").alias("n"))  # 4096 rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("bucket", before.alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("order_key", "seq")) - 1
    rows = rows.withColumn("rank", rank).join(F.broadcast(totals), "bucket").withColumn("place", F.col("before") + F.col("rank"))
    batch = F.floor(F.col("place") / size)
    return rows.withColumn("batch", batch).where((F.col("batch") + 1) * size <= F.col("total")).drop("order_key", "bucket", "rank", "before", "total")
