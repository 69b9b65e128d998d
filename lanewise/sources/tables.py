"""Readers and writers: problems as JSON lines, metrics, weights and Parquet tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBLEM = "seq bigint, op string, a decimal(38,0), b decimal(38,0), ans decimal(38,0), prompt string, completion string, roles array<string>, cell string, tmpl int"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that the session names, or in a folder of this process where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or 'file://' + _own_folder()).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lanewise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_problems(problems: DataFrame, path: str) -> None:
    problems.write.mode("overwrite").json(path)


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with exactly the problem's fields, blank lines left out; a line that lacks one or has another raises."""
    names = {f.split()[0] for f in PROBLEM.split(", ")}
    lines = spark.read.text(path).where("trim(value) <> ''")
    keys = F.json_object_keys("value")
    odd = keys.isNull() | (F.size(F.array_except(keys, F.array(*map(F.lit, sorted(names))))) > 0) | ~F.array_contains(keys, "op") | ~F.array_contains(keys, "prompt")
    row = F.from_json("value", PROBLEM, {"mode": "FAILFAST"})
    return lines.select(F.when(odd, F.raise_error(F.concat(F.lit("not a problem: "), F.col("value")))).otherwise(row).alias("row")).select("row.*")


def read_if_there(spark: SparkSession, path: str) -> DataFrame:
    """read_problems(), or no rows if the path isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return read_problems(spark, path)
    return spark.createDataFrame([], PROBLEM)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_weights(spark: SparkSession, layers: dict[str, list[list[float]]], path: str) -> None:
    """A row for each layer and unit."""
    rows = [(layer, i, [float(x) for x in w]) for layer, own in layers.items() for i, w in enumerate(own)]
    spark.createDataFrame(rows, "layer string, unit int, weights array<double>").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, list[list[float]]]:
    out: dict[str, list[list[float]]] = {}
    for r in spark.read.parquet(path).orderBy("layer", "unit").collect():
        out.setdefault(r.layer, []).append(list(r.weights))
    return out


def formatted(report: DataFrame, rates: list[str]) -> DataFrame:
    """The report with rates as text of four decimals, for a console."""
    return report.select(*[F.format_string("%.4f", c).alias(c) if c in rates else c for c in report.columns])
