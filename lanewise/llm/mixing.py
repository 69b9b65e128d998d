"""Mixing sources to target weights by nested hash thresholds.

A document's size is its number of words.  Sources share the total of all sizes by weight;
a source's target stops at REPEATS times its own size, and what is over is shared again by
weight among the others until none is above: target = min(REPEATS * size, level * weight), the
level found from the sources in order of size over weight.

A source with target r times its size takes each document floor(r) times, and once more those
whose hash lies under the source's threshold.  The threshold comes from histograms: sizes are
summed by source and hash bucket, the bucket in which the budget runs out is cut into finer
buckets, and so on down; only that bucket's documents are summed again.  No documents are
sorted, thresholds nest (a larger budget takes what a smaller one does, and more), and the
choice depends on doc_id alone, so reruns agree.

Null texts and empty tables have size 0; a null source is a source of its own, after the
others; sources whose sizes are all 0 get target 0.  Rows that repeat a doc_id are taken or
left alike.  Only sums by source (and bucket) are shuffled, after partial sums, so a hot source
costs no more than another.  Windows over sources are in one task: their number is a plan's, not the
documents'.  Columns but doc_id, source and text are not read; `mixed` returns all of them as they
are, `with_copies` replaces those named source_size, target and copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

REPEATS = 3
LEVELS, BITS = 4, 10


def _size() -> F.Column:
    return F.expr(r"cast(size(array_remove(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), '')) as bigint)")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> source, source_size, target; one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # order by code point, which is the order of UTF-8 bytes; null last
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("weight", (((rank - 1) % 3) + 1).cast("double"))
    fill = Window.orderBy((F.col("source_size") * REPEATS / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    capped = F.sum(F.col("source_size") * REPEATS).over(fill.rowsBetween(Window.unboundedPreceding, -1))
    weight_left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    # the level if exactly the sources before this one are capped; the first that fits holds
    by = by.withColumn("level", (total - F.coalesce(capped, F.lit(0))) / weight_left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("source_size") * REPEATS, F.col("level"))
    by = by.withColumn("fit", fits)
    first = F.first("fit", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumn("level", first).select(
        "source", "source_size",
        F.least(F.col("source_size") * float(REPEATS), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"),
    )


def _key(level: int) -> F.Column:
    """The hash's leading bits down to a level."""
    return F.shiftrightunsigned(F.col("hash"), 64 - BITS * (level + 1))


def mix_plan(sizes: DataFrame) -> DataFrame:
    """sizes(doc_id, source, size) -> a row for each source: source_size, target, whole copies, and the hash key below which there is one more."""
    with common.scratch(sizes.sparkSession):
        return common.staged(_mix_plan(sizes), "mix-plan", keep=True)


def _mix_plan(sizes: DataFrame) -> DataFrame:
    plan = targets(sizes).withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("ratio")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = plan.withColumn("below", F.lit(0.0)).withColumn("prefix", F.lit(0).cast("long"))
    docs = sizes.withColumn("hash", F.xxhash64("doc_id"))
    for level in range(LEVELS):
        # documents in the bucket where each source's budget runs out, cut finer
        in_bucket = docs if level == 0 else docs.join(plan.select(F.col("source").alias("__s"), F.col("prefix").alias("__p")), F.col("source").eqNullSafe(F.col("__s")) & (_key(level - 1) == F.col("__p")), "left_semi")
        sums = in_bucket.groupBy("source", _key(level).alias("key")).agg(F.sum("size").alias("n"))
        up_to = F.sum("n").over(Window.partitionBy("source").orderBy("key"))
        sums = sums.withColumn("end", up_to).withColumnRenamed("source", "__s")
        at = plan.join(sums, F.col("source").eqNullSafe(F.col("__s")), "left")
        over = F.col("below") + F.col("end") > F.col("budget")
        at = at.groupBy("source", "source_size", "target", "ratio", "whole", "budget", "below").agg(
            F.min(F.when(over, F.col("key"))).alias("prefix"),
            F.max(F.when(~over, F.col("end"))).alias("added"),
            F.min(F.when(over, F.col("end"))).alias("next"),
        )
        plan = at.withColumn("below", F.col("below") + F.coalesce("added", F.lit(0)))
        plan = common.staged(plan, "mix-level")
    # the last bucket, usually one document, is taken if that comes nearer to the budget
    last = F.when((F.col("next").isNotNull()) & (F.col("next") - F.coalesce("added", F.lit(0)) < 2 * (F.col("budget") - F.col("below"))), 1).otherwise(0)
    return plan.select("source", "source_size", "target", F.col("whole").cast("long").alias("whole"), (F.col("prefix") + last).alias("limit"), "budget")


def _planned(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs(doc_id, source, ..) with __mix: source_size, target and copies, how often the mix takes each."""
    plan = plan.select(F.struct(*plan.columns).alias("__plan"))
    rows = docs.join(plan, docs["source"].eqNullSafe(F.col("__plan.source")), "left")
    under = F.shiftrightunsigned(F.xxhash64(docs["doc_id"]), 64 - BITS * LEVELS) < F.col("__plan.limit")
    extra = F.when(F.col("__plan.budget") > 0, F.coalesce(under.cast("long"), F.lit(1))).otherwise(0)
    copies = F.least(F.lit(REPEATS).cast("long"), F.col("__plan.whole") + extra)
    return rows.withColumn("__mix", F.struct(F.col("__plan.source_size").alias("source_size"), F.col("__plan.target").alias("target"), copies.alias("copies"))).drop("__plan")


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs(doc_id, source, ..) with source_size, target and copies; all other columns stay."""
    added = ("source_size", "target", "copies")
    return _planned(docs, plan).withColumns({c: F.col(f"__mix.{c}") for c in added}).drop("__mix")


def sizes_of(docs: DataFrame) -> DataFrame:
    return common.staged(docs.select("doc_id", "source", _size().alias("size")), "sizes")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in their own columns."""
    with common.scratch(docs.sparkSession):
        plan = mix_plan(sizes_of(docs))
    rows = _planned(docs, plan)
    return rows.withColumn("__row", F.explode(F.expr("if(__mix.copies > 0, sequence(1L, __mix.copies), cast(array() as array<bigint>))"))).select(*[docs[c] for c in docs.columns])


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_of(common.documents(spark, sf_dir))
    return with_copies(sizes, mix_plan(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
