"""Document fingerprints from spot signatures, in SQL expressions alone.

A signature is an anchor, one of the commonest words of some languages, with up to CHAIN content
words after it, as far as the next anchor; case and kinds of white space don't count.  A text
without any has its words for signatures.  A document's fingerprint is its set of signatures: how
many there are, by which sets are partitioned, then their 64-bit hashes in order.  Likeness, the
Jaccard coefficient of two sets, is read from two fingerprints alone; equal fingerprints have equal
sets.  It is at most the ratio of the lengths, so where a bound is asked for (`near_pairs`), sets
whose lengths differ by more are not intersected.

Null and empty texts have the empty set; two empty sets are alike (1), an empty and another not
(0).  Rows are in the order of doc_id, falling, a null last, equal ids by text; the next document
is the next row, after the last the first; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CHAIN = 3
ROWS = 1_000

# Common words of English, French, Spanish and German.
ANCHORS = "a an and are as at be by de del der des die das el en es et for from ist il in is it la las le les los of on or que se sur that the this to un una une und von was with y zu".split()


def signatures(text: str) -> tuple[str, str]:
    """SQL for the distinct signature hashes of a text column that is not null, and for those of its words."""
    words = "|".join(ANCHORS)
    plain = f"lower(translate({text}, '\\u0009\\u000A\\u000B\\u000C\\u000D', '     '))"
    chain = f"(?<![^ ])(?:{words})(?: +(?!(?:{words})(?: |$))[^ ]+)" + "{1," + str(CHAIN) + "}"
    spots = f"transform(regexp_extract_all({plain}, '{chain}', 0), x -> xxhash64(x))"
    return f"array_distinct({spots})", f"array_distinct(transform(array_remove(split({plain}, ' +'), ''), x -> xxhash64(x)))"


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the signature set of a text column in `out`."""
    spots, words = signatures(text)
    df = df.withColumn(out, F.expr(spots))
    return df.withColumn(out, F.expr(f"if(size({out}) > 0, {out}, {words})"))


def fingerprint(sigs: str) -> F.Column:
    """The set's length in decimal, a hyphen, and 16 hex digits for each hash, rising."""
    return F.expr(f"concat(size({sigs}), '-', lower(array_join(transform(sort_array({sigs}), x -> lpad(hex(x), 16, '0')), '')))")


def signatures_of(fingerprint: str) -> F.Column:
    """The hashes in a fingerprint."""
    return F.expr(f"regexp_extract_all(substring_index({fingerprint}, '-', -1), '.{{16}}', 0)")


def likeness(a: str, b: str, floor: float = 0.0) -> F.Column:
    """Jaccard coefficient of two sets; with a floor, 0 where their lengths alone bound it below that."""
    bound = f"WHEN least(size({a}), size({b})) < {floor}D * greatest(size({a}), size({b})) THEN 0D" if floor else ""
    return F.expr(f"""CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D {bound}
        ELSE cast(size(array_intersect({a}, {b})) AS double) / size(array_union({a}, {b})) END""")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, next_text, sigs, next_sigs.

    Rows are dealt by ranges of doc_id between quantiles, as many as rows ask for but no more than four for each
    shuffle partition, so that most neighbours meet in one window; the last of a range gets the first of the next range
    that has rows, a row a range.  The bounds are all that the driver gets.  Rows of one id are in one range."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = max(1, min(-(-n // rows), 4 * common.n_buckets(spark)))
    cuts = [i / ranges for i in range(1, ranges)]
    # bounds of equal numbers of rows, null where there are no ids
    bounds = docs.agg(F.percentile_approx("doc_id", cuts, 20 * ranges)).first()[0] if cuts else None
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(bounds or []))]).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))))
    dealt = docs.withColumn("range", place.cast("int")).repartition(common.n_buckets(spark), "range")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    own = with_signatures(dealt, "text", "sigs").withColumn("rank", F.row_number().over(order))
    own = own.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    first = dealt.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    first = with_signatures(first.select("range", "text"), "text", "sigs")
    # ranges with rows (a bounded number), each with the one before it in rising order; the first with the last
    ranges = docs.select(place.cast("int").alias("range")).distinct()
    whole = Window.orderBy("range")
    last = F.max("range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = ranges.select(F.col("range").alias("__of"), F.coalesce(F.lag("range").over(whole), last).alias("range"))
    first = first.join(ranges, "range").select("__of", F.col("text").alias("__text"), F.col("sigs").alias("__sigs"))
    out = own.join(first, (F.col("range") == F.col("__of")) & F.col("next_text").isNull(), "left")
    return out.select("doc_id", "text", "sigs", F.coalesce("next_text", "__text").alias("next_text"), F.coalesce("next_sigs", "__sigs").alias("next_sigs"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of fingerprints whose sets' likeness reaches the threshold, a < b.

    Documents of one fingerprint are one member.  Sets are partitioned by length, so that only a
    partition and the next can hold a pair; within them a pair must share one of the rarest
    signatures of both, as many as a set may lack and one more, and is then compared."""
    sets = with_signatures(docs.select(F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    sets = sets.where(F.size("sigs") > 0).select(fingerprint("sigs").alias("print")).distinct()
    sets = sets.withColumns({"fp": F.monotonically_increasing_id(), "sigs": signatures_of("print")})
    sets = common.staged(sets.withColumn("n", F.size("sigs")).withColumn("part", F.floor(F.log("n") / -F.log(F.lit(threshold)))), "spots", keep=True)
    each = sets.select("fp", "n", "part", F.explode("sigs").alias("sig"))
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("df", "sig"))
    # a signature of no other set can't be shared, but counts among those that a set may lack
    prefix = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    left = prefix.select("sig", "part", F.col("fp").alias("a"), F.col("n").alias("an"))
    right = prefix.select("sig", F.explode(F.array("part", F.col("part") - 1, F.col("part") + 1)).alias("part"), F.col("fp").alias("b"), F.col("n").alias("bn"))
    fits = (F.col("a") < F.col("b")) & (F.least("an", "bn") >= threshold * F.greatest("an", "bn"))
    pairs = left.join(right, ["sig", "part"]).where(fits).select("a", "b").distinct()
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("sigs").alias(f"{x}_sigs"), F.col("print").alias(f"{x}_print"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("likeness", likeness("a_sigs", "b_sigs", threshold)).where(F.col("likeness") >= threshold)
    return pairs.select(F.least("a_print", "b_print").alias("a"), F.greatest("a_print", "b_print").alias("b"), "likeness")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, and their likeness to those and to the next document's.

    An edited text has the start of the next document's in place of its last third."""
    rows = with_next(docs.select("doc_id", "text"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - cut), left(next_text, cut))"))
    rows = with_signatures(rows.select("doc_id", "n_chars", "sigs", "next_sigs", "edited"), "edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"),
    )


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(common.documents(spark, sf_dir))
