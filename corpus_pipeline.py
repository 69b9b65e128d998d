"""From raw documents to token ids: quality rules, near duplicates, repeated passages, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read back as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import byte_bpe, common, mixing, passages, quality, shingle_join


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts have too few words and go; of repeated rows all stay or all go."""
    return quality.accepted(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once.

    Empty texts are in no group and stay; of rows of one doc_id and text one stays.  Rows of one doc_id with
    different texts all stay where one of them stands for its group.  A null doc_id stands for its group only
    where all of the group's are null."""
    groups = shingle_join.joined(docs.select("doc_id", "text"))
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    # copies among them by 128 bits of hash
    key = {"__text": F.xxhash64(F.lit(1), docs["text"], docs["text"].isNull()), "__more": F.xxhash64(F.lit(2), docs["text"], docs["text"].isNull())}
    return kept.withColumns(key).dropDuplicates(["doc_id", *key]).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay where they first occur and are cut elsewhere. Null and empty texts and all rows stay; n_chars follows the text, other columns stay as they are."""
    return passages.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in their own columns. Null and empty texts have size 0; of repeated rows all are taken alike."""
    return mixing.mixed(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's ids, and the digest of what they decode to. Null is the empty text; every row gets a row; other columns go."""
    return byte_bpe.encoded_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_level_bpe),
]

#: Components, minimisers and merges have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table gives no rows. All tables but the result's are dropped."""
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        with common.results_dropped(spark):
            made = stage(spark, docs, sf_dir)
            kept = common.staged(made, name.replace(" ", "-"))
            common.keep(kept)
        if i:
            common.unstage(docs)
        docs = kept
    return docs
