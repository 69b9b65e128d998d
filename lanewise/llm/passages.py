"""Passages of LENGTH words or more that occur more than once, by sparse suffix arrays.

A suffix is retained where its first PREFIX words have the least hash of some run of STARTS
neighbouring starts (a minimiser).  The choice depends on content alone, so each occurrence
of a passage of PREFIX + STARTS - 1 = LENGTH words retains a suffix at the same place in it.

1. Retained suffixes are ordered by their first PREFIX words; those that equal a neighbour
   match, all others are done with.
2. Each match is extended: of the LENGTH-word windows that reach left and right over it, as
   many as its place as minimiser covers, those are kept that occur elsewhere too.
3. A document's kept windows are joined to its longest spans.

Every window has a minimiser, so no repeat of LENGTH words is missed, and a span holds nothing
but such repeats.  The first occurrence by (doc_id, position) is the one to stay; words of a
span of which an earlier occurrence exists are `later`.  Words are `[^\\x20\\x09-\\x0D]+`, compared
as they are, by 64-bit hashes.

Hashes are posted by chunks of documents to buckets, each distinct one once with its first
place in the chunk, and answered in the order of the post; so a passage in a third of all
documents is one entry for each chunk, and no task holds all places of it.

Null and empty texts and texts of fewer than LENGTH words have no spans.  Rows of one doc_id
and text are copies; as they are the same place, what is first in one is first in all.  Rows of
one doc_id with different texts take part each for itself, but `without_repeats` cuts the spans
of both from both.  A null doc_id counts as the largest.  Other columns pass through
`without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PREFIX, STARTS = 26, 25
LENGTH = PREFIX + STARTS - 1
CHUNK_PLACES = 1_000_000
NULL_ID = (1 << 63) - 1


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def _document(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's word hashes: the prefixes' hashes, the least of each window, and whether a suffix is retained."""
    prefix = common.shingle_hashes(words, PREFIX)
    least = _slide(prefix, STARTS, np.minimum)
    padded = np.zeros(len(least) + 2 * (STARTS - 1), dtype=prefix.dtype)
    padded[STARTS - 1 : STARTS - 1 + len(least)] = least
    return prefix, least, _slide(padded, STARTS, np.maximum) == prefix


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of each text that can hold a passage."""
    row = 0
    for _, data, offsets in common.text_blocks(list(range(batch.num_rows)), batch.column("text")):
        words, counts = common.word_hashes(data, offsets, fold=False)
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in np.flatnonzero(counts >= LENGTH).tolist():
            yield row + i, words[at[i] : at[i + 1]]
        row += len(counts)


CHUNK = "chunk long, bucket int, ids binary, counts binary, at binary, hashes binary, answer binary"
POST = "bucket int, chunk long, hashes binary, places binary, first_ids binary, first_at binary"


class _Chunks:
    """Gathers places of documents and their hashes into rows of about CHUNK_PLACES, bucket -1."""

    def __init__(self):
        self.base, self.made, self.held, self.size = TaskContext.get().partitionId() << 32, 0, [], 0

    def add(self, doc: int, at: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((doc, at, hashes))
        self.size += len(at) + 1
        if self.size >= CHUNK_PLACES:
            yield self.row()

    def row(self) -> pa.RecordBatch:
        ids, at, hashes = zip(*self.held, strict=True)
        row = (self.base + self.made, -1, np.array(ids, dtype=np.int64).tobytes(), common.packed(np.array([len(x) for x in at])), common.packed(np.concatenate(at)), np.concatenate(hashes).tobytes(), None)
        self.held, self.size, self.made = [], 0, self.made + 1
        return _chunk_row(row)


def _chunk_row(row: tuple) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "bucket", "ids", "counts", "at", "hashes", "answer"])


class _Places:
    """A chunk read back: each place's document, position and number of its hash among the chunk's distinct ones."""

    def __init__(self, row: dict):
        self.chunk = row["chunk"]
        self.ids, counts, self.at = np.frombuffer(row["ids"], dtype=np.int64), common.unpacked(row["counts"]), common.unpacked(row["at"])
        self.doc = np.repeat(np.arange(len(self.ids)), counts)
        self.ends = np.cumsum(counts)
        self.hashes, self.number, self.times = np.unique(np.frombuffer(row["hashes"], dtype=common.U64), return_inverse=True, return_counts=True)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """The first place, by id and position, of each hash."""
        order = np.lexsort((self.at, self.ids[self.doc]))
        first = np.empty(len(self.hashes), dtype=np.int64)
        first[self.number[order[::-1]]] = order[::-1]
        return self.ids[self.doc[first]], self.at[first]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks = _Chunks()
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for row, words in _documents(batch):
            prefix, _, kept = _document(words)
            at = np.flatnonzero(kept)
            yield from chunks.add(int(ids[row]), at, prefix[at])
    if chunks.held:
        yield chunks.row()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows over matched suffixes, each with its hash."""
    chunks = _Chunks()
    for batch in batches:
        ids, matched = batch.column("id").to_numpy(), batch.column("matched")
        for row, words in _documents(batch):
            prefix, least, _ = _document(words)
            at = np.unique(np.concatenate([common.unpacked(x) for x in matched[row].as_py()]))
            at = at[at < len(prefix)]
            starts = (at[:, None] - np.arange(STARTS)[None, :]).ravel()
            owner = np.repeat(at, STARTS)
            fits = (starts >= 0) & (starts < len(least))
            starts, owner = starts[fits], owner[fits]
            starts = np.unique(starts[least[starts] == prefix[owner]])
            if len(starts):
                yield from chunks.add(int(ids[row]), starts, common.shingle_hashes(words, LENGTH)[starts])
    if chunks.held:
        yield chunks.row()


def _posts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct hashes by bucket, whether it has each more than once, and each one's first place in it."""
    for row in common.rows(batches):
        chunk = _Places(row)
        ids, at = chunk.firsts()
        docs = np.searchsorted(np.sort(chunk.ids), ids)
        known = np.sort(chunk.ids)
        for b, own in enumerate(common.by_bucket(chunk.hashes, buckets)):
            if len(own):
                # the first document is sent as its number among those that this row names
                named, number = np.unique(docs[own], return_inverse=True)
                places = (chunk.times[own] > 1).astype(np.uint8)
                out = (b, chunk.chunk, chunk.hashes[own].tobytes(), places.tobytes(), known[named].tobytes(), common.packed(number) + b"|" + common.packed(at[own]))
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=["bucket", "chunk", "hashes", "places", "first_ids", "first_at"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered by hash, equal neighbours match. For each hash of a post: 0 it stands alone, 1 its first place of all is the post's, 2 it is elsewhere."""
    for bucket, rows in common.grouped(batches, "bucket"):
        hashes = [np.frombuffer(r["hashes"], dtype=common.U64) for r in rows]
        sizes = np.array([len(x) for x in hashes])
        ids, at = [], []
        for r, n in zip(rows, sizes.tolist(), strict=True):
            width = r["first_at"][0]
            ids.append(np.frombuffer(r["first_ids"], dtype=np.int64)[common.unpacked(r["first_at"][: 1 + width * n])])
            at.append(common.unpacked(r["first_at"][2 + width * n :]))
        ids, at, hashes = np.concatenate(ids), np.concatenate(at), np.concatenate(hashes)
        several = np.concatenate([np.frombuffer(r["places"], dtype=np.uint8) for r in rows]).astype(bool)
        order = np.lexsort((at, ids, hashes))
        ranked = hashes[order]
        begins = np.ones(len(ranked), dtype=bool)
        begins[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(begins) - 1
        twice = np.bincount(group, weights=1 + several[order]) > 1
        head = order[begins][group]
        first = (ids[order] == ids[head]) & (at[order] == at[head])
        answer = np.empty(len(ranked), dtype=np.uint8)
        answer[order] = np.where(twice[group], np.where(first, 1, 2), 0)
        ends = np.cumsum(sizes)
        for r, a, b in zip(rows, (ends - sizes).tolist(), ends.tolist(), strict=True):
            yield _chunk_row((r["chunk"], bucket, None, None, None, None, answer[a:b].tobytes()))


def _answered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[_Places, np.ndarray]]:
    """Rows stand by chunk, its own first: each chunk with the answer for each of its places."""
    for _, rows in common.grouped(batches, "chunk"):
        chunk = _Places(rows[0])
        answer = np.zeros(len(chunk.hashes), dtype=np.uint8)
        parts = common.by_bucket(chunk.hashes, buckets)
        for r in rows[1:]:
            answer[parts[r["bucket"]]] = np.frombuffer(r["answer"], dtype=np.uint8)
        yield chunk, answer


def _matched(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for chunk, answer in _answered(batches, buckets):
        hit = np.flatnonzero(answer[chunk.number] > 0)
        docs, begins = np.unique(chunk.doc[hit], return_index=True)
        ends = np.append(begins[1:], len(hit))
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[docs], pa.int64()), pa.array([common.packed(chunk.at[hit[a:b]]) for a, b in zip(begins, ends, strict=True)], pa.binary())], names=["id", "places"])


def _spans(starts: np.ndarray) -> list[dict]:
    """Ordered starts of windows -> their unions."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return [{"start": a, "end": b + LENGTH} for a, b in zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True)]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("spans", _SPAN), T.StructField("later", _SPAN)])


def _found(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for chunk, answer in _answered(batches, buckets):
        ids, at = chunk.firsts()
        own = answer[chunk.number]
        first = (own == 1) & (chunk.ids[chunk.doc] == ids[chunk.number]) & (chunk.at == at[chunk.number])
        rows: list[tuple] = []
        for i, (a, b) in enumerate(zip(np.append(0, chunk.ends[:-1]).tolist(), chunk.ends.tolist(), strict=True)):
            hit = own[a:b] > 0
            if hit.any():
                rows.append((int(chunk.ids[i]), _spans(chunk.at[a:b][hit]), _spans(chunk.at[a:b][hit & ~first[a:b]])))
        if rows:
            ids, spans, later = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind), pa.array(later, kind)], names=["id", "spans", "later"])


def _with_answers(chunks: DataFrame, buckets: int) -> DataFrame:
    """The chunks and what all others together say of their hashes, by chunk."""
    posts = common.map_arrow(chunks, lambda b: _posts(b, buckets), POST).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    both = chunks.unionByName(common.map_arrow(posts, _answers, CHUNK))
    return both.repartition(common.n_tasks(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "bucket")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").cast("binary").alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> id, spans, later: in words, half open; a row for each document with a repeated passage."""
    common.small_batches(docs.sparkSession)
    buckets = common.n_buckets(docs.sparkSession)
    rows = _keyed(docs)
    with common.scratch(docs.sparkSession):
        suffixes = common.staged(common.map_arrow(rows, _suffixes, CHUNK), "suffixes")
        matched = common.map_arrow(_with_answers(suffixes, buckets), lambda b: _matched(b, buckets), "id long, places binary").groupBy("id").agg(F.collect_list("places").alias("matched"))
        windows = common.staged(common.map_arrow(rows.join(matched, "id"), _windows, CHUNK), "windows")
        return common.staged(common.map_arrow(_with_answers(windows, buckets), lambda b: _found(b, buckets), FOUND), "spans", keep=True)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after them."""
    data = np.frombuffer(text, dtype=np.uint8)
    begins, _, _ = common.word_spans(data, np.array([0, len(data)]))
    begins = np.append(begins, len(data))
    out, at = [], 0
    for a, b in spans:
        if a >= len(begins) - 1:
            break
        out.append(text[at : begins[a]])
        at = int(begins[min(b, len(begins) - 1)])
    out.append(text[at:])
    return b"".join(out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with passages cut of which an earlier occurrence exists; all columns and rows stay, n_chars follows the text."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("__later").to_pylist()):
                if spans and texts[i] is not None:
                    texts[i] = cut_words(texts[i].encode(), _united([(s["start"], s["end"]) for s in spans])).decode()
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    later = repeats(docs.select("doc_id", "text")).where(F.size("later") > 0).groupBy(F.col("id").alias("__id")).agg(F.flatten(F.collect_list("later")).alias("__later"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return common.map_arrow(docs.withColumn("__id", key).join(later, "__id", "left").drop("__id"), run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated passages: how many, how many words, and how many of those a first occurrence elsewhere makes superfluous."""
    found = repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.size("spans").cast("long").alias("n_spans"), words("spans").alias("repeated_words"), words("later").alias("later_words"), F.transform("spans", lambda s: s["start"]).alias("starts"), F.transform("spans", lambda s: s["end"]).alias("ends"))
