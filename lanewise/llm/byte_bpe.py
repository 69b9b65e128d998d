"""Byte-level BPE encoding and decoding.

Each piece that the pre-tokenizer's pattern cuts off is merged over a segment tree: leaf i
holds the rank of the pair that starts at byte i, an inner node the least of its two
children, with the leftmost position on ties.  The root names the next merge; a merge
writes three leaves (the merged pair's, its left neighbour's, the swallowed token's), each
in a logarithmic number of steps, so a piece of n bytes costs O(n log n) however long.

Null and empty texts have no ids and decode to the empty text; an empty table gives no rows.  Rows
are independent, so repeated rows and ties change nothing.  All columns but the text pass through;
the result's column replaces one of its name.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

CACHE_UNITS, CACHE_PIECES = 200_000, 700_000
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # where the live token that starts at i ends
    before = list(range(-1, n))  # start of the live token before the one at i
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            least = value if value < other else other
            if tree[k] == least:
                return
            tree[k] = value = least

    while tree[1] != NONE:
        i = tree[1] % size
        j = end[i]
        stop = end[j]
        end[i] = stop
        put(j, NONE)
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i : end[stop]])
            put(i, NONE if r is None else r * size + i)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:stop])
            put(h, NONE if r is None else r * size + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary. Units that recur are kept packed, as many as CACHE_UNITS and CACHE_PIECES."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        codec = self

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                if len(self) >= CACHE_UNITS:
                    self.clear()
                value = self[unit] = b"".join(map(codec.piece, codec.find(unit)))
                return value

        self.units = Units()

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = np.array(merge_piece(piece.encode(), self.ranks), dtype="<u4").tobytes()
            if len(piece) <= 64:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Where a text has no whitespace but single spaces and line feeds between words, a
        space with the word after it is cut alike in any surroundings, so such units are
        looked up whole; any other text is cut by the pattern as a whole."""
        if "\x00" not in text and " ".join(text.split()) == text.replace("\n", " "):
            if not text:
                return b""
            units = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
            return b"".join(map(self.units.__getitem__, units))
        return b"".join(map(self.piece, self.find(text)))

    def decode_packed(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def forget() -> None:
    """Drops the codecs that this process keeps."""
    codec.cache_clear()
    gc.collect()  # a codec and its units refer to each other


def _each(path: str, pattern: str, text: str, out: str, make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rest = batch.drop_columns([n for n in batch.schema.names if n in (text, out)])
            yield make(c, rest, batch.column(text))

    return run


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Replaces the column `text` by `out`, the ids packed as little-endian unsigned 32-bit integers."""

    def make(c: Codec, rest: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        return rest.append_column(out, pa.array([c.encode_packed(x or "") for x in texts.to_pylist()], pa.binary()))

    common.small_batches(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in (text, out)]
    return common.map_arrow(df, _each(path, pattern, text, out, make), T.StructType([*fields, T.StructField(out, T.BinaryType())]), forget)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rest = batch.drop_columns([n for n in batch.schema.names if n == out])
            yield rest.append_column(out, pa.array([c.decode_packed(x or b"") for x in batch.column(ids).to_pylist()], pa.binary()))

    fields = [f for f in df.schema.fields if f.name != out]
    return common.map_arrow(df, run, T.StructType([*fields, T.StructField(out, T.BinaryType())]), forget)


def encoded_documents(docs: DataFrame) -> DataFrame:
    """Documents with their ids and decoded text as digests; one row per document. Encoding, decoding and digests share a task's worker."""
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = c.encode_packed(text or "")
                rows.append((len(ids) // 4, sha(ids), sha(c.decode_packed(ids))))
            n, ids_sha, decoded_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    common.small_batches(docs.sparkSession)
    return common.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", forget)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(common.documents(spark, sf_dir))
