"""Token-id shards with a minimal perfect hash index.

A shard is one file, little-endian throughout:

    payload   the ids of its documents end to end, 2 bytes each if the vocabulary allows, else 4
    keys      int64 per document, in order        (0 for a null key)
    nulls     uint8 per document, 1 for a null key
    starts    uint64 per document, ids before it in this shard, and one more, the end
    seeds     int64 per bucket of the hash
    slots     uint32 document number per slot, then uint32 fingerprint per slot
    trailer   64 bytes: magic, version, id width, documents, ids, buckets

A key is a document's id with the count of equal ids before it, so repeated rows keep a
place each.  A lookup hashes the key to a bucket, the bucket's seed (or fixed slot) gives
the slot, the stored fingerprint rejects keys that are not there, and the slot names the
document: constant time.  The manifest, one line per shard, gives each shard's first key and
the ids before it; it has as many lines as there are shards.  `Shards` finds a key's shard by it.

Shards are cut by ranges of doc_id, nulls first, written under a name of the task attempt and
renamed at the end, so a task that runs twice leaves one file.  Null and empty texts hold the
end id alone; an empty table gives no shard.  Columns but the id and the text are not read.
"""

from __future__ import annotations

import bisect
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix_int

MAGIC, VERSION = b"LWTOKENS", 1
TRAILER = struct.Struct("<8sIIQQQ24x")
GOLD = 0x9E3779B97F4A7C15
CACHE_WORDS, BLOCK_BYTES = 1_200_000, 3 << 20
AHEAD_IDS = 1 << 20
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


# --- encoding ------------------------------------------------------------------------


def _whole(stem: str) -> bool:
    """Whether lower-casing and composing keep these letters letters."""
    return unicodedata.normalize("NFC", stem).lower().isalpha()


class WordEncoder:
    """Packed ids of texts, put together from the ids of their words.

    The tokenizer lower-cases, drops white space and lets no id span it, so a text's ids are
    its words' ids in order.  Texts are cut into words, and words into what ends with an ASCII
    letter or digit and the ASCII punctuation after it, which the tokenizer's own pattern parts
    there too; both by numpy over many texts at once.  Equal words of a block are found by hash and
    their bytes compared; if two that differ had one hash, the block's texts go to the tokenizer one
    by one.  New words go to the tokenizer, runs of letters many in a call, cut where word-end ids
    stand; ids are kept by word.  A text that may spell a special token goes to the tokenizer whole."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.end = self.pack([end_id])
        self.ends_word = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith("</w>")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.is_punctuation, self.is_alnum = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        self.is_punctuation[list(PUNCTUATION)] = True
        self.is_alnum[[i for i in range(128) if chr(i).isalnum()]] = True

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def alone(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def together(self, stems: list[bytes]) -> list[bytes]:
        """Ids of runs of letters."""
        ids = self.tokenizer.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids
        ids = np.array(ids, dtype=self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(stems) or len(ids) and ends[-1] != len(ids):
            return [self.alone(x.decode()) for x in stems]
        packed = ids.tobytes()
        at = [0, *(ends * self.width).tolist()]
        return [packed[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, words: list[bytes]) -> None:
        letters = [w.isalpha() or not w.isascii() and _whole(w.decode()) for w in words]
        runs = [w for w, ok in zip(words, letters, strict=True) if ok]
        for a in range(0, len(runs), 2_000):
            part = runs[a : a + 2_000]
            self.known.update(zip(part, self.together(part), strict=True))
        for w, ok in zip(words, letters, strict=True):
            if not ok:
                self.known[w] = self.alone(w.decode())

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where units begin and end, and how many each text has."""
        s, e, counts = common.word_spans(data, offsets)
        solid = np.where(self.is_punctuation[data], -1, np.arange(len(data)))
        t = np.maximum.accumulate(solid)[e - 1] + 1
        cut = (t > s) & (t < e) & self.is_alnum[data[np.maximum(t, 1) - 1]]
        each = 1 + cut
        second = np.cumsum(each)[cut] - 1
        begins, ends = np.repeat(s, each), np.repeat(e, each)
        begins[second] = t[cut]
        ends[second - 1] = t[cut]
        before = np.concatenate([[0], np.cumsum(each)])
        return begins, ends, np.diff(before[np.concatenate([[0], np.cumsum(counts)])])

    def _block(self, texts: list[bytes]) -> Iterator[bytes]:
        raw = b"".join(texts).lower()
        data = np.frombuffer(raw, dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        if not len(data):
            yield from (self.end for _ in texts)
            return
        begins, ends, counts = self._units(data, offsets)
        _, first, at = np.unique(common.span_hashes(data, begins, ends), return_index=True, return_inverse=True)
        if not common.same_spans(data, begins, ends, first[at]):
            yield from (self.alone(x.decode()) + self.end for x in texts)
            return
        words = [raw[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)]
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE_WORDS and known:
            known.clear()
            new = words
        self.learn(new)
        values = [known[w] for w in words]
        flat = np.frombuffer(b"".join(values), dtype=self.dtype)
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.width
        starts = np.cumsum(sizes) - sizes
        own = sizes[at]
        total = np.concatenate([[0], np.cumsum(own)])
        out = flat[np.repeat(starts[at] - total[:-1], own) + np.arange(total[-1])].tobytes()
        cuts = (total[np.concatenate([[0], np.cumsum(counts)])] * self.width).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield out[a:b] + self.end

    def documents(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of each text with the end id."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if any(x in text for x in self.special):
                yield from self._block(held)
                held, size = [], 0
                yield self.alone(text.decode()) + self.end
                continue
            held.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)


@cache
def encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


# --- minimal perfect hash ------------------------------------------------------------


def key_hash(key: int | None, nth: int) -> int:
    base = mix_int(nth * GOLD + 1)
    return mix_int((mix_int(key) if key is not None else 0x6E756C6C) ^ base)


def _slot(h: int, seed: int, n: int) -> int:
    return mix_int(h + seed * GOLD) % n


def build_index(hashes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds by bucket, document number and fingerprint by slot. Buckets are placed largest first; a bucket of one key takes a free slot, kept as -1 - slot."""
    n = len(hashes)
    buckets: list[list[int]] = [[] for _ in range(max(1, n // 4))]
    for i, h in enumerate(hashes):
        buckets[h % len(buckets)].append(i)
    seeds, slots = np.zeros(len(buckets), dtype="<i8"), np.zeros(n, dtype="<u4")
    taken, free = bytearray(n), 0
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        own = buckets[b]
        if not own:
            break
        if len(own) == 1:
            while taken[free]:
                free += 1
            places, seeds[b] = [free], -1 - free
        else:
            seed = 1
            while True:
                places = [_slot(hashes[i], seed, n) for i in own]
                if len(set(places)) == len(places) and not any(taken[p] for p in places):
                    break
                seed += 1
            seeds[b] = seed
        for i, p in zip(own, places, strict=True):
            taken[p], slots[p] = 1, i
    prints = np.array([hashes[i] >> 32 for i in slots.tolist()], dtype="<u4")
    return seeds, slots, prints


# --- files ---------------------------------------------------------------------------


def _trailer(width: int, n_docs: int, n_ids: int, buckets: int) -> bytes:
    return TRAILER.pack(MAGIC, VERSION, width, n_docs, n_ids, buckets)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Shard:
    """An open shard; `find` gives one document's ids by key."""

    def __init__(self, uri: str, ahead: int = 0):
        """ahead: for documents read in order, at least so many ids are fetched at once."""
        fs, path = _file_system(uri)
        self.file = fs.open_input_file(path)
        self.ahead, self.held_at, self.held = ahead, 0, b""
        size = self.file.size()
        magic, version, self.width, self.n, self.n_ids, buckets = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no shard of version {VERSION}")
        at = self.n_ids * self.width

        def array(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.file.read_at(n * np.dtype(dtype).itemsize, at), dtype=dtype)
            at += out.nbytes
            return out

        self.keys, self.nulls, self.starts = array("<i8", self.n), array("u1", self.n), array("<u8", self.n + 1)
        self.seeds, self.slots, self.prints = array("<i8", buckets), array("<u4", self.n), array("<u4", self.n)

    def number(self, key: int | None, nth: int = 0) -> int | None:
        """Which document has this key; the fingerprint turns other keys away, and the stored key settles it."""
        if not self.n:
            return None
        h = key_hash(key, nth)
        seed = int(self.seeds[h % len(self.seeds)])
        slot = -1 - seed if seed < 0 else _slot(h, seed, self.n)
        if int(self.prints[slot]) != h >> 32:
            return None
        i = int(self.slots[slot])
        return i if (None if self.nulls[i] else int(self.keys[i])) == key else None

    def ids(self, number: int) -> np.ndarray:
        a, b = int(self.starts[number]) * self.width, int(self.starts[number + 1]) * self.width
        if a < self.held_at or b > self.held_at + len(self.held):
            size = min(max(b - a, self.ahead * self.width), self.n_ids * self.width - a)
            self.held_at, self.held = a, self.file.read_at(size, a)
        return np.frombuffer(self.held, dtype=f"<u{self.width}", offset=a - self.held_at, count=(b - a) // self.width).astype("<u4")

    def find(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        number = self.number(key, nth)
        return None if number is None else self.ids(number)


def _nulls_first(key: int | None) -> tuple[bool, int]:
    return key is not None, key or 0


class Shards:
    """All shards of a folder: the manifest tells which one may hold a key, that one's index where. Opened shards stay open."""

    def __init__(self, folder: str):
        self.folder, self.lines, self.open = folder, read_manifest(folder), {}
        self.firsts = [_nulls_first(x["first_key"]) for x in self.lines]

    def find(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of the nth document of this key; None where there is none."""
        at = bisect.bisect_right(self.firsts, _nulls_first(key)) - 1
        if at < 0:
            return None
        name = self.lines[at]["name"]
        if name not in self.open:
            self.open[name] = Shard(f"{self.folder}/{name}")
        return self.open[name].find(key, nth)


def _occurrences(keys: list) -> list[int]:
    """How many equal keys stand before each; equal keys stand together."""
    out = []
    for i, k in enumerate(keys):
        out.append(out[-1] + 1 if i and k == keys[i - 1] else 0)
    return out


def write_shards(df: DataFrame, folder: str, path: str, end_id: int, shards: int | None = None) -> list[dict]:
    """Encodes df(doc_id, text) and writes its shards and manifest.json to folder. Returns the manifest's lines."""
    spark = df.sparkSession
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():05d}.tok"
        fs, base = _file_system(folder)
        part, keys, starts, out = f"{base}/.{name}.{task.taskAttemptId()}", [], [0], None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            if out is None and ids:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(part)
            for key, got in zip(ids, enc.documents(texts), strict=True):
                out.write(got)
                keys.append(key)
                starts.append(starts[-1] + len(got) // enc.width)
        if out is None:
            return
        seeds, slots, prints = build_index([key_hash(k, nth) for k, nth in zip(keys, _occurrences(keys), strict=True)])
        for array in (np.array([k or 0 for k in keys], dtype="<i8"), np.array([k is None for k in keys], dtype="u1"), np.array(starts, dtype="<u8"), seeds, slots, prints):
            out.write(array.tobytes())
        out.write(_trailer(enc.width, len(keys), starts[-1], len(seeds)))
        out.close()
        fs.move(part, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "name": [name], "first_key": pa.array([keys[0]], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([starts[-1]], pa.int64())})

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange(shards or common.n_buckets(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = common.map_arrow(rows, run, "shard int, name string, first_key long, n_docs long, n_ids long").collect()
    lines, before = [], 0
    for r in sorted(done, key=lambda r: r.shard):
        lines.append(r.asDict() | {"start": before})
        before += r.n_ids
    fs, base = _file_system(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write("".join(json.dumps(x) + "\n" for x in lines).encode())
    return lines


def read_manifest(folder: str) -> list[dict]:
    fs, base = _file_system(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, found by its key: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(f"{folder}/{name}", AHEAD_IDS)
                keys = [None if null else key for key, null in zip(shard.keys.tolist(), shard.nulls.tolist(), strict=True)]
                numbers = [shard.number(k, nth) for k, nth in zip(keys, _occurrences(keys), strict=True)]
                if None in numbers:
                    raise ValueError(f"{name}: its index misses a key")
                ids = map(shard.ids, numbers)
                crc, sizes = zip(*[(zlib.crc32(x.tobytes()), len(x)) for x in ids], strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "start": pa.array((before + shard.starts[numbers].astype("i8")).tolist(), pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    lines = [(x["name"], x["start"]) for x in read_manifest(folder)]
    shards = spark.createDataFrame(lines, "name string, start long")
    if lines:
        shards = shards.repartition(min(len(lines), 4 * common.n_buckets(spark)), "name")
    return common.map_arrow(shards, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def looked_up(keys: DataFrame, folder: str) -> DataFrame:
    """keys(doc_id) -> doc_id, ids of the first document of that id; null where there is none. Keys are dealt by range, so a task opens few shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for batch in batches:
            shards = shards or Shards(folder)
            found = [shards.find(k) for k in batch.column(0).to_pylist()]
            ids = pa.array([None if x is None else x.tolist() for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    common.small_batches(keys.sparkSession)
    rows = keys.select(F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    return common.map_arrow(rows, run, "doc_id long, ids array<long>")


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    folder = common.new_path(spark, "tokens")
    write_shards(common.documents(spark, sf_dir), folder, P.path("word_bpe_49k.json"), end_id=2)
    return read_shards(spark, folder)
