"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Words `[^\\x20\\x09-\\x0D]+`, A-Z folded, and an end after each text, are the tokens.  The word
before has a restaurant of its own, however rare it is; all of them share one parent, the
restaurant of single words; its parent is the uniform distribution over the V known words and
one unknown.

    P(w | u) = (c_uw - d t_uw + (strength + d t_u) P(w)) / (strength + c_u),   P(w) alike from P0 = 1 / (V + 1)

Each table of a restaurant is a customer of the parent.  Seatings are sampled by Gibbs sweeps
(`seating.py`): customers leave their tables and are seated again given those who stay.  A pass
has SWEEPS of them; then restaurants and parent tell each other their new sums, so within a pass
a dish sees its own moves at once and those of others as they were when it began.  The first pass
starts from customers seated one after the other; after BURN_IN passes the predictive
probabilities of SAMPLES passes are averaged.  Discounts are n1 / (n1 + 2 n2) of the counts, the
strength is STRENGTH.  Random numbers are drawn by cell and pass, whose contents depend on the
data alone, so scores depend neither on partitions of the input nor on reruns.

How it is laid out: texts are cut into chunks of some megabytes, written once as numbers of a
chunk's own dictionary.  Pairs are dealt to a grid of cells, rows by word before, columns by word,
so that a frequent word is spread over a row and a column.  A chunk posts its distinct pairs to the
cells; a cell sums them, keeps their tables, and answers each post with probabilities in its order.
The sums of a word, as context or as dish, are kept by its home: cells post theirs and are told the
totals.  What moves grows with the distinct words and pairs of chunks and cells; the driver has
totals over all restaurants only.

Null and empty texts have the end alone; an empty table gives no rows.  Repeated rows are texts
of their own.  A null doc_id counts as the empty string for the held-out rule.  Other columns
are not read.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix, packed, unpacked
from .seating import Seating

BURN_IN, SAMPLES, SWEEPS = 1, 2, 1
STRENGTH = 1.0
CHUNK_BYTES = 8 << 20
FOLDS, HELD_OUT = 7, 2
END = 0x454E44


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _table(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; columns as in a schema of Spark."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in columns.split(", ")]
    values = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(v), kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _rising(x: np.ndarray) -> bytes:
    """Ordered numbers as packed differences."""
    return packed(np.diff(x, prepend=0))


def _risen(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x))


# --- chunks --------------------------------------------------------------------------

CHUNKS = "chunk long, ids binary, nulls binary, held binary, counts binary, tokens binary, words binary, seen binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes, all lowest bytes first, which compresses better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each CHUNK_BYTES of texts: documents, tokens by number, the words' hashes (ordered) and how often each is in training texts."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal made
        ids = [x for part in held for x in part[0]]
        counts = np.concatenate([part[2] for part in held])
        # an end after each text
        hashes = np.insert(np.concatenate([part[1] for part in held]), np.cumsum(counts), U64(END))
        counts = counts + 1
        out = np.array([is_held_out(x) for x in ids], dtype=bool)
        words, tokens = common.numbered(hashes)
        seen = np.bincount(tokens[np.repeat(~out, counts)], minlength=len(words))
        made += 1
        return _table(CHUNKS, [(base + made - 1, np.array([x or 0 for x in ids], dtype=np.int64).tobytes(), np.array([x is None for x in ids]).tobytes(), out.tobytes(), packed(counts), _planes(tokens), words.tobytes(), packed(seen))])

    for batch in batches:
        for ids, data, offsets in common.text_blocks(batch.column(0).to_pylist(), batch.column(1)):
            hashes, counts = common.word_hashes(data, offsets)
            held.append((ids, hashes, counts))
            size += len(data) + len(ids)
            if size >= CHUNK_BYTES:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Chunk:
    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.ids, self.nulls, self.held = read("ids", np.int64), read("nulls", bool), read("held", bool)
        self.counts, self.words = unpacked(row["counts"]), read("words", U64)
        self.tokens = np.ascontiguousarray(read("tokens", np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and words before of distinct pairs, in this order, and the number that each token's pair has."""
        before = np.empty(len(self.tokens), dtype=np.int64)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.counts) - self.counts] = np.searchsorted(self.words, U64(END))
        keys, which = common.numbered_keys(self.tokens * len(self.words) + before)
        return *np.divmod(keys, len(self.words)), which


class Plan:
    """Where words and pairs belong: `homes` of words, a grid of `cells` for pairs. Homes are ranges of hashes."""

    def __init__(self, parts: int):
        self.homes, self.rows = -(-parts // 4), max(1, math.isqrt(2 * parts))
        self.columns = max(1, 2 * parts // self.rows)
        self.cells = self.rows * self.columns

    def cuts(self, words: np.ndarray) -> np.ndarray:
        """Where each home's words begin among ordered ones."""
        return np.searchsorted(words, np.array([-(-(h << 64) // self.homes) for h in range(self.homes)], dtype=U64)).tolist() + [len(words)]

    def cell(self, words: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        row, column = ((mix(words + U64(salt)) % U64(n)).astype(np.uint16 if self.cells < 1 << 16 else np.int32) for salt, n in ((0x43, self.rows), (0x42, self.columns)))
        return row[context] * self.columns + column[word]


# --- counts of words -----------------------------------------------------------------

WORD_POSTS, WORD_COUNTS = "home int, chunk long, words binary, seen binary", "chunk long, home int, seen binary, v long, n long"


def _word_posts(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for row in common.rows(batches):
        words, seen = np.frombuffer(row["words"], dtype=U64), unpacked(row["seen"])
        cuts = plan.cuts(words)
        yield _table(WORD_POSTS, [(h, row["chunk"], words[a:b].tobytes(), packed(seen[a:b])) for h, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each post the training counts of its words over all chunks; with one of them, how many words are known and their sum."""
    for home, rows in common.grouped(batches, "home"):
        words = [np.frombuffer(r["words"], dtype=U64) for r in rows]
        _, at = common.numbered(np.concatenate(words))
        counts = np.bincount(at, weights=np.concatenate([unpacked(r["seen"]) for r in rows])).astype(np.int64)
        v, n = int((counts > 0).sum()), int(counts.sum())
        ends = np.cumsum([len(x) for x in words])
        yield _table(WORD_COUNTS, [(r["chunk"], home, packed(counts[at[e - len(x) : e]]), v * (i == 0), n * (i == 0)) for i, (r, x, e) in enumerate(zip(rows, words, ends.tolist(), strict=True))])


# --- cells ---------------------------------------------------------------------------

PAIR_POSTS = "cell int, chunk long, words binary, contexts binary, pair_word binary, pair_context binary, pair_count binary"
#: kind 0: a cell's pairs and counts, and (chunk) how many words stand before one; 1: those of them that occur more than once;
#: 2: sums for the homes of its words; 3: where the pairs of a chunk's post are among the cell's
CELLS = "kind int, cell int, home int, chunk long, first binary, second binary, names binary, n1 long, n2 long"
PAIRS, MANY, ASKS, PLACES = 0, 1, 2, 3


def _pair_posts(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """What a chunk posts to a cell: the words and the words before of its pairs, pairs as numbers in those lists, training counts."""

    def numbered(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flag[own] = True
        names = np.flatnonzero(flag)
        flag[names] = False
        number[names] = np.arange(len(names))
        return names, number[own]

    for row in common.rows(batches):
        chunk = Chunk(row)
        words, (word, context, which) = chunk.words, chunk.pairs()
        counts = np.bincount(which[np.repeat(~chunk.held, chunk.counts)], minlength=len(word))
        flag, number = np.zeros(len(words), dtype=bool), np.empty(len(words), dtype=np.int64)
        cell = plan.cell(words, word, context)
        order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[order], np.arange(plan.cells + 1))
        out = []
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[c] : cuts[c + 1]]
            names, w = numbered(word[own])
            contexts, u = numbered(context[own])
            out.append((c, row["chunk"], words[names].tobytes(), words[contexts].tobytes(), _rising(w), packed(u), packed(counts[own])))
        yield _table(PAIR_POSTS, out)


def _summed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """A cell's pairs, and its sums with every dish at one table: by context tables and customers, by word tables."""
    for cell, rows in common.grouped(batches, "cell"):
        names, numbers = [], []
        for name, pair in (("words", "pair_word"), ("contexts", "pair_context")):
            lists = [np.frombuffer(r[name], dtype=U64) for r in rows]
            own, at = common.numbered(np.concatenate(lists))
            starts = np.cumsum([0, *(len(x) for x in lists)])
            read = _risen if name == "words" else unpacked
            numbers.append(np.concatenate([at[read(r[pair]) + a] for r, a in zip(rows, starts.tolist(), strict=False)]))
            names.append(own)
        width = len(names[1])
        keys, at = common.numbered_keys(numbers[0] * width + numbers[1])
        each = [unpacked(r["pair_count"]) for r in rows]
        counts = np.bincount(at, weights=np.concatenate(each), minlength=len(keys)).astype(np.int64)
        many, (word, context) = counts > 1, np.divmod(keys, max(width, 1))
        out = [(PAIRS, cell, -1, width, _rising(keys), packed(counts), None, int((counts == 1).sum()), int((counts == 2).sum())), (MANY, cell, -1, width, _rising(keys[many]), packed(counts[many]), None, 0, 0)]
        sums = lambda which, n, x: np.bincount(which, weights=x, minlength=n).astype(np.int64)
        tables, customers, dishes = sums(context, width, counts > 0), sums(context, width, counts), sums(word, len(names[0]), counts > 0)
        for side, own, first, second in ((0, names[1], tables, customers), (1, names[0], dishes, None)):
            cuts = plan.cuts(own)
            out += [(ASKS, cell, 2 * h + side, -1, packed(first[a:b]), None if second is None else packed(second[a:b]), own[a:b].tobytes(), 0, 0) for h, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        ends = np.cumsum([len(x) for x in each]).tolist()
        out += [(PLACES, cell, -1, r["chunk"], _rising(at[e - len(x) : e]), None, None, 0, 0) for r, x, e in zip(rows, each, ends, strict=True)]
        yield _table(CELLS, out)


class Cell:
    """Pairs of a cell: numbers of word and word before, training counts."""

    def __init__(self, row: dict):
        self.word, self.context = np.divmod(_risen(row["first"]), max(row["chunk"], 1))
        self.count = unpacked(row["second"])


# --- homes ---------------------------------------------------------------------------

#: Homes of words as contexts have even numbers, as dishes odd ones.
#: kind 0: places of each asking cell's words; 1: sums with every dish at one table; 2: the parent's seating; 3: what a cell is told, or posts
HOMES = "kind int, home int, cell int, pass int, first binary, second binary, customers double, tables double"
BASE, SUMS, SEATED, TOLD = 0, 1, 2, 3
START = -1


def _homes(batches: Iterator[pa.RecordBatch], given: Given) -> Iterator[pa.RecordBatch]:
    """Sums over all asking cells; dishes of the parent are seated for the first time."""
    for home, rows in common.grouped(batches, "home"):
        names = [np.frombuffer(r["names"], dtype=U64) for r in rows]
        _, at = common.numbered(np.concatenate(names))
        places = np.split(at, np.cumsum([len(x) for x in names])[:-1])
        first = _total(places, [r["first"] for r in rows])
        out = [(BASE, home, r["cell"], START, _rising(x), None, 0.0, 0.0) for r, x in zip(rows, places, strict=True)]
        out.append((SUMS, home, -1, START, packed(first), None, 0.0, 0.0))
        if home % 2:
            seating = Seating.started(first).seated(given.opens, given.discounts[0], _random(home, START, 1))
            yield _table(HOMES, out + _kept(home, START, seating) + _tell(home, START, rows, places, first, seating.tables))
        else:
            yield _table(HOMES, out + _tell(home, START, rows, places, first, _total(places, [r["second"] for r in rows])))


def _total(places: list[np.ndarray], posted: list[bytes]) -> np.ndarray:
    size = 1 + max((int(x[-1]) for x in places), default=-1)
    out = np.zeros(size, dtype=np.int64)
    for x, values in zip(places, posted, strict=True):
        out[x] += unpacked(values)
    return out


def _tell(home: int, number: int, rows: list[dict], places: list[np.ndarray], first: np.ndarray, second: np.ndarray | None) -> list[tuple]:
    return [(TOLD, home, r["cell"], number, packed(first[x]), None if second is None else packed(second[x]), 0.0, 0.0) for r, x in zip(rows, places, strict=True)]


def _kept(home: int, number: int, seating: Seating) -> list[tuple]:
    customers = seating.customers
    return [(SEATED, home, -1, number, packed(seating.tables), packed(seating.sizes), float(customers.sum()), float(seating.tables[customers > 0].sum()))]


def _rehomed(batches: Iterator[pa.RecordBatch], given: Given, number: int) -> Iterator[pa.RecordBatch]:
    """Rows stand by home and kind, then by cell. Cells post how many tables more than one their dishes have."""
    for home, rows in common.grouped(batches, "home"):
        base, posts = [r for r in rows if r["kind"] == BASE], [r for r in rows if r["kind"] == TOLD]
        places = [_risen(r["first"]) for r in base]
        first = unpacked(next(r["first"] for r in rows if r["kind"] == SUMS)) + _total(places, [r["first"] for r in posts])
        if home % 2:
            old = next(r for r in rows if r["kind"] == SEATED)
            random = _random(home, number, 1)
            before = Seating(unpacked(old["first"]), unpacked(old["second"]))
            seating = before.with_customers(first, given.opens, given.discounts[0], random)
            for _ in range(SWEEPS):
                seating = seating.swept(given.opens, given.discounts[0], random, before.tables)
            yield _table(HOMES, _kept(home, number, seating) + _tell(home, number, base, places, first, seating.tables))
        else:
            yield _table(HOMES, _tell(home, number, base, places, first, None))


# --- passes --------------------------------------------------------------------------


def _random(place: int, number: int, kind: int) -> np.random.Generator:
    return np.random.default_rng([0x5059, kind, place, number + 1])


class Given:
    """What holds for all restaurants together: V, discounts, the parent's customers and tables."""

    def __init__(self, v: int, discounts: tuple[float, float], customers: float, tables: float, number: int = START):
        self.v, self.discounts, self.customers, self.tables, self.number = v, discounts, customers, tables, number

    def single(self, customers: np.ndarray, tables: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
        """P(w) from the parent's customers and tables of each word; `more` customers have come since."""
        d = self.discounts[0]
        customers = np.maximum(customers + more, 0)
        return (np.maximum(customers - d * np.minimum(tables, customers), 0) + (STRENGTH + d * self.tables) / (self.v + 1)) / (STRENGTH + self.customers + more)

    def opens(self, dishes: np.ndarray, more: np.ndarray) -> np.ndarray:
        """The parent's weight of a new table, with `more` tables of the dish than these sums have."""
        return (STRENGTH + self.discounts[0] * (self.tables + more)) / (self.v + 1)

    def after(self, count: np.ndarray, tables: np.ndarray, context_count: np.ndarray, context_tables: np.ndarray, single: np.ndarray) -> np.ndarray:
        """P(w | u)."""
        d = self.discounts[1]
        return (count - d * tables + (STRENGTH + d * context_tables) * single) / (STRENGTH + context_count)


class Told:
    """What a cell was told in a pass: by word the parent's customers and tables, by context tables (and customers, at the start)."""

    def __init__(self, rows: list[dict], number: int):
        own = sorted((r for r in rows if r["pass"] == number), key=lambda r: r["home"])
        read = lambda side, k: np.concatenate([unpacked(r[k]) for r in own if r["home"] % 2 == side and r[k] is not None] or [np.empty(0, dtype=np.int64)])
        self.customers, self.tables = read(1, "first"), read(1, "second")
        self.context_tables, self.context_customers = read(0, "first"), read(0, "second")


#: what a pass reads and writes of cells; kind 4: tables of the cell's dishes of several customers, 5: what it posts to homes
STATE = "kind int, cell int, home int, pass int, first binary, second binary, chunk long"
TABLES, POSTS = 4, 5


def _passed(batches: Iterator[pa.RecordBatch], given: Given, number: int) -> Iterator[pa.RecordBatch]:
    """Rows stand by cell and kind: pairs, what homes told, the seating after the pass before. The cell's new seating and its posts to homes.
    A single customer of a dish sits alone, so only dishes of several are seated."""
    for cell, rows in common.grouped(batches, "cell"):
        c, told = Cell(rows[0]), Told([r for r in rows if r["kind"] == TOLD], given.number)
        random = _random(cell, number, 0)
        old = [r for r in rows if r["kind"] == TABLES]
        seating = Seating(unpacked(old[0]["first"]), unpacked(old[0]["second"])) if old else Seating.started(c.count)
        begun = seating.tables

        def opens(dishes: np.ndarray, more: np.ndarray) -> np.ndarray:
            """A dish's weight of a new table, with `more` tables of it than the pass began with."""
            w, u = c.word[dishes], c.context[dishes]  # noqa: B023
            return (STRENGTH + given.discounts[1] * (told.context_tables[u] + more)) * given.single(told.customers[w], told.tables[w], more)  # noqa: B023

        if not old:
            seating = seating.seated(opens, given.discounts[1], random)
        for _ in range(SWEEPS):
            seating = seating.swept(opens, given.discounts[1], random, begun)
        out = [(TABLES, cell, -1, number, packed(seating.tables), packed(seating.sizes), 0)]
        names = [r for r in rows if r["kind"] == TOLD and r["pass"] == START]
        for side, own in ((0, c.context), (1, c.word)):
            homes = sorted((r["home"], len(unpacked(r["first"]))) for r in names if r["home"] % 2 == side)
            more = np.bincount(own, weights=seating.tables - 1, minlength=sum(n for _, n in homes)).astype(np.int64)
            ends = np.cumsum([n for _, n in homes]).tolist()
            out += [(POSTS, cell, home, number, packed(more[e - n : e]), None, 0) for (home, n), e in zip(homes, ends, strict=True)]
        yield _table(STATE, out)


ANSWERS = "chunk long, cell int, pair binary"


def _answers(batches: Iterator[pa.RecordBatch], samples: list[Given]) -> Iterator[pa.RecordBatch]:
    """Rows stand by cell and kind, places of posts last: for each post its pairs' log10 P(w | u), averaged over samples."""
    for cell, rows in common.grouped(batches, "cell"):
        c, told = Cell(rows[0]), [r for r in rows if r["kind"] == TOLD]
        whole = Told(told, START).context_customers[c.context]
        p, many = np.zeros(len(c.count)), c.count > 1
        for s in samples:
            own = Told(told, s.number)
            tables = np.minimum(c.count, 1)
            tables[many] = unpacked(next(r["first"] for r in rows if r["kind"] == TABLES and r["pass"] == s.number))
            p += s.after(c.count, tables, whole, own.context_tables[c.context], s.single(own.customers, own.tables)[c.word])
        pair = np.log10(p / len(samples)).astype("<f4")
        yield _table(ANSWERS, [(r["chunk"], cell, pair[_risen(r["first"])].tobytes()) for r in rows if r["kind"] == POSTS])


# --- scores --------------------------------------------------------------------------

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _scores(batches: Iterator[pa.RecordBatch], plan: Plan, n: int, v: int) -> Iterator[pa.RecordBatch]:
    """Rows stand by chunk: the chunk itself (kind 0), counts of its words by home (1), probabilities of its pairs by cell (2)."""
    for _, rows in common.grouped(batches, "chunk"):
        chunk = Chunk(rows[0])
        word, context, which = chunk.pairs()
        counts = np.concatenate([unpacked(r["seen"]) for r in rows if r["kind"] == 1])
        pair = np.empty(len(word))
        pair[np.argsort(plan.cell(chunk.words, word, context), kind="stable")] = np.concatenate([np.frombuffer(r["pair"], dtype="<f4") for r in rows if r["kind"] == 2])
        size = chunk.counts
        begins = np.cumsum(size) - size
        total = lambda by_word: np.add.reduceat(by_word[chunk.tokens], begins)  # noqa: E731, B023
        score = np.add.reduceat(pair[which], begins)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(chunk.ids, pa.int64(), mask=chunk.nulls), pa.array(chunk.held), pa.array(size), pa.array(total((counts > 0).astype(np.int64))),
                pa.array(np.full(len(begins), n)), pa.array(total(np.log10((counts + 1) / (n + v + 1)))), pa.array(score), pa.array(10.0 ** np.minimum(-score / size, 300)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def scored(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> a row for each, scored by a model of those that are not held out."""
    with common.scratch(docs.sparkSession):
        return common.staged(_scored(docs), "scores", keep=True)


def _scored(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.n_buckets(spark)
    plan = Plan(parts)
    together = lambda df, *keys: df.repartition(parts, keys[0]).sortWithinPartitions(*keys)
    union = lambda tables: functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chunks = common.staged(common.map_arrow(rows, _chunks, CHUNKS), "chunks")
    posts = common.map_arrow(chunks.select("chunk", "words", "seen"), lambda b: _word_posts(b, plan), WORD_POSTS)
    words = common.staged(common.map_arrow(together(posts, "home", "chunk"), _word_counts, WORD_COUNTS), "words")
    v, n = (int(x or 0) for x in words.agg(F.sum("v"), F.sum("n")).first())

    posts = common.map_arrow(chunks.drop("seen"), lambda b: _pair_posts(b, plan), PAIR_POSTS)
    cells = common.staged(common.map_arrow(together(posts, "cell", "chunk"), lambda b: _summed(b, plan), CELLS), "cells", by="kind")
    of_kind = lambda df, k, *names: df.where(F.col("kind") == k).select("kind", *names)
    n1, n2 = (int(x or 0) for x in cells.where(F.col("kind") == PAIRS).agg(F.sum("n1"), F.sum("n2")).first())

    # the parent begins with a customer for each pair
    discounts = (_discount(n1, n2),) * 2
    given = Given(v, discounts, 0.0, float(v))
    asks = of_kind(cells, ASKS, "home", "cell", "first", "second", "names")
    new = common.staged(common.map_arrow(together(asks, "home", "cell"), lambda b, g=given: _homes(b, g), HOMES), "homes", by="kind")
    columns = ["home", "cell", "pass", "first", "second"]
    base = [of_kind(new, BASE, *columns), of_kind(new, SUMS, *columns)]
    states: list[DataFrame] = []

    def totals(df: DataFrame, number: int) -> Given:
        sums = df.where(F.col("kind") == SEATED).agg(F.sum("customers"), F.sum("tables")).first()
        return Given(v, discounts, float(sums[0] or 0), float(sums[1] or 0), number)

    given, told, samples = totals(new, START), [of_kind(new, TOLD, *columns)], []
    for k in range(BURN_IN + SAMPLES):
        rows = union([of_kind(cells, MANY, "cell", "chunk", "first", "second"), *told[:1], *told[1:][-1:], *states[-1:]])
        rows = together(rows, "cell", "kind", "pass", "home").select("kind", "cell", "home", "pass", "first", "second", "chunk")
        state = common.staged(common.map_arrow(rows, lambda b, g=given, k=k: _passed(b, g, k), STATE), "pass", by="kind")
        states.append(of_kind(state, TABLES, *columns))
        posts = of_kind(state, POSTS, *columns).withColumn("kind", F.lit(TOLD))
        rows = together(union([*base, of_kind(new, SEATED, *columns), posts]), "home", "kind", "cell")
        new = common.staged(common.map_arrow(rows, lambda b, g=given, k=k: _rehomed(b, g, k), HOMES), "homes", by="kind")
        told.append(of_kind(new, TOLD, *columns))
        given = totals(new, k)
        samples += [given] * (k >= BURN_IN)

    places = of_kind(cells, PLACES, "cell", "chunk", "first").withColumn("kind", F.lit(POSTS))
    rows = union([of_kind(cells, PAIRS, "cell", "chunk", "first", "second"), told[0], *told[-SAMPLES:], *states[-SAMPLES:], places])
    rows = together(rows, "cell", "kind", "pass", "home", "chunk").select("kind", "cell", "home", "pass", "first", "second", "chunk")
    answers = common.staged(common.map_arrow(rows, lambda b: _answers(b, samples), ANSWERS), "answers")
    common.unstage(cells)
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    both = union([kind(chunks.drop("seen"), 0), kind(words.select("chunk", "home", "seen"), 1), kind(answers, 2)])
    return common.map_arrow(together(both, "chunk", "kind", "home", "cell"), lambda b: _scores(b, plan, n, v), RESULT)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir).select("doc_id", "text"))
