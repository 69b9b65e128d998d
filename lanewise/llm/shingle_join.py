"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct five-word shingles (64-bit hashes; A-Z folded).  Documents
link at 100 * intersection >= 80 * union; the result is the components of that graph.

1. Filter.  A linked document misses at most e = n - ceil(0.8 n) of its n shingles.  Of the
   shingles below a fixed fraction of the hash range (a prefix in hash order) those that no
   other document has are counted; a document with more than e of them links with nothing.
2. Equal sets become one class, so copies cost one member.  Over the sets that are left all
   shingles are counted so.  A pair can share no more than either has in common with others,
   which leaves few pairs to compare even in a large group of texts that are nearly alike.
3. Prefixes.  Of each remaining class the e + 1 + G smallest shingles are posted.  A shingle on
   up to FREQUENT postings is a signature alone.  Frequent ones are dealt into G subclasses by
   hash, and pairs of them within a subclass are signatures: of e + 1 + G shingles a linked
   class shares at least one rare one or two of one subclass, as a subclass can hold back one
   shared shingle without a pair.  G grows with the length, so pairs stay in proportion; as
   linked lengths differ by a quarter at most, a class near the next power of two also posts
   for that one's G.
4. Verification.  In each signature's group every class is first compared with the group's
   leader, the class with the fewest shingles of its own; components are formed from the links
   found.  Classes of groups that then hold several components go on.  Each has its shingles in
   one order, those that the fewest such classes have first, without those that no other has.
   Linked ones have a first shingle in common, and no more in common than either has left from
   there on; as the shingles that it has to itself are not among those, a class with many of
   them is met at few places or none.  Of two the shorter has eight ninths of its shingles left
   there.  Classes meet so with the one of each place that has most left, and the components grow
   by the links found; then all of different components meet.  Parity sketches bound what
   they share, and only pairs that pass have their sets compared.  Pairs inside a component need no
   comparison, and none across that could link is left out.  A leader's members are dealt to
   tasks in parts of about MEMBERS.

Null and empty texts have the empty set and link with nothing; fewer than five words make one
shingle of the whole sequence.  Repeated rows are copies; rows of one doc_id with different
texts each get a row.  A null doc_id is kept and counts as larger than any other.  Other
columns are not read.  Sets are told apart by their size and 128 bits of hash, shingles by 64.
Everything is written to the shared folder between steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix
from .components import components

K, PERCENT = 5, 80
SAMPLE = 3 / 8
FREQUENT = 64
MEMBERS = 1024
CHUNK_HASHES = 800_000


def allowed_misses(n: np.ndarray | int, percent: int = PERCENT):
    """The most shingles of a set of n that a linked set may lack."""
    return n - (-(-n * percent // 100))


def block_sets(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's documents, each document's sorted, and how many each has."""
    words, counts = common.word_hashes(data, offsets)
    n_docs = len(counts)
    starts = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(counts, out=starts[1:])
    wins = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    sizes = wins.copy()
    sizes[short] = 1
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if n_docs else 0, dtype=U64)
    if len(words) >= k:
        every = common.shingle_hashes(words, k)
        place = np.repeat(starts[:-1] - (ends - sizes), sizes) + np.arange(len(out))
        place[ends[short] - 1] = 0
        out[:] = every[np.minimum(place, len(every) - 1)]
    for i in short.tolist():
        h = common.shingle_hashes(words[starts[i] : starts[i + 1]], int(counts[i]))
        out[ends[i] - 1] = mix(h ^ U64(0x5348 + int(counts[i])))[0]
    for i in np.flatnonzero(sizes > 1).tolist():
        out[ends[i] - sizes[i] : ends[i]].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[(ends - sizes)[sizes > 0]] = True
    owner = np.repeat(np.arange(n_docs), sizes)
    return out[fresh], np.bincount(owner[fresh], minlength=n_docs)


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.zeros(len(hashes) + 1, dtype=U64)
        np.cumsum(mix(hashes ^ U64(salt)), out=sums[1:])
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64) + U64(salt)))
    return out[0], out[1]


DEALT = "bucket int, chunk long, docs binary, counts binary, hashes binary"


class _Dealer:
    """Gathers sets and deals their hashes out by bucket: for each chunk of sets a row for each bucket, and one with the sets' ids, sizes and keys."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size, self.made = buckets, [], 0, 0
        self.base = TaskContext.get().partitionId() << 32

    def add(self, ids: np.ndarray, hashes: np.ndarray, each: np.ndarray, sizes: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """`each`: how many of the hashes are of each set; `sizes`: how many it has altogether."""
        self.held.append((ids, hashes, each, sizes, *keys))
        self.size += len(hashes) + len(ids)
        if self.size >= CHUNK_HASHES:
            yield self.rows()

    def rows(self) -> pa.RecordBatch:
        ids, hashes, each, sizes, first, second = [np.concatenate(x) for x in zip(*self.held, strict=True)]
        chunk = self.base + self.made
        self.held, self.size, self.made = [], 0, self.made + 1
        owner = np.repeat(np.arange(len(ids)), each)
        bucket = (hashes % U64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        hashes, owner, bucket = hashes[order], owner[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        known = np.array([x is not None for x in ids.tolist()]) if ids.dtype == object else np.ones(len(ids), dtype=bool)
        ids = np.where(known, ids, 0).astype(np.int64)
        rows: list[tuple] = [(self.buckets + chunk % self.buckets, ids.tobytes() + known.tobytes(), sizes.astype("<u4").tobytes(), first.tobytes() + second.tobytes())]
        for b in range(self.buckets):
            own = slice(cuts[b], cuts[b + 1])
            docs, counts = np.unique(owner[own], return_counts=True)
            if len(docs):
                rows.append((b, common.packed(np.diff(docs, prepend=0)), common.packed(counts), hashes[own].tobytes()))
        bucket, *rest = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), *[pa.array(x, pa.binary()) for x in rest]], names=["bucket", "chunk", "docs", "counts", "hashes"])


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, k: int) -> Iterator[pa.RecordBatch]:
    """Sampled hashes of the documents' sets."""
    dealer, limit = _Dealer(buckets), U64(int(SAMPLE * 2**64))
    for batch in batches:
        for ids, data, offsets in common.text_blocks(batch.column(0).to_pylist(), batch.column(1)):
            hashes, sizes = block_sets(data, offsets, k)
            kept = hashes < limit
            each = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
            yield from dealer.add(np.array(ids, dtype=object), hashes[kept], each, sizes, set_keys(hashes, sizes))
    if dealer.held:
        yield dealer.rows()


def _dealt_sets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """All hashes of the sets that are left."""
    dealer = _Dealer(buckets)
    for batch in batches:
        for node, hashes in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            hashes, node = np.frombuffer(hashes, dtype=U64), np.array([node], dtype=np.int64)
            size = np.array([len(hashes)])
            yield from dealer.add(node, hashes, size, size, (node.view(U64), node.view(U64)))
    if dealer.held:
        yield dealer.rows()


OWN = "chunk long, bucket int, docs binary, counts binary, keys binary"


def _own_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """To each chunk, how many hashes of a bucket its sets have to themselves; the chunks' own rows pass through as bucket -1."""

    def made(chunk: int, bucket: int, docs: bytes, counts: bytes, keys: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in (docs, counts, keys)]], names=["chunk", "bucket", "docs", "counts", "keys"])

    held: dict[int, list] = {}
    for batch in batches:
        for b, chunk, docs, counts, hashes in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if b >= buckets:
                yield made(chunk, -1, docs, counts, hashes)
            else:
                held.setdefault(b, []).append((chunk, docs, common.unpacked(counts), np.frombuffer(hashes, dtype=U64)))
    for b in list(held):
        parts = held.pop(b)
        hashes = np.concatenate([p[3] for p in parts])
        order = np.argsort(hashes)
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        alone = np.ones(len(ranked), dtype=bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        flag = np.zeros(len(ranked), dtype=np.int64)
        flag[order] = alone
        at = 0
        for chunk, docs, counts, _ in parts:
            begins = np.cumsum(counts) - counts
            own = np.add.reduceat(flag[at : at + int(counts.sum())], begins)
            at += int(counts.sum())
            yield made(chunk, b, docs, common.packed(own), None)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand by chunk, its own first: id, own, n, first, second of each set."""

    def made() -> pa.RecordBatch:
        columns = [pa.array(ids, pa.int64(), mask=~known), *[pa.array(x, pa.int64()) for x in (own, sizes, keys[: len(ids)], keys[len(ids) :])]]
        return pa.RecordBatch.from_arrays(columns, names=["id", "own", "n", "first", "second"])

    ids = known = own = sizes = keys = None
    for batch in batches:
        for bucket, docs, counts, own_keys in zip(*[batch.column(c).to_pylist() for c in ("bucket", "docs", "counts", "keys")], strict=True):
            if bucket < 0:
                if ids is not None:
                    yield made()
                sizes, keys = np.frombuffer(counts, dtype="<u4").astype(np.int64), np.frombuffer(own_keys, dtype=np.int64)
                ids, known = np.frombuffer(docs, dtype=np.int64, count=len(sizes)), np.frombuffer(docs, dtype=bool, offset=8 * len(sizes))
                own = np.zeros(len(ids), dtype=np.int64)
            else:
                own[np.cumsum(common.unpacked(docs))] += common.unpacked(counts)
    if ids is not None:
        yield made()


def _counted(dealt: DataFrame, buckets: int) -> DataFrame:
    """Of each set: id, own (how many of the hashes dealt no other set has), n, first, second."""
    own = common.map_arrow(dealt.repartition(buckets, "bucket"), lambda b: _own_counts(b, buckets), OWN)
    return common.map_arrow(own.repartition("chunk").sortWithinPartitions("chunk", "bucket"), _totals, "id long, own long, n long, first long, second long")


def _levels(n: int) -> list[int]:
    """The powers of two that n posts for: its own, and the next if a linked set may reach it."""
    own = n.bit_length() - 1
    return [own] + [own + 1] * (100 * n >= PERCENT * (1 << (own + 1)))


def _subclasses(level: int) -> int:
    return 1 << max(0, level - 5)


def _sketch(hashes: np.ndarray) -> bytes:
    """Parities of the hashes over four bits for each of the next lower power of two; two sets differ in as many hashes as bits, at least."""
    bits = 4 << (len(hashes).bit_length() - 1) if len(hashes) > 1 else 8
    return np.packbits((np.bincount((hashes >> U64(20)) & U64(bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of the documents that stand for their classes: rows of id, text, first, second, node."""
    for batch in batches:
        want, nodes = [np.asarray(batch.column(i)) for i in (2, 3)], np.asarray(batch.column(4))
        at = 0
        for ids, data, offsets in common.text_blocks(batch.column(0).to_pylist(), batch.column(1)):
            hashes, sizes = block_sets(data, offsets, k)
            keys = set_keys(hashes, sizes)
            ends = np.cumsum(sizes)
            here = slice(at, at + len(ids))
            keep = np.flatnonzero((keys[0].view(np.int64) == want[0][here]) & (keys[1].view(np.int64) == want[1][here])).tolist()
            if keep:
                own = [hashes[ends[i] - sizes[i] : ends[i]] for i in keep]
                yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[here][keep], pa.int64()), "n": pa.array(sizes[keep], pa.int64()), "hashes": pa.array([x.tobytes() for x in own], pa.binary()), "bits": pa.array([_sketch(x) for x in own], pa.binary())})
            at += len(ids)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The extended prefix of each set."""
    for batch in batches:
        nodes, tokens = [], []
        for node, n, hashes in zip(*[batch.column(c).to_pylist() for c in ("node", "n", "hashes")], strict=True):
            length = allowed_misses(n) + 1 + _subclasses(_levels(n)[-1])
            tokens.append(np.frombuffer(hashes, dtype=np.int64)[:length])
            nodes.append(np.full(len(tokens[-1]), node, dtype=np.int64))
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(nodes), pa.int64())], names=["token", "node"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shingles of each set."""
    for batch in batches:
        for node, hashes in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
            tokens = np.frombuffer(hashes, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(np.full(len(tokens), node), pa.int64())], names=["token", "node"])


def _combinations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a set's frequent shingles within a subclass, as signatures."""
    for batch in batches:
        for node, n, tokens in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            tokens = np.sort(np.array(tokens, dtype=np.int64)).view(U64)
            for level in _levels(n):
                groups = _subclasses(level)
                own = mix(tokens ^ U64(0xC1A55)) % U64(groups)
                order = np.argsort(own, kind="stable")
                ranked, own = tokens[order], own[order]
                found, step = [], 1
                while step < len(ranked):
                    near = own[step:] == own[:-step]
                    if not near.any():
                        break
                    found.append(mix(ranked[:-step][near] * U64(0x9E3779B97F4A7C15) + mix(ranked[step:][near]) + U64(level)))
                    step += 1
                if found:
                    sigs = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64), pa.int64()), pa.array(np.full(len(sigs), node), pa.int64())], names=["sig", "node"])


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of an ordered set's members another has."""
    if not len(left):
        return np.zeros(len(right), dtype=bool)
    at = np.searchsorted(left, right)
    at[at == len(left)] = 0
    return left[at] == right


def _differing(left: np.ndarray, right: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer folded to the other's length."""
    while len(left) > len(right):
        left = left[: len(left) // 2] ^ left[len(left) // 2 :]
    while len(right) > len(left):
        right = right[: len(right) // 2] ^ right[len(right) // 2 :]
    return int(np.bitwise_count(left ^ right).sum())


def _compared(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows stand by u and part, the set of u itself first (v null)."""
    now, left, n_left = None, np.empty(0, dtype=U64), 0
    for batch in batches:
        rows = []
        for u, v, n, data in zip(*[batch.column(c).to_pylist() for c in ("u", "v", "n", "data")], strict=True):
            right = np.frombuffer(data, dtype=U64 if exact else np.uint8)
            if v is None:
                now, left, n_left = u, right, n
            elif u == now:
                both = int(_shared(left, right).sum()) if exact else (n_left + n - _differing(left, right)) // 2
                rows.append((u, v, both, n_left + n))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["u", "v", "both", "sizes"])


def overlaps(pairs: DataFrame, sets: DataFrame, exact: bool = True) -> DataFrame:
    """pairs(u, v) with `both`, how many shingles they share (at most, by sketches, if not exact), and `sizes`, how many they have.
    A set or sketch travels once for each u that it is compared with, and that of u once for each part of its v."""
    data = sets.select("node", "n", F.col("hashes" if exact else "bits").alias("data"))
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part")
    members = pairs.join(parts, "u").select("u", "v", part).join(data.withColumnRenamed("node", "v"), "v").select("u", "part", "v", "n", "data")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own = data.withColumnRenamed("node", "u").join(parts, "u").select("u", part, F.lit(None).cast("long").alias("v"), "n", "data")
    rows = own.unionByName(members).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return common.map_arrow(rows.drop("part"), lambda batches: _compared(batches, exact), "u long, v long, both long, sizes long")


LINKED = f"100 * both >= {PERCENT} * (sizes - both)"


def _rarest(listing: DataFrame, sets: DataFrame) -> DataFrame:
    """listing(node, n) -> token, node, n, left: where the first shingle that a class shares with a linked one may stand.

    Each class has its shingles in one order, the rarest of the listing first and without those that no other has; `left`
    is how many it has from this one on. Two classes share no more than either has left at the first that they share."""
    tokens = common.map_arrow(sets.join(listing.select("node"), "node", "left_semi").select("node", "hashes"), _members, "token long, node long")
    held = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(held, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("held")).join(listing, "node")
    ranked = ranked.withColumn("count", F.size("held")).withColumn("first", F.expr(f"slice(held.token, 1, greatest(0, count - cast(ceil(n * {PERCENT} / 100) as int) + 1))"))
    posts = ranked.select("node", "n", "count", F.posexplode("first").alias("at", "token"))
    return posts.select("token", "node", "n", (F.col("count") - F.col("at")).alias("left"))


#: Of two the shorter, or at one length the one of the lesser number, has so much left.
SHORTER = f"{100 + PERCENT} * left >= {2 * PERCENT} * n"
FITS = f"u_component <> v_component and {100 + PERCENT} * least(u_left, v_left) >= {PERCENT} * (u_n + v_n)"


def _meeting(posts: DataFrame) -> DataFrame:
    """posts(token, node, n, left, component) -> those that a class of another component may meet, `within` for the token's largest component."""
    shortest = posts.where(SHORTER).groupBy("token").agg(F.min("n").alias("shortest"))
    posts = posts.join(shortest, "token").where(f"{100 + PERCENT} * left >= {PERCENT} * (n + shortest)").drop("shortest")
    parts = posts.groupBy("token", "component").agg(F.count("*").alias("size"))
    several = parts.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("top.component").alias("top"))
    return posts.join(several, "token").withColumn("within", F.col("component") == F.col("top")).drop("top")


def _side(posts: DataFrame, x: str, keys: list[str]) -> DataFrame:
    return posts.select(*keys, *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "component", "left")])


def _with_centres(meeting: DataFrame) -> DataFrame:
    """Pairs (u, v) of each class with that which has most left at the token."""
    centres = meeting.groupBy("token").agg(F.max(F.struct("left", "node", "n", "component")).alias("c")).select("token", "c.*")
    both = _side(centres, "u", ["token"]).join(_side(meeting, "v", ["token"]), "token").where(FITS)
    return both.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def _across(meeting: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components that may link; a token's largest component does not meet itself."""
    keys = ["token", "with_top"]
    longer = meeting.withColumn("with_top", F.explode(F.when(F.col("within"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    both = _side(meeting.where(SHORTER).withColumn("with_top", F.col("within")), "u", keys).join(_side(longer, "v", keys), keys)
    both = both.where(FITS).where(F.struct("u_n", "u_node") < F.struct("v_n", "v_node"))
    return both.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()


def _links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes(node, n, own), sets(node, n, hashes) -> (node, component) of those classes that link."""
    spark = nodes.sparkSession
    postings = common.staged(common.map_arrow(sets, _postings, "token long, node long"), "postings")
    about = postings.count()
    tokens = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(tokens, "token")
    rare = shared.where(F.col("df") <= FREQUENT).select(F.col("token").alias("sig"), "node")
    often = shared.where(F.col("df") > FREQUENT).groupBy("node").agg(F.collect_list("token").alias("tokens")).join(nodes.select("node", "n"), "node")
    signed = rare.unionByName(common.map_arrow(often, _combinations, "sig long, node long"))
    signed = common.staged(common.narrow(signed.join(nodes, "node"), about), "signatures")  # sig, node, n, own

    # the leader of a group has the smallest share of shingles to itself
    rank = F.struct((F.col("own") / F.col("n")).alias("share"), F.col("node").alias("leader"))
    groups = signed.groupBy("sig").agg(F.min(rank).alias("first"), F.count("*").alias("size")).where("size > 1")
    groups = groups.select("sig", "first.leader")
    led = common.staged(common.narrow(signed.join(groups.select("sig", "leader"), "sig"), about), "led")
    pairs = led.where(F.col("node") != F.col("leader")).select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()
    stars = common.staged(common.narrow(overlaps(pairs, sets)), "stars")
    edges = stars.where(LINKED).select("u", "v")
    labels = common.staged(components(edges, about), "labels")

    # what is left: classes of groups that hold several components
    led = led.select("leader", "node", "n").distinct().join(labels.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    led = common.staged(common.narrow(led, about), "members")
    several = led.groupBy("leader").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("leader")
    open_ = common.staged(common.narrow(led.join(several, "leader", "left_semi").select("node", "n").distinct(), about), "open")
    posts = common.staged(common.narrow(_rarest(open_, sets)), "rarest")
    placed_rows = posts.count()
    tried = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    for label, pairs_of in (("centres", _with_centres), ("rest", _across)):
        placed = posts.join(labels.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        meeting = common.staged(common.narrow(_meeting(placed), placed_rows), "meeting")
        pairs = common.staged(common.narrow(pairs_of(meeting).join(tried, ["u", "v"], "left_anti")), label)
        near = common.staged(common.narrow(overlaps(pairs, sets, exact=False).where(LINKED).select("u", "v")), "near")
        late = common.staged(common.narrow(overlaps(near, sets).where(LINKED).select("u", "v")), "edges")
        tried = tried.unionByName(pairs)
        if not late.isEmpty():
            labels = common.staged(components(labels.select("u", F.col("component").alias("v")).unionByName(late), about), "labels")
    return labels


def joined(docs: DataFrame, k: int = K) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    common.small_batches(spark)
    buckets = common.n_buckets(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    sized = common.staged(_counted(common.map_arrow(rows, lambda b: _dealt(b, buckets, k), DEALT), buckets), "sizes", keep=True)
    key = ["first", "second", "n"]
    classes = sized.where("n > 0").groupBy(*key).agg(F.min("id").alias("id"), F.min("own").alias("own"))
    misses = F.col("n") - F.ceil(F.col("n") * PERCENT / 100).cast("long")
    with common.scratch(spark):
        # a class's number, once written, stays
        alive = common.staged(common.narrow(classes.where(F.col("own") <= misses), sized.count()).withColumn("node", F.monotonically_increasing_id()), "alive")
        at = lambda df: df.withColumn("at", F.coalesce("id", F.lit(-1)))  # noqa: E731  texts of -1 and of null are told apart by their sets
        with common.prefiltered_joins(spark):  # most texts need not travel
            texts = at(rows).join(at(alive.where("n > 0")).select("at", *key[:2], "node"), "at").select("id", "text", *key[:2], "node")
            sets = common.staged(common.narrow(common.map_arrow(texts, lambda b: _sets(b, k), "node long, n long, hashes binary, bits binary").dropDuplicates(["node"])), "sets")
        again = _counted(common.map_arrow(sets, lambda b: _dealt_sets(b, buckets), DEALT), buckets).select(F.col("id").alias("node"), "own")
        nodes = alive.select("node", "n").join(again, "node", "left").fillna(0, ["own"]).where(F.col("own") <= misses)
        nodes = common.staged(common.narrow(nodes, alive.count()), "nodes")
        links = _links(nodes, sets.join(nodes.select("node"), "node", "left_semi"))
        # the least doc_id of each component of several classes
        linked = alive.select(*key, "node", "id").join(links.withColumnRenamed("u", "node"), "node")
        least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
        linked = common.staged(common.narrow(linked.join(least, "component").select(*key, "component_id"), alive.count()), "links", keep=True)

    alone = sized.where("n > 0").groupBy(*key).agg(F.min("id").alias("least"))
    out = sized.join(alone, key, "left").join(linked.withColumn("linked", F.lit(True)), key, "left")
    component = F.when(F.col("linked"), F.col("component_id")).when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.documents(spark, sf_dir).select("doc_id", "text"))
