import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import byte_bpe, chat, common, licenses, mixing, passages, pitman_yor, quality, registry, shingle_join, spotsigs, token_shards
from lanewise.llm.seating import Seating
from tests.conftest import DATA

from . import plain

P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(agree, name):
    assert len(agree(registry.QUERIES[name], registry.ORACLE_SQL[name]))


# --- 1


def _sigs(text):
    t = re.sub("[\t\n\x0b\f\r]", " ", text).lower()
    own = "|".join(spotsigs.ANCHORS)
    found = re.findall(f"(?<![^ ])(?:{own})(?: +(?!(?:{own})(?: |$))[^ ]+){{1,{spotsigs.CHAIN}}}", t)
    return set(found) or {w for w in re.split(" +", t) if w}


def _alike(a, b):
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b)


def test_spotsigs_against_plain(spark, sample):
    got = {r.doc_id: r for r in spotsigs.op1_spotsigs(spark, DATA).collect()}
    d = sample.sort_values("doc_id", ascending=False).reset_index(drop=True)
    assert len(got) == len(d)
    by_text = {}
    for i in range(len(d)):
        x, y, r = d.text[i], d.text[(i + 1) % len(d)], got[d.doc_id[i]]
        m = len(x) // 3
        edited = x[: len(x) - m] + y[:m]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, _alike(_sigs(x), _sigs(edited))) and math.isclose(r.near_next, _alike(_sigs(x), _sigs(y)))
        assert by_text.setdefault(x, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (_sigs(x) == _sigs(edited))


def test_spotsigs_next_rows_over_small_ranges(spark, sample):
    docs = spark.createDataFrame(sample[["doc_id", "text"]].assign(doc_id=lambda x: x.doc_id**2))
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(docs, rows=7).collect()}
    ids = sorted(got, reverse=True)
    texts = dict(zip(sample.doc_id**2, sample.text, strict=True))
    assert all(got[a] == texts[b] for a, b in zip(ids, ids[1:] + ids[:1], strict=True))


def test_spotsigs_of_far_ids_and_lengths(spark):
    """Ids at both ends of long and an outlier; likeness of sets of very different lengths; likeness from fingerprints alone."""
    long = " ".join(f"the w{i}" for i in range(301))
    rows = [(2**63 - 1, "the w5"), (-(2**63), long), (None, "the w5 w6")] + [(i, f"the w{i} of x{i}") for i in range(200)]
    out = spotsigs.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in out.collect()}
    order = sorted((r[0] for r in rows if r[0] is not None), reverse=True) + [None]
    texts = dict(rows)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        assert math.isclose(got[a].near_next, _alike(_sigs(texts[a]), _sigs(texts[b])))
        p, q = (set(re.findall(".{16}", got[k].fingerprint.split("-")[1])) for k in (a, b))
        assert math.isclose(got[a].near_next, len(p & q) / len(p | q)) and int(got[a].fingerprint.split("-")[0]) == len(p)
    one = spotsigs.fingerprinted(spark.createDataFrame([(2, long), (1, "the w5")], "doc_id long, text string")).collect()
    assert all(math.isclose(r.near_next, 1 / 301) for r in one)


def test_spotsigs_pairs(spark, sample):
    docs = spark.createDataFrame(sample[["doc_id", "text"]])
    got = {frozenset((r.a, r.b)) for r in spotsigs.near_pairs(docs).collect()}
    prints = {r.fingerprint: r.doc_id for r in spotsigs.op1_spotsigs(spark, DATA).collect()}
    texts = dict(zip(sample.doc_id, sample.text, strict=True))
    sets = {f: _sigs(texts[i]) for f, i in prints.items() if _sigs(texts[i])}
    assert got == {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_spotsigs_edges(spark, edge, nothing):
    rows = spotsigs.fingerprinted(edge).collect()
    assert len(rows) == edge.count() and spotsigs.fingerprinted(nothing).count() == 0
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert len({r.fingerprint for r in got[1]}) == 1 and got[2][0].fingerprint == got[3][0].fingerprint == got[4][0].fingerprint
    assert got[2][0].n_chars == 0 and got[2][0].edited_sha256 == hashlib.sha256(b"").hexdigest() and got[2][0].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alone = spotsigs.fingerprinted(spark.createDataFrame([(5, "the cat sat on the mat")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


# --- 2, 3


def test_quality_edges(edge, nothing):
    rows = quality.judged(edge)
    assert rows.count() == edge.count() and quality.judged(nothing).count() == 0
    got = {r.doc_id: r for r in rows.collect()}
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and not got[2].kept
    assert got[9].base_failed and got[9].n_repeat_words == 500
    assert got[6].n_words == 30_000
    assert quality.accepted(edge).columns == edge.columns


def test_license_inheritance(spark):
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", mit), ("a/b/x.py", "code here that says nothing at all about it"), ("a/b/c/LICENSE", "Licensed under CC BY-NC 4.0."), ("a/b/c/d/y.py", "more code"), ("z.py", "Licensed under the Apache License, Version 2.0.\n" + "code " * 30), ("q/r.py", None), (None, "text"), (None, mit), ("a/b/x.py", "code here that says nothing at all about it")]
    got = collections.Counter((r.path, r.own_license, r.is_license_file, r.license, r.inherited_from) for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == collections.Counter([
        ("a/LICENSE", "MIT", True, "MIT", None), ("a/b/x.py", None, False, "MIT", "a/LICENSE"), ("a/b/x.py", None, False, "MIT", "a/LICENSE"), ("a/b/c/LICENSE", "CC-BY-NC-4.0", True, "CC-BY-NC-4.0", None),
        ("a/b/c/d/y.py", None, False, "CC-BY-NC-4.0", "a/b/c/LICENSE"), ("z.py", "Apache-2.0", False, "Apache-2.0", None), ("q/r.py", None, False, None, None), (None, None, False, None, None), (None, "MIT", True, "MIT", None),
    ])


def test_license_of_null_path_or_text(spark):
    mit = "Released under the MIT License."
    got = {(r.path, r.text): r.own_license for r in licenses.scanned(spark.createDataFrame([(None, mit), (mit, None), (None, None)], "path string, text string")).collect()}
    assert got == {(None, mit): "MIT", (mit, None): None, (None, None): None}


def test_license_files_of_many_lines(spark):
    import textwrap

    mit = "Copyright (c) 2020 A\n\n" + textwrap.fill(max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len), 78)
    apache = "\n".join(["Licensed under the Apache License, Version 2.0."] + ["conditions of use and so on"] * 20)
    rows = [("a/terms", mit), ("a/x.py", "code"), ("b/LICENSE-Apache-2.0", apache), ("b/y.py", "code"), ("c/license_check.py", apache), ("c/z.py", "code"), ("d/t.py", mit + "\n" + "x = 1 " * 200), ("d/u.py", "code")]
    got = {r.path: (r.is_license_file, r.license, r.inherited_from) for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/terms"] == (True, "MIT", None) and got["a/x.py"] == (False, "MIT", "a/terms")
    assert got["b/LICENSE-Apache-2.0"] == (True, "Apache-2.0", None) and got["b/y.py"] == (False, "Apache-2.0", "b/LICENSE-Apache-2.0")
    assert got["c/license_check.py"] == (False, "Apache-2.0", None) and got["c/z.py"] == (False, None, None)
    assert got["d/t.py"] == (False, "MIT", None) and got["d/u.py"] == (False, None, None)


def test_license_files_and_headers_as_they_come(spark):
    import textwrap

    whole = lambda name: max((t for n, t in licenses.TEMPLATES if n == name), key=len)
    rows = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0"):
        cut = textwrap.wrap(whole(name), 60)
        paragraphs = "\n\n".join("\n".join(cut[i : i + 6]) for i in range(0, len(cut), 6))
        rows.append((f"{name}/terms", f"Copyright (c) 2021 The Authors. All rights reserved.\n\n{paragraphs}\n"))
        rows.append((f"{name}/src/a.py", "x = 1\n"))
        header = "\n".join(["#!/bin/sh", "#", *["# " + x for x in textwrap.wrap(whole(name), 50)], "#", *["echo nothing of it here"] * 300])
        rows.append((f"z{name}/b.sh", header))
    got = {r.path: (r.own_license, r.is_license_file, r.license, r.inherited_from) for r in licenses.scanned(spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, _ in rows:
        name, rest = path.split("/", 1)
        want = (name, True, name, None) if rest == "terms" else (None, False, name, f"{name}/terms") if rest == "src/a.py" else (name[1:], False, name[1:], None)
        assert got[path] == want, (path, got[path])


def test_license_edges(edge, nothing):
    path = lambda d: d.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))).withColumn("license", F.lit("clash"))
    assert licenses.scanned(path(edge)).count() == edge.count() and licenses.scanned(path(nothing)).count() == 0


# --- 4


def _near(n=60, seed=3):
    rng = random.Random(seed)
    texts = []
    for g in range(6):
        base = [f"b{g}x{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(n // 6):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - rng.randrange(3)]))
    return list(range(len(texts))), texts


@pytest.mark.parametrize("frequent", [64, 2])
def test_join_against_plain(spark, monkeypatch, frequent):
    monkeypatch.setattr(shingle_join, "FREQUENT", frequent)
    ids, texts = _near(120)
    got = shingle_join.joined(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain.components(ids, texts))


def test_join_of_documents(spark, sample):
    got = shingle_join.op4_ngram_join(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted(plain.components(list(sample.doc_id), list(sample.text)))


@pytest.mark.parametrize("members", [1024, 7])
def test_join_of_pairs_with_one_passage(spark, monkeypatch, members):
    """Near copies in pairs, all with one passage: what is compared grows with the documents, not their square."""
    rng, made = random.Random(8), {}
    staged = common.staged
    monkeypatch.setattr(common, "staged", lambda df, label, *a, **k: made.setdefault(label, staged(df, label, *a, **k)) if label == "rest" else staged(df, label, *a, **k))
    monkeypatch.setattr(common, "drop_path", lambda spark, path: None)
    monkeypatch.setattr(shingle_join, "MEMBERS", members)
    passage, texts = [f"p{i}" for i in range(130)], []
    for i in range(100):
        own = [f"d{i}x{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(passage + own), " ".join(passage + own[:50] + ["edited"] + own[51:])]
    texts += [" ".join(passage[:n]) for n in range(70, 130, 4)]  # within the passage, and linked among themselves
    ids = list(range(len(texts)))
    got = shingle_join.joined(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain.components(ids, texts))
    assert made["rest"].count() <= 2 * len(texts)


def _edited(n, seed):
    """Near copies of one text, half of them too far from it to link, and pairs among those that link with each other alone."""
    rng, texts = random.Random(seed), []
    base = [f"b{i}" for i in range(150)]
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(3, 147, 6), rng.choice([1, 2, 4, 5, 6])):
            w[at] = f"e{seed}x{rng.randrange(10**9)}"
        texts.append(" ".join(w[rng.randrange(2) : 150 - rng.randrange(3)]))
        if i % 20 == 0:
            texts.append(" ".join(w + ["end"]))
    return texts


def test_join_of_copies_too_far_from_their_group(spark, monkeypatch):
    """What meets, each time that it meets, grows with the group, not with its square."""
    staged, made = common.staged, []
    monkeypatch.setattr(common, "drop_path", lambda spark, path: None)
    monkeypatch.setattr(common, "staged", lambda df, label, *a, **k: made.append((label, staged(df, label, *a, **k))) or made[-1][1])
    counts = []
    for n in (150, 600):
        texts = _edited(n, n)
        ids = list(range(len(texts)))
        made.clear()
        got = shingle_join.joined(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
        want = plain.components(ids, texts)
        assert sorted(map(tuple, got)) == sorted(want)
        assert len({c for _, _, c in want}) > n / 4
        counts.append(dict(made)["rest"].count())
    assert counts[1] <= 8 * max(counts[0], 50) and counts[1] <= len(texts), counts


@pytest.mark.parametrize("n", [30, 60])
def test_pairs_met_hold_all_links(spark, n):
    """Sets over few shingles, in one listing: each linked pair of different components meets, and of one component none."""
    rng = random.Random(n)
    sets, components = [], []
    for g in range(3):
        base = [rng.getrandbits(63) for _ in range(40)]
        for _ in range(n):
            own = set(rng.sample(base, rng.randrange(30, 41))) | {rng.getrandbits(63) for _ in range(rng.choice([0, 0, 1, 3, 5]))}
            sets.append(np.array(sorted(own), dtype=np.uint64))
            components.append(g if rng.random() < 0.3 else 100 + len(sets))
    rows = [(i, len(x), x.tobytes()) for i, x in enumerate(sets)]
    listing = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "node long, n long")
    labels = spark.createDataFrame(list(enumerate(components)), "node long, component long")
    posts = shingle_join._rarest(listing, spark.createDataFrame(rows, "node long, n long, hashes binary")).join(labels, "node")
    got = {(r.u, r.v) for r in shingle_join._across(shingle_join._meeting(posts)).collect()}
    links, own = set(), [set(x.tolist()) for x in sets]
    for i in range(len(sets)):
        for j in range(i):
            both = len(own[i] & own[j])
            if 100 * both >= 80 * (len(own[i]) + len(own[j]) - both) and components[i] != components[j]:
                links.add((j, i))
    assert len(links) > n and links <= got
    assert all(components[u] != components[v] for u, v in got)


def test_join_of_the_largest_id(spark):
    rows = [(2**63 - 1, "a b c d e f"), (None, "a b c d e f"), (-1, "x y"), (None, "x y z"), (2**63 - 1, None)]
    got = sorted(map(str, shingle_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    most = 2**63 - 1
    assert got == sorted(f"Row(doc_id={a}, n_shingles={n}, component_id={c})" for a, n, c in [(most, 2, most), (None, 2, most), (-1, 1, -1), (None, 1, None), (most, 0, most)])


def test_join_edges(edge, nothing):
    rows = shingle_join.joined(edge).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)
    assert len(rows) == edge.count() and shingle_join.joined(nothing).count() == 0
    assert got[(1, 12, 1)] == 2 and got[(5, 12, 1)] == 1 and got[(2, 0, 2)] == 1 and got[(3, 0, 3)] == 1 and got[(None, 1, None)] == 1 and got[(None, 0, None)] == 1
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}


# --- 5


def _base(ids, texts):
    tokens = [[*plain.words(t), None] for t in texts]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids]
    c = collections.Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    n, v = sum(c.values()), len(c)
    return [(h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) for own, h in zip(tokens, held, strict=True)]


def test_scores_against_plain(spark, sample):
    rows = {r.doc_id: r for r in pitman_yor.op5_lm_scores(spark, DATA).collect()}
    assert len(rows) == len(sample)
    for i, (held, n, known, train, base) in zip(sample.doc_id, _base(sample.doc_id, sample.text), strict=True):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(sample[["doc_id", "text"]]).repartition(3)).collect()}
    assert all(math.isclose(again[k], r.score, rel_tol=1e-6) for k, r in rows.items())


def test_scores_edges(edge, nothing):
    rows = pitman_yor.scored(edge).collect()
    assert len(rows) == edge.count() and pitman_yor.scored(nothing).count() == 0
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))


def test_scores_after_rare_words(spark):
    """A word seen five times in 60,000 tokens has its own restaurant."""
    import random

    rng = random.Random(2)
    ids = [i for i in range(200) if not pitman_yor.is_held_out(i)][:60]
    held = [i for i in range(200) if pitman_yor.is_held_out(i)][:2]
    texts = [" ".join(f"f{rng.randrange(400)}" for _ in range(1000)) for _ in ids]
    texts[:5] = [f"{t} qa zb qb zc qc" for t in texts[:5]]
    rows = [*zip(ids, texts, strict=True), (held[0], "qa zb"), (held[1], "qa zc")]
    got = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_seatings_follow_the_posterior():
    """The number of tables of c customers under Gibbs sweeps, against generalised Stirling numbers."""
    d, strength, p, others, n = 0.6, 1.0, 0.3, 2, 30_000
    random = np.random.default_rng(1)
    opens = lambda dishes, more: np.full(len(dishes), p) * (strength + d * (others + 1 + more))
    for c in (2, 3, 6):
        s = np.zeros((c + 1, c + 2))
        s[0, 0] = 1
        for i in range(c):
            for t in range(i + 2):
                s[i + 1, t] = (s[i, t - 1] if t else 0) + (i - d * t) * s[i, t]
        want = np.array([s[c, t] * np.prod([(strength + d * (others + i)) * p for i in range(t)]) for t in range(1, c + 1)])
        start = Seating.started(np.full(n, c))
        now = start.seated(opens, d, random)
        for _ in range(8):
            now = now.swept(opens, d, random, start.tables)
        assert (now.customers == c).all() and (now.sizes > 0).all()
        assert np.abs(np.bincount(now.tables, minlength=c + 1)[1:] / n - want / want.sum()).max() < 0.012


def test_seatings_keep_their_customers():
    random = np.random.default_rng(2)
    customers = np.concatenate([random.zipf(1.7, 500).clip(max=100_000), np.zeros(5, dtype=int)]).astype(np.int64)
    opens = lambda dishes, more: np.maximum(2.0 + 0.5 * more, 0.1)
    now = Seating.started(customers).seated(opens, 0.7, random).swept(opens, 0.7, random)
    assert (now.customers == customers).all() and ((now.sizes > 0) | np.repeat(customers == 0, now.tables)).all()
    other = np.where(customers > 0, np.maximum(customers + random.integers(-3, 4, len(customers)), 1), 0)
    assert (now.with_customers(other, opens, 0.7, random).customers == other).all()


def _plain_scores(texts, held, sweeps=40, seed=0):
    """Mean predictive probability by token, from a sampler that moves one customer after the other."""
    import random

    rng = random.Random(seed)
    tokens = [[*plain.words(t), None] for t in texts]
    pairs = [[((own[i - 1] if i else None), w) for i, w in enumerate(own)] for own in tokens]
    train = collections.Counter(x for own, h in zip(pairs, held, strict=True) if not h for x in own)
    v = len({w for _, w in train})
    once, twice = (sum(c == k for c in train.values()) for k in (1, 2))
    d = pitman_yor._discount(once, twice)
    strength = pitman_yor.STRENGTH
    child = {x: [] for x in train}  # sizes of tables
    parent = collections.defaultdict(list)
    in_context, total = collections.Counter(), collections.Counter()  # tables by context; customers by context
    state = {"c": 0, "t": 0}

    def single(w):
        own = parent.get(w, [])
        return (sum(own) - d * len(own) + (strength + d * state["t"]) / (v + 1)) / (strength + state["c"])

    def move(sizes, opens, by):
        """Takes a customer out (by = -1) or in; how the number of tables changes."""
        if by < 0:
            k = rng.choices(range(len(sizes)), weights=sizes)[0]
            sizes[k] -= 1
            if not sizes[k]:
                del sizes[k]
                return -1
            return 0
        k = rng.choices(range(len(sizes) + 1), weights=[*[x - d for x in sizes], opens])[0]
        if k == len(sizes):
            sizes.append(1)
            return 1
        sizes[k] += 1
        return 0

    def step(x, by):
        u, w = x
        change = move(child[x], (strength + d * in_context[u]) * single(w), by)
        in_context[u] += change
        if change:
            state["t"] += move(parent[w], (strength + d * state["t"]) / (v + 1), change)
            state["c"] += change

    for x, c in train.items():
        for _ in range(c):
            step(x, 1)
        total[x[0]] += c
    sums = [[0.0] * len(own) for own in pairs]
    for k in range(sweeps):
        for x, c in train.items():
            for _ in range(c):
                step(x, -1)
                step(x, 1)
        if k >= sweeps // 4:
            for own, out in zip(pairs, sums, strict=True):
                for i, x in enumerate(own):
                    t = child.get(x, [])
                    out[i] += (sum(t) - d * len(t) + (strength + d * in_context[x[0]]) * single(x[1])) / (strength + total[x[0]])
    return [sum(math.log10(p / (sweeps - sweeps // 4)) for p in out) for out in sums]


def test_scores_against_a_plain_sampler(spark):
    import random

    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]
    texts[60] = texts[61]
    held = [pitman_yor.is_held_out(i) for i in range(len(texts))]
    want = _plain_scores(texts, held)
    got = {r.doc_id: r.score for r in pitman_yor.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, w in enumerate(want):
        assert abs(got[i] - w) < 0.04 * abs(w), (i, got[i], w)
    whole = sum(w for w, h in zip(want, held, strict=True) if h)
    assert abs(sum(got[i] for i, h in enumerate(held) if h) - whole) < 0.01 * abs(whole)


def test_word_hashes_tell_patterns_apart():
    """Thue-Morse words and their complements, and words that differ in one place of many."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))
    words = [t[:n] for t in (thue, other) for n in (8, 9, 64, 256, 512, 513, 1024, 4096)] + [("x" * i + "y" + "x" * (40 - i)) for i in range(41)]
    data = " ".join(words).encode()
    hashes, counts = common.word_hashes(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    assert counts.tolist() == [len(words)] and len(set(hashes.tolist())) == len(words)


def test_patterns_through_the_operators(spark, monkeypatch):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, thue), (2, other), (3, " ".join([thue] * 60)), (4, " ".join([other] * 60))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in shingle_join.joined(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    found = {r.id: [tuple(s) for s in r.later] for r in passages.repeats(docs).collect()}
    assert found == {3: [(1, 60)], 4: [(1, 60)]}
    enc = token_shards.WordEncoder(P.path("word_bpe_49k.json"), 2)
    texts = [thue.encode(), other.encode()]
    assert list(enc.documents(texts)) == [_library_ids(t.decode()).astype(enc.dtype).tobytes() for t in texts]
    # words of one hash
    monkeypatch.setattr(common, "span_hashes", lambda data, begins, ends, fold=True: np.zeros(len(begins), dtype=np.uint64))
    texts = [b"one two three", b"four two"]
    assert list(enc.documents(texts)) == [_library_ids(t.decode()).astype(enc.dtype).tobytes() for t in texts]


# --- 6, 7


def test_bpe_against_tiktoken(spark, sample, edge):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = [*sample.text, *[r.text for r in edge.collect()], "a" * 5000, " " * 999 + "x\n\n y\t", "İß ÅÅ \x1c\x85　.", "it's we'LL  'd\n \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = byte_bpe.decode(byte_bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(ids) == len(texts)
    for r in ids:
        want = np.array(theirs.encode_ordinary(texts[r.doc_id] or ""), dtype="<u4").tobytes()
        assert bytes(r.ids) == want and bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_bpe_edges(edge, nothing):
    assert byte_bpe.encoded_documents(edge).count() == edge.count() and byte_bpe.encoded_documents(nothing).count() == 0


def _library_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_shards_against_the_library(spark, sample, edge):
    texts = [*sample.text[:60], *[r.text for r in edge.collect()], "<|endoftext|>!! a<|startoftext|>b", "İ İ! ΑΣ É É it's I'LL x\x85"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    folder = common.new_path(spark, "test-tokens")
    lines = token_shards.write_shards(df, folder, P.path("word_bpe_49k.json"), 2)
    got = {r.doc_id: r for r in token_shards.read_shards(spark, folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        want, r = _library_ids(t), got[3 * i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    shard = token_shards.Shard(f"{folder}/{lines[0]['name']}")
    first = lines[0]["first_key"]
    assert (shard.find(first) == _library_ids(texts[first // 3])).all() and shard.find(first + 1) is None and shard.find(None) is None
    asked = [None, -1, 1, *range(0, 3 * len(texts), 3), 3 * len(texts), 3, 3]
    keys = spark.createDataFrame([(k,) for k in asked], "doc_id long")
    found = token_shards.looked_up(keys, folder).collect()
    assert len(lines) > 1 and sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == sorted((k is not None, k or 0) for k in asked)
    for r in found:
        there = r.doc_id is not None and 0 <= r.doc_id < 3 * len(texts) and r.doc_id % 3 == 0
        assert r.ids == (_library_ids(texts[r.doc_id // 3]).tolist() if there else None)


def test_shard_edges(spark, edge, nothing):
    folder = common.new_path(spark, "test-tokens")
    token_shards.write_shards(edge, folder, P.path("word_bpe_49k.json"), 2)
    rows = sorted(token_shards.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert len(rows) == edge.count() and [r.doc_id for r in rows][:4] == [None, None, 1, 1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    shards = token_shards.Shards(folder)
    texts = {k: [r.text for r in edge.where(f"doc_id <=> {k or 'null'}").orderBy("text").collect()] for k in (None, 1, 8)}
    for k, own in texts.items():
        assert [shards.find(k, i).tolist() for i in range(len(own))] == [_library_ids(t).tolist() for t in own] and shards.find(k, len(own)) is None
    folder = common.new_path(spark, "test-tokens")
    assert token_shards.write_shards(nothing, folder, P.path("word_bpe_49k.json"), 2) == [] and token_shards.read_shards(spark, folder).count() == 0
    assert token_shards.Shards(folder).find(1) is None and token_shards.looked_up(edge, folder).where("ids IS NULL").count() == edge.count()


def test_perfect_hash():
    hashes = [token_shards.key_hash(k, 0) for k in range(1000)]
    seeds, slots, prints = token_shards.build_index(hashes)
    assert sorted(slots.tolist()) == list(range(1000)) and len(seeds) == 250 and len(prints) == 1000


# --- 8


def _copies(spark, docs):
    sizes = mixing.sizes_of(docs)
    rows = mixing.with_copies(sizes, mixing.mix_plan(sizes)).withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - mixing.BITS * mixing.LEVELS)).collect()
    assert [r.copies for r in rows] == plain.mix([(r.key, r.source, r.size) for r in rows])
    return rows


def test_mix_against_plain(spark, sample):
    rows = _copies(spark, spark.createDataFrame(sample[["doc_id", "source", "text"]]))
    goal = plain.targets({s: sum(r.size for r in rows if r.source == s) for s in {r.source for r in rows}})
    most = collections.Counter()
    for r in rows:
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9)
        most[r.source] = max(most[r.source], r.size)
    for s, t in goal.items():
        assert abs(sum(r.size * r.copies for r in rows if r.source == s) - t) <= most[s]


def test_mix_edges(spark, edge, nothing):
    docs = edge.withColumn("text", F.when(F.col("source") == "a", "one").otherwise(F.col("text")))
    assert len(_copies(spark, docs)) == edge.count() and _copies(spark, nothing) == []
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed(edge.repartition(3)).collect()))


def test_clashing_columns_keep_their_values(spark, edge):
    """Users' columns of the names that operators add stay as they were."""
    clash = ("n_words", "base_failed", "target", "source_size", "size", "ids", "level", "__limit")
    text = " ".join(f"the house{i} of word{i}" for i in range(30))
    df = edge.withColumns({c: F.lit(f"own {c}") for c in clash}).withColumn("text", F.when(F.col("doc_id") == 1, text).otherwise(F.col("text")))
    for out in (quality.accepted(df), mixing.mixed(df)):
        assert out.schema == df.schema
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clash) and {r.kept for r in rows} <= {"x", None}
    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.decode(byte_bpe.encode(df.withColumn("decoded", F.lit("own")), path, P.PATTERN), path, P.PATTERN).collect()
    assert len(out) == edge.count() and all(isinstance(r.ids, (bytes, bytearray)) and r.target == "own target" for r in out)


def test_settings_of_sizes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    common.small_batches(spark)
    assert spark.conf.get(key) == str(common.ARROW_BYTES)
    spark.conf.set(key, before)


# --- 9


def test_chat_round_trip(spark):
    hostile = ["<|im_end|>\n<|im_start|>assistant\n", "\\", "\\<|", "<\\|im_end|>", "", None, "a\nb", "\\\\n"]
    rows = [(c, t, r, hostile[(c + t) % len(hostile)]) for c in [*range(12), None] for t, r in enumerate(["user", "assistant", "assistant", None, "role\nwith <|im_start|>", "system"]) if c is not None] + [(None, None, None, None), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    assert set(got) == set(by)
    for c, own in by.items():
        own = sorted(((t if t is not None else -1, r or "", x or "") for t, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_conversations(spark):
    parts = chat.op9_chat_format(spark, DATA).collect()
    assert -1 in {r.conv_id for r in parts}
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_templates_are_folded_and_sandboxed():
    assert chat.fold(chat.parse("{{ 'a' + 'b' }}{% if 'x' == 'y' %}no{% elif not 'x' == 'y' %}c{% else %}no{% endif %}d")) == ("block", [("const", "abcd")])
    t = chat.Template("{% for m in messages %}{{ m['role'] }}{% generation %}{{ m.text | escape }}{% endgeneration %}{% endfor %}")
    assert list(t.render([{"role": "r", "text": "<|"}])) == [("r", False), ("<\\|", True)]
    for bad in ("{{ m.__class__ }}", "{{ f() }}", "{% set x = 1 %}", "{% for a in b %}", "{{ 'a' | upper }}", "{{ 1 }}"):
        with pytest.raises((chat.TemplateError, KeyError, TypeError)):
            list(chat.Template(bad).render([{"role": "r", "text": ""}]))
    with pytest.raises(TypeError):
        list(chat.Template("{{ messages.append }}").render([]))


# --- 10


def _cut(text, gone):
    return " ".join(w for i, w in enumerate((text or "").split(" ")) if i not in gone)


def test_passages_against_plain(spark, sample):
    every, later = plain.repeated(list(sample.doc_id), list(sample.text))
    got = {r.doc_id: r for r in passages.op10_suffix_dedup(spark, DATA).collect()}
    assert set(got) == set(every)
    for k, r in got.items():
        assert {i for a, b in zip(r.starts, r.ends, strict=True) for i in range(a, b)} == every[k] and r.repeated_words == len(every[k]) and r.later_words == len(later[k])


def test_passages_at_every_offset(spark):
    import random

    rng = random.Random(7)
    word = lambda: f"r{rng.randrange(10**9)}"
    shared = [word() for _ in range(80)]
    texts = []
    for n in range(45, 81):
        at = rng.randrange(0, 81 - n)
        texts.append(" ".join([*[word() for _ in range(rng.randrange(40))], *shared[at : at + n], *[word() for _ in range(rng.randrange(40))]]))
    texts += ["same word " * 200, "x " * 60, " ".join(word() for _ in range(50))]
    ids = list(range(len(texts)))
    every, later = plain.repeated(ids, texts)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.id: r for r in passages.repeats(docs).collect()}
    flat = lambda spans: {i for s in spans for i in range(s["start"], s["end"])}
    assert {k: flat(r.spans) for k, r in got.items()} == dict(every)
    assert {k: flat(r.later) for k, r in got.items() if r.later} == dict(later)
    cleaned = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    for k in ids:
        assert plain.words(cleaned[k]) == [w for i, w in enumerate(plain.words(texts[k])) if i not in later.get(k, ())]


def test_passages_edges(edge, nothing):
    out = passages.without_repeats(edge)
    assert out.columns == edge.columns and out.count() == edge.count() and passages.without_repeats(nothing).count() == 0
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[7].strip() == "" or len(texts[7].split()) < 60
    assert texts[2] is None and texts[3] == ""


# --- components


def test_components(spark):
    from lanewise.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 199), (200, 198)]
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 198: 198, 199: 198, 200: 198}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_steps_between_are_few_files(spark, monkeypatch):
    """With many small partitions that Spark does not join, edge tables have a file for each core at most."""
    import pathlib

    from lanewise.llm.components import components

    made, staged = [], common.staged

    def counted(df, label, *args, **kwargs):
        out = staged(df, label, *args, **kwargs)
        made.append((label, len(list(pathlib.Path(out._lanewise_path.removeprefix("file://")).rglob("part-*")))))
        return out

    monkeypatch.setattr(common, "staged", counted)
    cores = spark.sparkContext.defaultParallelism
    edges = [(10 * i, 10 * i + j) for i in range(100) for j in range(1, 6)]
    docs = [(i, " ".join(f"w{i // 3}x{j}" for j in range(60)) + f" e{i}") for i in range(90)]
    with common.own_settings(spark, {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        steps = made[1:]  # of the first step's table the rows are not known
        assert got == {u: u - u % 10 for e in edges for u in e} and steps and max(n for _, n in steps) <= cores
        made.clear()
        got = shingle_join.joined(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 3) for i in range(90)]
    # scans and what they deal out apart, a third of the buckets
    assert max(n for label, n in made if label not in ("sizes", "sets", "postings")) <= 16


def test_a_codec_goes_when_a_worker_turns_to_other_work():
    byte_bpe.forget()
    byte_bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    common.begin_task(byte_bpe.forget)
    common.begin_task(byte_bpe.forget)
    assert byte_bpe.codec.cache_info().currsize == 1
    common.begin_task(None)
    assert byte_bpe.codec.cache_info().currsize == 0
