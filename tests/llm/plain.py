"""Plain versions of the operators, for small tables."""

import collections

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, fold=True):
    data = (text or "").encode()
    return (data.translate(FOLD) if fold else data).split()


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, texts):
    """doc_id -> (set size, least doc_id of its component)."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(sets)):
        least[top(i)] = min(least.get(top(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least[top(i)]) for i in range(len(sets))]


def repeated(ids, texts, length=50):
    """doc_id -> words in repeated windows, and in windows with an earlier occurrence; ids ascending."""
    places = collections.defaultdict(list)
    for k, t in zip(ids, texts, strict=True):
        w = words(t, fold=False)
        for i in range(len(w) - length + 1):
            places[tuple(w[i : i + length])].append((k, i))
    every, later = collections.defaultdict(set), collections.defaultdict(set)
    for own in places.values():
        if len(own) > 1:
            for n, (k, i) in enumerate(own):
                every[k].update(range(i, i + length))
                if n:
                    later[k].update(range(i, i + length))
    return every, later


def targets(sizes):
    """source -> target, by sharing again what is above three times a source's size."""
    total = sum(sizes.values())
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    capped, left, budget = {}, set(sizes), total
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 3 * sizes[s]
            left.discard(s)
            budget -= capped[s]
    return capped


def mix(rows):
    """rows of (key, source, size) -> copies of each, by thresholds over the 40-bit key."""
    sizes = collections.Counter()
    for _, source, size in rows:
        sizes[source] += size
    goal, limit, whole = targets(dict(sizes)), {}, {}
    for s, n in sizes.items():
        whole[s] = int(goal[s] / n) if n else 0
        budget, below, limit[s] = goal[s] - whole[s] * n, 0, 0
        by = collections.Counter()
        for key, source, size in rows:
            if source == s:
                by[key] += size
        if budget > 0:
            for key in sorted(by):
                if below + by[key] > budget:
                    limit[s] = key + (by[key] < 2 * (budget - below))
                    break
                below += by[key]
    return [min(3, whole[s] + (key < limit[s])) for key, s, _ in rows]
