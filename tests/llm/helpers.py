"""Plain Python versions of the operators' definitions."""
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(ids, linked):
    """Smallest id reachable."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_groups(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return groups(ids, links), {i: len(s) for i, s in sets.items()}


def edits(words, rng, n, vocabulary):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at:at + 1] = [] if kind == 0 and len(out) > 1 else [rng.choice(vocabulary)] if kind == 1 else [out[at], rng.choice(vocabulary)]
    return out


def near_copies(seed=1, originals=12, copies=9, length=80):
    """Texts with chains and stars of edited copies around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(originals):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, length))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            base_or_last = rng.choice([base, rows[-1].split()])
            rows.append("  ".join(edits(base_or_last, rng, rng.randrange(4), vocabulary)))
    return list(enumerate(rows))
