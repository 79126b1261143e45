"""Inputs and brute-force results shared by the tests of the curation operators."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def prose(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1):
    """Unrelated texts, exact and near copies, a large family, a frequent line, and a shared passage inside lines."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice((60, 120, 300))) for _ in range(60)]
    line, passage = prose(rng, 14), prose(rng, 55)
    texts += [texts[3]] * 5
    texts += [edited(rng, texts[k % 20], 0.02) for k in range(30)]
    texts += [edited(rng, texts[0], 0.03) for _ in range(40)]
    texts += [f"{prose(rng, 40)}\n{line}\n{prose(rng, 40)}" for _ in range(30)]
    texts += [f"{prose(rng, 33)} {passage} {prose(rng, 21)}" for _ in range(8)]
    texts += ["", None, "  \n\t", "one", "One two", "one two", "a b c d e f " * 400, prose(rng, 20_000)]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def shingle_sets(docs):
    out = {}
    for k, t in docs:
        w = words(t)
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def components(docs, percent=75):
    sets = shingle_sets(docs)
    holders, parent = defaultdict(list), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(j), find(k)))
                parent[b] = a
        for g in s:
            holders[g].append(k)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def later_holders(docs, run=50):
    """Documents that share a run of so many words with an earlier one."""
    seen = defaultdict(set)
    for k, t in docs:
        w = words(t)
        for i in range(len(w) - run + 1):
            seen[tuple(w[i : i + run])].add(k)
    return set().union(*[v - {min(v)} for v in seen.values() if len(v) > 1])
