"""Near copies around the limit: groups must be those of brute force over all pairs of whole shingle sets."""

import random

import pytest

from plumbline.llm import simhash


def shingles(text, width=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    out = []
    for size in (9, 12, 30, 100, 300):
        for k in range(30):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for _ in range(2):
                changed = list(base)
                for at in rng.sample(range(size), max(1, round(size * rng.uniform(0.018, 0.04)))):
                    changed[at] = word()
                out.append(" ".join(changed))
            # cut off at the end: the share of shingles is hit closely
            n = size - 4
            out += [" ".join(base[: 4 + round(n * s)]) for s in (0.75, 0.79, 0.8, 0.82, 0.85)[k % 5 :][:1] if round(n * s) > 0]
    hot = [word() for _ in range(200)]
    for _ in range(60):  # one group in which everything is near the limit
        changed = list(hot)
        for at in rng.sample(range(200), 5):
            changed[at] = word()
        out.append(" ".join(changed))
    passage = [word() for _ in range(60)]
    out += [" ".join([*passage, *(word() for _ in range(20))]) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def wanted(texts):
    sets, top = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    at = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= s < 0.85 for s in at) > 50 and sum(0.7 <= s < 0.8 for s in at) > 100
    for i, a in enumerate(sets):
        for k in range(i):
            if jaccard(a, sets[k]) >= 0.8:
                top[find(i)] = find(k)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("limits", [{}, {"most": 8, "most_shingles": 3000}])
def test_groups_are_those_of_all_pairs(spark, texts, wanted, limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(docs, **limits).collect()}
    groups = lambda names: sorted(tuple(i for i, n in enumerate(names) if n == g) for g in set(names))
    assert groups([got[i] for i in range(len(texts))]) == groups(wanted)
