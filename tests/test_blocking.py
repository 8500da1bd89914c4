"""Candidates of all rules against a comparison of all with all."""

import random

import pytest

from plumbline.operators import blocking

SCHEMA = "id long, name string, canonical string, prefix string, floors int, units int, year int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    stems = ["park", "parkhouse", "sky tower", "sky tower east", "tower", "白金ザスカイ", "白金ザスカイ東棟", "ab", "b", "", None]
    one = lambda i: (i, rng.choice([None, f"n{rng.randint(0, 60)}"]), rng.choice(stems) if rng.random() < 0.5 else f"{rng.choice(stems)}{rng.randint(0, 40)}", rng.choice([None, "x", "y", "z1", "z2"]), rng.choice([None, *range(1, 9)]), rng.choice([None, *range(1, 30)]), rng.choice([None, *range(1990, 2010)]))
    out = [one(i) for i in range(260)]
    return out + [(1000 + i, *out[i][1:]) for i in range(20)]


def match(a, b):
    return bool(a) and bool(b) and (a in b or b in a or (len(a) >= 5 and len(b) >= 5 and a[:5] == b[:5]))


def eq(a, b):
    return a is not None and a == b


def test_pairs_of_classes_are_those_of_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = blocking.classes(df)
    got = [(r["a"], r["b"]) for r in blocking.candidate_pairs(found).collect()]
    first = {}
    for r in rows:
        first[r[1:]] = min(first.get(r[1:], r[0]), r[0])

    def met(p, q):
        near = p[5] is not None and q[5] is not None and abs(p[5] - q[5]) <= 1
        place = (eq(p[3], q[3]) and eq(p[4], q[4]) and near) or (eq(p[3], q[3]) and eq(p[5], q[5])) or (match(p[1], q[1]) and (eq(p[3], q[3]) or eq(p[4], q[4]) or eq(p[5], q[5])))
        return eq(p[0], q[0]) or (p[2] == q[2] and place)

    assert sorted(got) == sorted((first[p], first[q]) for p in first for q in first if first[p] < first[q] and met(p, q))
    assert {(r["id"], r["class"]) for r in blocking.members(df, found).collect()} == {(r[0], first[r[1:]]) for r in rows}


def plain_ids(rows):
    out = {}
    put = lambda r, rule: out.setdefault(r[0], set()).add(rule)
    groups = {}
    for r in rows:
        if r[4] is not None and r[5] is not None:
            groups.setdefault((r[3], r[4], r[5]), []).append(r)
    for g in groups.values():
        years = [r[6] for r in g]
        if len(g) > 1 and None not in years and any(abs(x - y) <= 1 for i, x in enumerate(years) for y in years[:i]):
            for r in g:
                put(r, "floors_units")
    for i, p in enumerate(rows):
        for q in rows[:i]:
            rules = ["name"] if eq(p[1], q[1]) else []
            if p[3] == q[3]:
                rules += ["floors_year"] if eq(p[4], q[4]) and eq(p[6], q[6]) else []
                rules += [f"{n}_matching" for n, k in (("floors", 4), ("units", 5), ("year", 6)) if eq(p[k], q[k]) and match(p[2], q[2])]
            for rule in rules:
                put(p, rule)
                put(q, rule)
    return {k: sorted(v) for k, v in out.items()}


def test_ids_are_those_of_the_rules(spark, rows):
    got = blocking.candidate_ids(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["id"]: list(r["rules"]) for r in got} == plain_ids(rows) and len(got) == len({r["id"] for r in got})


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert blocking.candidate_ids(none).count() == 0 and blocking.candidate_pairs(blocking.classes(none)).count() == 0
