"""Merges and reverts in any order, against tables that are changed event by event."""

import random

import pytest

from plumbline.operators import undo


def frames(spark, units, merges, unit_merges, reverts):
    e = "event long, source long, target long"
    return spark.createDataFrame(units, "unit long, building long"), spark.createDataFrame(merges, e), spark.createDataFrame(unit_merges, e), spark.createDataFrame([(r,) for r in reverts], "event long")


def test_the_scenario_of_a_merged_building_and_a_merged_unit(spark):
    """A = 100 has 1, 2, 3; B = 200 has 4, 5, 6. B goes into A, unit 4 into 1; then the building merge is taken back."""
    units = [(u, 100 if u < 4 else 200) for u in range(1, 7)]
    u, b, m, r = frames(spark, units, [(1, 200, 100)], [(2, 4, 1)], [])
    moved, warned = undo.taken_back(u, b, m, r, 1)
    assert {tuple(x) for x in moved.collect()} == {(5, 100, 200), (6, 100, 200)}
    assert [x["unit"] for x in warned.collect()] == [4]
    favourites, lists, apart = spark.createDataFrame([("x", 1, 5), ("x", 4, 3), ("y", 4, 1)], "user string, unit long, since int"), spark.createDataFrame([(1, [6, 4, 1]), (2, []), (3, None)], "list int, ids array<long>"), spark.createDataFrame([(100, 200), (300, 200)], "first long, second long")
    told = lambda reverts: {k: sorted(map(tuple, v.collect()), key=str) for k, v in undo.replay(u, favourites, lists, apart, b, m, frames(spark, units, [], [], reverts)[3]).items()}
    assert told([]) == {"units": [(1, 100), (2, 100), (3, 100), (5, 100), (6, 100)], "favourites": [("x", 1, 3), ("y", 1, 1)], "lists": [(1, [1, 6]), (2, []), (3, None)], "exclusions": [(100, 300)]}
    assert told([1])["units"] == [(1, 100), (2, 100), (3, 100), (5, 200), (6, 200)] and told([1])["exclusions"] == [(100, 200), (200, 300)]
    assert told([2, 1])["units"] == [(u, b) for u, b in units] and told([2, 99])["favourites"] == [("x", 1, 5), ("x", 4, 3), ("y", 4, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_nested_merges_and_reverts(spark, seed):
    rng = random.Random(seed)
    units = [(u, 1000 + rng.randint(0, 30)) for u in range(120)]
    left, merges = list(range(1000, 1031)), []
    while len(left) > 6:
        a, b = rng.sample(left, 2)
        left.remove(a)
        merges.append((len(merges), a, b))
    reverts = rng.sample(range(len(merges)), 9)
    stands = [m for m in merges if m[0] not in reverts]

    def end(b):
        while True:
            nxt = next((t for _, s, t in stands if s == b), None)
            if nxt is None:
                return b
            b = nxt

    u, b, m, r = frames(spark, units, merges, [(500, 3, 4), (501, 4, 5)], reverts)
    final = undo.final_ids(undo.standing(b, r))
    got = undo.units_after(u, final, undo.final_ids(undo.standing(m, r))).collect()
    assert sorted(map(tuple, got)) == sorted((k, end(x)) for k, x in units if k not in (3, 4))
    want = {}  # the way of every unit
    for k, x in units:
        while (step := next(((e, s, t) for e, s, t in stands if s == x), None)) is not None:
            want[step[0], k] = (step[1], step[2])
            x = step[2]
    inverse = {(q["event"], q["unit"]): (q["before"], q["after"]) for q in undo.inverse(u, "unit", "building", undo.standing(b, r)).collect()}
    assert inverse == want


def test_rings_and_nothing(spark):
    u, b, m, r = frames(spark, [(1, 10), (2, 11), (3, 12)], [(1, 10, 11), (2, 11, 10), (3, 12, 10), (4, 12, 12)], [], [])
    assert sorted(map(tuple, undo.units_after(u, undo.final_ids(undo.standing(b, r)), undo.final_ids(undo.standing(m, r))).collect())) == [(1, 10), (2, 11), (3, 12)]
    assert undo.inverse(u, "unit", "building", undo.standing(b, r)).count() == 0
    assert undo.inverse(u.limit(0), "unit", "building", undo.standing(b, r)).count() == 0
