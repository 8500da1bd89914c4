"""Buildings found in stages or made, against one advert after the other."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import registry
from test_similar import plain_scores

FACTS = "floors int, year int, month int, units int"


def points(a, b):
    """For addresses of a ward, an area and at most two numbers."""
    if not a or not b:
        return 0
    if a == b:
        return 100
    (wa, na), (wb, nb) = (x.split("芝") for x in (a, b))
    if wa != wb:
        return 0
    if not na or not nb:
        return 80 if na or nb else 70
    x, y = (n.split("-") + [None] for n in (na, nb))
    return 100 if na == nb else 80 if x[0] != y[0] else 100 if x[1] == y[1] else 90


def strict(a, b):
    return all(x is None or y is None or x == y for x, y in zip(a, b, strict=True))


def fair(a, b):
    (f, y, m, u), (g, z, n, v) = a, b
    said = 0
    if f is not None and g is not None:
        if f != g:
            return False
        said += 1
    floors, date, late, more = said == 1, False, False, False
    if y is not None and z is not None:
        if y != z:
            return False
        late = m is not None and n is not None and m != n
        date = not late
        said += date
    units = u is not None and v is not None and u == v
    more = u is not None and v is not None and u != v
    said += units
    if said < 2 or not (late or more):
        return True
    return (floors and units and late and abs(m - n) <= 1) or ((floors or date) and more and abs(u - v) <= 2)


def lookup(name, address, facts, buildings, aliases):
    if not name or not address:
        return None
    known = [b for b in buildings if b[1] and b[2]]
    here = [b for b in known if b[2] == address and (b[1].startswith(name) or name.startswith(b[1]))]
    unsure = len(here) >= 2
    table = plain_scores([(0, name)], aliases)
    if unsure:
        table = ambiguous_scores(name, aliases)

    def best(rows, hold):
        rows = sorted(((0.4 * points(address, b[2]) + (30 if strict(facts, b[3:]) else 21 if fair(facts, b[3:]) else 0) + 0.3 * table.get((0, b[0]), 0), b[0]) for b in rows), key=lambda r: (-r[0], r[1]))
        return rows and not (hold and unsure and len(rows) > 1 and rows[0][0] - rows[1][0] < 5) and rows[0][1]

    ok = lambda b: fair(facts, b[3:])
    if hit := best([b for b in known if b[1] == name and points(address, b[2]) >= 40 and ok(b)], False):
        return hit, "name"
    ids = {i for i, n, _ in aliases if n == name} | ({b[0] for b in here} if unsure else set())
    if hit := best([b for b in known if b[0] in ids and (b[2].startswith(address) or address.startswith(b[2])) and (ok(b) or strict(facts, b[3:]))], True):
        return hit, "alias"
    if hit := best([b for b in known if (b[1] in name or name in b[1]) and (b[2] in address or address in b[2]) and points(address, b[2]) >= 40], True):
        return hit, "partial"
    return None


def ambiguous_scores(name, aliases):
    plain = plain_scores([(0, name)], [(i, n, c) for i, n, c in aliases if n != name] or [])
    own, every = {}, {}
    for i, n, c in aliases:
        own[i], every[n] = own.get(i, 0) + c, every.get(n, 0) + c
    out = {}
    for i, n, c in aliases:
        part = plain_scores([(0, name)], [(i, n, c)])
        if part:
            text = 95 if n == name else (next(iter(part.values())))  # with one alias alone the factor is 1
            out[0, i] = max(out.get((0, i), 0), text * (c / own[i] + c / every[n]) / 2)
    return out if out or not plain else out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    stems = ["park", "parkhouse", "park house east", "sky", "skytower", "tower", "白金", "白金ザスカイ"]
    place = lambda: rng.choice([None, "", *(f"東京都{w}芝{n}" for w in ("港区", "中央区") for n in ("", "1", "2", "1-1", "1-2", "2-1"))])
    facts = lambda: (rng.choice([None, 5, 6]), rng.choice([None, 1990, 1990, 1991]), rng.choice([None, 1, 2, 4]), rng.choice([None, 20, 21, 30]))
    buildings = [(i, rng.choice([*stems, None]), place(), *facts()) for i in range(1, 60)]
    aliases = list({(i, rng.choice(stems)): (i, rng.choice(stems), rng.randint(1, 5)) for i in range(1, 50) for _ in range(2)}.values())
    aliases = list({(i, n): (i, n, c) for i, n, c in aliases}.values())
    adverts = [(k, rng.choice(["a", "b"]), rng.choice([None, None, f"e{rng.randint(0, 60)}"]), rng.choice([*stems, "park", "sky", "unknown", None]), place(), *facts()) for k in range(300)]
    external = [("a", f"e{k}", rng.choice([1, 5, 9, 777])) for k in range(15)]
    return buildings, aliases, adverts, external


@pytest.fixture(scope="module")
def frames(spark, data):
    make = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    return (
        make(data[2], f"key long, site string, external_id string, name string, address string, {FACTS}"), make(data[0], f"id long, name string, address string, {FACTS}"),
        make(data[3], "site string, external_id string, id long"), make(data[1], "id long, alias string, n long"),
    )


def test_points(spark):
    places = [f"東京都{w}芝{n}" for w in ("港区", "中央区") for n in ("", "1", "2", "1-1", "1-2", "2-1")] + ["", None]
    pairs = spark.createDataFrame([(a, b) for a in places for b in places], "a string, b string").select("a", "b", registry.address_points(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r["a"], r["b"], r["p"]) for r in pairs if r["p"] != points(r["a"], r["b"])] == []


def test_adverts_are_found_as_one_after_the_other(data, frames):
    buildings, aliases, adverts, external = data
    assigned, grown, entries = registry.find_or_create(*frames)
    got = {r["key"]: (r["id"], r["how"]) for r in assigned.collect()}
    live = {(s, e): i for s, e, i in external if i < 60}
    assert set(got) == {a[0] for a in adverts if a[3]}
    new, led = {}, {}
    for key, site, ext, name, address, *facts in adverts:
        if not name:
            continue
        if ext and (site, ext) in live:
            assert got[key] == (live[site, ext], "external")
            continue
        if ext and (site, ext) in led:
            assert got[key] == (led[site, ext], "external")
            continue
        if not ext and (site, name, address, *facts) in led:
            assert got[key] == (led[site, name, address, *facts], "external")
            continue
        led[(site, ext) if ext else (site, name, address, *facts)] = got[key][0]
        hit = lookup(name, address, facts, buildings, aliases)
        if hit:
            assert got[key] == hit, (key, name, address, facts)
        else:
            assert got[key][1] == "new"
            new.setdefault((name, address or ""), set()).add(got[key][0])
    assert sorted(i for ids in new.values() for i in ids) == list(range(60, 60 + len(new)))
    rows = {r["id"]: r for r in grown.collect()}
    assert all(rows[i]["name"] == name and address in ("", rows[i]["address"]) for (name, address), (i,) in new.items())
    assert len(rows) == len(buildings) + len(new) and all(rows[b[0]]["name"] == b[1] for b in buildings)
    known = {b[0]: b for b in buildings}
    for r in rows.values():
        if r["id"] in known:
            assert all(old is None or r[c] == old for c, old in zip(["floors", "year", "month", "units"], known[r["id"]][3:], strict=True))
    assert len({(r["site"], r["external_id"]) for r in entries.collect()}) == entries.count()


def test_a_second_run_finds_everything_and_adds_nothing(frames):
    adverts, buildings, external, aliases = frames
    one, grown, entries = registry.find_or_create(adverts, buildings, external, aliases)
    two, grown2, entries2 = registry.find_or_create(adverts.repartition(5), grown, entries, aliases)
    assert {(r["key"], r["id"]) for r in one.collect()} == {(r["key"], r["id"]) for r in two.collect()}
    assert {r["how"] for r in two.collect()} == {"external"}
    assert sorted(map(str, grown.collect())) == sorted(map(str, grown2.collect())) and entries.count() == entries2.count()


def test_nothing(frames):
    adverts, buildings, external, aliases = (f.limit(0) for f in frames)
    assert [f.count() for f in registry.find_or_create(adverts, buildings, external, aliases)] == [0, 0, 0]
    assert [f.count() for f in registry.find_or_create(frames[0], buildings, external, aliases)][0] > 0


def test_values_that_were_often_said_are_tolerated(spark):
    facts = lambda *v: {k: F.lit(x).cast("int") for k, x in zip(registry.FACTS, v, strict=True)}
    row = spark.range(1).select(
        registry.tolerably_agree(facts(5, 1990, 1, 20), facts(5, 1980, 1, 20), F.lit(False), F.lit(False)), registry.tolerably_agree(facts(5, 1990, 1, 20), facts(5, 1980, 1, 20), F.lit(True), F.lit(False)),
        registry.tolerably_agree(facts(5, 1990, 1, 20), facts(5, 1990, 1, 99), F.lit(False), F.lit(False)), registry.tolerably_agree(facts(5, 1990, 1, 20), facts(5, 1990, 1, 99), F.lit(False), F.lit(True)),
    ).first()
    assert list(row) == [False, True, False, True]
