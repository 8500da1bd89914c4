"""Fallback matches by places against a comparison of all adverts with all listings."""

import random

from plumbline.operators import match

SCHEMA = "advert_id long, unit_id long, building_id long, address string, total_floors int, built_year int, floor int, area double, price long"


def test_places_give_what_all_pairs_give(spark, monkeypatch):
    monkeypatch.setattr(match, "DEALT", 10, raising=False)
    rng = random.Random(5)
    address = lambda: rng.choice([None, "", "港区芝", "港区芝浦", "港区芝浦1", "港区芝浦1-2", "港区海岸"])
    one = lambda i: (i, rng.choice([None, *range(3)]), rng.choice([None, 1, 2, 3, 4]), address(), rng.choice([None, 0, 9]), 1990, rng.choice([1, 2]), rng.choice([50.5, 51.0]), 30)
    # adverts 0 to 9 are there twice
    rows = [one(i) for i in range(300)] + [one(i) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = match.fallback_match(df, df.where("advert_id % 2 = 0"), "advert_id")
    assert got.rdd.getNumPartitions() > 4
    want = {}
    for w in rows:
        if not w[3] or w[2] is None or not w[4]:
            continue
        # as in the SQL, a missing unit comes last
        hits = [(p[2], p[1] is None, p[1]) for p in rows if p[0] % 2 == 0 and p[2] is not None and p[2] != w[2] and p[4:] == w[4:] and p[3] is not None and p[3].startswith(w[3])]
        if hits:
            want[w[0]] = min([*hits, *([want[w[0]]] if w[0] in want else [])])
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(want) and {r[0]: r[1:] for r in out} == {k: (b, u) for k, (b, _, u) in want.items()}
