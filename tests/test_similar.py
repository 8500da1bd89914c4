"""Joins of similar names against a comparison of all with all."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import match, similar


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.fixture(scope="module")
def names():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    out = [word("abcde ", 14) for _ in range(150)] + [word("ハイツ渋谷新宿パーク", 9) for _ in range(60)]
    out += ["ハイツ渋谷", "グランハイツ渋谷", "parkhouse", "xarkhouse", "park  house", "park house", "park          house", "a", "aa", "aaa", "a" * 40, "", " ", None, "parkhouse", "x\ty", "x y"]
    return out


def test_contained_names(spark, names):
    one, two = names[::2], names[1::2]
    got = similar.contained_pairs(spark.createDataFrame([(n,) for n in one], "x string"), spark.createDataFrame([(n,) for n in two], "y string"), "x", "y").collect()
    assert sorted((r["inner"], r["outer"]) for r in got) == sorted({(a, b) for a in one for b in two if a and b and a in b})


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 1.0])
def test_close_names(spark, names, least):
    df = spark.createDataFrame([(n,) for n in names], "n string").repartition(3)
    got = similar.close_pairs(df, df, "n", "n", least).collect()
    plain = {n for n in names if n}
    assert sorted((r["left"], r["right"]) for r in got) == sorted((a, b) for a in plain for b in plain if ratio(a, b) >= least)
    if least >= 0.6:
        assert similar.close_candidates(df, df, "n", "n", least).count() < 0.5 * len(plain) ** 2


def plain_scores(wanted, aliases):
    own, every, count = {}, {}, {}
    for o, n, c in aliases:
        if n:
            own[o], every[n], count[o, n] = own.get(o, 0) + c, every.get(n, 0) + c, count.get((o, n), 0) + c
    out = {}
    for k, q in wanted:
        for (o, n), c in count.items():
            if not q:
                continue
            r = min(len(q), len(n)) / max(len(q), len(n))
            close = ratio(q, n)
            text = 100 if q == n else 80 + 15 * r if q.startswith(n) or n.startswith(q) else 50 + 25 * r if q in n or n in q else 60 * close if close >= 0.6 else None
            if text is not None:
                factor = (c / own[o] + c / every[n]) / 2
                out[k, o] = max(out.get((k, o), 0), 50 + 50 * factor if q == n else text * factor)
    return out


def test_alias_scores_are_those_of_all_pairs(spark, names):
    rng = random.Random(1)
    aliases = [(rng.randint(1, 12), n, rng.randint(1, 9)) for n in names for _ in range(2)]
    wanted = [(i, n) for i, n in enumerate(names[::3] + ["ハイツ渋谷", "parkhouse"])]
    got = similar.alias_scores(spark.createDataFrame(wanted, "q int, n string"), spark.createDataFrame(aliases, "building_id int, canonical_name string, occurrence_count int"), "q", "n").collect()
    want = plain_scores(wanted, aliases)
    assert {(r["q"], r["building_id"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["score"] - want[r["q"], r["building_id"]]) < 1e-9 for r in got)


def test_names_contained_further_on_and_with_another_beginning_are_found(spark):
    aliases = spark.createDataFrame([(1, "グランハイツ渋谷", 1), (2, "xarkhouse", 1)], "building_id long, canonical_name string, occurrence_count long")
    wanted = spark.createDataFrame([("a", "ハイツ渋谷"), ("b", "parkhouse")], "q string, n string")
    assert {(r["q"], r["building_id"]) for r in similar.alias_scores(wanted, aliases, "q", "n").collect()} == {("a", 1), ("b", 2)}


def test_similar_classes_of_blocks(spark, names):
    rows = [(i % 3 if i % 10 else None, n) for i, n in enumerate(names * 2)]
    got = similar.similar_classes(spark.createDataFrame(rows, "b int, n string"), "n", ["b"]).collect()
    inside = {b: sorted({n for c, n in rows if c == b and n}) for b in range(3)}
    pairs = [(b, x, y) for b, ns in inside.items() for x in ns for y in ns if x < y]
    told = spark.createDataFrame(pairs, "b int, x string, y string").select("*", match.name_similarity(F.col("x"), F.col("y")).alias("s")).where("s >= 0.6").collect()
    assert sorted((r["b"], r["a"], r["b_"], r["similarity"]) for r in [{**r.asDict(), "b_": r[2], "b": r[0]} for r in got]) == sorted(tuple(r) for r in told)


def plain_seeds(rows, least):
    seeds, out = {}, []
    for b, k, n in sorted(rows, key=lambda r: r[1]):
        hit = next((s for s, t in seeds.get(b, []) if t == (n or "") or ratio(n or "", t) >= least), None)
        if hit is None:
            seeds.setdefault(b, []).append((k, n or ""))
        out.append((k, k if hit is None else hit))
    return sorted(out)


def test_seeds_are_those_of_one_row_after_the_other(spark, names):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "x", "y", None]), k, rng.choice(names)) for k in range(500)]
    df = spark.createDataFrame(rows, "b string, k long, n string").repartition(4)
    got = sorted((r["key"], r["seed"]) for r in similar.group_by_seed(df, "b", "k", "n", 0.6).collect())
    assert got == plain_seeds(rows, 0.6)


def test_nothing_and_chains(spark):
    none = spark.createDataFrame([], "b string, k long, n string")
    assert similar.group_by_seed(none, "b", "k", "n", 0.6).count() == 0
    assert similar.similar_classes(none, "n", ["b"]).count() == 0
    assert similar.alias_scores(none, none.withColumn("c", F.lit(1)), "k", "n", "n", "c", "b").count() == 0
    chain = [("z", k, "abcdefghijklmnopqrstuvwxyz"[k : k + 8]) for k in range(12)]
    got = sorted((r["key"], r["seed"]) for r in similar.group_by_seed(spark.createDataFrame(chain, "b string, k long, n string"), "b", "k", "n", 0.8).collect())
    assert got == plain_seeds(chain, 0.8)
