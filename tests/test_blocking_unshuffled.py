"""Pairs of candidates are told where they are made: classes are shuffled, pairs are not, and blocks run in several tasks."""

from plumbline.operators import blocking


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(blocking, "ROWS", 10, raising=False)
    # names that only hold one another (park in skypark), agreeing in one, two or all three of floors, units and year
    rows = [(i, None, ["park", "skypark", "oldskypark"][i % 3], "x", i % 2, i % 4 + 50, 1990 + i // 4 % 3) for i in range(48)]
    df = spark.createDataFrame(rows, "id long, name string, canonical string, prefix string, floors int, units int, year int")
    got = blocking.candidate_pairs(blocking.classes(df))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(1 for n in got.rdd.glom().map(len).collect() if n) > 2
    first = {}
    for r in rows:
        first.setdefault(r[1:], r[0])
    want = [(first[p], first[q]) for p in first for q in first if first[p] < first[q] and (p[3] == q[3] or p[4] == q[4] or p[5] == q[5])]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)
