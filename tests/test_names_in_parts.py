"""Names are compared part by part, where they are: no pair without the ratio is told or shuffled, and no exploded rows are broadcast."""

import difflib
import itertools

from plumbline import runtime
from plumbline.operators import similar


def test_only_pairs_with_the_ratio_are_told(spark, monkeypatch):
    monkeypatch.setattr(similar, "PART", 16, raising=False)
    monkeypatch.setattr(similar, "TASK", 300, raising=False)
    # the same characters in other orders: their bags say nothing
    names = ["".join(p) for p in itertools.permutations("abcde")] + ["x" * 70 + "y", "x" * 69 + "yx", "y" + "x" * 230, "x" * 230]
    df = spark.createDataFrame([("b", n) for n in names] + [(None, n) for n in names[:9]], "k string, n string")
    got = similar.close_candidates(df, df, "n", "n", 0.7, ["k"])
    want = [(a, b) for a in names for b in names if difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7]
    assert sorted((r["left"], r["right"]) for r in got.collect()) == sorted(want)
    assert sum(1 for n in got.rdd.glom().map(len).collect() if n) > 4
    pairs = similar.similar_classes(df, "n", ["k"], 0.7).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == sorted((a, b) for a, b in want if a < b)


def test_pieces_of_names_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similar, "sized", lambda df: runtime.sized(df, 10), raising=False)
    spark.createDataFrame([(f"{i:05d}",) for i in range(0, 20000, 7)], "n string").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    got = similar.contained_pairs(names.selectExpr("substr(n, 1, 4) AS n"), names, "n", "n")
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
    plain = {r["n"] for r in names.collect()}
    parts = {n[:4] for n in plain}
    assert got.count() == sum((n[:4] in parts) + (n[1:] in parts) for n in plain if n[:4] != n[1:]) + sum(1 for n in plain if n[:4] == n[1:] and n[:4] in parts)
