"""Searches that agree in name and address are scored and matched with buildings once, however many say it."""

from plumbline.operators import registry


def test_names_are_scored_once(spark, monkeypatch):
    asked = spark.createDataFrame([(k, "ハイツ", "東京都港区芝1-2", 1 + k % 9, None, None, None) for k in range(60)], "ask long, name string, address string, floors int, year int, month int, units int")
    known = spark.createDataFrame([(k, "ハイツ", f"東京都港区芝1-{k}", None, None, None, k) for k in (1, 2, 5)], "id long, name string, address string, floors int, year int, month int, units int")
    aliases = known.selectExpr("id", "name AS alias", "1 AS n")
    scored, points = [], []
    scores, compared = registry.alias_scores, registry._met
    monkeypatch.setattr(registry, "alias_scores", lambda wanted, *a: scored.append(wanted.count()) or scores(wanted, *a))
    monkeypatch.setattr(registry, "_met", lambda found, *a: points.append(found.count()) or compared(found, *a))
    got = {r["ask"]: (r["id"], r["how"]) for r in registry.staged_lookup(asked, known, aliases).collect()}
    assert len(got) == 60 and got[2] == (2, "name") and set(got.values()) == {(2, "name")}
    assert scored == [1] and points[0] == 3
