"""Texts are read out in tasks of a bounded number of rows, also where the table is one small file."""

from plumbline.plans import base


def test_keys_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(base, "ROWS", 100)
    spark.range(1000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = base.keys(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 10 and max(got.rdd.glom().map(len).collect()) <= 200
    assert sorted(tuple(r) for r in got.collect()) == [(k, k % 50) for k in range(1000)]


def test_similar_addresses_run_in_several_tasks(spark, tmp_path, monkeypatch):
    from plumbline.plans import texts

    monkeypatch.setattr(base, "ROWS", 100)
    spark.range(400).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = texts.similar_addresses(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 400
    assert {r["k"] % 4: r["similarity"] for r in got.collect()} == {0: 1.0, 1: 0.866667, 2: 0.866667, 3: 0.555556}
