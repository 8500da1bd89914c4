"""Two addresses are compared once, however many rows have them."""

from plumbline.plans import texts


def test_addresses_are_not_compared_row_by_row(spark, tmp_path):
    spark.range(400).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = texts.similar_addresses(spark, str(tmp_path))
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["k"] for r in got.collect()) == list(range(400))
