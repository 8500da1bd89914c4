"""Groups of equal rows: no group is gathered, excluded pairs rule out their group, NULL equals NULL."""

from pyspark.sql import functions as F

from plumbline.operators import match


def test_groups_without_excluded_pairs(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", 5), (4, "a", 5), (5, "b", 5), (6, "c", 1), (7, "c", 1), (8, "c", 1), (9, None, None), (10, None, None)]
    df = spark.createDataFrame(rows, "id long, k string, v int")
    out = spark.createDataFrame([(8, 6), (1, 3), (10, 9)], "property1_id long, property2_id long")
    by = {"k": F.col("k"), "v": F.col("v")}
    take = lambda groups: {(r["k"], r["v"], r["n"], r["first_id"]) for r in groups.collect()}
    assert take(match.duplicate_groups(df, "id", by)) == {("a", None, 2, 1), ("a", 5, 2, 3), ("c", 1, 3, 6), (None, None, 2, 9)}
    assert take(match.duplicate_groups(df, "id", by, out)) == {("a", None, 2, 1), ("a", 5, 2, 3)}
    plan = match.duplicate_groups(df, "id", by, out)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
