"""Tenures are voted on in one pass: adverts are read and counted once, and nothing is joined back."""

from pyspark.sql import functions as F

from plumbline.operators import vote


def test_adverts_are_read_once(spark):
    lease = "一般定期借地権、借地期間残存20年、登記不可"
    rows = [(1, "所有権", "s1"), (1, "所有権", "s9"), (1, lease, "s1"), (2, lease, "s2"), (2, lease, "s9"), (2, "一般定期借地権、借地期間残存35年", "s1"), (3, "旧法借地権", "s3"), (3, "旧法借地権（地主承諾）", "s1"), (4, None, "s1"), (4, "", "s1"), (None, lease, "s1"), (None, lease, "s2")]
    df = spark.createDataFrame(rows, "k long, t string, s string").withColumn("listed", F.lit("2001-03-01").cast("date"))
    got = vote.tenure(df, "k", "t", "s", "listed", F.lit("2001-06-15").cast("date"), ["s1", "s2", "s3"])
    assert {r["k"]: r["tenure"] for r in got.collect()} == {1: "所有権", 2: "一般定期借地権、借地期間残存19年8ヶ月、登記不可", 3: "旧法借地権（地主承諾）"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
