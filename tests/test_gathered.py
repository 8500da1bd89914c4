"""Clusters by marks: the same as one pair after the other gives, without the pairs."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster, gathered
from plumbline.plans import catalog


def test_as_by_pairs(spark):
    pick = random.Random(5)
    like = {("ab", "ac"): 0.8, ("ac", "ab"): 0.7, ("ac", "ad"): 0.7, ("ad", "ac"): 0.7, **{(k, k): 1.0 for k in ("ab", "ac", "ad", "z")}}
    rows = [(f"b{k % 2}", pick.choice([1, 2, 3, 6, 20, 22, 90]), pick.choice(["ab", "ac", "ad", "z"]), k * 3 + pick.randrange(3)) for k in range(160)]
    r = spark.createDataFrame(rows, "block string, at int, kind string, node long")
    near = spark.createDataFrame([(b, x, y, s) for b in ("b0", "b1") for (x, y), s in like.items()], "block string, x string, y string, similarity double")
    assert gathered.fits(r, near) and not gathered.fits(r, near, most=10) and not gathered.fits(r.union(r.limit(1)), near) and not gathered.fits(r, near.where("x <= y"))
    pairs = spark.createDataFrame([(a[3], b[3], like[a[2], b[2]]) for a in rows for b in rows if a[0] == b[0] and a[3] < b[3] and abs(a[1] - b[1]) <= 3 and (a[2], b[2]) in like], "a long, b long, similarity double")
    apart = pairs.where("(a + b) % 5 = 0").select("a", "b")
    members = cluster.clusters(pairs.where("(a + b) % 5 <> 0"), apart)
    scores = {x["cluster"]: (x["mean"], x["max"]) for x in cluster.cluster_confidence(members, pairs).collect()}
    got = gathered.clusters_by_marks(r, near, 3, 5).collect()
    assert {(x["node"], x["cluster"]) for x in got} == {tuple(x) for x in members.select("node", "cluster").collect()}
    for x in got:
        assert (x["cluster_mean"], x["cluster_max"]) == pytest.approx(scores[x["cluster"]]) if x["cluster"] in scores else x["cluster_mean"] is None
    lead = {x["cluster"]: x["primary"] for x in cluster.primaries(members, pairs.withColumn("similarity", F.col("similarity").cast("decimal(9,6)"))).collect()}
    assert lead == {c: max((x for x in got if x["cluster"] == c), key=lambda x: (round(x["mean"] or 0, 9), -x["node"]))["node"] for c in lead}


def test_query_makes_no_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "scored_names", None)
    spark.createDataFrame([(k, "x", "red rod", 1) for k in range(1, 40)], "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.duplicate_clusters(spark, str(tmp_path)).collect()
    assert len(got) == 39 and all((a["node"] + b["node"]) % 11 for a in got for b in got if a["cluster"] == b["cluster"] and a["node"] < b["node"])
