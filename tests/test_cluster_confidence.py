"""Confidence of clusters: size steps, no cap, and the attribute bonus of the member that agrees most with its primary."""

import pytest

from plumbline.operators import cluster


def test_steps_bonus_and_no_cap(spark):
    members = [(c * 10 + k, c) for c, n in ((1, 2), (2, 3), (3, 4), (4, 5), (5, 9)) for k in range(n)]
    pairs = [(c * 10, c * 10 + k, 1.0) for c, n in ((1, 2), (2, 3), (3, 4), (4, 5), (5, 9)) for k in range(1, n)]
    m = spark.createDataFrame(members, "node long, cluster long")
    p = spark.createDataFrame(pairs, "a long, b long, similarity double")
    plain = {r["cluster"]: r["confidence"] for r in cluster.cluster_confidence(m, p).collect()}
    assert plain == pytest.approx({1: 1.3, 2: 1.25, 3: 1.2, 4: 1.1, 5: 1.1})
    rows = [(10, "港区芝1-2", 9, 40, 2000), (11, "港区芝3", 9, 40, 2001), (20, "", 0, None, 2000), (21, "", 0, None, 2002), (22, "x", 5, None, None), (30, None, 7, 30, None), (31, None, 7, 30, 1990), (40, "a", 1, 1, 1990), (41, "a", 1, 2, 1990), (50, None, 3, None, None), (58, None, 3, None, None)]
    lead = spark.createDataFrame([(c, c * 10) for c in range(1, 6)], "cluster long, primary long")
    attributes = spark.createDataFrame(rows, "node long, address string, floors int, units int, year int")
    got = {r["cluster"]: r["confidence"] for r in cluster.cluster_confidence(m, p, lead, attributes).collect()}
    assert got == pytest.approx({1: 1.8, 2: 1.25, 3: 1.35, 4: 1.4, 5: 1.15})
