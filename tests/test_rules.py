"""Rules of matching, clustering in rounds, rings of merges: small cases against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster, lineage, match, timeline


def greedy(pairs, apart):
    """One pair after the other, the most similar first."""
    group = {n: {n} for a, b, _ in pairs for n in (a, b)}
    for a, b, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1]), reverse=True):
        x, y = group[a], group[b]
        if x is y or any((min(i, j), max(i, j)) in apart for i in x for j in y):
            continue
        x |= y
        for n in y:
            group[n] = x
    return {n: min(g) for n, g in group.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_in_rounds_are_those_of_one_pair_after_the_other(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b): rng.randint(50, 99) / 100 for a, b in (sorted(rng.sample(range(24), 2)) for _ in range(40))}
    rows = [(a, b, s) for (a, b), s in pairs.items()]
    apart = {tuple(sorted(rng.sample(range(24), 2))) for _ in range(14)}
    df = spark.createDataFrame(rows, "a long, b long, similarity double")
    kept = spark.createDataFrame(sorted(apart), "a long, b long")
    for most in (0, cluster.MOST_PAIRS):
        assert {r["node"]: r["cluster"] for r in cluster.clusters(df, kept, most).collect()} == greedy(rows, apart)


def test_merges_in_a_ring_have_no_end(spark):
    merges = [(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (7, 5), (8, 5), (9, 9)]
    got = {r["s"]: (r["direct"], r["final"], r["depth"]) for r in lineage.final_targets(spark.createDataFrame(merges, "s long, t long"), "s", "t").collect()}
    assert got == {1: (2, 4, 3), 2: (3, 4, 2), 3: (4, 4, 1), 5: (6, None, None), 6: (7, None, None), 7: (5, None, None), 8: (5, None, None), 9: (9, None, None)}


def test_unit_scores(spark):
    units = [(1, 5, 50.0, "1LDK", "南", "501", 5.0), (2, 5, 50.4, "1ldk+S", "SE", "502", 5.5), (3, 6, 50.0, "1LDK", "南", "501", 5.0), (4, None, None, None, None, None, None), (5, 5, 60.0, "2LDK", "北", None, None)]
    df = match.keyed_units(spark.createDataFrame(units, "id long, floor int, area double, layout string, direction string, room string, balcony double"))
    j = df.select(*[F.col(c).alias(f"a_{c}") for c in df.columns]).join(df.select(*[F.col(c).alias(f"b_{c}") for c in df.columns]), F.col("a_id") == 1)
    a, b = ({c: F.col(f"{s}_{c}") for c in df.columns} for s in "ab")
    got = {r["b_id"]: round(r["score"], 2) for r in j.select("b_id", match.unit_score(a, b).alias("score")).collect()}
    assert got == {1: 1.0, 2: 0.8, 3: 0.0, 4: 0.52, 5: 0.35}


def test_a_record_before_its_span_is_carried_into_it(spark):
    h = spark.createDataFrame([(1, "a", 10, "2024-01-01", 1), (1, "b", 20, "2024-01-03", 2)], "item long, source string, price long, day string, id long").withColumn("at", F.col("day").cast("timestamp_ntz"))
    spans = spark.createDataFrame([(1, "a", "2024-01-02", "2024-01-04"), (1, "b", "2024-01-03", "2024-01-03")], "item long, source string, s string, e string").select("item", "source", F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))
    got = {str(r["day"]): (r["price"], r["n_prices"]) for r in timeline.event_timeline(h, spans, "item", "source", "price", "at", "id").collect()}
    assert got == {"2024-01-02": (10, 1), "2024-01-03": (10, 2), "2024-01-04": (10, 1)}


def test_timeline_carries_records_from_before_a_span(spark):
    day = "CAST(to_date(concat('2024-01-', lpad(d, 2, '0'))) AS TIMESTAMP) AS at"
    h = spark.createDataFrame([(1, "s", 7, 2, 1), (1, "s", 8, 3, 2), (1, "s", 9, 12, 3), (1, "t", 5, 6, 4), (1, "t", None, 7, 5), (2, "s", 4, 9, 6)], "item int, source string, price int, d int, id int").selectExpr("item", "source", "price", "id", day)
    spans = spark.sql("SELECT 1 AS item, 's' AS source, DATE '2024-01-05' AS start, DATE '2024-01-10' AS end UNION ALL SELECT 1, 't', DATE '2024-01-06', DATE '2024-01-08' UNION ALL SELECT 2, 's', NULL, DATE '2024-01-09'")
    got = {(r["item"], r["day"].day): (r["price"], [(x["source"], x["price"]) for x in r["by_source"]]) for r in timeline.event_timeline(h, spans, "item", "source", "price", "at", "id").collect()}
    assert got == {(1, 5): (8, [("s", 8)]), (1, 6): (5, [("s", 8), ("t", 5)]), (1, 8): (5, [("s", 8), ("t", 5)]), (1, 9): (8, [("s", 8)]), (1, 10): (8, [("s", 8)])}
