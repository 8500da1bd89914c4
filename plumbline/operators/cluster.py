"""Clusters of pairs that are similar, under pairs that must stay apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.runtime import stage, unstage

# What ends the name of a municipality, and what begins the number of a block.
MUNICIPAL, NUMBERS = "区市町村", "0-9０-９一二三四五六七八九十－-"


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one component, most similar first, join their clusters unless that would unite a pair kept apart."""
    apart = {(a, b) for a, b, s in zip(pairs.a, pairs.b, pairs.similarity, strict=True) if s < 0}
    enemies: dict[int, set[int]] = {}
    for a, b in apart:
        enemies.setdefault(a, set()).add(b)
        enemies.setdefault(b, set()).add(a)
    cluster: dict[int, set[int]] = {}
    for a, b, s in pairs.sort_values(["similarity", "a", "b"], ascending=False)[["a", "b", "similarity"]].itertuples(index=False):
        x, y = cluster.setdefault(a, {a}), cluster.setdefault(b, {b})
        if s < 0 or x is y:
            continue
        small, large = sorted((x, y), key=len)
        if any(enemies.get(k, set()) & large for k in small):
            continue
        large |= small
        for k in small:
            cluster[k] = large
    return pd.DataFrame([(k, min(v)) for k, v in cluster.items()], columns=["node", "cluster"])


#: Components with more pairs than this are not gathered.
MOST_PAIRS = 50_000


def _joined_in_rounds(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """(node, cluster): the same clusters as one pair after the other gives, by rounds over all clusters at once.

    A pair that is the first in order for both its clusters can be joined now: nothing that comes before it touches them. Each
    round joins all such pairs and renames their clusters; pairs between clusters that must stay apart go first.
    """
    labels = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("cluster", F.col("node")), "labels")
    edges = stage(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.struct(F.col("similarity").alias("s"), "a", "b").alias("rank")), "edges")
    enemies = stage(apart.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "enemies")
    while True:
        left = edges.join(enemies, ["x", "y"], "left_anti")
        best = left.select(F.col("x").alias("k"), "rank").union(left.select("y", "rank")).groupBy("k").agg(F.max("rank").alias("rank"))
        chosen = left.join(best.withColumnRenamed("k", "x"), ["x", "rank"]).join(best.withColumnRenamed("k", "y"), ["y", "rank"]).select(F.col("y").alias("old"), F.col("x").alias("new")).distinct()
        chosen = stage(chosen, "joined")
        if chosen.limit(1).count() == 0:
            return labels

        def renamed(df: DataFrame, c: str, chosen=chosen) -> DataFrame:
            return df.join(chosen.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")

        def both(df: DataFrame) -> DataFrame:
            moved = renamed(renamed(df, "x"), "y").where("x <> y")
            return moved.withColumns({"x": F.least("x", "y"), "y": F.greatest("x", "y")})

        before = (labels, edges, enemies, chosen)
        edges = stage(both(left).groupBy("x", "y").agg(F.max("rank").alias("rank")), "edges")
        enemies, labels = stage(both(enemies).distinct(), "enemies"), stage(renamed(labels, "cluster"), "labels")
        unstage(*before)


def clusters(pairs: DataFrame, apart: DataFrame | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """(node, cluster): greedy clusters of (a, b, similarity), the smallest id their name; no pair of ``apart`` (a, b) in one cluster.

    Components without a pair kept apart are clusters as they are. In the others the order of joining matters: those of up
    to ``most`` pairs are settled as one group each, larger ones in rounds over all their clusters.
    """
    comp = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    if apart is None:
        return comp.withColumnRenamed("component", "cluster")
    inside = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    inside = inside.join(comp.select(F.col("node").alias("a"), F.col("component").alias("c")), "a").join(comp.select(F.col("node").alias("b"), F.col("component").alias("d")), "b").where("c = d")
    torn = inside.select("c").distinct()
    rows = pairs.select("a", "b", F.col("similarity").cast("double")).join(comp.select(F.col("node").alias("a"), F.col("component").alias("c")), "a").join(torn, "c", "left_semi")
    rows = stage(rows.select("c", "a", "b", "similarity").union(inside.select("c", "a", "b", F.lit(-1.0))), "torn")
    large = stage(rows.groupBy("c").count().where(F.col("count") > most).select("c"), "large")
    split = rows.join(large, "c", "left_anti").groupBy("c").applyInPandas(lambda pdf: _greedy(pdf), "node long, cluster long")
    whole = comp.join(torn.withColumnRenamed("c", "component"), "component", "left_anti").select("node", F.col("component").alias("cluster"))
    out = whole.unionByName(split)
    if large.limit(1).count():
        rest = rows.join(large, "c", "left_semi")
        out = out.unionByName(_joined_in_rounds(rest.where("similarity >= 0").select("a", "b", "similarity"), rest.where("similarity < 0").select("a", "b")))
    return out


def primaries(members: DataFrame, pairs: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(cluster, primary): the member with the highest mean similarity to the others; ties: more units, then the smaller id."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("o"), "similarity").union(pairs.select("b", "a", "similarity"))
    other = members.select(F.col("node").alias("o"), F.col("cluster").alias("oc"))
    mean = both.join(members, "node").join(other, "o").where("cluster = oc").groupBy("node").agg(F.avg("similarity").alias("mean"))
    rows = members.join(mean, "node", "left")
    rows = rows.join(units.select("node", "units"), "node", "left") if units is not None else rows.withColumn("units", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("mean"), F.desc_nulls_last("units"), "node"))
    return rows.withColumn("_r", rank).where("_r = 1").select("cluster", F.col("node").alias("primary"))


def _up_to_district(address: Column) -> Column:
    """An address up to the number of its district: its municipality and the words after it; without a municipality all of it."""
    head = F.regexp_extract(address, f"^[^{MUNICIPAL}]*[{MUNICIPAL}]", 0)
    words = F.get(F.split(F.substring(address, F.char_length(head) + 1, F.char_length(address)), f"[{NUMBERS}]"), F.lit(0))
    return F.when(head == "", address).otherwise(F.concat(head, words))


def _pair_scores(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster, mean, max) of the pairs within a cluster."""
    j = pairs.join(members.select(F.col("node").alias("a"), "cluster"), "a").join(members.select(F.col("node").alias("b"), F.col("cluster").alias("c2")), "b").where("cluster = c2")
    return j.groupBy("cluster").agg(F.avg("similarity").alias("mean"), F.max("similarity").alias("max"))


def cluster_confidence(members: DataFrame, pairs: DataFrame | None, primary: DataFrame | None = None, attributes: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(cluster, size, mean, max, confidence): mean + 0.3 max + the attribute bonus, less 0, 0.05, 0.1 or 0.2 for 2, 3, 4 and more members.

    With ``primary`` (cluster, primary) and ``attributes`` (node, address, floors, units, year) the bonus is 0.05, 0.15,
    0.3 or 0.5 for the member that agrees with its primary in most of them: 1, 2, 3 or all 4. Addresses agree up to their
    district, years within one; what is missing, 0 or empty agrees with nothing. ``scores`` (cluster, mean, max) may stand for the pairs.
    """
    s = _pair_scores(members, pairs) if scores is None else scores
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    penalty = F.when(F.col("size") <= 2, 0.0).when(F.col("size") == 3, 0.05).when(F.col("size") == 4, 0.1).otherwise(0.2)
    rows = sizes.join(s, "cluster")
    if primary is not None and attributes is not None:
        own = attributes.select("node", *(F.col(c).alias(f"x_{c}") for c in ("address", "floors", "units", "year")))
        lead = primary.join(attributes.withColumnRenamed("node", "primary"), "primary").select("cluster", "primary", "address", "floors", "units", "year")
        district = lambda c: _up_to_district(F.nullif(F.col(c), F.lit("")))
        same = [district("address") == district("x_address"), (F.col("floors") != 0) & (F.col("floors") == F.col("x_floors")), (F.col("units") != 0) & (F.col("units") == F.col("x_units")), (F.col("year") != 0) & (F.col("x_year") != 0) & (F.abs(F.col("year") - F.col("x_year")) <= 1)]
        n = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in same), F.lit(0))
        best = members.join(own, "node").join(lead, "cluster").where("node <> primary").groupBy("cluster").agg(F.max(n).alias("_n"))
        rows = rows.join(best, "cluster", "left")
    else:
        rows = rows.withColumn("_n", F.lit(0))
    bonus = F.when(F.col("_n") == 4, 0.5).when(F.col("_n") == 3, 0.3).when(F.col("_n") == 2, 0.15).when(F.col("_n") == 1, 0.05).otherwise(0.0)
    return rows.withColumn("confidence", F.col("mean") + 0.3 * F.col("max") + bonus - penalty).drop("_n")
