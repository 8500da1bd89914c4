"""The log of merges over the star schema: parts as units of buildings of four, customers' favourites, orders as lists of units."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import undo
from plumbline.plans.base import query
from plumbline.sources.files import table

_UNITS = "SELECT p_partkey AS unit, p_partkey // 4 AS building FROM part"
#: Every third building goes into the next, every sixth of these into the one after; every fifth unit into the second after it, every tenth of these on.
_BUILDING_EVENTS = "SELECT 2 * building AS event, building AS source, building + 1 AS target FROM (SELECT DISTINCT building FROM u WHERE building % 3 = 0) UNION ALL SELECT 2 * building + 3, building + 1, building + 2 FROM (SELECT DISTINCT building FROM u WHERE building % 6 = 0)"
_UNIT_EVENTS = "SELECT 1000000 + unit AS event, unit AS source, unit + 2 AS target FROM u WHERE unit % 5 = 0 UNION ALL SELECT 1000002 + unit, unit + 2, unit + 3 FROM u WHERE unit % 10 = 0"
_REVERTS = "SELECT event FROM (SELECT event FROM be UNION ALL SELECT event FROM ue) WHERE event % 7 = 3"
_FAVOURITES = "SELECT c_custkey % 40 AS user, c_custkey % (SELECT count(*) FROM part) AS unit, c_nationkey AS since FROM customer"
_APART = "SELECT building AS first, building + 1 AS second FROM (SELECT DISTINCT building FROM u) WHERE building % 2 = 0 UNION ALL SELECT building, building + 5 FROM (SELECT DISTINCT building FROM u)"
_LOG = f"""u AS ({_UNITS}), be AS ({_BUILDING_EVENTS}), ue AS ({_UNIT_EVENTS}), rv AS ({_REVERTS}), bs AS (SELECT * FROM be WHERE event NOT IN (SELECT event FROM rv)), us AS (SELECT * FROM ue WHERE event NOT IN (SELECT event FROM rv)),
bw(source, target, depth) AS (SELECT source, target, 1 FROM bs UNION ALL SELECT w.source, e.target, depth + 1 FROM bw w JOIN bs e ON e.source = w.target), bf AS (SELECT source, arg_max(target, depth) AS target FROM bw GROUP BY source),
uw(source, target, depth) AS (SELECT source, target, 1 FROM us UNION ALL SELECT w.source, e.target, depth + 1 FROM uw w JOIN us e ON e.source = w.target), uf AS (SELECT source, arg_max(target, depth) AS target FROM uw GROUP BY source)"""


def _log(spark, d):
    """Units, building events, unit events and reverts."""
    u = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.floor(F.col("p_partkey") / 4).alias("building"))
    be = spark.sql(_BUILDING_EVENTS.replace("FROM u", "FROM {u}"), u=u)
    ue = spark.sql(_UNIT_EVENTS.replace("FROM u", "FROM {u}"), u=u)
    return u, be, ue, be.select("event").unionByName(ue.select("event")).where("event % 7 = 3")


def _replayed(spark, d):
    u, be, ue, rv = _log(spark, d)
    n = table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").join(F.broadcast(n)).select((F.col("c_custkey") % 40).alias("user"), (F.col("c_custkey") % F.col("n")).alias("unit"), F.col("c_nationkey").alias("since"))  # one row
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("list")).agg(F.collect_set("l_partkey").alias("ids"))
    apart = spark.sql(_APART.replace("FROM u", "FROM {u}"), u=u)
    return undo.replay(u, c, lines, apart, be, ue, rv)


@query(f"WITH RECURSIVE {_LOG} SELECT unit, coalesce(target, building) AS building FROM u LEFT JOIN bf ON bf.source = building WHERE unit NOT IN (SELECT source FROM uf)")
def replayed_units(spark, d):
    """Units and their buildings after all merges that stand."""
    return _replayed(spark, d)["units"]


@query(f'WITH RECURSIVE {_LOG} SELECT "user", coalesce(target, unit) AS unit, min(since) AS since FROM ({_FAVOURITES}) LEFT JOIN uf ON uf.source = unit GROUP BY ALL')
def replayed_favourites(spark, d):
    """Favourites after the merges of units, one for each user and unit."""
    return _replayed(spark, d)["favourites"]


@query(f"WITH RECURSIVE {_LOG} SELECT l_orderkey AS list, string_agg(DISTINCT CAST(coalesce(target, l_partkey) AS VARCHAR), ',' ORDER BY lpad(CAST(coalesce(target, l_partkey) AS VARCHAR), 12, '0'), CAST(coalesce(target, l_partkey) AS VARCHAR)) AS ids FROM lineitem LEFT JOIN uf ON uf.source = l_partkey GROUP BY 1")
def replayed_lists(spark, d):
    """Lists of units after the merges, ids in order."""
    return _replayed(spark, d)["lists"].select("list", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH RECURSIVE {_LOG}, x AS (SELECT coalesce(p.target, first) AS a, coalesce(q.target, second) AS b FROM ({_APART}) LEFT JOIN bf p ON p.source = first LEFT JOIN bf q ON q.source = second)
SELECT DISTINCT least(a, b) AS first, greatest(a, b) AS second FROM x WHERE a <> b""")
def replayed_exclusions(spark, d):
    """Pairs of buildings kept apart, after the merges of buildings."""
    return _replayed(spark, d)["exclusions"]


@query(f"""WITH RECURSIVE {_LOG}, w AS (SELECT unit, e.event, e.source, e.target FROM u JOIN bs e ON e.source = building UNION ALL SELECT unit, e.event, e.source, e.target FROM w JOIN bs e ON e.source = w.target)
SELECT event, unit, source AS before, target AS after FROM w""")
def undo_details(spark, d):
    """What every standing merge of buildings moved: the mapping that takes it back."""
    u, be, _, rv = _log(spark, d)
    return undo.inverse(u, "unit", "building", undo.standing(be, rv))


@query(f"""WITH RECURSIVE {_LOG}, b2 AS (SELECT * FROM bs WHERE event <> 24), w2(source, target, depth) AS (SELECT source, target, 1 FROM b2 UNION ALL SELECT w.source, e.target, depth + 1 FROM w2 w JOIN b2 e ON e.source = w.target), f2 AS (SELECT source, arg_max(target, depth) AS target FROM w2 GROUP BY source),
x AS (SELECT unit, coalesce(bf.target, building) AS before, coalesce(f2.target, building) AS after, unit IN (SELECT source FROM uf) AS gone FROM u LEFT JOIN bf ON bf.source = building LEFT JOIN f2 ON f2.source = building)
SELECT unit, CASE WHEN NOT gone THEN before END AS before, CASE WHEN NOT gone THEN after END AS after, CASE WHEN gone THEN 'merged into another unit: not moved back' END AS warning FROM x WHERE before <> after""")
def undo_preview(spark, d):
    """What taking back one more merge would move, and what it could not."""
    u, be, ue, rv = _log(spark, d)
    moved, lost = undo.taken_back(u, be, ue, rv, 24)
    return moved.withColumn("warning", F.lit(None).cast("string")).unionByName(lost, True)
