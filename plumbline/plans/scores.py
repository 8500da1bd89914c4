"""Scores, votes and merges over buildings and units made of the suppliers and parts, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import classes, lineage, match, timeline, vote
from plumbline.plans.base import ADVERTS, adverts, query
from plumbline.runtime import broadcast_checked, stage
from plumbline.sources.files import table

# Suppliers as buildings, in SQL for both engines. n1-n2-n3 is the block; some buildings lack parts of it, or an address.
_BUILDINGS = """SELECT id, town, base, name, n1, n2, n3, place, CASE WHEN id % 17 <> 0 THEN '東京都港区' || place || coalesce('' || n1, '') || coalesce('-' || n2, '') || coalesce('-' || n3, '') END AS address,
CASE WHEN id % 9 <> 0 THEN 1990 + id % 4 END AS year, CASE WHEN id % 2 = 0 THEN 1 + id % 3 END AS month, CASE WHEN id % 8 <> 0 THEN 5 + id * 3 % 30 END AS floors, CASE id % 4 WHEN 0 THEN 'RC' WHEN 1 THEN 'SRC' WHEN 2 THEN 'RC' END AS structure, 20 + id % 7 AS units
FROM (SELECT s_suppkey AS id, s_nationkey AS town, 'コート' || (s_suppkey % 20) AS base, 'コート' || (s_suppkey % 20) || CASE s_suppkey % 3 WHEN 0 THEN '東棟' WHEN 1 THEN '西棟' ELSE '' END AS name,
CASE WHEN s_suppkey % 10 <> 0 THEN 1 + s_suppkey % 2 END AS n1, CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % 4 <> 0 THEN 1 + s_suppkey % 3 END AS n2, CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % 4 IN (1, 2) THEN 1 + s_suppkey % 5 END AS n3,
CASE s_suppkey % 7 WHEN 0 THEN '三田' WHEN 1 THEN '海岸' ELSE '芝浦' END AS place FROM {0}) b"""
BUILDINGS = f"({_BUILDINGS.format('supplier')})"


def buildings(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_BUILDINGS.replace("{0}", "{suppliers}"), suppliers=table(spark, d, "supplier"))


def _sides(df: DataFrame, *names: str):
    return [{n: F.col(f"{side}_{n}") for n in names} for side in ("a", "b")]


def _town_pairs(spark, d, by: list[str]):
    """Ordered pairs of different buildings of a town, a class with itself too, and the members of the classes."""
    b = buildings(spark, d).where("id IS NOT NULL AND town IS NOT NULL")
    found = classes.found(b, by)
    members = classes.parts(b, "id", by, found)
    pairs = classes.side(found, "a").join(classes.side(found, "b"), F.col("a_town") == F.col("b_town"))
    return stage(pairs, "town_pairs"), members


def _by_addresses(pairs, **scores):
    """Pairs with scores of their two addresses, made once for each two addresses."""
    x, y = F.col("a_address"), F.col("b_address")
    met = stage(pairs.select(x, y).distinct(), "addresses")
    scored = broadcast_checked(stage(met.select(x.alias("_x"), y.alias("_y"), *(f(x, y).alias(k) for k, f in scores.items())), "scored_addresses"))
    return pairs.join(scored, x.eqNullSafe(F.col("_x")) & y.eqNullSafe(F.col("_y")))


_PAIRS = f"(SELECT a.id AS a, b.id AS b, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in ('name', 'base', 'address', 'place', 'n1', 'n2', 'n3', 'year', 'month', 'floors', 'structure', 'units'))} FROM {BUILDINGS} a JOIN {BUILDINGS} b ON a.town = b.town AND a.id < b.id)"
_SIZE = lambda s: f"(CASE WHEN {s}_n3 IS NOT NULL THEN 3 WHEN {s}_n2 IS NOT NULL THEN 2 ELSE 1 END)"
_SAME = f"(least({_SIZE('a')}, {_SIZE('b')}) < 2 OR a_n2 = b_n2) AND (least({_SIZE('a')}, {_SIZE('b')}) < 3 OR a_n3 = b_n3)"
_LADDER = f"""CASE WHEN a_address IS NULL OR b_address IS NULL THEN 0.0 WHEN a_address = b_address THEN 1.0 WHEN a_n1 IS NOT NULL AND b_n1 IS NOT NULL THEN
 CASE WHEN a_n1 <> b_n1 THEN CASE WHEN a_place = b_place THEN 0.3 ELSE 0.1 END WHEN {_SAME} AND {_SIZE('a')} = {_SIZE('b')} THEN 0.95 WHEN {_SAME} THEN CASE least({_SIZE('a')}, {_SIZE('b')}) WHEN 1 THEN 0.85 WHEN 2 THEN 0.9 ELSE 0.93 END ELSE 0.4 END
 WHEN a_n1 IS NOT NULL OR b_n1 IS NOT NULL THEN CASE WHEN a_place = b_place THEN 0.75 ELSE 0.3 END ELSE 10.0 / 14 END"""
_GRADE = """CASE WHEN a_address IS NULL OR b_address IS NULL THEN 0 WHEN a_address = b_address THEN 100 WHEN a_place <> b_place THEN 0
 WHEN a_n1 IS NOT NULL AND b_n1 IS NOT NULL THEN CASE WHEN a_n1 <> b_n1 THEN 80 WHEN a_n2 = b_n2 THEN 100 ELSE 90 END WHEN a_n1 IS NOT NULL OR b_n1 IS NOT NULL THEN 80 ELSE 70 END"""
_YEAR = "CASE WHEN abs(a_year - b_year) = 0 THEN CASE WHEN a_month = b_month THEN 1.0 WHEN a_month <> b_month THEN 0.3 ELSE 0.7 END WHEN abs(a_year - b_year) = 1 THEN 0.2 WHEN abs(a_year - b_year) = 2 THEN 0.1 WHEN abs(a_year - b_year) > 2 THEN 0.0 END"
_TALL = "CASE WHEN abs(a_floors - b_floors) = 0 THEN 1.0 WHEN abs(a_floors - b_floors) = 1 THEN 0.8 WHEN abs(a_floors - b_floors) <= 5 THEN 0.5 WHEN abs(a_floors - b_floors) <= 10 THEN 0.3 WHEN abs(a_floors - b_floors) <= 20 THEN 0.2 WHEN abs(a_floors - b_floors) > 20 THEN 0.1 END"
_FRAME = "CASE WHEN a_structure = b_structure THEN 1.0 WHEN a_structure <> b_structure THEN 0.5 END"
_NAMED = """CASE WHEN a_name = b_name THEN 100.0 WHEN starts_with(a_name, b_name) OR starts_with(b_name, a_name) THEN 80 + 15.0 * least(length(a_name), length(b_name)) / greatest(length(a_name), length(b_name))
 WHEN contains(a_name, b_name) OR contains(b_name, a_name) THEN 50 + 25.0 * least(length(a_name), length(b_name)) / greatest(length(a_name), length(b_name)) ELSE 0.0 END"""


@query(f"""WITH p AS (SELECT *, {_LADDER} AS address, {_YEAR} AS y, {_TALL} AS t, {_FRAME} AS f, ({_NAMED}) / 100 AS named FROM {_PAIRS}),
q AS (SELECT *, CASE WHEN y IS NULL AND t IS NULL AND f IS NULL THEN 0.5 ELSE (2.0 * coalesce(y, 0) + 0.8 * coalesce(t, 0) + 0.5 * coalesce(f, 0)) / (CASE WHEN y IS NULL THEN 0 ELSE 2.0 END + CASE WHEN t IS NULL THEN 0 ELSE 0.8 END + CASE WHEN f IS NULL THEN 0 ELSE 0.5 END) END AS attributes FROM p)
SELECT a, b, round(address, 6) AS address, round(attributes, 6) AS attributes, round(CASE WHEN abs(a_year - b_year) > 2 THEN 0.3 WHEN address >= 0.95 AND attributes >= 0.9 THEN CASE WHEN named < 0.3 THEN 0.92 ELSE 0.95 END WHEN named >= 0.85 AND address >= 0.8 THEN greatest(named, address)
WHEN named < 0.5 AND address >= 0.9 AND attributes >= 0.8 THEN 0.85 WHEN address = 0 AND named >= 0.9 AND attributes >= 0.8 THEN 0.85 WHEN address > 0 THEN 0.4 * address + 0.3 * named + 0.3 * attributes ELSE 0.6 * named + 0.4 * attributes END, 6) AS similarity FROM q""")
def building_similarities(spark, d):
    """Pairs of a town's buildings: address ladder, attributes, and the whole with its override rules."""
    pairs, members = _town_pairs(spark, d, ["town", "name", "address", "year", "month", "floors", "structure"])
    pairs = _by_addresses(pairs, address=match.address_ladder)
    a, b = _sides(pairs, "name", "address", "year", "month", "floors", "structure")
    named = match.name_priority(a["name"], b["name"])["score"] / 100
    scored = pairs.select("a_class", "a_n", "b_class", "b_n", "address", match.attribute_similarity(a, b).alias("attributes"), named.alias("named"), F.abs(a["year"] - b["year"]).alias("gap"))
    whole = match.building_similarity(F.col("named"), F.col("address"), F.col("attributes"), F.col("gap"))
    scored = scored.select("a_class", "a_n", "b_class", "b_n", F.round("address", 6).alias("address"), F.round("attributes", 6).alias("attributes"), F.round(whole, 6).alias("similarity"))
    return classes.told(scored, members, members, ["address", "attributes", "similarity"], F.col("a") < F.col("b"))


@query(f"""SELECT a, b, {_GRADE} AS grade, CASE WHEN a_name = b_name THEN 1 WHEN starts_with(a_name, b_name) OR starts_with(b_name, a_name) THEN 2 WHEN contains(a_name, b_name) OR contains(b_name, a_name) THEN 3 ELSE 4 END AS priority,
a_name = b_name OR contains(a_name, b_name) OR contains(b_name, a_name) OR (length(a_name) >= 5 AND length(b_name) >= 5 AND left(a_name, 5) = left(b_name, 5)) AS overlap,
round(0.4 * ({_GRADE}) + 0.3 * CASE WHEN a_floors = b_floors AND a_year = b_year THEN 100.0 WHEN abs(a_floors - b_floors) <= 5 THEN 70.0 ELSE 0.0 END + 0.3 * ({_NAMED}), 6) AS score,
0.7 * ({_NAMED}) / 100 + 0.3 * ({_LADDER}) >= 0.85 AS same FROM {_PAIRS}""")
def building_grades(spark, d):
    """The same pairs by the steps of a lookup: address grade, name priority, name overlap, building score, and whether they are one."""
    pairs, members = _town_pairs(spark, d, ["town", "name", "address", "year", "floors"])
    pairs = _by_addresses(pairs, grade=match.address_grade, ladder=match.address_ladder)
    a, b = _sides(pairs, "name", "year", "floors")
    named = match.name_priority(a["name"], b["name"])
    strict, flexible = (a["floors"] == b["floors"]) & (a["year"] == b["year"]), F.abs(a["floors"] - b["floors"]) <= 5
    scored = pairs.select(
        "a_class", "a_n", "b_class", "b_n", "grade", named["priority"].alias("priority"), match.names_overlap(a["name"], b["name"]).alias("overlap"), F.round(match.building_score(F.col("grade"), strict, flexible, named["score"]), 6).alias("score"),
        match.same_building(named["score"] / 100, F.col("ladder")).alias("same"),
    )
    return classes.told(scored, members, members, ["grade", "priority", "overlap", "score", "same"], F.col("a") < F.col("b"))


@query(f"""WITH b AS {BUILDINGS}, c AS (SELECT address, name, count(*) AS n FROM b WHERE address IS NOT NULL GROUP BY ALL)
SELECT b.id, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS at_address, CAST(coalesce(sum(CASE WHEN starts_with(c.name, b.base) OR starts_with(b.base, c.name) THEN c.n END), 0) AS BIGINT) AS matching,
coalesce(sum(c.n), 0) >= 2 AND coalesce(sum(CASE WHEN starts_with(c.name, b.base) OR starts_with(b.base, c.name) THEN c.n END), 0) >= 2 AS is_ambiguous FROM b LEFT JOIN c ON b.address = c.address GROUP BY b.id""")
def ambiguous_searches(spark, d):
    """Searches for a building's base name at its address: do several buildings there answer to it?"""
    b = buildings(spark, d)
    return match.ambiguous_names(b, b, "id", "base", "address", "name", "address")


_OFFERS = "SELECT l_orderkey * 10 + l_linenumber AS advert_id, l_partkey AS unit_id, l_suppkey AS building_id, b.address, b.floors AS total_floors, b.year AS built_year, l_linenumber AS floor, l_partkey % 50 + 0.5D AS area, CAST(l_quantity AS BIGINT) AS price, l_linestatus = 'O' AS is_active FROM {0} l JOIN {1} b ON l_suppkey = b.id"


@query(f"""WITH o AS ({_OFFERS.format("lineitem", BUILDINGS).replace("0.5D", "CAST(0.5 AS DOUBLE)")}), j AS (SELECT w.advert_id, l.building_id, l.unit_id, row_number() OVER (PARTITION BY w.advert_id ORDER BY l.building_id, l.unit_id) AS rn
FROM o w JOIN o l ON l.is_active AND w.total_floors = l.total_floors AND w.built_year = l.built_year AND w.floor = l.floor AND w.area = l.area AND w.price = l.price AND w.building_id <> l.building_id AND starts_with(l.address, w.address))
SELECT advert_id, building_id, unit_id FROM j WHERE rn = 1""")
def fallback_matches(spark, d):
    """Adverts whose physical attributes fit a unit of another building at their address."""
    o = spark.sql(_OFFERS.replace("{0}", "{lines}").replace("{1}", "{b}"), lines=table(spark, d, "lineitem"), b=buildings(spark, d))
    return match.fallback_match(o, o.where("is_active"), "advert_id")


_KINDS = "SELECT p_partkey AS id, p_brand AS building_id, p_size % 5 AS floor, 50 + CAST(p_partkey % 4 AS DOUBLE) / 4 AS area, (1 + p_partkey % 2) || 'LDK' AS layout, CASE p_partkey % 5 WHEN 0 THEN '南' WHEN 1 THEN '南東' WHEN 2 THEN '東' WHEN 3 THEN '南' END AS direction FROM {0} part"


@query(f"""WITH v AS ({_KINDS.format("")}), u AS (SELECT * FROM v WHERE id % 3 <> 0), m AS (SELECT * FROM v WHERE id % 3 = 0),
x AS (SELECT building_id, floor, area, layout, list(DISTINCT direction) AS ds FROM m WHERE direction IS NOT NULL GROUP BY ALL HAVING count(DISTINCT direction) > 1), y AS (SELECT building_id, floor, area, direction, list(DISTINCT layout) AS ls FROM m WHERE layout IS NOT NULL GROUP BY ALL HAVING count(DISTINCT layout) > 1),
j AS (SELECT a.id AS a, b.id AS b, 4 + CASE WHEN coalesce(list_contains(x.ds, a.direction) AND list_contains(x.ds, b.direction), false) THEN 3 ELSE 0 END + CASE WHEN coalesce(list_contains(y.ls, a.layout) AND list_contains(y.ls, b.layout), false) THEN 3 ELSE 0 END AS t
FROM u a JOIN u b ON a.building_id = b.building_id AND a.floor = b.floor AND a.id <> b.id AND abs(a.area - b.area) <= 0.5 LEFT JOIN x ON a.building_id = x.building_id AND a.floor = x.floor AND a.area = x.area AND a.layout = x.layout LEFT JOIN y ON a.building_id = y.building_id AND a.floor = y.floor AND a.area = y.area AND a.direction = y.direction)
SELECT a, b, CAST(t AS DOUBLE) / 10 AS score FROM j WHERE t >= 7""")
def learned_merges(spark, d):
    """Units that earlier merges (a third of the parts stands for them) let one expect to be the same."""
    v = spark.sql(_KINDS.replace("{0} part", "{parts} part"), parts=table(spark, d, "part"))
    return match.learned_suggestions(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), "id")


_MOVE = """CASE WHEN a.name = b.name THEN 15 WHEN a.base = b.base THEN 8 WHEN contains(b.name, a.base) THEN 5 ELSE 0 END + CASE WHEN a.address = b.address THEN 5 WHEN starts_with(a.address, b.address) OR starts_with(b.address, a.address) THEN 3 ELSE 0 END
+ CASE WHEN a.year = b.year THEN 5 ELSE 0 END + CASE WHEN a.floors = b.floors THEN 5 ELSE 0 END"""


@query(f"""WITH v AS {BUILDINGS}, j AS (SELECT a.id AS a, b.id AS b, {_MOVE} AS score FROM v a JOIN v b ON a.base = b.base AND a.id <> b.id)
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM j) WHERE rn <= 10""")
def move_to_building(spark, d):
    """Ten buildings to which a unit of each building may be moved, among those of its name."""
    x, y = F.col("a_address"), F.col("b_address")
    place = F.when(x == y, True).when(x.startswith(y) | y.startswith(x), None).otherwise(False)
    score = match.move_building_score(F.col("a_name") == F.col("b_name"), F.lit(True), F.col("b_name").contains(F.col("a_base")), place, F.col("a_year") == F.col("b_year"), F.col("a_floors") == F.col("b_floors"))
    return classes.best_others(buildings(spark, d), "id", ["base", "name", "address", "year", "floors"], ["base"], score, 10)


@query(f"""WITH v AS {BUILDINGS} SELECT a, b, score FROM (SELECT a.id AS a, b.id AS b, CASE WHEN a.address = b.address THEN 50 WHEN contains(a.address, b.address) OR contains(b.address, a.address) THEN 20 ELSE 0 END
+ CASE WHEN a.floors = b.floors THEN 20 WHEN abs(a.floors - b.floors) <= 1 THEN 10 ELSE 0 END + CASE WHEN a.units = b.units THEN 15 WHEN abs(a.units - b.units) <= 5 THEN 5 ELSE 0 END + CASE WHEN a.year = b.year THEN 15 WHEN abs(a.year - b.year) <= 1 THEN 5 ELSE 0 END AS score
FROM v a JOIN v b ON a.base = b.base AND a.id <> b.id) WHERE score >= 20""")
def suggested_buildings(spark, d):
    """Buildings with an advert's name whose address and attributes earn them 20 points."""
    by = ["base", "address", "floors", "units", "year"]
    v = buildings(spark, d).where("id IS NOT NULL AND base IS NOT NULL")
    found = classes.found(v, by)
    pairs = classes.side(found, "a").join(classes.side(found, "b"), F.col("a_base") == F.col("b_base"))
    a, b = _sides(pairs, "address", "floors", "units", "year")
    scored = pairs.select("a_class", "a_n", "b_class", "b_n", match.advert_building_score(a, b).alias("score")).where("score >= 20")
    members = classes.parts(v, "id", by, found)
    return classes.told(scored, members, members, ["score"], F.col("a") != F.col("b"))


_ROOMS = "SELECT p_partkey AS id, p_brand AS building, p_size AS floor, CASE WHEN p_partkey % 11 <> 0 THEN 50 + p_partkey * 13 % 40 / 10.0D END AS area, CASE p_partkey % 7 WHEN 0 THEN '1LDK' WHEN 1 THEN '1ldk+S' WHEN 2 THEN '2LDK' WHEN 3 THEN 'ワンルーム' WHEN 4 THEN '1R' WHEN 5 THEN '2LDK+N' END AS layout, CASE p_partkey % 6 WHEN 0 THEN '南' WHEN 1 THEN 'SE' WHEN 2 THEN 'E' WHEN 3 THEN '北' WHEN 4 THEN '南向き' END AS direction, CASE WHEN p_partkey % 4 = 0 THEN '10' || (p_partkey % 3) END AS room, CASE WHEN p_partkey % 3 <> 0 THEN 5 + (p_partkey % 4) / 2.0D END AS balcony FROM {0} part"
_ROOMS_DUCK = _ROOMS.format("").replace("10.0D", "CAST(10 AS DOUBLE)").replace("2.0D", "CAST(2 AS DOUBLE)")


@query(f"""WITH r AS (SELECT *, CASE layout WHEN '1ldk+S' THEN '1SLDK' WHEN 'ワンルーム' THEN '1R' WHEN '2LDK+N' THEN '2LDK' ELSE layout END AS lk, CASE direction WHEN 'SE' THEN '南東' WHEN 'E' THEN '東' WHEN '南向き' THEN '南' ELSE direction END AS dk FROM ({_ROOMS_DUCK}))
SELECT a.id AS a, b.id AS b, round(least(1.0, (30 + CASE WHEN abs(a.area - b.area) <= 0.5 THEN 30 WHEN abs(a.area - b.area) <= 1.0 THEN 20 WHEN abs(a.area - b.area) > 1.0 THEN 5 ELSE 15 END
+ CASE WHEN a.lk = b.lk THEN 25 WHEN left(a.lk, 1) = left(b.lk, 1) THEN 15 WHEN a.lk IS NOT NULL AND b.lk IS NOT NULL THEN 0 ELSE 12 END
+ CASE WHEN a.dk = b.dk THEN 15 WHEN (a.dk || b.dk) IN ('南南東', '南東南', '東南東', '南東東') THEN 10 WHEN a.dk IS NOT NULL AND b.dk IS NOT NULL THEN 0 ELSE 10 END
+ CASE WHEN a.room = b.room THEN 20 WHEN a.room <> b.room THEN -10 ELSE 0 END + CASE WHEN abs(a.balcony - b.balcony) <= 0.5 THEN 5 ELSE 0 END) / 100.0), 6) AS score
FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.id < b.id""")
def unit_similarity(spark, d):
    """Units on one floor of a building, by all rules; pairs on different floors score 0 and are not made."""
    rooms = spark.sql(_ROOMS.replace("{0} part", "{parts} part"), parts=table(spark, d, "part"))
    pairs = match.block_pairs(match.keyed_units(rooms), "id", ["building", "floor"])
    a, b = _sides(pairs, "floor", "area", "layout", "rooms", "direction", "room", "balcony")
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(match.unit_score(a, b), 6).alias("score"))


@query(f"""WITH r AS ({_ROOMS_DUCK}), j AS (SELECT a.id AS a, b.id AS b, 10 * CAST(a.id % 3 = 0 AS INTEGER) + 5 + CASE WHEN abs(a.area - b.area) <= 0.5 THEN 5 ELSE 0 END + CASE WHEN a.layout IS NOT DISTINCT FROM b.layout THEN 3 ELSE 0 END
+ CASE WHEN a.direction IS NOT DISTINCT FROM b.direction THEN 3 ELSE 0 END + CASE WHEN a.room IS NOT DISTINCT FROM b.room THEN 2 ELSE 0 END AS score FROM r a JOIN r b ON a.building = b.building AND a.floor = b.floor AND a.id <> b.id)
SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM j) WHERE rn <= 20""")
def move_to_unit(spark, d):
    """Twenty units on its floor to which an advert may be moved."""
    r = spark.sql(_ROOMS.replace("{0} part", "{parts} part"), parts=table(spark, d, "part"))
    a, b = _sides(r, "floor", "area", "layout", "direction", "room")
    # the points of a suggested building are the same for all targets of a unit, so they do not change their order
    best = classes.best_others(r, "id", ["building", "floor", "area", "layout", "direction", "room"], ["building", "floor"], match.move_unit_score(a, b, F.lit(False)), 20)
    return best.withColumn("score", F.col("score") + F.when(F.col("a") % 3 == 0, 10).otherwise(0))


# Votes ---------------------------------------------------------------------------------------------------------------------------
_SAID = "SELECT l_partkey AS unit_id, l_suppkey AS site, l_shipdate AS seen_at, l_orderkey * 10 + l_linenumber AS advert_id, l_orderkey % 4 AS form, 'コート ' || (l_partkey % 9) AS name FROM {0} lineitem"
_SPELLING = "CASE form WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' ', '　') WHEN 2 THEN name || ' ' ELSE name || '別' END"


@query(f"""WITH v AS (SELECT unit_id, CASE WHEN site BETWEEN 1 AND 5 THEN site ELSE 99 END AS s, {_SPELLING} AS said, CASE WHEN form < 3 THEN replace(name, ' ', '') ELSE replace(name, ' ', '') || '別' END AS normal FROM ({_SAID.format("")})),
n AS (SELECT unit_id, normal, count(*) AS votes, min(s) AS s FROM v GROUP BY ALL), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY votes DESC, s, normal) AS rn FROM n) WHERE rn = 1)
SELECT unit_id, said, votes FROM (SELECT w.unit_id, v.said, w.votes, row_number() OVER (PARTITION BY w.unit_id ORDER BY v.s, v.said) AS rn FROM w JOIN v USING (unit_id, normal)) WHERE rn = 1""")
def voted_spelling(spark, d):
    """The name most adverts mean, in the spelling of the best site."""
    v = spark.sql(_SAID.replace("{0} lineitem", "{lines} lineitem"), lines=table(spark, d, "lineitem")).withColumn("said", F.expr(_SPELLING)).withColumn("site_name", F.concat(F.lit("s"), F.col("site").cast("string")))
    return vote.majority_spelling(v, ["unit_id"], "said", F.regexp_replace("said", "[ 　]", ""), "site_name", [f"s{k}" for k in range(1, 6)])


_STATIONS = "SELECT l_partkey AS unit_id, CASE l_orderkey % 4 WHEN 0 THEN '青山線「北駅」徒歩' || (1 + l_linenumber) || '分' WHEN 1 THEN '青山線「北駅」徒歩5分、東駅まで徒歩' || (2 + l_linenumber % 2) || '分' WHEN 2 THEN '東駅 徒歩3分' ELSE NULL END AS text FROM {0} lineitem"


@query(f"""WITH v AS ({_STATIONS.format("")}), n AS (SELECT unit_id, count(*) AS adverts FROM v WHERE text IS NOT NULL GROUP BY unit_id),
m AS (SELECT unit_id, '北駅' AS station, '青山線' AS line, CAST(regexp_extract(text, '北駅」徒歩(\\d+)分', 1) AS INTEGER) AS minutes FROM v WHERE contains(text, '北駅') UNION ALL
SELECT unit_id, '東駅', NULL, CAST(regexp_extract(text, '東駅(?:まで| )徒歩(\\d+)分', 1) AS INTEGER) FROM v WHERE contains(text, '東駅')),
c AS (SELECT unit_id, station, line, minutes, count(*) AS k FROM m GROUP BY ALL), b AS (SELECT unit_id, station, line, CAST(sum(k) AS BIGINT) AS votes, arg_min(minutes, (-k, minutes)) AS minutes FROM c GROUP BY ALL)
SELECT unit_id, station, line, minutes, votes FROM b JOIN n USING (unit_id) WHERE votes >= 0.3 * adverts""")
def voted_stations(spark, d):
    """Stations that adverts of a unit name, with the usual minutes."""
    v = spark.sql(_STATIONS.replace("{0} lineitem", "{lines} lineitem"), lines=table(spark, d, "lineitem"))
    return vote.stations(v, "unit_id", "text")


_TENURE = """SELECT l_partkey AS unit_id, l_suppkey AS site, l_shipdate AS listed, CASE (l_orderkey + l_linenumber) % 6 + 10 * (l_partkey % 2)
WHEN 0 THEN '一般定期借地権、借地期間残存' || (20 + l_partkey % 3) || '年' || (1 + l_partkey % 5) || 'ヶ月、登記不可' WHEN 1 THEN '一般定期借地権、借地期間残存35年、登記不可' WHEN 2 THEN '一般定期借地権、※定期賃借権：借地期限2061年3月31日まで 登記可' WHEN 3 THEN '所有権' WHEN 4 THEN '旧法借地権'
WHEN 10 THEN '旧法借地権' WHEN 11 THEN '旧法借地権（地主承諾）' WHEN 12 THEN '所有権' WHEN 13 THEN '一般定期借地権、借地期間新規50年' WHEN 14 THEN '所有権の共有' END AS text FROM {0} lineitem"""
_AT = "2001-06-15"


@query(f"""WITH v AS (SELECT *, CASE WHEN site BETWEEN 1 AND 5 THEN site ELSE 99 END AS s, CASE WHEN contains(text, '定期借地権') THEN '一般定期借地権' WHEN contains(text, '旧法借地権') THEN '旧法借地権' WHEN contains(text, '所有権') THEN '所有権' END AS kind FROM ({_TENURE.format("")}) WHERE text IS NOT NULL),
k AS (SELECT unit_id, kind FROM (SELECT unit_id, kind, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, min(s), kind) AS rn FROM v GROUP BY unit_id, kind) WHERE rn = 1),
m AS (SELECT v.*, CASE WHEN contains(text, '借地期限') THEN regexp_extract(text, '借地期限(\\d+)年', 1) || '-' || lpad(regexp_extract(text, '年(\\d+)月', 1), 2, '0')
  WHEN contains(text, '借地期間') THEN strftime(CAST(listed AS DATE) + to_months(CAST(12 * CAST(regexp_extract(text, '(\\d+)年', 1) AS INTEGER) + coalesce(try_cast(nullif(regexp_extract(text, '年(\\d+)ヶ月', 1), '') AS INTEGER), 0) AS INTEGER)), '%Y-%m') END AS until FROM v JOIN k USING (unit_id, kind) WHERE kind <> '所有権'),
e AS (SELECT unit_id, until FROM (SELECT unit_id, until, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, until) AS rn FROM m WHERE until IS NOT NULL GROUP BY unit_id, until) WHERE rn = 1),
c AS (SELECT m.unit_id, e.until, m.s, regexp_replace(regexp_replace(regexp_replace(m.text, '借地期間(?:残存|新規)\\d+年(?:\\d+ヶ月)?、?', ''), '※定期賃借権：借地期限\\d+年\\d+月\\d+日まで ?', ''), '、$', '') AS cond FROM m JOIN e ON m.unit_id = e.unit_id AND m.until = e.until),
w AS (SELECT unit_id, until, cond FROM (SELECT unit_id, until, cond, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, min(s), cond) AS rn FROM c GROUP BY unit_id, until, cond) WHERE rn = 1),
f AS (SELECT *, date_sub('month', DATE '{_AT}', CAST(until || '-01' AS DATE)) AS left_months FROM w),
g AS (SELECT unit_id, cond, left_months, '借地期間残存' || (left_months // 12) || '年' || CASE WHEN left_months % 12 > 0 THEN (left_months % 12) || 'ヶ月' ELSE '' END AS dur FROM f),
z AS (SELECT m.unit_id, m.text, row_number() OVER (PARTITION BY m.unit_id ORDER BY count(*) DESC, min(m.s), m.text) AS rn FROM m WHERE unit_id NOT IN (SELECT unit_id FROM e) GROUP BY m.unit_id, m.text)
SELECT unit_id, '所有権' AS tenure FROM k WHERE kind = '所有権' UNION ALL
SELECT unit_id, CASE WHEN left_months <= 0 THEN cond WHEN contains(cond, '、') THEN split_part(cond, '、', 1) || '、' || dur || '、' || substr(cond, strpos(cond, '、') + 1) WHEN cond <> '' THEN cond || '、' || dur ELSE dur END FROM g UNION ALL
SELECT unit_id, text FROM z WHERE rn = 1""")
def voted_tenure(spark, d):
    """The kind of tenure most adverts name, the end of its lease and its conditions, as text with the time that is left."""
    v = spark.sql(_TENURE.replace("{0} lineitem", "{lines} lineitem"), lines=table(spark, d, "lineitem")).withColumn("site_name", F.concat(F.lit("s"), F.col("site").cast("string")))
    return vote.tenure(v, "unit_id", "text", "site_name", "listed", F.lit(_AT).cast("date"), [f"s{k}" for k in range(1, 6)])


@query("""WITH a AS (SELECT l_partkey AS unit_id, CASE WHEN l_suppkey BETWEEN 1 AND 5 THEN l_suppkey ELSE 99 END AS s, l_returnflag AS flag, CASE WHEN l_orderkey % 3 <> 0 THEN l_linestatus END AS status FROM lineitem),
f AS (SELECT unit_id, flag FROM (SELECT unit_id, flag, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, min(s), flag) AS rn FROM a GROUP BY unit_id, flag) WHERE rn = 1),
t AS (SELECT unit_id, status FROM (SELECT unit_id, status, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, min(s), status) AS rn FROM a WHERE status IS NOT NULL GROUP BY unit_id, status) WHERE rn = 1)
SELECT unit_id, f.flag, coalesce(t.status, p.p_type) AS status FROM f LEFT JOIN t USING (unit_id) LEFT JOIN part p ON p.p_partkey = unit_id""")
def voted_attributes(spark, d):
    """Every attribute by its own majority; without votes the value from before stays."""
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_linestatus")).alias("status"))
    before = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.lit(None).cast("string").alias("flag"), F.col("p_type").alias("status"))
    return vote.attributes(a, "unit_id", ["flag", "status"], "site", before, [f"s{k}" for k in range(1, 6)])


# Lineage ---------------------------------------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT c_nationkey AS owner, lower(c_mktsegment) AS canonical_name, count(*) AS n, min(c_custkey) AS f, max(c_custkey) AS l FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL), b AS (SELECT c_nationkey, lower(c_mktsegment), count(*), min(c_custkey), max(c_custkey) FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL),
u AS (SELECT owner // 5 AS owner, canonical_name, n, f, l FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT owner, canonical_name, CAST(sum(n) AS BIGINT) AS occurrence_count, min(f) AS first_seen_at, max(l) AS last_seen_at FROM u GROUP BY ALL""")
def merged_aliases(spark, d):
    """Aliases of old and new adverts added up, after their buildings were merged in fives."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name"), F.lit("x").alias("site"), F.col("c_custkey").alias("seen"))
    old, new = (lineage.rebuild_aliases(c.where(f"seen % 2 = {k}"), "owner", "name", F.lower("name"), "site", "seen") for k in (0, 1))
    moved = lambda df: df.withColumn("owner", F.expr("CAST(owner DIV 5 AS INT)"))
    return lineage.merge_aliases(moved(old), moved(new), "owner").select("owner", "canonical_name", "occurrence_count", "first_seen_at", "last_seen_at")


@query("""WITH m AS (SELECT p_partkey AS unit, p_size AS now_in, p_size % 7 AS merge_id, p_partkey % 5 AS before FROM part WHERE p_partkey % 4 <> 0), h AS (SELECT p_partkey AS unit, p_partkey % 5 AS before FROM part WHERE p_size % 7 = 3)
SELECT m.unit, CASE WHEN h.unit IS NULL THEN CAST(m.now_in AS BIGINT) ELSE h.before END AS building, NULL AS warning FROM m LEFT JOIN h USING (unit) UNION ALL SELECT unit, NULL, 'no longer there: not moved back' FROM h WHERE unit NOT IN (SELECT unit FROM m)""")
def reverted_merge(spark, d):
    """Undo a merge: its units go back to where they were; those that are gone get a warning."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_size").cast("long").alias("building"), (F.col("p_size") % 7).alias("merge_id"), (F.col("p_partkey") % 5).alias("before"))
    back, lost = lineage.revert(p.where("unit % 4 <> 0").select("unit", "building"), p.select("merge_id", "unit", "before"), "unit", "building", 3)
    return back.select("unit", "building", F.lit(None).cast("string").alias("warning")).unionByName(lost.select("unit", F.lit(None).cast("long").alias("building"), "warning"))


@query(f"""SELECT advert_id, coalesce(abs(price - before) / before > 0.7, false) OR price IS NULL AS suspicious, before IS NULL OR coalesce(price <> before, false) OR day < DATE '1998-06-01' AS refetch
FROM (SELECT advert_id, day, CASE WHEN l_linenumber <> 7 THEN price END AS price, CASE WHEN l_orderkey % 10 <> 0 THEN CAST(10 + l_orderkey % 30 AS BIGINT) END AS before FROM {ADVERTS}) WHERE before IS NOT NULL OR price IS NOT NULL""".replace("OR price IS NULL AS suspicious", "OR (before IS NOT NULL AND price IS NULL) AS suspicious"))
def update_guards(spark, d):
    """Updates that are held back, and adverts that must be fetched again."""
    a = adverts(spark, d).select("advert_id", F.col("seen_at"), F.when(F.col("l_linenumber") != 7, F.col("price")).alias("price"), F.when(F.col("l_orderkey") % 10 != 0, 10 + F.col("l_orderkey") % 30).alias("before")).where("before IS NOT NULL OR price IS NOT NULL")
    now = F.lit("1998-08-30").cast("timestamp_ntz")
    return a.select("advert_id", lineage.suspicious(F.col("before"), F.col("price")).alias("suspicious"), lineage.needs_refetch(F.col("before").isNotNull(), F.col("before"), F.col("price"), F.col("seen_at"), now).alias("refetch"))


@query("""WITH p AS (SELECT least(n_nationkey, (n_nationkey * 7 + 3) % 25) AS a, greatest(n_nationkey, (n_nationkey * 7 + 3) % 25) AS b FROM nation WHERE n_nationkey % 3 = 0) SELECT DISTINCT a AS first, b AS second FROM p WHERE a <> b""")
def excluded_pairs(spark, d):
    """Pairs ruled out, each once whatever the order they came in."""
    k = F.col("n_nationkey")
    p = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(lineage.pair_key(k, (k * 7 + 3) % 25).alias("p")).select("p.*")
    return p.where("first <> second").distinct()
