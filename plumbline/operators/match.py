"""Similarity of items and candidates for duplicates: blocking first, cheap rejects next, text similarity last."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions.address import address_parts, block_numbers, haversine
from plumbline.operators import classes
from plumbline.operators.filters import any_of

# Compass neighbours, two characters each.
BESIDE = {"北": "北東北西", "南": "南東南西", "東": "北東南東", "西": "北西南西"}


def _ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 if a side is missing; equal pairs within a batch are compared once."""
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = 1.0 if pair[0] == pair[1] and pair[0] else _ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of tokens; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def shared_prefix(a: Column, b: Column) -> Column:
    """Leading tokens that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))).otherwise(0)


def name_similarity(a: Column, b: Column, known: Column | None = None) -> Column:
    """Names as tokens: 1 if equal; without a shared first token their ratio; else 0.65 at most if one goes on, 0.6 if both go on differently, 0.95 if only blanks differ.

    ``known``: their ratio, where it was found before.
    """
    x, y = F.split(a, r"\s+"), F.split(b, r"\s+")
    p, r = shared_prefix(x, y), ratio(a, b) if known is None else known
    return (
        F.when(a == b, 1.0).when(p == 0, r).when((p < F.size(x)) & (p < F.size(y)), F.least(r, F.lit(0.6))).when((p < F.size(x)) | (p < F.size(y)), F.least(r, F.lit(0.65))).otherwise(0.95)
    )


def same_building(name: Column, address: Column) -> Column:
    return 0.7 * name + 0.3 * address >= 0.85


def attribute_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted mean of what both sides know (0 and NULL are unknown); 0.5 if nothing can be compared.

    Built year, weight 2: the same year 0.7, with the same month 1, with another 0.3; a year apart 0.2, two 0.1. Floors, 0.8: by
    their gap of 0, 1, 5, 10, 20 and more. Structure, 0.5: equal 1, else 0.5. Sides: year, month, floors, structure.
    """
    said = lambda k: (a[k] != 0) & (b[k] != 0)
    gap, tall = F.abs(a["year"] - b["year"]), F.abs(a["floors"] - b["floors"])
    month = F.when(said("month") & (a["month"] == b["month"]), 1.0).when(said("month"), 0.3).otherwise(0.7)
    steps = F.when(tall == 0, 1.0).when(tall == 1, 0.8).when(tall <= 5, 0.5).when(tall <= 10, 0.3).when(tall <= 20, 0.2).otherwise(0.1)
    parts = [
        (2.0, F.when(said("year"), F.when(gap == 0, month).when(gap == 1, 0.2).when(gap == 2, 0.1).otherwise(0.0))),
        (0.8, F.when(said("floors"), steps)),
        (0.5, F.when((a["structure"] != "") & (b["structure"] != ""), F.when(a["structure"] == b["structure"], 1.0).otherwise(0.5))),
    ]
    total = sum((F.coalesce(s * w, F.lit(0.0)) for w, s in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for w, s in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.5)


def building_similarity(name: Column, address: Column, attributes: Column, year_gap: Column) -> Column:
    """Similarity of two buildings from its three parts; ``address`` is 0 if unknown.

    Built more than two years apart: 0.3. Then, in order: address and attributes agree (0.95 and 0.9): 0.95, with very different
    names 0.92; name and address agree (0.85, 0.8): the larger; only the name differs (address 0.9, attributes 0.8): 0.85;
    without an address, name and attributes agree (0.9, 0.8): 0.85. Else 40 address, 30 name, 30 attributes, or 60 and 40.
    """
    return (
        F.when(year_gap > 2, 0.3)
        .when((address >= 0.95) & (attributes >= 0.9), F.when(name < 0.3, 0.92).otherwise(0.95))
        .when((name >= 0.85) & (address >= 0.8), F.greatest(name, address))
        .when((name < 0.5) & (address >= 0.9) & (attributes >= 0.8), 0.85)
        .when((address == 0) & (name >= 0.9) & (attributes >= 0.8), 0.85)
        .when(address > 0, 0.4 * address + 0.3 * name + 0.3 * attributes)
        .otherwise(0.6 * name + 0.4 * attributes)
    )


def _equal_places(x: Column, y: Column, n: Column) -> Column:
    """How many of the first ``n`` numbers of two arrays are equal, place by place."""
    return F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) == F.element_at(y, i)))


def address_ladder(a: Column, b: Column) -> Column:
    """Similarity of two normalized addresses, 0 if one is missing or empty.

    Equal 1. Both with a block: by its numbers, other first number 0.3 in the same area, else 0.1; one the beginning of the
    other 0.85, 0.9 or 0.93 for one, two or more common numbers; another number later 0.4. One block only: 0.75 in the
    same area, else 0.3. No block: the ratio of the texts.
    """
    p, q = address_parts(a), address_parts(b)
    x, y = block_numbers(p["block"]), block_numbers(q["block"])
    area = p["prefecture"].eqNullSafe(q["prefecture"]) & p["city"].eqNullSafe(q["city"]) & p["area"].eqNullSafe(q["area"])
    short = F.least(F.size(x), F.size(y))
    same = _equal_places(x, y, short) == short
    both = (
        F.when(F.get(x, 0) != F.get(y, 0), F.when(area, 0.3).otherwise(0.1))
        .when(same & (F.size(x) == F.size(y)), 0.95)
        .when(same, F.when(short == 1, 0.85).when(short == 2, 0.9).otherwise(0.93))
        .otherwise(0.4)
    )
    one = F.when(area, 0.75).otherwise(0.3)
    known = F.coalesce((a != "") & (b != ""), F.lit(False))
    n_blocks = p["block"].isNotNull().cast("int") + q["block"].isNotNull().cast("int")
    return F.when(~known, 0.0).when(a == b, 1.0).when(n_blocks == 2, both).when(n_blocks == 1, one).otherwise(ratio(a, b))


def address_grade(a: Column, b: Column) -> Column:
    """0 to 100 for two normalized addresses: 0 if one is missing or a part that both name differs.

    Equal addresses or blocks 100; blocks with the same first number 90, with the second one the same too 100, else 80; one
    block only 80; no blocks 70, or, if no part is even missing on both sides, 60, 50 or 40 for one text within the other.
    """
    p, q = address_parts(a), address_parts(b)
    names = ["prefecture", "city", "ward", "town", "area"]
    differs = any_of([F.coalesce(p[k] != q[k], F.lit(False)) for k in names])
    x, y = block_numbers(p["block"]), block_numbers(q["block"])
    blocks = F.when(p["block"] == q["block"], 100).when(F.get(x, 0) != F.get(y, 0), 80).when(F.get(x, 1) == F.get(y, 1), 100).otherwise(90)
    share = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    within = F.when(a.contains(b) | b.contains(a), F.when(share >= 0.8, 60).when(share >= 0.6, 50).otherwise(40)).otherwise(0)
    level = any_of([p[k].eqNullSafe(q[k]) for k in names])
    none, both = p["block"].isNull() & q["block"].isNull(), p["block"].isNotNull() & q["block"].isNotNull()
    known = F.coalesce((a != "") & (b != ""), F.lit(False))
    return F.when(~known, 0).when(a == b, 100).when(differs, 0).when(both, blocks).when(~none, 80).when(level, 70).otherwise(within)


def name_priority(wanted: Column, name: Column) -> Column:
    """struct(priority, score): equal 1, 100; one the beginning of the other 2, 80 to 95; one within the other 3, 50 to 75; else 4, 0."""
    r = F.least(F.length(wanted), F.length(name)) / F.greatest(F.length(wanted), F.length(name))
    head, inside = wanted.startswith(name) | name.startswith(wanted), wanted.contains(name) | name.contains(wanted)
    rank = F.when(wanted == name, 1).when(head, 2).when(inside, 3).otherwise(4)
    return F.struct(rank.alias("priority"), F.when(wanted == name, 100.0).when(head, 80 + 15 * r).when(inside, 50 + 25 * r).otherwise(0.0).alias("score"))


def names_overlap(a: Column, b: Column) -> Column:
    """Equal, one within the other, or five or more characters in common at the start."""
    return F.coalesce((a != "") & (b != "") & (a.contains(b) | b.contains(a) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5))))), F.lit(False))


def building_score(address: Column, strict: Column, flexible: Column, name: Column) -> Column:
    """0 to 100: 40 % address, 30 % attributes (100 strictly equal, 70 within tolerance, else 0), 30 % name."""
    attribute = F.when(strict, 100.0).when(flexible, 70.0).otherwise(0.0)
    return 0.4 * address + 0.3 * attribute + 0.3 * F.coalesce(name, F.lit(0.0))


def ambiguous_names(wanted: DataFrame, buildings: DataFrame, key: str, name: str, address: str, building_name: str, building_address: str) -> DataFrame:
    """(key, at_address, matching, is_ambiguous): a name that two or more buildings at its address begin with, or begin.

    Buildings with one name at one address are counted before the join.
    """
    b = buildings.groupBy(F.col(building_address).alias("_a"), F.col(building_name).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    hit = F.col("_n").startswith(F.col(name)) | F.col(name).startswith(F.col("_n"))
    j = wanted.select(key, name, address).join(b, F.col(address) == F.col("_a"), "left").groupBy(key).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("at_address"), F.coalesce(F.sum(F.when(hit, F.col("_c"))), F.lit(0)).alias("matching"))
    return j.withColumn("is_ambiguous", (F.col("at_address") >= 2) & (F.col("matching") >= 2))


#: Adverts are dealt over tasks of about so many, so that a task's memory does not grow with the table.
DEALT = 200_000


def fallback_match(adverts: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """(key, building_id, unit_id): a unit of another building with the same total floors, built year, floor, area and price whose
    address begins with the advert's; the smallest building, then unit. What is missing or 0 matches nothing.

    Both: building_id, address, total_floors, built_year, floor, area, price; listings also unit_id, active ones only. An advert
    leaves out no building but its own, so the two smallest buildings of every place decide: places are compared, not adverts.
    """
    same = ["total_floors", "built_year", "floor", "area", "price"]
    at = [*same, "address"]
    known = " AND ".join(f"{c} <> 0" for c in same) + " AND address <> '' AND building_id IS NOT NULL"
    # the area as text: fractional keys are rewritten in joins, and would be shuffled once more
    rows = lambda df, name: df.where(known).select(*same, "address", "building_id", name).withColumn("area", F.col("area").cast("double").cast("string"))
    wanted, held = rows(adverts, key), rows(listings, "unit_id")
    n = int(min(20_000, max(wanted.count(), held.count()) // DEALT + 1))

    def two(df: DataFrame) -> DataFrame:
        """The two smallest buildings of a place, each with its smallest unit."""
        least = df.groupBy(*at, "building_id").agg(F.min("unit_id").alias("unit_id"))
        return least.withColumn("_r", F.row_number().over(Window.partitionBy(*at).orderBy("building_id"))).where("_r <= 2")

    offered = two(held.repartition(n, *at)).select(*same, F.col("address").alias("_held"), "building_id", "unit_id").repartition(n, *same)
    asked = wanted.select(*at).distinct().repartition(n, *same)
    met = two(asked.join(offered, same).where(F.col("_held").startswith(F.col("address"))).select(*at, "building_id", "unit_id"))
    of = lambda r: F.max(F.when(F.col("_r") == r, F.struct("building_id", "unit_id"))).alias(f"_{r}")
    best = met.groupBy(*at).agg(of(1), of(2)).repartition(n, *at)
    own = F.col("building_id")
    hit = F.when(F.col("_1.building_id") != own, F.col("_1")).otherwise(F.col("_2"))
    found = wanted.repartition(n, *at).join(best, at).select(key, hit.alias("_b")).where("_b IS NOT NULL").select(key, "_b.building_id", "_b.unit_id")
    # a key may be in several rows
    smallest = F.min(F.struct("building_id", F.col("unit_id").isNull(), "unit_id")).alias("_b")
    return found.repartition(n, key).groupBy(key).agg(smallest).select(key, "_b.building_id", "_b.unit_id")


def learned_values(merged: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, learned): values that merged units of one kind had, where there were several: they count as equal from then on."""
    sets = merged.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("learned"))
    return sets.where(F.size("learned") > 1)


def learned_suggestions(units: DataFrame, merged: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """(a, b, score): units of a building's floor that history lets one expect to be the same: area within 0.5 counts 0.4, and 0.3
    each for directions and layouts that were merged before under the target's (a's) own floor, area and layout or direction.

    Without the area no pair reaches 0.7, so it is the join's condition; pairs go in both directions. Both: building_id, floor,
    area, layout, direction.
    """
    by_layout, by_direction = ["building_id", "floor", "area", "layout"], ["building_id", "floor", "area", "direction"]
    d = learned_values(merged, by_layout, "direction").withColumnRenamed("learned", "_directions")
    y = learned_values(merged, by_direction, "layout").withColumnRenamed("learned", "_layouts")
    # units equal in all of it are one class: the classes are compared, and pairs of units told out at the end
    by = ["building_id", "floor", "area", "layout", "direction"]
    rows = units.where(F.col(key).isNotNull())
    found = classes.found(rows, by)
    known = found.join(d, by_layout, "left").join(y, by_direction, "left").where("_directions IS NOT NULL OR _layouts IS NOT NULL")
    cell = F.floor(F.col("area") / 0.5)
    a = known.select(F.col("class").alias("a_class"), F.col("n").alias("a_n"), "building_id", "floor", F.col("area").alias("_area"), F.col("layout").alias("_l"), F.col("direction").alias("_d"), "_directions", "_layouts", F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell"))
    b = found.withColumn("_cell", cell).withColumnsRenamed({"class": "b_class", "n": "b_n"})
    j = a.join(b, ["building_id", "floor", "_cell"]).where(F.abs(F.col("_area") - F.col("area")) <= 0.5)
    has = lambda learned, x, z: F.coalesce(F.array_contains(learned, F.col(x)) & F.array_contains(learned, F.col(z)), F.lit(False)).cast("int")
    tenths = 4 + 3 * has(F.col("_directions"), "_d", "direction") + 3 * has(F.col("_layouts"), "_l", "layout")
    scored = j.withColumn("score", tenths / 10).where(F.col("score") >= least).select("a_class", "a_n", "b_class", "b_n", "score")
    members = classes.parts(rows, key, by, found)
    return classes.told(scored, members, members, ["score"], F.col("a") != F.col("b"))


def move_building_score(equal: Column, group: Column, part: Column, address: Column, year: Column, floors: Column) -> Column:
    """Points of a building that a unit may be moved to: name 15, 8 for another wing, 5 for a part; address 5 (equal, a boolean) or 3
    (partly: NULL), year 5, floors 5."""
    return F.when(equal, 15).when(group, 8).when(part, 5).otherwise(0) + F.when(address, 5).when(address.isNull(), 3).otherwise(0) + F.when(year, 5).otherwise(0) + F.when(floors, 5).otherwise(0)


def move_unit_score(a: dict[str, Column], b: dict[str, Column], suggested: Column) -> Column:
    """Points of a unit that an advert may be moved to: building suggested 10, floor 5, area within 0.5 5, layout 3, direction 3, room 2.

    Two missing values agree, but for areas.
    """
    same = lambda k: a[k].eqNullSafe(b[k])
    points = [(suggested, 10), (same("floor"), 5), (F.abs(a["area"] - b["area"]) <= 0.5, 5), (same("layout"), 3), (same("direction"), 3), (same("room"), 2)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def advert_building_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Points of a building with an advert's name: address 50 or, one within the other, 20; floors 20, within one 10; units 15, within
    five 5; year 15, within one 5. From 20 points on it is suggested."""
    said = lambda k: (a[k] != 0) & (b[k] != 0)
    near = lambda k, n, full, part: F.when(said(k) & (a[k] == b[k]), full).when(said(k) & (F.abs(a[k] - b[k]) <= n), part).otherwise(0)
    x, y = a["address"], b["address"]
    place = F.when(x == y, 50).when(x.contains(y) | y.contains(x), 20).otherwise(0)
    return place + near("floors", 1, 20, 10) + near("units", 5, 15, 5) + near("year", 1, 15, 5)


#: Spellings of directions and of single rooms that count as one.
DIRECTION_KEYS = {"東": ["東", "E", "EAST", "東向き"], "西": ["西", "W", "WEST", "西向き"], "南": ["南", "S", "SOUTH", "南向き"], "北": ["北", "N", "NORTH", "北向き"], "南東": ["南東", "SE", "SOUTHEAST", "東南"], "南西": ["南西", "SW", "SOUTHWEST", "西南"], "北東": ["北東", "NE", "NORTHEAST", "東北"], "北西": ["北西", "NW", "NORTHWEST", "西北"]}
ONE_ROOM = ["ワンルーム", "1ルーム", "1ROOM", "スタジオ", "STUDIO"]


def direction_key(c: Column) -> Column:
    """One spelling for each direction; others stay, empty is NULL."""
    t = F.nullif(F.trim(c), F.lit(""))
    out = t
    for key, spellings in DIRECTION_KEYS.items():
        out = F.when(t.isin(spellings), key).otherwise(out)
    return out


def layout_key(c: Column) -> Column:
    """Layouts for comparison: upper case, no blanks, single rooms as 1R, +S as SLDK, other small rooms dropped; empty is NULL."""
    t = F.regexp_replace(F.upper(F.nullif(F.trim(c), F.lit(""))), r"\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\+(?:WIC|SIC|N)$", ""), r"^(\d+)LDK\+S$", "$1SLDK")
    return F.when(t.isin(ONE_ROOM), "1R").otherwise(t)


def keyed_units(df: DataFrame, layout: str = "layout", direction: str = "direction") -> DataFrame:
    """Units with layout and direction in one spelling, and ``rooms``, the number in the layout: once per unit, before pairs are made."""
    keyed = df.withColumns({layout: layout_key(F.col(layout)), direction: direction_key(F.col(direction))})
    return keyed.withColumn("rooms", F.nullif(F.regexp_extract(layout, r"(\d+)", 1), F.lit("")))


def unit_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Similarity of two ``keyed_units`` of a building, at most 1: points over 100.

    Floor: equal 30, missing on a side 15, different: the score is 0. Area: within 0.5 30, within 1 20, else 5; missing 15. Layout:
    equal 25, the same number of rooms 15; missing 12. Direction: equal 15, beside it 10; missing 10. Rooms: equal +20,
    different -10. Balconies within 0.5: +5. Sides: floor, area, layout, rooms, direction, room and, if known, balcony.
    """
    gap = F.abs(a["area"] - b["area"])
    x, y, p, q = a["layout"], b["layout"], a["direction"], b["direction"]
    pairs = [k + n for k, near in BESIDE.items() for n in (near[:2], near[2:])]
    beside = F.concat(p, q).isin([*pairs, *(n + k for k, near in BESIDE.items() for n in (near[:2], near[2:]))])
    points = (
        F.when(a["floor"] == b["floor"], 30).otherwise(15)
        + F.when(gap <= 0.5, 30).when(gap <= 1.0, 20).when(gap.isNotNull(), 5).otherwise(15)
        + F.when(x == y, 25).when(a["rooms"] == b["rooms"], 15).when(x.isNotNull() & y.isNotNull(), 0).otherwise(12)
        + F.when(p == q, 15).when(beside, 10).when(p.isNotNull() & q.isNotNull(), 0).otherwise(10)
        + F.when((a["room"] != "") & (a["room"] == b["room"]), 20).when((a["room"] != "") & (b["room"] != ""), -10).otherwise(0)
    )
    if "balcony" in a:
        points = points + F.when(F.abs(a["balcony"] - b["balcony"]) <= 0.5, 5).otherwise(0)
    return F.when(a["floor"] != b["floor"], 0.0).otherwise(F.least(points / 100.0, F.lit(1.0)))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.95, "high").when(score >= 0.85, "medium").when(score >= 0.75, "low")


def block_pairs(df: DataFrame, key: str, blocks: list[str], near: dict[str, float] | None = None) -> DataFrame:
    """Pairs a.key < b.key that agree on all ``blocks`` (NULL agrees with nothing) and lie within ``near`` of each other.

    The first ``near`` column is cut into cells as wide as its tolerance, and each row meets its own and the neighbouring
    cells only, so a block with very many rows is not compared with itself as a whole.
    """
    a, b = classes.side(df, "a"), classes.side(df, "b")
    return _met(a, b, blocks, near).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def _met(a: DataFrame, b: DataFrame, blocks: list[str], near: dict[str, float] | None) -> DataFrame:
    """The sides a and b joined where they agree on all ``blocks`` and lie within ``near``."""
    cond = F.lit(True)
    for c in blocks:
        cond = cond & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    for k, (c, tolerance) in enumerate((near or {}).items()):
        if k == 0:
            cell = lambda side: F.floor(F.col(f"{side}_{c}") / tolerance)  # noqa: B023, E731
            a = a.withColumn("_cell", cell("a"))
            b = b.withColumn("_cell_b", F.explode(F.sequence(cell("b") - 1, cell("b") + 1)))
            cond = cond & (F.col("_cell") == F.col("_cell_b"))
        cond = cond & (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance)
    return a.join(b, cond).drop("_cell", "_cell_b")


def class_pairs(df: DataFrame, key: str, blocks: list[str], near: dict[str, float] | None = None, hit: Column | None = None, both: bool = False, **scores: Column) -> DataFrame:
    """(a, b, scores): the pairs of ``block_pairs``, ``both``: in both orders, for which ``hit`` holds.

    ``hit`` and scores are made of a_ and b_ columns of ``df`` without its key. Rows equal in all but the key are one class:
    classes are compared, and pairs of rows told out at the end. Where most rows are a class of their own they are compared.
    """
    hit = F.lit(True) if hit is None else hit
    order = lambda a, b: F.col(a) != F.col(b) if both else F.col(a) < F.col(b)
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, *blocks)))
    by = [c for c in df.columns if c != key]
    found = classes.found(rows, by)
    several = found.agg((F.sum("n") >= 2 * F.count(F.lit(1))).alias("several")).first()["several"]
    named = [c.alias(k) for k, c in scores.items()]
    if not several:
        met = _met(classes.side(rows, "a"), classes.side(rows, "b"), blocks, near)
        return met.where(hit & order(f"a_{key}", f"b_{key}")).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), *named)
    met = _met(classes.side(found, "a"), classes.side(found, "b"), blocks, near).where(hit)
    members = classes.parts(rows, key, by, found)
    return classes.told(met.select("a_class", "a_n", "b_class", "b_n", *named), members, members, list(scores), order("a", "b"))


def without_excluded(pairs: DataFrame, excluded: DataFrame, left: str, right: str, first: str, second: str) -> DataFrame:
    """Pairs but those that were ruled out, in either order."""
    out = excluded.select(F.least(first, second).alias("_x"), F.greatest(first, second).alias("_y")).distinct()
    return pairs.join(out, (F.least(left, right) == F.col("_x")) & (F.greatest(left, right) == F.col("_y")), "left_anti")


def duplicate_groups(df: DataFrame, key: str, by: dict[str, Column], excluded: DataFrame | None = None, first: str = "property1_id", second: str = "property2_id") -> DataFrame:
    """Groups of two rows or more that are equal in all of ``by`` (NULL equals NULL): ``n`` and ``first_id``; without groups that hold an excluded pair.

    No group is gathered: rows are counted, and only the ends of excluded pairs are looked up.
    """
    rows = df.withColumns(by)
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")
    if excluded is None:
        return groups
    end = lambda name, tag: rows.select(F.col(key).alias(name), F.struct(*by).alias(tag))
    hit = excluded.join(end(first, "_g"), first).join(end(second, "_h"), second).where(F.col("_g").eqNullSafe(F.col("_h"))).select(*(F.col(f"_g.{c}").alias(f"_x_{c}") for c in by)).distinct()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_x_{c}"))
    return groups.join(hit, same, "left_anti")


def nearby(points: DataFrame, key: str, lat: str, lon: str, metres: float) -> DataFrame:
    """(a, b, metres): pairs within a distance, by an equi join on grid cells and the exact distance."""
    step = metres / 111_000.0
    rows = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    # a cell of longitude is as wide as the distance at the row's own band of latitude, and half as wide again for the band beside it
    rows = rows.withColumn("_y", F.floor(F.col("lat") / step))
    around = rows.select(F.col(key).alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)).alias("_y"))
    width = lambda y: F.lit(step) / F.greatest(F.lit(0.01), F.least(F.cos(F.radians(y * step)), F.cos(F.radians((y + 1) * step)))) * 1.001
    a = rows.withColumn("_x", F.floor(F.col("lon") / width(F.col("_y")))).withColumnRenamed(key, "a")
    b = around.withColumn("_x0", F.floor(F.col("lon2") / width(F.col("_y")))).withColumn("_x", F.explode(F.sequence(F.col("_x0") - 1, F.col("_x0") + 1))).drop("_x0")
    d = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["_y", "_x"]).where("a < b").withColumn("metres", d).where(F.col("metres") <= metres).select("a", "b", "metres")


def match_unit(adverts: DataFrame, units: DataFrame, advert: str, unit: str) -> DataFrame:
    """(advert, unit, confidence): the unit of an advert by building, floor, layout and direction (NULL only meets NULL) and area within 0.5.

    Among several: the same room number, then a unit without one, then the smallest id; confidence 0.9, 0.7, 0.6, and
    0.3 if several are left on the last rung.
    """
    # adverts that say the same are one class, and so are units: rungs are counted by classes, and added up for each advert
    own = ["building_id", "floor_number", "layout", "direction", "area"]
    wanted = classes.found(adverts, [*own, "room_number"])
    held = units.groupBy(*(F.col(c).alias(f"u_{c}") for c in own), F.col("room_number").alias("u_room_number")).agg(F.min(unit).alias("_first"), F.count(F.lit(1)).alias("_units"))
    cond = F.col("building_id") == F.col("u_building_id")
    for c in ("floor_number", "layout", "direction"):
        cond = cond & F.col(c).eqNullSafe(F.col(f"u_{c}"))
    joined = wanted.join(held, cond & ((F.abs(F.col("area") - F.col("u_area")) <= 0.5) | (F.col("area").isNull() & F.col("u_area").isNull())))
    rung = F.when(F.col("room_number") == F.col("u_room_number"), 1).when(F.col("u_room_number").isNull() | F.col("room_number").isNull(), 2).otherwise(3)
    on = lambda k, c: F.when(F.col("_rung") == k, F.col(c))
    rungs = joined.withColumn("_rung", rung).groupBy("class").agg(*(F.sum(on(k, "_units")).alias(f"_n{k}") for k in (1, 2, 3)), *(F.min(on(k, "_first")).alias(f"_f{k}") for k in (1, 2, 3)))
    rows = classes.of_rows(adverts, advert, [*own, "room_number"], wanted).join(rungs, "class")
    out = rows.groupBy(F.col("key").alias(advert)).agg(*(F.sum(f"_n{k}").alias(f"_n{k}") for k in (1, 2, 3)), *(F.min(f"_f{k}").alias(f"_f{k}") for k in (1, 2, 3)))
    grade = F.when(F.col("_n1") > 0, 0.9).when(F.col("_n2") == 1, 0.7).when(F.col("_n2").isNull() & (F.col("_n3") == 1), 0.6).otherwise(0.3)
    return out.select(advert, F.when(F.col("_n1") > 0, F.col("_f1")).when(F.col("_n2") > 0, F.col("_f2")).otherwise(F.col("_f3")).alias(unit), grade.alias("confidence"))


def staged_lookup(stages: list[DataFrame], key: str, candidate: str, score: str, least_gap: float = 5.0) -> DataFrame:
    """Per key the best candidate of the first stage that has any; held back if the two best are closer than ``least_gap``."""
    rows = None
    for k, s in enumerate(stages):
        part = s.select(key, candidate, score, F.lit(k).alias("_stage"))
        rows = part if rows is None else rows.unionByName(part)
    w = Window.partitionBy(key)
    rows = rows.withColumn("_first", F.min("_stage").over(w)).where("_stage = _first")
    ranked = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc(score), candidate))).withColumn("_next", F.lead(score).over(w.orderBy(F.desc(score), candidate)))
    return ranked.where("_r = 1").select(key, candidate, score, (F.col("_next").isNotNull() & (F.col(score) - F.col("_next") < least_gap)).alias("held_back"))


def attested(df: DataFrame, key: str, value: str, least: int = 3, share: float = 0.05) -> DataFrame:
    """Values of a key that occur ``least`` times and in ``share`` of its rows."""
    total = Window.partitionBy(key)
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("_all", F.sum("n").over(total)).where((F.col("n") >= least) & (F.col("n") >= share * F.col("_all"))).drop("_all")


def first_of_lists(lists: list[DataFrame], key: str) -> DataFrame:
    """The rows of several lists, each id once: from the first list that has it."""
    rows = None
    for k, df in enumerate(lists):
        part = df.withColumn("matched_by", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("matched_by"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")
