"""Buildings of adverts: found in stages, or made; the registry grows by them and is only ever filled where it has gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.address import address_parts, block_numbers
from plumbline.operators.ranking import bucketed_prefix
from plumbline.operators.similar import alias_scores, contained_pairs
from plumbline.runtime import broadcast_checked, stage

#: What an advert and a building may say about themselves.
FACTS = ["floors", "year", "month", "units"]
#: Candidates whose addresses score less are none; two best candidates nearer than this are held back in an ambiguous search.
LEAST_ADDRESS, LEAST_GAP = 40, 5.0


def address_points(a: Column, b: Column) -> Column:
    """How well two normalized addresses agree, 0 to 100; 0 if one is missing or a named part differs.

    Equal 100. By the numbers of their blocks: both first ones 100, the first only 90, none 80; one without a block 80; no
    blocks: 70 if any part is the same (or missing on both sides), else by how much of the longer one holds the other: 60, 50, 40.
    """
    p, q = address_parts(a), address_parts(b)
    named = ["prefecture", "city", "ward", "town", "area"]
    clash = reduce(lambda x, y: x | y, (F.coalesce((p[k] != "") & (q[k] != "") & (p[k] != q[k]), F.lit(False)) for k in named))
    alike = reduce(lambda x, y: x | y, (p[k].eqNullSafe(q[k]) for k in named))
    x, y = block_numbers(p["block"]), block_numbers(q["block"])
    by_block = F.when(p["block"] == q["block"], 100).when(F.get(x, F.lit(0)) != F.get(y, F.lit(0)), 80).when(F.get(x, F.lit(1)) == F.get(y, F.lit(1)), 100).otherwise(90)
    part = F.least(F.char_length(a), F.char_length(b)) / F.greatest(F.char_length(a), F.char_length(b))
    inside = F.when(a.contains(b) | b.contains(a), F.when(part >= 0.8, 60).when(part >= 0.6, 50).otherwise(40)).otherwise(0)
    blocks = p["block"].isNotNull().cast("int") + q["block"].isNotNull().cast("int")
    points = F.when(a == b, 100).when(clash, 0).when(blocks == 2, by_block).when(blocks == 1, 80).when(alike, 70).otherwise(inside)
    return F.when((a != "") & (b != ""), points).otherwise(0)


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def strictly_agree(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Nothing that both know differs."""
    return ~reduce(lambda x, y: x | y, (_differs(a[k], b[k]) for k in FACTS))


def tolerably_agree(a: dict[str, Column], b: dict[str, Column], date_attested: Column, units_attested: Column) -> Column:
    """Whether what both know agrees, with tolerance.

    Floors must be equal; years too, unless the building's adverts have often said this date. With fewer than two points to
    compare that is enough. Otherwise months and units must be equal (or units often said), or: floors and units agree and
    the months are one apart; floors or the date agree and the units are at most two apart.
    """
    known = {k: a[k].isNotNull() & b[k].isNotNull() for k in FACTS}
    floors = known["floors"] & (a["floors"] == b["floors"])
    year = known["year"] & (a["year"] == b["year"])
    late = year & known["month"] & (a["month"] != b["month"])
    date = year & ~late
    old = known["year"] & (a["year"] != b["year"])
    more = known["units"] & (a["units"] != b["units"])
    said_units = (known["units"] & ~more) | (more & units_attested)
    wrong_units = more & ~units_attested
    points = floors.cast("int") + (date | (old & date_attested)).cast("int") + said_units.cast("int")
    near_month = floors & said_units & late & (F.abs(a["month"] - b["month"]) <= 1)
    near_units = (floors | date) & wrong_units & (F.abs(a["units"] - b["units"]) <= 2)
    excluded = _differs(a["floors"], b["floors"]) | (old & ~date_attested)
    return F.coalesce(~excluded & ((points < 2) | ~(late | wrong_units) | near_month | near_units), F.lit(False))


def _sides(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in FACTS}


#: What candidates are found by; searches that agree in it have the same ones.
PLACE = ["name", "address", "ambiguous"]


def _met(found: DataFrame, buildings: DataFrame, scores: DataFrame) -> DataFrame:
    """(PLACE, id) with what the building says of itself, the score of its name and address points; two addresses are compared once."""
    j = stage(found.distinct().join(buildings.select("id", F.col("address").alias("b_address"), *(F.col(k).alias(f"b_{k}") for k in FACTS)), "id"), "met")
    points = j.select("address", "b_address").distinct().withColumn("points", address_points(F.col("address"), F.col("b_address")))
    return j.join(stage(points, "points"), ["address", "b_address"]).join(scores, ["name", "ambiguous", "id"], "left")


def _judged(met: DataFrame, asked: DataFrame, attested: DataFrame | None) -> DataFrame:
    """(ask, id) with address points, agreement and the whole score: 40 % address, 30 % attributes, 30 % name."""
    j = asked.join(broadcast_checked(stage(met, "judged"), 1_000_000), PLACE)
    dated, counted = F.lit(False), F.lit(False)
    if attested is not None:
        # (id, kind, year, month, units): what adverts of the building often said
        dates = attested.where("kind = 'date'").select("id", "year", F.col("month").alias("_m"), F.lit(True).alias("_d"))
        units = attested.where("kind = 'units'").select("id", "units", F.lit(True).alias("_u"))
        hit = dates.join(j.select("ask", "id", "year", "month"), ["id", "year"]).where("month IS NULL OR month = _m").select("ask", "id").distinct().withColumn("_d", F.lit(True))
        j = j.join(hit, ["ask", "id"], "left").join(units, ["id", "units"], "left")
        dated, counted = F.coalesce("_d", F.lit(False)), F.coalesce("_u", F.lit(False))
    strict, fair = strictly_agree(_sides(""), _sides("b_")), tolerably_agree(_sides(""), _sides("b_"), dated, counted)
    j = j.withColumns({"strict": strict, "fair": fair})
    return j.withColumn("total", F.col("points") * 0.4 + F.when(F.col("strict"), 30.0).when(F.col("fair"), 21.0).otherwise(0.0) + F.coalesce("score", F.lit(0.0)) * 0.3)


def _best(rows: DataFrame, how: str, hold: bool) -> DataFrame:
    """(ask, id, how): the highest total, the smaller id of equal ones; none if an ambiguous search has two within the gap.

    Candidates of a search are added up where they are; only those of ambiguous searches are brought together, for the second best.
    """
    top = lambda df: df.groupBy("ask").agg((-F.max(F.struct("total", (-F.col("id")).alias("id")))["id"]).alias("id")).select("ask", "id", F.lit(how).alias("how"))
    if not hold:
        return top(rows)
    w = Window.partitionBy("ask").orderBy(F.desc("total"), "id")
    ranked = rows.where("ambiguous").withColumn("_next", F.lead("total").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    near = F.coalesce(F.col("total") - F.col("_next") < LEAST_GAP, F.lit(False))
    return top(rows.where("NOT ambiguous")).unionByName(ranked.where(~near).select("ask", "id", F.lit(how).alias("how")))


def staged_lookup(asked: DataFrame, buildings: DataFrame, aliases: DataFrame, attested: DataFrame | None = None) -> DataFrame:
    """(ask, id, how): the building of each search, from the first stage that settles it; no row if none does.

    asked (ask, name, address and FACTS), buildings (id, name, address and FACTS), aliases (id, alias, n). Without a name or an
    address nothing is found. name: equal names, tolerable attributes. alias: an equal alias (or, in an ambiguous search, a
    building at the same address whose name begins alike), an address that goes on from the other, agreeing attributes.
    partial: one name in the other and one address in the other. A search is ambiguous if two buildings at its address have
    names that begin with it or begin it; then the two later stages settle nothing if the two best are near each other.
    Each stage looks only for what those before it left. All candidates are judged.
    """
    asked = stage(asked.where("name <> '' AND address <> ''"), "asked")
    known = stage(buildings.where("name <> '' AND address <> ''"), "registered")
    names = known.groupBy("address", F.col("name").alias("b_name")).agg(F.count(F.lit(1)).alias("n"))
    begins = asked.select("name", "address").distinct().join(names, "address").where(F.col("b_name").startswith(F.col("name")) | F.col("name").startswith(F.col("b_name")))
    unsure = begins.groupBy("name", "address").agg(F.sum("n").alias("_n")).where("_n >= 2").select("name", "address", F.lit(True).alias("ambiguous"))
    asked = stage(asked.join(unsure, ["name", "address"], "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False))), "searches")
    # names are scored, and candidates found, once for all searches that agree in what counts for it
    said = asked.select("name", "ambiguous").distinct().withColumn("said", F.struct("name", "ambiguous"))
    scores = stage(alias_scores(said, aliases, "said", "name", "alias", "n", "id", "ambiguous").select("said.name", "said.ambiguous", "id", "score"), "name_scores")
    places = lambda rows: stage(rows.select(*PLACE).distinct(), "places")

    by_name = _met(places(asked).join(known.select("id", "name"), "name").select(*PLACE, "id"), known, scores).where(F.col("points") >= LEAST_ADDRESS)
    first = stage(_best(_judged(by_name, asked, attested).where("fair"), "name", False), "by_name")
    rest = stage(asked.join(first, "ask", "left_anti"), "left")
    left = places(rest)
    alias = left.join(aliases.select("id", F.col("alias").alias("name")).distinct(), "name").select(*PLACE, "id")
    beside = left.where("ambiguous").join(known.select("id", "address", F.col("name").alias("b_name")), "address").where(F.col("b_name").startswith(F.col("name")) | F.col("name").startswith(F.col("b_name"))).select(*PLACE, "id")
    goes_on = F.col("b_address").startswith(F.col("address")) | F.col("address").startswith(F.col("b_address"))
    second = stage(_best(_judged(_met(alias.unionByName(beside), known, scores).where(goes_on), rest, attested).where(F.col("strict") | F.col("fair")), "alias", True), "by_alias")
    rest = stage(rest.join(second, "ask", "left_anti"), "left")
    left = places(rest)
    inner = contained_pairs(left, known, "name", "name").select(F.col("inner").alias("name"), F.col("outer").alias("b_name"))
    outer = contained_pairs(known, left, "name", "name").select(F.col("outer").alias("name"), F.col("inner").alias("b_name"))
    near = left.join(inner.unionByName(outer).distinct(), "name").join(known.select("id", F.col("name").alias("b_name"), F.col("address").alias("b_address")), "b_name")
    near = near.where(F.col("address").contains(F.col("b_address")) | F.col("b_address").contains(F.col("address"))).select(*PLACE, "id")
    third = _best(_judged(_met(near, known, scores).where(F.col("points") >= LEAST_ADDRESS), rest, attested), "partial", True)
    return first.unionByName(second).unionByName(third)


def _first_said(names: list[str]) -> list[Column]:
    """Per group and fact what the row with the smallest ``key`` says, of those that say anything."""
    return [F.min_by(n, F.when(F.col(n).isNotNull(), F.col("key"))).alias(n) for n in names]


def find_or_create(adverts: DataFrame, buildings: DataFrame, external: DataFrame, aliases: DataFrame, attested: DataFrame | None = None, buckets: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assignments (key, id, how), the new registry of buildings and the new external ids (site, external_id, id).

    adverts (key, site, external_id, name, address, FACTS). An advert whose external id belongs to a building is its; entries of
    buildings that are gone are dropped. Of others with one external id the first is looked up in stages (how: name, alias,
    partial) and the rest follow it. What is left makes new buildings, one for each name and address. Ids go on from the
    largest, in the order of a hash of name and address, counted in buckets. Adverts without an external id get one made of
    what they say, so a second run with the results of the first finds every advert by it, and changes nothing.
    Gaps of a building are filled with what its first advert says, nothing else is changed. Adverts without a name, and rows
    that repeat a key, are no adverts of any building and one advert.
    """
    own = F.concat(F.lit("#"), F.sha2(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in ["name", "address", *FACTS])), 256))
    rows = adverts.where("name <> ''").dropDuplicates(["key"]).select("key", F.coalesce("site", F.lit("")).alias("site"), F.coalesce(F.nullif("external_id", F.lit("")), own).alias("external_id"), "name", F.nullif("address", F.lit("")).alias("address"), *FACTS)
    rows = stage(rows, "adverts")
    live = stage(external.join(buildings.select("id"), "id", "left_semi").groupBy("site", "external_id").agg(F.min("id").alias("id")), "external")
    known = rows.join(live, ["site", "external_id"]).select("key", "id", F.lit("external").alias("how"))
    open_rows = stage(rows.join(live, ["site", "external_id"], "left_anti"), "open")
    # of the adverts with one external id the first is looked up, the others follow it
    lead = stage(open_rows.groupBy("site", "external_id").agg(F.min("key").alias("leader")), "leaders")
    leaders = stage(open_rows.join(lead.select(F.col("leader").alias("key")), "key", "left_semi"), "leading")
    # leaders that say the same are looked up once
    same = ["name", "address", *FACTS]
    asked = stage(leaders.groupBy(*same).agg(F.min("key").alias("ask")), "searches")
    hits = staged_lookup(asked, buildings, aliases, attested)
    alike = reduce(lambda x, y: x & y, (F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in same))
    told = stage(leaders.alias("r").join(asked.join(hits, "ask").alias("a"), alike).select("r.key", "a.id", "a.how"), "told")

    rest = leaders.join(told, "key", "left_anti").withColumn("_place", F.struct("name", F.coalesce("address", F.lit("")).alias("address")))
    rest = stage(rest, "unknown")
    fresh = rest.groupBy("_place").agg(*_first_said(FACTS)).withColumn("_hash", F.xxhash64("_place.name", "_place.address"))
    fresh = bucketed_prefix(fresh.withColumn("_one", F.lit(1)).withColumn("_bucket", F.floor(F.col("_hash") / F.lit(2.0**64 / buckets)).cast("int")), ["_one"], "_bucket", [F.col("_hash"), F.col("_place")], F.lit(1), "_rank")
    last = buildings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = stage(fresh.join(F.broadcast(last)).select((F.col("_rank") + F.col("_last") + 1).alias("id"), "_place", *FACTS), "new_buildings")  # one row
    first = stage(told.unionByName(rest.join(fresh.select("_place", "id"), "_place").select("key", "id", F.lit("new").alias("how"))), "first")
    followers = open_rows.join(lead, ["site", "external_id"]).where("key <> leader").select("key", "leader")
    follow = followers.join(first.select(F.col("key").alias("leader"), "id"), "leader").select("key", "id", F.lit("external").alias("how"))
    assigned = stage(known.unionByName(first).unionByName(follow), "assigned")

    said = rows.join(assigned, "key").groupBy("id").agg(*_first_said(["address", *FACTS]))
    every = buildings.select("id", "name", "address", *FACTS).unionByName(fresh.select("id", F.col("_place.name").alias("name"), F.nullif(F.col("_place.address"), F.lit("")).alias("address"), *FACTS))
    grown = every.join(said.select("id", *(F.col(c).alias(f"_{c}") for c in ["address", *FACTS])), "id", "left").select("id", "name", *(F.coalesce(c, f"_{c}").alias(c) for c in ["address", *FACTS]))
    entries = rows.join(assigned, "key").groupBy("site", "external_id").agg(F.min("id").alias("id"))
    grown_external = live.unionByName(entries.join(live, ["site", "external_id"], "left_anti"))
    return assigned, grown, grown_external
