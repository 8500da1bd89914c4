"""Candidates for duplicate buildings by several rules at once, without comparing all of a block with all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.similar import contained_pairs
from plumbline.runtime import broadcast_checked, stage

#: A common beginning of so many characters makes two names match.
BEGINNING = 5
#: What decides whether buildings are candidates; buildings equal in all of it are one class.
ATTRIBUTES = ["name", "canonical", "prefix", "floors", "units", "year"]
#: Blocks are dealt over tasks by so many classes; at 60 times sf0.1 a task then makes about a million pairs.
ROWS = 5_000
#: The three pairs of columns in which buildings whose names match must agree.
SHARED = ["floors", "units", "year"]


def address_prefix(address: Column) -> Column:
    """A normalized address up to its first hyphen."""
    return F.substring_index(address, "-", 1)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def names_match(a: Column, b: Column) -> Column:
    """Equal, one in the other, or with the same first five characters; a missing or empty name matches nothing."""
    long = (F.char_length(a) >= BEGINNING) & (F.char_length(b) >= BEGINNING)
    met = (a == b) | a.contains(b) | b.contains(a) | (long & (F.left(a, F.lit(BEGINNING)) == F.left(b, F.lit(BEGINNING))))
    return F.coalesce((a != "") & (b != "") & met, F.lit(False))


def _begun(canonical: Column) -> Column:
    """The beginning that makes names match; NULL of a shorter name."""
    return F.when(F.char_length(canonical) >= BEGINNING, F.left(canonical, F.lit(BEGINNING)))


def first_rule(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The number of the first rule by which two buildings are candidates; NULL if none does.

    The same address prefix (two missing ones are the same) and: 0 floors and year; 1 floors and units, with years at most one
    apart; or a matching name (2 to 4 the same beginning, 5 to 7 the same short name, 8 to 10 one in the other) and the same
    floors, units or year. 11: the same name, anywhere.
    """
    sure = lambda x: F.coalesce(x, F.lit(False))
    eq = {c: sure(a[c] == b[c]) for c in ["name", *SHARED]}
    x, y = a["canonical"], b["canonical"]
    near = sure(F.abs(a["year"] - b["year"]) <= 1)
    same = [sure(_begun(x) == _begun(y)), sure((x == y) & (x != "")), names_match(x, y)]
    rules = [eq["floors"] & eq["year"], eq["floors"] & eq["units"] & near, *(eq[s] & m for m in same for s in SHARED)]
    place = _same(a["prefix"], b["prefix"])
    return F.coalesce(*(F.when(place & r, i) for i, r in enumerate(rules)), F.when(eq["name"], len(rules)))


def _at(rule: int, *parts: Column) -> Column:
    """A rule's block, told by a hash: whoever meets in it is judged by the rule itself. NULL if a part is; the prefix may be."""
    known = reduce(lambda x, y: x & y, (p.isNotNull() for p in parts))
    return F.when(known, F.struct(F.lit(rule).alias("rule"), F.xxhash64(F.lit(rule), *parts, *([] if rule == 11 else [F.col("prefix")])).alias("key")))


def _blocks() -> Column:
    """All blocks of a building. Years one apart share a block: each year is in its own and in the next one's."""
    c = F.col
    short = F.when(F.char_length("canonical") < BEGINNING, F.nullif("canonical", F.lit("")))
    at = [_at(0, c("floors"), c("year")), *(_at(1, c("floors"), c("units"), c("year") + k) for k in (0, 1))]
    at += [_at(2 + i, c(s), _begun(c("canonical"))) for i, s in enumerate(SHARED)] + [_at(5 + i, c(s), short) for i, s in enumerate(SHARED)]
    return F.explode(F.array_compact(F.array(*at, _at(11, c("name")))))


def classes(buildings: DataFrame) -> DataFrame:
    """Buildings equal in all attributes: class (the smallest id) and n."""
    return buildings.groupBy(*ATTRIBUTES).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))


def members(buildings: DataFrame, found: DataFrame) -> DataFrame:
    """(id, class) of every building."""
    same = reduce(lambda x, y: x & y, (F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ATTRIBUTES))
    return buildings.alias("b").join(found.alias("c"), same).select("b.id", "c.class")


def candidate_pairs(found: DataFrame) -> DataFrame:
    """(a, b): classes a < b that are candidates by any rule, each pair once.

    A class is in the blocks that its attributes name; a pair is made in the block of the first rule that it meets, and only
    there. Names contained in others are found by their rarest pieces; for rules 8 to 10 a class is in the blocks of its own
    name and of those in it. So a block grows with its different classes, what is shuffled are classes and not pairs, and
    blocks are dealt over as many tasks as the classes ask for.
    """
    rows = stage(found.select("class", *ATTRIBUTES), "blocks")
    n = int(min(20_000, rows.count() // ROWS + 1))
    # only the last rule asks for the name
    placed = lambda df, at, *more: df.select("*", at.alias("at")).select("at.*", "class", F.when(F.col("at.rule") == 11, F.col("name")).alias("name"), *ATTRIBUTES[1:], *more).repartition(n, "rule", "key", *more)
    side = lambda df, tag: df.select(*(F.col(c) if c in ("rule", "key", "_in") else F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    first = first_rule(*({c: F.col(f"{tag}_{c}") for c in ATTRIBUTES} for tag in ("a", "b"))) == F.col("rule")
    blocks = placed(rows, _blocks())
    met = side(blocks, "a").join(side(blocks, "b"), ["rule", "key"]).where((F.col("a_class") < F.col("b_class")) & first)
    inside = broadcast_checked(stage(contained_pairs(rows, rows, "canonical", "canonical").where("inner <> outer").distinct(), "contained"))
    of = F.explode(F.array_compact(F.array(*(_at(8 + i, F.col(s), F.col("_in")) for i, s in enumerate(SHARED)))))
    held = placed(rows.join(inside, F.col("canonical") == F.col("inner"), "left_semi").withColumn("_in", F.col("canonical")), of, "_in")
    holding = placed(rows.join(inside.withColumnRenamed("inner", "_in"), F.col("canonical") == F.col("outer")), of, "_in")
    apart = side(held, "a").join(side(holding, "b"), ["rule", "key", "_in"]).where(first)
    pair = lambda df: df.select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))
    return pair(met).unionByName(pair(apart))


def candidate_ids(buildings: DataFrame) -> DataFrame:
    """(id, rules): buildings that another one makes a candidate, with the names of the rules that say so, sorted.

    No pairs are made but of names contained in others: in a block of any size rows are counted. floors_units takes a whole
    block of equal prefix, floors and units if all its years are known and two of them are at most one apart.
    """
    rows = buildings.select("id", *ATTRIBUTES)
    out = []

    def of(name: str, by: list[str | Column], known: list[str], more=None) -> None:
        """Rows of groups with two rows or more."""
        some = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in known))
        # counted before they are brought together: a row for each group, not for each building
        groups = rows.where(some).groupBy(*[b.alias(f"g{i}") if isinstance(b, Column) else F.col(b).alias(f"g{i}") for i, b in enumerate(by)], *([F.col("year").alias("_y")] if more else [])).agg(F.count(F.lit(1)).alias("_n"))
        if more:
            w = Window.partitionBy(*(f"g{i}" for i in range(len(by))))
            gap = F.col("_y") - F.lag("_y").over(w.orderBy("_y"))
            groups = groups.withColumn("_gap", gap).groupBy(*(f"g{i}" for i in range(len(by)))).agg(F.sum("_n").alias("_n"), F.max(F.col("_y").isNull()).alias("_lost"), F.max(F.coalesce(F.col("_gap") <= 1, F.lit(False)) | ((F.col("_n") > 1) & F.col("_y").isNotNull())).alias("_near")).where("NOT _lost AND _near")
        groups = groups.where("_n > 1")
        same = reduce(lambda x, y: x & y, ((b if isinstance(b, Column) else F.col(b)).eqNullSafe(F.col(f"g{i}")) for i, b in enumerate(by)))
        out.append(rows.where(some).join(groups.select(*(f"g{i}" for i in range(len(by)))), same, "left_semi").select("id", F.lit(name).alias("rule")))

    of("name", ["name"], ["name"])
    of("floors_units", ["prefix", "floors", "units"], ["floors", "units"], more=True)
    of("floors_year", ["prefix", "floors", "year"], ["floors", "year"])
    named = rows.where("canonical <> ''")
    inside = stage(contained_pairs(named, named, "canonical", "canonical").where("inner <> outer"), "contained")
    head = F.when(F.char_length("canonical") >= BEGINNING, F.left("canonical", F.lit(BEGINNING)))
    for s in SHARED:
        rows = named.withColumn("_head", head)
        of(f"{s}_matching", ["prefix", s, "canonical"], [s, "canonical"])
        of(f"{s}_matching", ["prefix", s, "_head"], [s, "_head"])
        sides = named.where(F.col(s).isNotNull()).groupBy("prefix", s, "canonical").agg(F.lit(1).alias("_one"))
        a, b = (sides.select(F.col("prefix").alias(f"{t}_p"), F.col(s).alias(f"{t}_s"), F.col("canonical").alias(t)) for t in ("inner", "outer"))
        both = a.join(inside, "inner").join(b, "outer").where(_same(F.col("inner_p"), F.col("outer_p")) & (F.col("inner_s") == F.col("outer_s")))
        hit = both.select(F.explode(F.array("inner", "outer")).alias("x"), F.col("inner_p").alias("p"), F.col("inner_s").alias("v")).distinct()
        out.append(named.join(hit, (F.col("canonical") == F.col("x")) & _same(F.col("prefix"), F.col("p")) & (F.col(s) == F.col("v")), "left_semi").select("id", F.lit(f"{s}_matching").alias("rule")))
    return reduce(DataFrame.unionByName, out).groupBy("id").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
