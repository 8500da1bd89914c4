"""Joins of names that are alike, without comparing all with all: filters that lose nothing, then the exact comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ratios
from plumbline.operators.match import name_similarity
from plumbline.runtime import broadcast_checked, sized, stage, unstage


def _names(df: DataFrame, name: str) -> DataFrame:
    """The different names of a column, without NULL and empty ones."""
    return df.select(F.col(name).alias("s")).where("s <> ''").distinct()


def _grams(s: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(s) - size + 1), lambda i: F.substring(s, i, size)))


def contained_pairs(inner: DataFrame, outer: DataFrame, inner_name: str, outer_name: str) -> DataFrame:
    """(inner, outer): the different names of one table that occur in names of the other, equal ones included.

    A name is looked up under one of its own pieces of three characters (or all of a shorter name), the one that fewest outer
    names hold; whatever holds the name holds that piece. A piece that no outer name holds ends the search.
    """
    inside, outside = stage(_names(inner, inner_name), "inner_names"), stage(_names(outer, outer_name), "outer_names")
    probes = inside.select("s", F.explode(_grams(F.col("s"), F.least(F.char_length("s"), F.lit(3)))).alias("gram"))
    sizes = F.sequence(F.lit(1), F.least(F.char_length("s"), F.lit(3)))
    index = outside.select("s", F.explode(F.flatten(F.transform(sizes, lambda k: _grams(F.col("s"), k)))).alias("gram"))
    held = stage(index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "held")
    rarest = probes.join(sized(held), "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    rarest = stage(rarest.select(F.col("s").alias("inner"), F.col("r.gram").alias("gram")), "rarest")
    # pieces that nothing is looked up under are left out before rows are brought together
    asked = index.join(sized(rarest.select("gram").distinct()), "gram", "left_semi").withColumnRenamed("s", "outer")
    found = asked.join(sized(rarest), "gram")
    return found.where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


#: Names of a block are compared in parts of about so many, every two of them in one place; places are dealt over tasks.
PART, TASK = 8192, 40_000_000


def _compared(blocks: list[str], least: float, ordered: bool):
    """Pairs of one part of a block's names with another: (blocks, left, right, ratio)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = left["l_s"].to_pylist(), right["r_s"].to_pylist()
        i, j, r = ratios.close(one, two, least, ordered) if one and two else (np.zeros(0, np.int64),) * 3
        names = pa.chunked_array([*left["l_s"].chunks, *right["r_s"].chunks], left["l_s"].type)
        first = np.zeros(len(i), np.int64)
        out = {**{c: left[f"l_{c}"].take(first) for c in blocks}, "left": names.take(i), "right": names.take(j if ordered else j + len(one)), "ratio": r.astype(float)}
        return pa.table(out)

    return run


def close_names(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: float = 0.6, blocks: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """(blocks, left, right, ratio): names of one block with a Ratcliff-Obershelp ratio of ``least`` and more, exactly.

    ``ordered``: the names of one table, pairs left < right. A block is dealt into parts, so that one of any size is in many
    tasks and pairs without that ratio are in no shuffle. NULL in a block column agrees with nothing.
    """
    blocks = blocks or []
    spark = left.sparkSession
    known = " AND ".join(["s <> ''", *(f"`{c}` IS NOT NULL" for c in blocks)])
    # one key column at least: without blocks all names are in one
    rows = lambda df, name: stage(df.select(*blocks, F.col(name).alias("s")).where(known).distinct(), "different_names")
    one = rows(left, left_name)
    two = one if ordered else rows(right, right_name)
    n_of = lambda df, n: df.groupBy(*blocks).agg(F.count(F.lit(1)).alias(n))
    a, b = n_of(one, "_a"), n_of(two, "_b")
    sizes = a.join(b, blocks) if blocks else a.crossJoin(b)
    sizes = stage(sizes.withColumns({"_pairs": F.col("_a").cast("double") * F.col("_b"), "_a": F.ceil(F.col("_a") / PART), "_b": F.ceil(F.col("_b") / PART)}), "sizes")
    tasks, shuffled = sizes.agg(F.sum("_pairs"), F.sum(F.col("_a") * F.col("_b"))).first()
    n = int(min(20_000, max(1, min((tasks or 0) // TASK + 1, shuffled or 1))))
    sizes = broadcast_checked(sizes)
    part = lambda df, own: (df.join(sizes, blocks) if blocks else df.crossJoin(sizes)).withColumn(own, F.pmod(F.xxhash64("s"), F.col(f"_n{own}")).cast("int"))
    sizes = sizes.withColumnsRenamed({"_a": "_n_i", "_b": "_n_j"})
    other = lambda first, last: F.explode(F.sequence(first, last.cast("int")))
    x = part(one, "_i").withColumn("_j", other(F.col("_i") if ordered else F.lit(0), F.col("_n_j") - 1))
    y = part(two, "_j").withColumn("_i", other(F.lit(0), F.col("_j") if ordered else F.col("_n_i") - 1))
    keys = [*blocks, "_i", "_j"]
    schema = one.select(*blocks, F.col("s").alias("left"), F.col("s").alias("right"), F.lit(0.0).alias("ratio")).schema
    dealt = lambda df, tag: df.select(*(F.col(c).alias(f"{tag}{c}") for c in (*keys, "s"))).repartition(n, *(f"{tag}{c}" for c in keys)).groupBy(*(f"{tag}{c}" for c in keys))
    return dealt(x, "l_").cogroup(dealt(y, "r_")).applyInArrow(_compared(blocks, least, ordered), schema)


def close_candidates(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: float = 0.6, blocks: list[str] | None = None) -> DataFrame:
    """(blocks, left, right) of ``close_names``: none with a ratio of ``least`` is missing, and no other is told."""
    return close_names(left, right, left_name, right_name, least, blocks).drop("ratio")


def close_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, least: float = 0.6) -> DataFrame:
    """(left, right, ratio): different names of two tables with a Ratcliff-Obershelp ratio of ``least`` and more, exactly."""
    return close_names(left, right, left_name, right_name, least)


def alias_scores(wanted: DataFrame, aliases: DataFrame, key: str, name: str, alias_name: str = "canonical_name", count: str = "occurrence_count", owner: str = "building_id", ambiguous: str | None = None) -> DataFrame:
    """(key, owner, score): the best match of a name with an owner's aliases; without any match no row.

    Exact 100, prefix 80 + 15 r, contained 50 + 25 r (r: the shorter length over the longer), ratio of 0.6 and more 60 times it;
    times f, the mean of the alias's share among its owner's and of its exclusivity, or for exact matches times half of 1 + f.
    Where the column ``ambiguous`` is true an exact match counts 95 times f, as the best prefix does. Rows of one alias of one
    owner count together. NULL and empty names match nothing. Different names are compared once, however many rows have them.
    """
    held = aliases.where(F.col(alias_name) != "").groupBy(F.col(owner).alias("_owner"), F.col(alias_name).alias("_alias")).agg(F.sum(count).alias("_n"))
    held = stage(held, "aliases")
    of_owner = stage(held.groupBy("_owner").agg(F.sum("_n").alias("_own")), "of_owner")
    of_alias = stage(held.groupBy("_alias").agg(F.sum("_n").alias("_every")), "of_alias")
    unsure = F.lit(False) if ambiguous is None else F.coalesce(ambiguous, F.lit(False))
    asked = stage(wanted.select(key, F.col(name).alias("_asked"), unsure.alias("_unsure")), "asked")
    inside = contained_pairs(asked, held, "_asked", "_alias").select(F.col("inner").alias("_asked"), F.col("outer").alias("_alias"))
    around = contained_pairs(held, asked, "_alias", "_asked").select(F.col("outer").alias("_asked"), F.col("inner").alias("_alias"))
    close = close_pairs(asked, held, "_asked", "_alias").select(F.col("left").alias("_asked"), F.col("right").alias("_alias"), "ratio")
    none = F.lit(None).cast("double").alias("ratio")
    q, n = F.col("_asked"), F.col("_alias")
    r = F.least(F.char_length(q), F.char_length(n)) / F.greatest(F.char_length(q), F.char_length(n))
    pairs = inside.select("*", none).unionByName(around.select("*", none)).unionByName(close).groupBy("_asked", "_alias").agg(F.max("ratio").alias("_ratio"))
    text = F.when(q == n, 100.0).when(q.startswith(n) | n.startswith(q), 80 + 15 * r).when(q.contains(n) | n.contains(q), 50 + 25 * r).otherwise(60 * F.col("_ratio"))
    factor = (F.col("_n") / F.col("_own") + F.col("_n") / F.col("_every")) / 2
    score = lambda exact: F.max(F.when(q == n, exact).otherwise(F.col("_text") * factor))
    known = held.join(sized(of_owner), "_owner").join(sized(of_alias), "_alias").hint("merge")
    scored = known.join(pairs.withColumn("_text", text), "_alias").groupBy("_asked", F.col("_owner").alias(owner)).agg(score(100 * (1 + factor) / 2).alias("_sure"), score(95 * factor).alias("_unsure_score"))
    return asked.join(scored.hint("merge"), "_asked").groupBy(key, owner).agg(F.max(F.when(F.col("_unsure"), F.col("_unsure_score")).otherwise(F.col("_sure"))).alias("score"))


def similar_classes(df: DataFrame, name: str, blocks: list[str], least: float = 0.6) -> DataFrame:
    """(blocks, a, b, similarity): pairs a < b of different names of a block with a name similarity of ``least`` and more.

    Rows with the same block and name are one class, so a block grows with its different names. The similarity is that of
    ``match.name_similarity``, which only exceeds the ratio where names differ in blanks alone: those meet by their words.
    NULL names are in no class.
    """
    classes = stage(df.select(*blocks, F.col(name).alias("s")).where("s <> ''").distinct(), "different_names")
    close = close_names(classes, classes, "s", "s", least, blocks, ordered=True)
    worded = lambda c: F.array_join(F.split(c, r"\s+"), " ")
    words = lambda tag: classes.select(*blocks, F.col("s").alias(tag), worded(F.col("s")).alias("w"))
    blank = words("left").join(words("right").hint("merge"), [*blocks, "w"]).where("left < right").drop("w").withColumn("ratio", F.lit(0.0))
    pairs = close.where(worded(F.col("left")) != worded(F.col("right"))).unionByName(blank)
    scored = pairs.withColumn("similarity", name_similarity(F.col("left"), F.col("right"), F.col("ratio"))).where(F.col("similarity") >= least)
    return scored.select(*blocks, F.col("left").alias("a"), F.col("right").alias("b"), "similarity")


def group_by_seed(df: DataFrame, block: str, key: str, name: str, least: float) -> DataFrame:
    """(key, seed): within a block, in order of key, each row joins the first seed whose name is equal or similar enough, or becomes one.

    The result is that of one row after the other, but found for all blocks at once: a row is a seed as soon as every
    earlier row that it is similar to is known not to be one, and not a seed once an earlier one it is similar to is. Each
    round settles at least the first open row of every block; chains in which each row is similar to the one before only
    need a round for every second row. Rows with the same name are one row. NULL names count as empty ones, which are
    similar to each other only; rows of a NULL block form a block.
    """
    rows = df.select(F.col(block).alias("_block"), F.col(key).alias("key"), F.coalesce(F.col(name), F.lit("")).alias("s"))
    rows = rows.withColumn("block", F.coalesce(F.concat(F.lit("="), F.col("_block").cast("string")), F.lit("")))
    classes = stage(rows.groupBy("block", "s").agg(F.min("key").alias("k")), "seed_classes")
    found = close_names(classes, classes, "s", "s", least, ["block"])
    keyed = found.join(classes.select("block", F.col("s").alias("left"), F.col("k").alias("later")), ["block", "left"]).join(classes.select("block", F.col("s").alias("right"), F.col("k").alias("earlier")), ["block", "right"])
    edges = stage(keyed.where("later > earlier").select("block", "later", "earlier"), "seed_edges")
    # seed: NULL while open, else whether the row is one
    state = stage(classes.select("block", F.col("k").alias("node"), F.lit(None).cast("boolean").alias("seed")), "seed_state")
    while state.where("seed IS NULL").limit(1).count():
        known = edges.join(state.select("block", F.col("node").alias("earlier"), F.col("seed").alias("_s")), ["block", "earlier"])
        told = known.groupBy("block", F.col("later").alias("node")).agg(F.max(F.coalesce("_s", F.lit(False))).alias("_covered"), F.max(F.col("_s").isNull()).alias("_waits"))
        now = F.when(F.coalesce("_covered", F.lit(False)), False).when(~F.coalesce("_waits", F.lit(False)), True)
        before, state = state, stage(state.join(told, ["block", "node"], "left").select("block", "node", F.coalesce("seed", now).alias("seed")), "seed_state")
        unstage(before)
    seeds = state.where("seed").select("block", F.col("node").alias("earlier"))
    joined = edges.join(seeds, ["block", "earlier"]).groupBy("block", F.col("later").alias("k")).agg(F.min("earlier").alias("_seed"))
    settled = classes.join(joined, ["block", "k"], "left").select("block", "s", F.coalesce("_seed", "k").alias("seed"))
    return rows.join(settled, ["block", "s"]).select("key", "seed")
