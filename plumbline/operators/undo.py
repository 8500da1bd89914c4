"""Merges as a log: what the tables look like after any set of merges, and how each merge is taken back, in any order.

The tables keep the ids that rows were given first; merges of buildings and of units are events (event, source, target), reverts
name an event. The state after the log is the base seen through the merges that stand: nothing is overwritten, so a merge that is
taken back leaves no trace, whatever came after it, and favourites or list entries that a merge had made equal are two again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lineage import final_targets, remap
from plumbline.runtime import stage


def standing(events: DataFrame, reverts: DataFrame) -> DataFrame:
    """The events that were not taken back; of several with one source the first. A revert of an unknown event changes nothing."""
    rows = events.join(reverts.select("event").distinct(), "event", "left_anti").where("source <> target")
    first = rows.groupBy("source").agg(F.min(F.struct("event", "target")).alias("e"))
    return first.select("e.event", "source", "e.target")


def final_ids(standing_events: DataFrame) -> DataFrame:
    """(source, target): where each merged id ends. Merges that lead into a ring of merges are not carried out: their ids stay."""
    return final_targets(standing_events, "source", "target").where("final IS NOT NULL").select("source", F.col("final").alias("target"))


def units_after(units: DataFrame, buildings_final: DataFrame, units_final: DataFrame) -> DataFrame:
    """(unit, building) of the units that are left."""
    moved = remap(units.select("unit", "building"), "building", buildings_final, "source", "target")
    return moved.join(units_final.select(F.col("source").alias("unit")), "unit", "left_anti")


def favourites_after(favourites: DataFrame, units_final: DataFrame) -> DataFrame:
    """(user, unit, since): one for each user and unit, the earliest."""
    return remap(favourites.select("user", "unit", "since"), "unit", units_final, "source", "target").groupBy("user", "unit").agg(F.min("since").alias("since"))


def lists_after(lists: DataFrame, units_final: DataFrame) -> DataFrame:
    """(list, ids): ids of units, each once, in order; empty and NULL lists stay as they are."""
    each = remap(lists.select("list", F.explode("ids").alias("id")), "id", units_final, "source", "target")
    moved = each.groupBy("list").agg(F.array_sort(F.collect_set("id")).alias("_ids"))
    return lists.select("list", "ids").join(moved, "list", "left").select("list", F.coalesce("_ids", "ids").alias("ids"))


def exclusions_after(pairs: DataFrame, buildings_final: DataFrame) -> DataFrame:
    """(first, second): pairs of buildings that must stay apart, each once; those that were merged into one are none any more."""
    moved = remap(remap(pairs.select("first", "second"), "first", buildings_final, "source", "target"), "second", buildings_final, "source", "target")
    return moved.where("first <> second").select(F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")).distinct()


def inverse(rows: DataFrame, key: str, fk: str, standing_events: DataFrame) -> DataFrame:
    """(event, key, before, after): what each standing merge moved, the mapping that takes it back.

    A merge moves the rows that were given its source and those that other merges had moved there. Rows pass from merge to
    merge in rounds, as many as the longest chain has merges; chains that lead into a ring are left out.
    """
    ends = final_targets(standing_events, "source", "target").where("final IS NOT NULL").select("source")
    steps = stage(standing_events.join(ends, "source", "left_semi").select("event", F.col("source").alias("before"), F.col("target").alias("after")), "steps")
    here = stage(rows.select(key, F.col(fk).alias("before")).join(steps, "before").select("event", key, "before", "after"), "moved")
    out = [here]
    while out[-1].limit(1).count():
        nxt = out[-1].select(key, F.col("after").alias("before")).join(steps, "before")
        out.append(stage(nxt.select("event", key, "before", "after"), "moved"))
    return reduce(DataFrame.unionByName, out)


def taken_back(units: DataFrame, building_events: DataFrame, unit_events: DataFrame, reverts: DataFrame, event: int) -> tuple[DataFrame, DataFrame]:
    """What a revert of one more building merge does: (unit, before, after) of the units that it moves, and (unit, warning) of those that it cannot.

    before and after are the unit's buildings. Units that the merge had moved and that were merged into others since are gone;
    they get a warning. An event that does not stand moves nothing.
    """
    stands = stage(standing(building_events, reverts), "standing")
    gone = final_ids(stage(standing(unit_events, reverts), "standing"))
    now = units_after(units, final_ids(stands), gone)
    after = units_after(units, final_ids(stage(standing(building_events, reverts.select("event").unionByName(stands.sparkSession.createDataFrame([(event,)], "event long"))), "standing")), gone)
    moved = now.join(after.withColumnRenamed("building", "after"), "unit").where("building <> after").select("unit", F.col("building").alias("before"), "after")
    lost = inverse(units, "unit", "building", stands).where(F.col("event") == event).join(gone.select(F.col("source").alias("unit")), "unit", "left_semi")
    return moved, lost.select("unit", F.lit("merged into another unit: not moved back").alias("warning"))


def replay(units: DataFrame, favourites: DataFrame, lists: DataFrame, exclusions: DataFrame, building_events: DataFrame, unit_events: DataFrame, reverts: DataFrame) -> dict[str, DataFrame]:
    """The four tables after the log. The two mappings are made once, by pointers doubled in a number of rounds that grows with the logarithm of the longest chain."""
    b = stage(final_ids(stage(standing(building_events, reverts), "standing")), "buildings_final")
    u = stage(final_ids(stage(standing(unit_events, reverts), "standing")), "units_final")
    return {"units": units_after(units, b, u), "favourites": favourites_after(favourites, u), "lists": lists_after(lists, u), "exclusions": exclusions_after(exclusions, b)}
