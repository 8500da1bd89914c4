"""State of listings, upserts, merges and their lineage, as whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.operators.vote import first_by
from plumbline.runtime import stage, unstage

#: Hours to wait after the first, second, third and later failures.
BACKOFF = [2, 24, 72, 168]


def listing_state(listings: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Active if confirmed within ``hours``; else inactive, delisted now unless it was before."""
    live = F.coalesce(F.col("last_confirmed_at") >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))
    return listings.withColumn("delisted_at", F.when(live, F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce("delisted_at", now))).withColumn("is_active", live)


def sold_state(items: DataFrame, listings: DataFrame, item: str, fk: str) -> DataFrame:
    """sold_at: the last delisting of items without an active advert, kept if set; NULL for items with one. Running it again changes nothing."""
    s = listings.groupBy(F.col(fk).alias("_item")).agg(F.bool_or("is_active").alias("_live"), F.max("delisted_at").alias("_gone"))
    j = items.join(s, items[item] == F.col("_item"), "left")
    return j.withColumn("sold_at", F.when(F.col("_live"), F.lit(None).cast("timestamp_ntz")).when(F.col("_item").isNotNull(), F.coalesce("sold_at", "_gone")).otherwise(F.col("sold_at"))).drop("_item", "_live", "_gone")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], price: str = "current_price", now: Column | None = None) -> DataFrame:
    """Old and new rows by key: a NULL never replaces a value; ``change`` is new, price, other, none or absent (not in new)."""
    values = [c for c in old.columns if c not in keys and c in new.columns]
    rest = [c for c in old.columns if c not in keys and c not in values]
    a = old.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values], *rest, F.lit(True).alias("_old"))
    b = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    j = a.join(b, keys, "full_outer")
    differs = F.lit(False)
    for c in values:
        if c != price:
            differs = differs | F.coalesce(F.col(f"_n_{c}") != F.col(f"_o_{c}"), F.col(f"_n_{c}").isNotNull() & F.col(f"_o_{c}").isNull())
    moved = F.coalesce(F.col(f"_n_{price}") != F.col(f"_o_{price}"), F.col(f"_n_{price}").isNotNull() & F.col(f"_o_{price}").isNull()) if price in values else F.lit(False)
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "absent").when(moved, "price").when(differs, "other").otherwise("none")
    return j.select(*keys, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in values], *rest, change.alias("change"))


def suspicious(old_value: Column, new_value: Column, share: float = 0.7) -> Column:
    """A change by more than ``share``, or a value that goes missing."""
    return (old_value.isNotNull() & new_value.isNull()) | F.coalesce((old_value != 0) & (F.abs(new_value - old_value) / F.abs(old_value) > share), F.lit(False))


def retry_at(errors: Column, last: Column) -> Column:
    hours = F.when(errors <= 1, BACKOFF[0]).when(errors == 2, BACKOFF[1]).when(errors == 3, BACKOFF[2]).otherwise(BACKOFF[3])
    return last + F.make_dt_interval(hours=hours)


def needs_refetch(known: Column, old_price: Column, new_price: Column, fetched: Column, now: Column, days: int = 90) -> Column:
    return F.coalesce(~known, F.lit(True)) | F.coalesce(old_price != new_price, F.lit(False)) | F.coalesce(fetched < now - F.make_dt_interval(days=F.lit(days)), F.lit(True))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("is_active") & (F.col("next_run_at") <= now))


def rebuild_aliases(adverts: DataFrame, owner: str, name: str, canonical: Column, site: str, seen: str) -> DataFrame:
    """Aliases per owner and canonical name: the most frequent spelling (ties the smallest), count, sites, first and last seen."""
    rows = adverts.where(F.col(name).isNotNull()).withColumn("canonical_name", canonical).where("canonical_name <> ''")
    spelled = rows.groupBy(owner, "canonical_name", name).agg(F.count(F.lit(1)).alias("_n"), F.collect_set(site).alias("_s"), F.min(seen).alias("_f"), F.max(seen).alias("_l"))
    merged = spelled.groupBy(owner, "canonical_name").agg(
        F.min_by(F.col(name), F.struct(-F.col("_n"), F.col(name))).alias("normalized_name"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))), ",").alias("source_sites"),
        F.sum("_n").alias("occurrence_count"), F.min("_f").alias("first_seen_at"), F.max("_l").alias("last_seen_at"),
    )
    return merged


def merge_aliases(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Aliases added up by owner and canonical name: counts summed, sites united, the more frequent spelling kept."""
    both = old.unionByName(new)
    return both.groupBy(owner, "canonical_name").agg(
        F.min_by("normalized_name", F.struct(-F.col("occurrence_count"), F.col("normalized_name"))).alias("normalized_name"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("source_sites", ","))))), ",").alias("source_sites"),
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )


def final_targets(merges: DataFrame, source: str, target: str) -> DataFrame:
    """(source, direct, final, depth) of merges in which each source was merged once; ids that lead into a ring have no final and depth.

    Pointers are doubled: each round joins the table to itself, so a chain of n merges takes log n rounds. As long as some
    chain has not reached its end, every round ends another one; what is open after a round that ended none is a ring.
    """
    first = first_by(merges.select(F.col(source).alias("s"), F.col(target).alias("t")), ["s"], [F.col("t")])
    cur, before = stage(first.select("s", F.col("t").alias("direct"), F.col("t").alias("final"), F.lit(1).alias("depth"), F.lit(True).alias("open")), "targets"), -1
    while True:
        nxt = cur.select(F.col("s").alias("final"), F.col("final").alias("_f"), F.col("depth").alias("_d"), F.col("open").alias("_o"))
        moved = cur.join(nxt, "final", "left").select("s", "direct", F.when(F.col("open"), F.coalesce("_f", "final")).otherwise(F.col("final")).alias("final"), F.when(F.col("open"), F.col("depth") + F.coalesce("_d", F.lit(0))).otherwise(F.col("depth")).alias("depth"), (F.col("open") & F.coalesce("_o", F.lit(False))).alias("open"))
        now = stage(moved, "targets")
        unstage(cur)
        cur, n_open = now, now.where("open").count()
        if n_open in (0, before):
            break
        before = n_open
    known = lambda c: F.when(~F.col("open"), F.col(c)).alias(c)
    return cur.select(F.col("s").alias(source), "direct", known("final"), known("depth"))


def remap(df: DataFrame, fk: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """``df`` with ``fk`` moved from merged ids to their target."""
    m = mapping.select(F.col(source).alias("_s"), F.col(target).alias("_t"))
    return df.join(m, df[fk] == F.col("_s"), "left").withColumn(fk, F.coalesce("_t", fk)).drop("_s", "_t")


def remap_array(df: DataFrame, ids: str, mapping: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """The same for arrays of ids; ids that become equal stay once, in order of value."""
    m = mapping.select(F.col(source).alias("_id"), F.col(target).alias("_t"))
    moved = df.select(key, F.explode(ids).alias("_id")).join(m, "_id", "left").groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("_t", "_id"))).alias(ids))
    return df.drop(ids).join(moved, key, "left")


def unite_units(units: DataFrame, unit: str, building: str) -> DataFrame:
    """(source, target) for units of a building equal in floor, area by half metres, layout and direction, unless both have different rooms; the target is the smallest id."""
    step = F.bround(F.col("area") * 2) / 2
    keyed = units.withColumn("_a", step)
    cols = [building, "floor_number", "_a", "layout", "direction"]
    group = keyed.groupBy(*cols).agg(F.count_distinct("room_number").alias("_rooms"), F.min(unit).alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _rooms <= 1")
    cond = None
    for c in cols:
        x = keyed[c].eqNullSafe(group[c])
        cond = x if cond is None else cond & x
    return keyed.join(group, cond).where(keyed[unit] != F.col("_least")).select(keyed[unit].alias("source"), F.col("_least").alias("target"))


def merge(facts: dict[str, tuple[DataFrame, str, list[str]]], mapping: DataFrame, source: str = "source", target: str = "target") -> dict[str, DataFrame]:
    """Several tables repointed by one mapping. facts: name → (frame, foreign key, columns that must be unique afterwards)."""
    out = {}
    for name, (df, fk, unique) in facts.items():
        moved = remap(df, fk, mapping, source, target)
        out[name] = moved.dropDuplicates(unique) if unique else moved
    return out


def revert(current: DataFrame, history: DataFrame, key: str, fk: str, merge_id: int) -> tuple[DataFrame, DataFrame]:
    """Undo a merge: rows it moved go back, if they still exist; and those that do not, with a warning.

    history: merge_id, key, before (the foreign key that each row had).
    """
    h = history.where(F.col("merge_id") == merge_id).select(key, F.col("before").alias("_before"))
    back = current.join(h, key, "left").withColumn(fk, F.coalesce("_before", fk)).drop("_before")
    lost = h.join(current.select(key), key, "left_anti").select(key, F.lit("no longer there: not moved back").alias("warning"))
    return back, lost


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def exclusion_groups(pairs: DataFrame) -> DataFrame:
    return connected_components(pairs, "first", "second")


def retained(history: DataFrame, at: str, now: Column, days: int, hours: int = 0) -> DataFrame:
    return history.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours)))


def exclusivity(aliases: DataFrame, owner: str, name: str, count: str) -> DataFrame:
    """Share of a name's occurrences that belong to each owner."""
    return aliases.withColumn("exclusivity", F.col(count) / F.sum(count).over(Window.partitionBy(name)))
