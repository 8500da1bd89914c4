"""Small state and audit operators: summaries, guards, logs, dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.vote import majority


def match_summary(matches: DataFrame, key: str, confidence: str, steps: tuple[float, float], top: int) -> DataFrame:
    """(key, matches, mean_confidence, high, medium, low): the ``top`` keys with most matches; steps: where medium and high begin."""
    c, (medium, high) = F.col(confidence), steps
    out = matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("matches"), (F.sum(c).cast("double") / F.count(F.lit(1))).alias("mean_confidence"), F.count_if(c >= high).alias("high"), F.count_if((c >= medium) & (c < high)).alias("medium"), F.count_if(c < medium).alias("low")
    )
    return out.orderBy(F.desc("matches"), key).limit(top)


def user_summary(users: DataFrame, bookmarks: DataFrame, today: Column) -> DataFrame:
    """One row: all users, active ones, those with bookmarks, and those created today, this week (from Monday) and this month."""
    have = bookmarks.select("user_id").distinct().withColumn("_b", F.lit(True))
    since = lambda unit: F.count_if(F.col("created") >= F.to_date(F.date_trunc(unit, today)))
    return users.join(have, "user_id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if("_b").alias("with_bookmarks"), F.count_if(F.col("created") >= today).alias("today"), since("week").alias("this_week"), since("month").alias("this_month")
    )


def drops_since(history: DataFrame, item: str, price: str, at: str, tie: str, now: Column, hours: int, percent: float) -> DataFrame:
    """(tie, item, before, price): records of the last ``hours`` that lie above the item's last price by ``percent`` of their own or more."""
    last = history.groupBy(item).agg(F.max_by(price, F.struct(at, tie)).alias("_now"))
    recent = history.where((F.col(at) > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col(price) > 0))
    return recent.join(last, item).where((F.col("_now") - F.col(price)) * 100 <= -percent * F.col(price)).select(tie, item, F.col(price).alias("before"), F.col("_now").alias("price"))


def revote(stored: DataFrame, adverts: DataFrame, key: str, old: str, price: str) -> DataFrame:
    """(key, old, new_price): stored prices that the majority of ``adverts`` contradicts; nothing is written."""
    return stored.join(majority(adverts, [key], price), key).where(F.col(old) != F.col(price)).select(key, old, F.col(price).alias("new_price"))


def stale_tasks(tasks: DataFrame, status: str, at: str, now: Column, hours: int) -> DataFrame:
    """Running tasks without a sign for ``hours`` have failed."""
    old = (F.col(status) == "running") & (F.col(at) < now - F.make_dt_interval(hours=F.lit(hours)))
    return tasks.withColumn(status, F.when(old, "failed").otherwise(F.col(status)))


def log_after(log: DataFrame, at: str, after: Column, tie: str) -> DataFrame:
    return log.where(F.col(at) > after).orderBy(at, tie)


def map_sum(c: Column) -> Column:
    """The sum of a map's values; 0 for an empty map."""
    return F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda total, x: total + x)


def sold_within(active: Column, sold: Column, now: Column, months: int) -> Column:
    """Active, or sold in the last ``months``."""
    return active | F.coalesce(sold >= now - F.make_ym_interval(months=F.lit(months)), F.lit(False))


def mismatches(seen: DataFrame, item: str, value: str, at: str, tie: str) -> DataFrame:
    """(item, seen, last_seen, last_value): one row per item, as an upsert by item would leave it."""
    return seen.groupBy(item).agg(F.count(F.lit(1)).alias("seen"), F.max(at).alias("last_seen"), F.max_by(value, F.struct(at, tie)).alias("last_value"))


def rederived(df: DataFrame, column: str, fresh: Column, key: str) -> DataFrame:
    """(key, column, fresh): rows whose stored value a new derivation would change."""
    return df.select(key, column, fresh.alias("fresh")).where(~F.col(column).eqNullSafe(F.col("fresh")))
