"""Majority votes over what several adverts say about one item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sites whose word counts first among equals; others come last.
SITE_ORDER = ["suumo", "homes", "rehouse", "nomu", "livable"]


def site_priority(c: Column, order: list[str] | None = None) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in order or SITE_ORDER]), F.lower(c))
    return F.when(place > 0, place).otherwise(F.lit(99)).cast("long")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def majority(df: DataFrame, keys: list[str], value: str, ties: str = "lowest", weight: Column | None = None) -> DataFrame:
    """(keys, value, votes): the value with most votes per key; equal votes go to the lowest or highest value.

    NULL values do not vote. Votes are counted before anything is shuffled by key, so a key with very many rows costs
    one row per value and task.
    """
    votes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("votes"))
    best = F.struct(F.col("votes"), (-F.col(value) if ties == "lowest" else F.col(value)).alias("_v"), F.col(value).alias("value"))
    return votes.groupBy(*keys).agg(F.max(best).alias("_best")).select(*keys, F.col("_best.value").alias(value), F.col("_best.votes").alias("votes"))


def majority_by_site(df: DataFrame, keys: list[str], value: str, site: str, seen: str | None = None, order: list[str] | None = None) -> DataFrame:
    """The value with most votes; ties: the best site that says it, then the first seen, then the smallest value."""
    c = F.col(value)
    rows = df.where(c.isNotNull() & (c.cast("string") != ""))
    votes = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(site_priority(F.col(site), order)).alias("_site"), F.min(F.col(seen) if seen else F.lit(0)).alias("_seen"))
    return first_by(votes, keys, [F.col("votes").desc(), F.col("_site"), F.col("_seen"), c]).drop("_site", "_seen")


def majority_spelling(df: DataFrame, keys: list[str], value: str, normal: Column, site: str, order: list[str] | None = None) -> DataFrame:
    """Vote on a normalized form; the answer is the raw spelling of the best site among those that say it."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_normal", normal).where(F.col("_normal").isNotNull())
    won = majority_by_site(rows, keys, "_normal", site, order=order)
    said = rows.join(won, [*keys, "_normal"]).withColumn("_site", site_priority(F.col(site), order))
    return first_by(said, keys, [F.col("_site"), F.col(value)]).select(*keys, value, "votes")


def two_stage(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """One vote per inner key (its own majority), then the majority of those per outer key."""
    return majority(majority(df, outer + inner, value).drop("votes"), outer, value)


def in_scope(df: DataFrame, key: str, active: str, last: str, sold: str | None = None, days: int = 7) -> DataFrame:
    """Rows that may vote: active ones; without any, those within ``days`` of the sale; without those, all."""
    w = Window.partitionBy(key)
    near = F.datediff(F.to_date(sold), F.to_date(last)) <= days if sold else F.lit(False)
    near = F.coalesce(near, F.lit(False))
    out = df.withColumn("_a", F.max(F.coalesce(F.col(active), F.lit(False))).over(w)).withColumn("_n", F.max(near).over(w))
    return out.where(F.when(F.col("_a"), F.col(active)).when(F.col("_n"), near).otherwise(F.lit(True))).drop("_a", "_n")


def hierarchical(df: DataFrame, key: str, levels: list[str], site: str) -> DataFrame:
    """Vote level by level: each level's winner narrows the rows of its key to those that agree; missing levels stay missing.

    Ties go to rows with more levels filled in, then to the better site, then to the smaller value.
    """
    depth = sum(F.col(c).isNotNull().cast("int") for c in levels)
    rows, out = df.withColumn("_depth", depth), df.select(key).distinct()
    for c in levels:
        votes = rows.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.count(F.lit(1)).alias("_n"), F.max("_depth").alias("_d"), F.min(site_priority(F.col(site))).alias("_s"))
        won = first_by(votes, [key], [F.col("_n").desc(), F.col("_d").desc(), F.col("_s"), F.col(c)]).select(key, F.col(c).alias(f"_won_{c}"))
        out = out.join(won.withColumnRenamed(f"_won_{c}", c), key, "left")
        rows = rows.join(won, key, "left").where(F.col(f"_won_{c}").isNull() | (F.col(c) == F.col(f"_won_{c}"))).drop(f"_won_{c}")
    return out


def stations(df: DataFrame, key: str, text: str, least_share: float = 0.3, top: int = 3) -> DataFrame:
    """(key, station, line, minutes, votes): stations that at least ``least_share`` of an item's adverts name, the ``top`` most named.

    Walking minutes are the most frequent, ties the fewest.
    """
    p = r"([^「」\s、,]*線)?[「\s]*([^「」\s、,線]+駅)[」\s]*(?:まで)?(?:徒歩|歩)(\d+)分"
    rows = df.where(F.col(text).isNotNull())
    adverts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_adverts"))
    at = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(2))).alias("_i", "station")
    named = rows.select(key, text, at).select(
        key, "station", F.nullif(F.get(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)), F.col("_i")), F.lit("")).alias("line"), F.get(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(3)), F.col("_i")).cast("int").alias("minutes")
    )
    counts = named.groupBy(key, "station", "line").agg(F.count(F.lit(1)).alias("votes"), F.mode("minutes", True).alias("minutes"))
    kept = counts.join(adverts, key).where(F.col("votes") >= least_share * F.col("_adverts"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "minutes", "station", F.col("line").asc_nulls_last()))
    return kept.withColumn("_r", rank).where(F.col("_r") <= top).select(key, "station", "line", "minutes", "votes")


def final_price(history: DataFrame, sold: DataFrame, key: str, price: str, at: str, sold_at: str, days: int = 7) -> DataFrame:
    """(key, final_price, votes, confidence): the mode of prices in the ``days`` to the sale, ties the highest; else the latest price."""
    rows = history.join(sold, key).where((F.col(price) > 0) & (F.col(at) <= F.col(sold_at)))
    near = rows.where(F.to_date(at) >= F.date_sub(F.to_date(sold_at), days))
    voted = majority(near, [key], price, "highest").withColumnRenamed(price, "_near")
    total = near.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    latest = rows.groupBy(key).agg(F.max_by(price, F.struct(at, price)).alias("_latest"))
    joined = latest.join(voted, key, "left").join(total, key, "left")
    return joined.select(key, F.coalesce("_near", "_latest").alias("final_price"), F.coalesce("votes", F.lit(0)).alias("votes"), F.coalesce(F.col("votes") / F.col("_total"), F.lit(0.5)).alias("confidence"))


def price_range(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Least and greatest price per key, without NULL and prices of 0 or less."""
    return df.where(F.col(price) > 0).groupBy(*keys).agg(F.min(price).alias("min_price"), F.max(price).alias("max_price"))


def attributes(df: DataFrame, key: str, columns: list[str], site: str, current: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per key with each column's majority; a column without votes keeps the value of ``current``."""
    out = df.select(key).distinct()
    for c in columns:
        out = out.join(majority_by_site(df, [key], c, site, order=order).select(key, c), key, "left")
    if current is not None:
        old = current.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
        out = out.join(old, key, "left").select(key, *[F.coalesce(c, f"_old_{c}").alias(c) for c in columns])
    return out


# Kinds of tenure and the words that mean them, the more specific first; the phrases that tell a lease's time.
TENURE_KINDS = [
    ("一般定期借地権", ["定期借地権"]), ("旧法借地権", ["旧法借地権", "旧法賃借権"]), ("普通借地権", ["普通借地権"]), ("賃借権（旧）", ["賃借権（旧）"]), ("賃借権（普）", ["賃借権（普）"]), ("賃借権", ["賃借権"]),
    ("地上権（旧）", ["地上権（旧）"]), ("地上権（普）", ["地上権（普）"]), ("地上権", ["地上権"]), ("所有権", ["所有権"]),
]
#: What is said is dealt over tasks of about so many rows.
DEALT = 200_000
UNTIL, LASTS = "借地期限([0-9]{4})年([0-9]{1,2})月", "借地期間(?:残存|新規)([0-9]+)年(?:([0-9]+)ヶ月)?"
TOLD_APART = [LASTS + "、?", "※定期賃借権：借地期限[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日まで\\s*", "保証金（[^）]+）は販売価格に含まれています\\s*、?"]


def tenure_kind(c: Column) -> Column:
    """The kind that a text names; a text that names none is its own kind."""
    out = None
    for kind, words in TENURE_KINDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(c)


def lease_until(c: Column, listed: Column) -> Column:
    """The month in which a lease ends, yyyy-MM: named, or so many years and months after the listing; NULL if neither."""
    part = lambda p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    # most texts hold neither word, and are not searched
    months = F.when(c.contains("借地期間"), part(LASTS, 1).cast("int") * 12 + F.coalesce(part(LASTS, 2).cast("int"), F.lit(0)))
    named = F.when(c.contains("借地期限"), F.concat(part(UNTIL, 1), F.lit("-"), F.lpad(part(UNTIL, 2), 2, "0")))
    return F.when(c.contains("借地"), F.coalesce(named, F.date_format(F.add_months(F.to_date(listed), months), "yyyy-MM")))


def tenure(df: DataFrame, key: str, text: str, site: str, listed: str, now: Column, order: list[str] | None = None) -> DataFrame:
    """(key, tenure): vote on the kind, then on the end of the lease, then on the conditions without it; told with the time left.

    Ties of kinds and conditions go to the better site, then the smaller text; ties of ends to the earlier one. Owned land
    needs no more than its name. A kind for which no advert tells an end keeps its most frequent text.
    """
    c = F.col
    rows = df.where(c(text).isNotNull() & (c(text) != "")).select(key, c(text).alias("_text"), tenure_kind(c(text)).alias("_kind"), lease_until(c(text), c(listed)).alias("_until"), site_priority(c(site), order).alias("_s"))
    # read and counted once; what equal adverts say then stays in the task of its key through all three votes
    said = rows.groupBy(key, "_text", "_kind", "_until").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_s"))
    said = said.repartition(int(min(20_000, df.count() // DEALT + 1)), key)
    of = lambda *more: Window.partitionBy(key, *more)
    votes = lambda df, value: df.withColumn("_votes", F.sum("_n").over(of(value))).withColumn("_site", F.min("_s").over(of(value)))
    won = F.first("_kind").over(of().orderBy(F.desc("_votes"), "_site", "_kind"))
    mine = votes(said, "_kind").withColumn("_won", won).where((c("_kind") == c("_won")) & (c(key).isNotNull() | (c("_kind") == "所有権")))
    end = F.first("_until").over(of().orderBy(c("_until").isNull(), F.desc("_votes"), "_until"))
    mine = votes(mine, "_until").withColumn("_end", F.when(c("_kind") != "所有権", end)).where((c("_until") == c("_end")) | c("_end").isNull())
    conditions = c("_text")
    for p in TOLD_APART:
        conditions = F.regexp_replace(conditions, p, "")
    conditions = F.trim(F.regexp_replace(F.regexp_replace(conditions, "、+", "、"), "^、|、$", ""))
    mine = mine.withColumn("_cond", F.when(c("_end").isNull(), c("_text")).otherwise(F.when(conditions == "", " ").otherwise(conditions)))
    agreed = first_by(votes(mine, "_cond"), [key], [F.desc("_votes"), c("_site"), c("_cond")]).withColumn("_said", F.trim("_cond"))
    left = F.floor(F.months_between(F.to_date(F.concat("_end", F.lit("-01"))), now)).cast("int")
    span = F.concat(F.lit("借地期間残存"), F.floor(left / 12).cast("string"), F.lit("年"), F.when(left % 12 > 0, F.concat((left % 12).cast("string"), F.lit("ヶ月"))).otherwise(""))
    head, rest = F.substring_index("_said", "、", 1), F.regexp_replace("_said", "^[^、]*、", "")
    told = F.when(left <= 0, c("_said")).when(c("_said").contains("、"), F.concat_ws("、", head, span, rest)).when(c("_said") != "", F.concat_ws("、", "_said", span)).otherwise(span)
    return agreed.select(key, F.when(c("_kind") == "所有権", c("_kind")).when(c("_end").isNull(), c("_cond")).otherwise(told).alias("tenure"))
