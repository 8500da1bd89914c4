"""Price histories as time series: carry-forward, daily majorities, changes, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.vote import first_by, majority


def calendar(df: DataFrame, start: Column, end: Column, day: str = "day") -> DataFrame:
    """Every row once for each day from start to end, both included; rows whose end is before their start vanish."""
    return df.where(end >= start).withColumn(day, F.explode(F.sequence(start, end)))


def daily_last(history: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """(keys, day, value): the latest record of each day."""
    rows = history.where(F.col(value).isNotNull()).withColumn("day", F.to_date(at))
    return rows.groupBy(*keys, "day").agg(F.max_by(value, F.struct(at, tie)).alias(value))


def carry_forward(history: DataFrame, spans: DataFrame, keys: list[str], value: str, at: str, tie: str, fallback: str | None = None) -> DataFrame:
    """(keys, day, value): an advert's value on each day of its span (``spans``: keys, start, end).

    A day has its latest record, else the last one before it, else ``fallback`` (a column of spans). Each series is a
    window of its own days; calendars are bounded by the spans and never joined day by day to all records.
    """
    days = calendar(spans, F.col("start"), F.col("end"))
    known = daily_last(history, keys, value, at, tie).withColumnRenamed(value, "_v")
    first_known = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = days.join(known, [*keys, "day"], "full_outer").withColumn("_carried", F.last("_v", True).over(first_known))
    carried = F.coalesce("_carried", fallback) if fallback else F.col("_carried")
    return both.where(F.col("start").isNotNull()).select(*keys, "day", carried.alias(value)).where(F.col(value).isNotNull())


def daily_majority(prices: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """(keys, day, value, votes): the majority of each day, ties the lowest."""
    return majority(prices, [*keys, day], value)


def changes(daily: DataFrame, keys: list[str], value: str, day: str = "day") -> DataFrame:
    """Days on which the daily value differs from the one before: both values and votes, difference and percent."""
    w = Window.partitionBy(*keys).orderBy(day)
    out = daily.withColumn("old_price", F.lag(value).over(w)).withColumn("old_price_votes", F.lag("votes").over(w))
    diff = F.col(value) - F.col("old_price")
    rate = F.when(F.col("old_price") != 0, F.round((diff * 100.0) / F.col("old_price"), 2))
    return out.where(F.col("old_price").isNotNull() & (F.col(value) != F.col("old_price"))).select(
        *keys, F.col(day).alias("change_date"), F.col(value).alias("new_price"), "old_price", diff.alias("price_diff"), rate.alias("price_diff_rate"), F.col("votes").alias("new_price_votes"), "old_price_votes"
    )


def event_timeline(history: DataFrame, spans: DataFrame, item: str, source: str, value: str, at: str, tie: str) -> DataFrame:
    """(item, day, least price, prices by source, disagree): on days with an event only, each source carried forward to them.

    Event days: of records, of the start and end of an advert, and the day after its end.
    """
    own = [item, source]
    known = daily_last(history, own, value, at, tie)
    days = known.select(item, "day").union(spans.select(item, "start")).union(spans.select(item, "end")).union(spans.select(item, F.date_add("end", 1))).distinct()
    # a source meets the days of its span only; its last record before that counts as one of the first day
    span = [*own, "start", "end"]
    entered = known.join(spans.select(*span), own).where(F.col("day") <= F.col("end")).groupBy(*span, F.greatest("day", "start").alias("day")).agg(F.max_by(value, "day").alias("_v"))
    met = days.join(spans.select(*span).withColumnRenamed(item, "_item"), (F.col(item) == F.col("_item")) & F.col("day").between(F.col("start"), F.col("end"))).drop("_item")
    w = Window.partitionBy(*span).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = met.join(entered, [*span, "day"], "left").withColumn(value, F.last("_v", True).over(w)).where(F.col(value).isNotNull())
    return per.groupBy(item, "day").agg(F.min(value).alias("price"), F.count_distinct(value).alias("n_prices"), F.sort_array(F.collect_list(F.struct(source, value))).alias("by_source"), (F.count_distinct(value) > 1).alias("disagree"))


def disagreements(history: DataFrame, item: str, source: str, value: str, at: str) -> DataFrame:
    """Days on which sources record different prices."""
    days = history.where(F.col(value).isNotNull()).groupBy(item, F.to_date(at).alias("day")).agg(F.count_distinct(source).alias("sources"), F.count_distinct(value).alias("prices"), F.min(value).alias("low"), F.max(value).alias("high"))
    return days.where("prices > 1")


def consistency(history: DataFrame, item: str, source: str, value: str, at: str) -> DataFrame:
    """(item, days, agreeing, score): the share of days with several sources on which they agree; 1 without such days."""
    days = history.where(F.col(value).isNotNull()).groupBy(item, F.to_date(at).alias("day")).agg(F.count_distinct(source).alias("s"), F.count_distinct(value).alias("p"))
    out = days.groupBy(item).agg(F.count_if(F.col("s") > 1).alias("days"), F.count_if((F.col("s") > 1) & (F.col("p") == 1)).alias("agreeing"))
    return out.withColumn("score", F.when(F.col("days") > 0, F.col("agreeing") / F.col("days")).otherwise(1.0))


def trend(history: DataFrame, item: str, value: str, at: str, tie: str, threshold: float = 5.0) -> DataFrame:
    """(item, first, last, change, percent, class, volatility, days, points): class is up or down beyond ``threshold`` percent, else stable."""
    rows = history.where(F.col(value).isNotNull())
    key = F.struct(at, tie)
    out = rows.groupBy(item).agg(
        F.min_by(value, key).alias("first_price"), F.max_by(value, key).alias("last_price"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("volatility"),
        F.datediff(F.to_date(F.max(at)), F.to_date(F.min(at))).alias("days"), F.count(F.lit(1)).alias("points"),
    )
    percent = F.when(F.col("first_price") != 0, (F.col("last_price") - F.col("first_price")) * 100.0 / F.col("first_price")).otherwise(0.0)
    out = out.withColumn("change", F.col("last_price") - F.col("first_price")).withColumn("percent", percent)
    return out.withColumn("trend", F.when(F.col("percent") > threshold, "up").when(F.col("percent") < -threshold, "down").otherwise("stable"))


def drops(history: DataFrame, item: str, value: str, at: str, tie: str, least: float = 5.0) -> DataFrame:
    """Items with two points or more whose price fell by ``least`` percent or more."""
    return trend(history, item, value, at, tie).where((F.col("points") >= 2) & (F.col("percent") <= -least))


def latest_change(history: DataFrame, item: str, value: str, at: str, tie: str) -> DataFrame:
    """(item, changed_at): the last record that differs from any earlier one."""
    w = Window.partitionBy(item).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = history.where(F.col(value).isNotNull()).withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w))
    return rows.where((F.col("_lo") != F.col(value)) | (F.col("_hi") != F.col(value))).groupBy(item).agg(F.max(at).alias("changed_at"))


def only_changes(history: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """Records whose value differs from the one before; the first of each key stays."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(at, tie))
    return history.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(value)) | F.col("_before").isNull()).drop("_before")


def first_seen(adverts: DataFrame, item: str, dates: list[str]) -> DataFrame:
    """(item, first_seen): the least of each advert's first filled-in date, in the order of ``dates``."""
    return adverts.groupBy(item).agg(F.min(F.coalesce(*dates)).alias("first_seen"))


def outliers(sales: DataFrame, key: str, area: str, year: str, quarter: str, price: str, age: str) -> DataFrame:
    """(key, peers, is_outlier): prices far above their peers of the area and quarter.

    Peers are of the quarter, or, with under ten, also of the quarters beside it; five are needed. Flagged is a price above
    all three of Q3 + 4 IQR, mean + 5 deviations and 7 medians, each times 1.3 for buildings up to five years, 1.15 up
    to ten. Quartiles are the elements n // 4, n // 2 and 3 n // 4 of the sorted prices. Sales are counted by area, quarter and
    price before anything else: only counts are spread to the neighbouring quarters, sorted and ranked, so an area with
    very many sales costs one row for each of its prices.
    """
    q = (F.col(year) * 4 + F.col(quarter)).cast("long")
    rows = sales.where(F.col(price).isNotNull()).withColumn("_q", q)
    counts = rows.groupBy(area, "_q", price).agg(F.count(F.lit(1)).alias("_c"))
    spread = counts.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_q", F.col("_q") + F.col("_o"))
    both = spread.groupBy(area, "_q", price).agg(F.sum("_c").alias("_b"), F.sum(F.when(F.col("_o") == 0, F.col("_c")).otherwise(0)).alias("_a"))
    w = Window.partitionBy(area, "_q").orderBy(price).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(area, "_q")
    stats = []
    for t in ("a", "b"):
        n = F.col(f"_{t}")
        both = both.withColumn(f"_upto_{t}", F.sum(n).over(w)).withColumn(f"_all_{t}", F.sum(n).over(every))
        at = lambda e, t=t: F.min(F.when(F.col(f"_upto_{t}") > F.expr(e.format(f"_all_{t}")), F.col(price)))
        total = lambda e: F.sum(e.cast("decimal(30,4)"))
        squares, sums = total(n * F.col(price) * F.col(price)).cast("double"), total(n * F.col(price)).cast("double")
        count = F.max(f"_all_{t}")
        stats += [
            count.alias(f"n_{t}"), at("{0} div 4").alias(f"q1_{t}"), at("{0} div 2").alias(f"q2_{t}"), at("3 * {0} div 4").alias(f"q3_{t}"), (sums / count).alias(f"m_{t}"),
            F.when(count > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - sums * sums / count) / (count - 1)))).alias(f"s_{t}"),
        ]
    found = both.groupBy(area, "_q").agg(*stats)
    pick = lambda c: F.when(F.col("n_a") >= 10, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c)
    found = found.where("n_a > 0").select(area, "_q", *[pick(c) for c in ("n", "q1", "q2", "q3", "m", "s")])
    joined = rows.join(found, [area, "_q"], "left")
    factor = F.when(F.col(age) <= 5, 1.3).when(F.col(age) <= 10, 1.15).otherwise(1.0)
    p = F.col(price)
    far = (p > F.col("q3") + 4 * (F.col("q3") - F.col("q1")) * factor) & (p > F.col("m") + 5 * F.col("s") * factor) & (p > 7 * F.col("q2") * factor)
    return joined.select(key, F.col("n").alias("peers"), ((F.col("n") >= 5) & F.coalesce(far, F.lit(False))).alias("is_outlier"))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, with their number if ``place`` names a column for it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn(place or "_rank", rank).where(F.col(place or "_rank") <= n)
    return out if place else out.drop("_rank")


def refresh(stored: DataFrame, recomputed: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """A materialized table with the rows of ``touched`` keys replaced."""
    return stored.join(touched.select(key).distinct(), key, "left_anti").unionByName(recomputed.join(touched.select(key).distinct(), key, "left_semi"))


def enqueue(queue: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One pending row per key: the lower priority value wins, then the older; rows in other states stay."""
    pending = queue.where("status = 'pending'").unionByName(new.withColumn("status", F.lit("pending")))
    return queue.where("status <> 'pending'").unionByName(first_by(pending, [key], [F.col("priority"), F.col("created_at"), F.col("reason")]))


def dequeue(queue: DataFrame, key: str, n: int) -> DataFrame:
    return queue.where("status = 'pending'").orderBy("priority", "created_at", key).limit(n)
