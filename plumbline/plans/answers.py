"""Whole answers: unit and building pages, recent updates, administrators' lists and summaries, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import address, names, numbers
from plumbline.operators import admin, filters, lineage, timeline, vote
from plumbline.plans.base import ADVERTS, HISTORY, KEYS, MEAN, UNITS, adverts, history, keys, mean, query, units
from plumbline.runtime import broadcast_checked, scratch_path
from plumbline.sources import files, html
from plumbline.sources.files import table
from plumbline.streaming.changes import price_changes

_CHANGED = f"""SELECT unit_id, day, price, o FROM (SELECT *, lag(price) OVER (PARTITION BY unit_id ORDER BY day) AS o FROM (SELECT unit_id, day, price FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, day ORDER BY n DESC, price) AS rn
FROM (SELECT unit_id, day, price, count(*) AS n FROM {HISTORY} GROUP BY ALL)) WHERE rn = 1)) WHERE o IS NOT NULL AND price <> o"""


# Pages ---------------------------------------------------------------------------------------------------------------------
@query(f"""WITH a AS (SELECT unit_id, count(*) AS adverts, count(*) FILTER (WHERE is_active) AS active, min(price) FILTER (WHERE is_active) AS low, max(price) FILTER (WHERE is_active) AS high, count(DISTINCT site) AS sites, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
arg_max(price, (seen_at, advert_id)) AS last_price FROM {ADVERTS} GROUP BY unit_id), v AS (SELECT unit_id, price, votes FROM (SELECT unit_id, price, count(*) AS votes, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, price) AS rn FROM {ADVERTS} WHERE is_active GROUP BY unit_id, price) WHERE rn = 1)
SELECT u.unit_id, u.building, u.layout, u.floor, u.area, coalesce(v.price, a.last_price) AS price, v.votes, coalesce(a.adverts, 0) AS adverts, coalesce(a.active, 0) AS active, a.low, a.high, coalesce(a.sites, 0) AS sites, a.first_seen, CASE WHEN coalesce(a.active, 0) = 0 THEN a.last_seen END AS sold_at,
CAST(date_diff('day', CAST(a.first_seen AS DATE), DATE '1998-12-01') AS INTEGER) AS days_listed FROM {UNITS} u LEFT JOIN a USING (unit_id) LEFT JOIN v USING (unit_id)""")
def unit_detail(spark, d):
    """Every unit's page: attributes, voted price (the last one if nothing is for sale), range, adverts, dates."""
    a = adverts(spark, d).groupBy("unit_id", "price", "site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_active").alias("votes"), F.min("seen_at").alias("f"), F.max("seen_at").alias("l"), F.max(F.struct("seen_at", "advert_id", "price")).alias("last")
    )
    by_price = a.groupBy("unit_id", "price").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"), F.min("f").alias("f"), F.max("l").alias("l"), F.max("last").alias("last"))
    sites = a.groupBy("unit_id", "site").count().groupBy("unit_id").agg(F.count(F.lit(1)).alias("sites"))
    on_sale = F.when(F.col("votes") > 0, F.col("price"))
    whole = by_price.groupBy("unit_id").agg(
        F.sum("n").alias("adverts"), F.sum("votes").alias("active"), F.min(on_sale).alias("low"), F.max(on_sale).alias("high"), F.min("f").alias("first_seen"), F.max("l").alias("last_seen"), F.max("last").alias("last"),
        F.max(F.when(F.col("votes") > 0, F.struct(F.col("votes"), (-F.col("price")).alias("_p"), F.col("price")))).alias("won"),
    )
    j = units(spark, d).join(whole.join(sites, "unit_id"), "unit_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(
        "unit_id", "building", "layout", "floor", "area", F.coalesce("won.price", "last.price").alias("price"), F.col("won.votes").alias("votes"), zero("adverts"), zero("active"), "low", "high", zero("sites"), "first_seen",
        F.when(F.coalesce("active", F.lit(0)) == 0, F.col("last_seen")).alias("sold_at"), F.datediff(F.lit("1998-12-01").cast("date"), F.to_date("first_seen")).alias("days_listed"),
    )


@query(f"""WITH a AS (SELECT unit_id, min(price) AS low, count(*) AS n FROM {ADVERTS} WHERE is_active GROUP BY unit_id), b AS (SELECT u.unit_id, u.building, u.floor, u.layout, a.low, coalesce(a.n, 0) AS n FROM {UNITS} u LEFT JOIN a USING (unit_id))
SELECT building, unit_id, floor, layout, low, n, CAST(row_number() OVER (PARTITION BY building ORDER BY low DESC NULLS LAST, floor, unit_id) AS INTEGER) AS place FROM b""")
def building_units(spark, d):
    """The units of each building with their least price, the dearest first, those not for sale last."""
    a = adverts(spark, d).where("is_active").groupBy("unit_id").agg(F.min("price").alias("low"), F.count(F.lit(1)).alias("n"))
    j = units(spark, d).join(a, "unit_id", "left").select("building", "unit_id", "floor", "layout", "low", F.coalesce("n", F.lit(0)).alias("n"))
    return timeline.first_n(j, ["building"], [F.desc_nulls_last("low"), F.col("floor"), F.col("unit_id")], 1 << 30, "place")


@query(f"""WITH c AS (SELECT 'NATION_' || (unit_id % 25) AS ward, unit_id, day, price, o FROM ({_CHANGED}) WHERE day >= DATE '2024-01-29'), f AS (SELECT 'NATION_' || (unit_id % 25) AS ward, unit_id, site, min(day) AS day FROM {HISTORY} GROUP BY ALL HAVING min(day) >= DATE '2024-01-03'),
x AS (SELECT ward, '[' || string_agg('{{"unit_id":' || unit_id || ',"day":"' || day || '","old":' || o || ',"new":' || price || '}}', ',' ORDER BY unit_id, day) || ']' AS changes, count(*) AS n_changes FROM c GROUP BY ward),
y AS (SELECT ward, '[' || string_agg('{{"unit_id":' || unit_id || ',"site":"' || site || '","day":"' || day || '"}}', ',' ORDER BY unit_id, site) || ']' AS fresh, count(*) AS n_fresh FROM f GROUP BY ward)
SELECT coalesce(x.ward, y.ward) AS ward, coalesce(changes, '[]') AS changes, coalesce(fresh, '[]') AS fresh, coalesce(n_changes, 0) AS n_changes, coalesce(n_fresh, 0) AS n_fresh FROM x FULL JOIN y ON x.ward = y.ward ORDER BY 1""")
def updates_by_ward(spark, d):
    """Recent updates as one row for each ward: its price changes and its new listings, as JSON."""
    ward = F.concat(F.lit("NATION_"), (F.col("unit_id") % 25).cast("string")).alias("ward")
    c = price_changes(history(spark, d), "unit_id", "price", "ts").where("change_date >= DATE '2024-01-29'")
    c = c.select(ward, F.struct("unit_id", F.col("change_date").alias("day"), F.col("old_price").alias("old"), F.col("new_price").alias("new")).alias("e"))
    n = history(spark, d).groupBy("unit_id", "site").agg(F.to_date(F.min("ts")).alias("day")).where("day >= DATE '2024-01-03'").select(ward, F.struct("unit_id", "site", "day").alias("e"))
    rows = lambda df, name: df.groupBy("ward").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    j = rows(c, "changes").join(rows(n, "fresh"), "ward", "full_outer")
    return j.select("ward", *[F.coalesce(k, F.lit("[]")).alias(k) for k in ("changes", "fresh")], *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n_changes", "n_fresh")]).orderBy("ward")


@query(f"SELECT unit_id, day AS change_date, o AS old_price, price AS new_price FROM ({_CHANGED}) ORDER BY abs(price - o) DESC, unit_id, day LIMIT 30")
def largest_changes(spark, d):
    """Thirty changes, the largest in either direction first."""
    c = price_changes(history(spark, d), "unit_id", "price", "ts")
    return c.orderBy(F.abs(F.col("new_price") - F.col("old_price")).desc(), "unit_id", "change_date").limit(30).select("unit_id", "change_date", "old_price", "new_price")


@query(f"SELECT unit_id, building, price, low, high FROM (SELECT unit_id, min(price) AS low, max(price) AS high, median(price) AS price FROM {ADVERTS} WHERE unit_id IN (3, 5, 8, 13, 21) GROUP BY unit_id) JOIN {UNITS} USING (unit_id)")
def compared_units(spark, d):
    """Some units side by side."""
    a = adverts(spark, d).where(filters.one_of(F.col("unit_id"), [3, 5, 8, 13, 21])).groupBy("unit_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.median("price").alias("price"))
    return a.join(units(spark, d), "unit_id").select("unit_id", "building", "price", "low", "high")


# Summaries -------------------------------------------------------------------------------------------------------------------
@query("SELECT ward, count(DISTINCT c_custkey) AS units FROM (SELECT c_custkey, nullif(regexp_extract(CASE WHEN c_nationkey % 5 = 0 THEN '大阪府' ELSE '東京都' END || CASE WHEN c_nationkey % 7 = 0 THEN '武蔵野市' ELSE 'W' || c_nationkey || '区' END || '2-3', '東京都([^区]+区)', 1), '') AS ward FROM customer) WHERE ward IS NOT NULL GROUP BY ward ORDER BY ward")
def ward_counts(spark, d):
    """Units by the ward that an address names."""
    k = F.col("c_nationkey")
    place = F.concat(F.when(k % 5 == 0, "大阪府").otherwise("東京都"), F.when(k % 7 == 0, "武蔵野市").otherwise(F.concat(F.lit("W"), k.cast("string"), F.lit("区"))), F.lit("2-3"))
    return table(spark, d, "customer").groupBy(address.tokyo_ward(place).alias("ward")).agg(F.count_distinct("c_custkey").alias("units")).where("ward IS NOT NULL").orderBy("ward")


_AUDIT = "SELECT event_id, user_id % 40 AS building, CAST(value AS DECIMAL(18,2)) AS confidence, ts FROM {0} events"


@query(f"""WITH a AS ({_AUDIT.format("")}) SELECT building, count(*) AS matches, CAST(sum(confidence) AS DOUBLE) / count(*) AS mean_confidence, count(*) FILTER (WHERE confidence >= 80) AS high, count(*) FILTER (WHERE confidence >= 50 AND confidence < 80) AS medium, count(*) FILTER (WHERE confidence < 50) AS low
FROM a WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY building ORDER BY matches DESC, building LIMIT 10""")
def match_audit(spark, d):
    """Ten buildings with most uncertain matches of the last days, with how sure these were."""
    a = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("building"), F.col("value").cast("decimal(18,2)").alias("confidence"), "ts")
    return admin.match_summary(lineage.retained(a, "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 20), "building", "confidence", (50, 80), 10)


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS active, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_bookmarks, count(*) FILTER (WHERE day = DATE '1998-08-05') AS today, count(*) FILTER (WHERE day >= DATE '1998-08-03') AS this_week, count(*) FILTER (WHERE day >= DATE '1998-08-01') AS this_month
FROM (SELECT c_custkey, c_acctbal, DATE '1998-08-05' - CAST(c_custkey % 40 AS INTEGER) AS day FROM customer)""")
def user_statistics(spark, d):
    """Users: all, active, with bookmarks, and new ones of the day, week and month."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"), F.expr("date_sub(DATE '1998-08-05', CAST(c_custkey % 40 AS INT))").alias("created"))
    return admin.user_summary(c, table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), F.lit("1998-08-05").cast("date"))


@query("SELECT (SELECT count(*) FROM (SELECT user_id, min(ts) AS f FROM events GROUP BY user_id) WHERE f > TIMESTAMP '2024-01-01 12:00:00') AS fresh, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00') AS records, (SELECT count(DISTINCT user_id) FROM events) AS total, (SELECT CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM events) AS mean_value")
def daily_summary(spark, d):
    """One row about a day: new items, price records, all items, mean price."""
    e = table(spark, d, "events")
    per = e.groupBy("user_id").agg(F.min("ts").alias("f"), F.count_if(F.col("ts") > F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("k"))
    return per.agg(F.count_if(F.col("f") > F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).alias("fresh"), F.sum("n").alias("records"), F.count(F.lit(1)).alias("total"), (F.sum("s").cast("double") / F.sum("k")).alias("mean_value"))


@query(f"""WITH now AS (SELECT unit_id, arg_max(price, (ts, event_id)) AS price FROM {HISTORY} GROUP BY unit_id) SELECT h.event_id, h.unit_id, h.price AS before, n.price AS price FROM {HISTORY} h JOIN now n USING (unit_id) WHERE h.ts > TIMESTAMP '2024-01-29 00:00:00' AND h.price > 0 AND (n.price - h.price) * 100 <= -5 * h.price""")
def drop_alerts(spark, d):
    """Records of the last day after which the price fell by five percent or more."""
    return admin.drops_since(history(spark, d), "unit_id", "price", "ts", "event_id", F.lit("2024-01-30").cast("timestamp_ntz"), 24, 5.0)


@query("SELECT user_id, first_seen FROM (SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id) WHERE first_seen > TIMESTAMP '2024-01-01 18:00:00' - INTERVAL 12 HOUR AND first_seen <= TIMESTAMP '2024-01-01 18:00:00' ORDER BY first_seen DESC, user_id")
def new_alerts(spark, d):
    """Items first seen in the last hours, newest first."""
    now = F.lit("2024-01-01 18:00:00").cast("timestamp_ntz")
    e = timeline.first_seen(table(spark, d, "events").select("user_id", "ts", F.lit(None).cast("timestamp_ntz").alias("published")), "user_id", ["published", "ts"])
    return lineage.retained(e.where(F.col("first_seen") <= now), "first_seen", now, 0, 12).where(F.col("first_seen") > F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")).orderBy(F.desc("first_seen"), "user_id")


@query("SELECT count(*) FILTER (WHERE regexp_matches(p_name, '[A-Z]')) AS with_capitals, count(*) FILTER (WHERE p_name LIKE '%ring%') AS rings, count(*) AS total FROM part")
def odd_names(spark, d):
    """How many names a conversion would have spoiled."""
    return table(spark, d, "part").agg(F.count_if(F.col("p_name").rlike("[A-Z]")).alias("with_capitals"), F.count_if(F.col("p_name").like("%ring%")).alias("rings"), F.count(F.lit(1)).alias("total"))


@query("SELECT p_type AS layout, count(*) AS n, count(DISTINCT p_brand) AS buildings FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def layout_coverage(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("layout")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("buildings")).orderBy(F.desc("n"), "layout").limit(10)


@query(f"SELECT building, {MEAN.format('t')} AS mean_per_tsubo, count(t) AS n FROM (SELECT u.building, CASE WHEN u.floor > 5 THEN round(a.price / (u.floor / 3.30578), 2) END AS t FROM {ADVERTS} a JOIN {UNITS} u USING (unit_id)) GROUP BY building")
def tsubo_averages(spark, d):
    """Mean price per tsubo of each building; units without a usable area do not count."""
    j = adverts(spark, d).join(units(spark, d), "unit_id").withColumn("t", F.when(F.col("floor") > 5, F.round(F.col("price") / (F.col("floor") / numbers.TSUBO), 2)))
    return j.groupBy("building").agg(mean("t").alias("mean_per_tsubo"), F.count("t").alias("n"))


@query("SELECT o_orderpriority AS k, count(*) AS n, count(DISTINCT o_custkey) AS users, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, CAST(sum(CASE WHEN o_totalprice BETWEEN 0 AND 100000 THEN 1 ELSE 0 END) AS BIGINT) AS cheap, CAST(sum(CASE WHEN o_totalprice BETWEEN 100000 AND 300000 THEN 1 ELSE 0 END) AS BIGINT) AS middle FROM orders GROUP BY o_orderpriority")
def transaction_summary(spark, d):
    """Closed sales in all: number, buyers, first and last, and two price bands with both ends."""
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("users"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.sum(F.when(p.between(0, 100_000), 1).otherwise(0)).alias("cheap"), F.sum(F.when(p.between(100_000, 300_000), 1).otherwise(0)).alias("middle")
    )


# Administration -------------------------------------------------------------------------------------------------------------------
@query(f"""SELECT unit_id, building, layout FROM {UNITS} u WHERE layout IN ('ECONOMY', 'LARGE', 'SMALL') AND contains(lower(building), '1') AND contains(lower(name), 'r') AND contains(lower(name), 'i') AND area >= 905.0 AND unit_id NOT IN (SELECT unit_id FROM {ADVERTS} WHERE is_active AND price > 45)""")
def administered_units(spark, d):
    """Comma lists, terms that must all occur, a least area, and units without a dear active advert."""
    a = adverts(spark, d).where("is_active AND price > 45")
    f = [filters.one_of(F.col("layout"), filters.comma_list("ECONOMY, LARGE ,SMALL")), filters.contains_any(F.col("building"), ["1"]), filters.contains_all(F.col("name"), "r  i"), filters.between(F.col("area"), 905.0)]
    return filters.has_related(units(spark, d).where(filters.all_of(f)), a, "unit_id", False).select("unit_id", "building", "layout")


@query(f"""SELECT s_suppkey, 'id' AS asked FROM supplier WHERE s_suppkey = 17 UNION ALL SELECT s_suppkey, 'name' FROM supplier WHERE contains(lower(s_name), 'r#000000017') AND s_suppkey IN (SELECT site FROM {ADVERTS} WHERE is_active)""")
def administered_buildings(spark, d):
    """Digits alone ask for an id, other text for a name."""
    s = table(spark, d, "supplier")
    by_id = s.where(filters.id_or_text(F.col("s_suppkey"), F.col("s_name"), " 17 ")).select("s_suppkey", F.lit("id").alias("asked"))
    named = s.where(filters.id_or_text(F.col("s_suppkey"), F.col("s_name"), "R#000000017"))
    by_name = filters.has_related(named, adverts(spark, d).where("is_active").select(F.col("site").alias("s_suppkey")), "s_suppkey", True)
    return by_id.unionByName(by_name.select("s_suppkey", F.lit("name").alias("asked")))


#: A district and its areas, in the way the driver's nations stand for areas.
DISTRICTS = {"東区": [f"NATION_{k}" for k in range(0, 8)], "西区": [f"NATION_{k}" for k in range(8, 20)]}


@query("SELECT CASE WHEN n_nationkey < 8 THEN '東区' ELSE '西区' END AS district, count(*) AS n, min(o_totalprice) AS low FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 20 GROUP BY 1")
def sales_by_district(spark, d):
    """Sales by district, through its list of areas."""
    districts = spark.createDataFrame([(k, a) for k, areas in DISTRICTS.items() for a in areas], "district string, area string")
    area = table(spark, d, "nation").join(broadcast_checked(districts), F.col("n_name") == F.col("area")).select("n_nationkey", "district")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(area, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"))


@query("""WITH c AS (SELECT DISTINCT p_brand || '_' || p_size || '_' || printf('%.1f', p_retailprice) AS k, first_value(p_type) OVER (PARTITION BY p_brand, p_size, printf('%.1f', p_retailprice) ORDER BY p_type) AS t FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, coalesce(c.t, p.p_type) AS layout, c.t IS NOT NULL AND c.t <> p.p_type AS changed FROM part p LEFT JOIN c ON c.k = p.p_brand || '_' || p.p_size || '_' || printf('%.1f', p.p_retailprice)""")
def corrected_layouts(spark, d):
    """Layouts from a list keyed by building, size and area to one digit; others stay."""
    p = table(spark, d, "part").withColumn("_area", F.format_string("%.1f", "p_retailprice"))
    c = p.where("p_partkey % 2 = 0").groupBy("p_brand", "p_size", "_area").agg(F.min("p_type").alias("_t"))
    return p.join(c, ["p_brand", "p_size", "_area"], "left").select("p_partkey", F.coalesce("_t", "p_type").alias("layout"), (F.col("_t").isNotNull() & F.coalesce(F.col("_t") != F.col("p_type"), F.lit(False))).alias("changed"))


@query(f"""WITH v AS (SELECT unit_id, price FROM (SELECT unit_id, price, row_number() OVER (PARTITION BY unit_id ORDER BY count(*) DESC, price) AS rn FROM {ADVERTS} WHERE is_active GROUP BY unit_id, price) WHERE rn = 1) SELECT p_partkey AS unit_id, CAST(p_size AS BIGINT) AS old_price, v.price AS new_price FROM part JOIN v ON v.unit_id = p_partkey WHERE p_size <> v.price""")
def revoted_prices(spark, d):
    """Stored prices that a new vote would change, without changing them."""
    stored = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_size").cast("long").alias("old_price"))
    return admin.revote(stored, adverts(spark, d).where("is_active"), "unit_id", "old_price", "price")


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOUR THEN 'failed' WHEN event_type = 'error' THEN 'running' ELSE 'completed' END AS status, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts, event_id""")
def task_log(spark, d):
    """Tasks after a time, in order; those that run for too long have failed."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "running").otherwise("completed").alias("status"), "ts")
    done = admin.stale_tasks(e, "status", "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 48)
    return admin.log_after(done, "ts", F.lit("2024-01-20").cast("timestamp_ntz"), "event_id")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND user_id % 3 = 1 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def alerts_page(spark, d):
    """The second page of a state's alerts, newest first."""
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("user_id") % 3 == 1)).orderBy(F.desc("ts"), "event_id")
    return filters.page(e, 2, 20).select("event_id", "user_id", "value")


@query("SELECT o_custkey, CAST(sum(l_quantity) AS BIGINT) AS found, count(*) AS workers FROM (SELECT o_custkey, l_linenumber, sum(l_quantity) AS l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY o_custkey")
def progress_sums(spark, d):
    """Counters that each worker keeps in a map, added up."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    per = j.groupBy("o_custkey", F.col("l_linenumber").cast("string").alias("w")).agg(F.sum("l_quantity").cast("long").alias("n"))
    maps = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("progress"))
    return maps.select("o_custkey", admin.map_sum(F.col("progress")).alias("found"), F.size("progress").cast("long").alias("workers"))


@query(f"""SELECT unit_id FROM (SELECT unit_id, bool_or(is_active) AS live, max(seen_at) AS gone FROM {ADVERTS} GROUP BY unit_id) WHERE live OR gone >= TIMESTAMP '2001-06-15 00:00:00' - INTERVAL 6 MONTH""")
def on_sale_or_sold_lately(spark, d):
    s = adverts(spark, d).groupBy("unit_id").agg(F.bool_or("is_active").alias("live"), F.max("seen_at").alias("gone"))
    return s.where(admin.sold_within(F.col("live"), F.col("gone"), F.lit("2001-06-15").cast("timestamp_ntz"), 6)).select("unit_id")


@query("SELECT user_id, count(*) AS seen, max(ts) AS last_seen, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE value >= 50 GROUP BY user_id")
def price_mismatches(spark, d):
    """One row for each item whose list price and page price differ: how often, when last, and by what."""
    return admin.mismatches(table(spark, d, "events").where("value >= 50"), "user_id", "value", "ts", "event_id")


@query("SELECT s_suppkey AS id, s_acctbal AS due_in FROM supplier WHERE s_acctbal <= 2000 AND s_nationkey <> 3")
def due_schedules(spark, d):
    """Active schedules whose time has come."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("next_run_at"), (F.col("s_nationkey") != 3).alias("is_active"))
    return lineage.due(s, F.lit(2000.0)).select("id", F.col("next_run_at").alias("due_in"))


@query("SELECT k, name AS stored, 'コート ' || k || ' 東棟' AS fresh FROM (SELECT k, CASE WHEN k % 3 = 0 THEN 'コート ' || k || ' 東棟' ELSE 'コート' || k || 'EAST' END AS name FROM " + KEYS + ") WHERE k % 3 <> 0")
def stale_display_names(spark, d):
    """Display names that a new derivation from the raw name would change."""
    v = keys(spark, d).select("k", F.expr("CASE WHEN k % 3 = 0 THEN 'コート ' || k || ' 東棟' ELSE 'コート' || k || 'EAST' END").alias("stored"))
    fresh = names.display_name(F.expr("'コート ' || k || ' EAST'"))
    return admin.rederived(v, "stored", fresh, "k")


# Sources and sinks -------------------------------------------------------------------------------------------------------------
_PERIOD = "y || '年第' || q || '四半期'"
_SOLD = "SELECT o_orderkey AS k, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(floor(o_totalprice) AS BIGINT) * 10 AS yen, 20 + o_custkey % 60 AS metres, (1 + o_custkey % 4) || 'LDK' AS rooms, 1960 + o_custkey % 60 AS built FROM {0} orders"


def _sold(spark, d):
    return spark.sql(_SOLD.replace("{0} orders", "{o} orders"), o=table(spark, d, "orders"))


@query(f"""SELECT k, y AS year, q AS quarter, CASE WHEN yen > 100000 THEN yen // 10000 ELSE yen END AS price, CAST(metres AS DOUBLE) AS area, rooms AS layout, built AS built_year FROM ({_SOLD.format("")})""")
def sales_from_csv(spark, d):
    """Sales written as CSV files with Japanese headers, read again under one set of names and types."""
    path = scratch_path(spark, "sales-csv")
    raw = _sold(spark, d).selectExpr("'区' AS `市区町村名`", "CAST(k AS STRING) AS `地区名`", f"{_PERIOD} AS `取引時期`", "format_number(yen, 0) AS `取引価格（総額）`", "CAST(metres AS STRING) AS `面積（㎡）`", "rooms AS `間取り`", "built || '年' AS `建築年`")
    files.export(raw, path, "csv")
    s = files.sales(files.csv_files(spark, f"{path}/*.csv", ["取引時期"]))
    return s.select(F.col("area_name").cast("long").alias("k"), F.col("transaction_year").alias("year"), F.col("transaction_quarter").alias("quarter"), F.col("transaction_price").alias("price"), F.col("floor_area").alias("area"), "layout", "built_year")


@query(f"SELECT k, y AS year, q AS quarter, yen // 10000 AS price, CAST(floor((yen // 10000) * 10000 / metres) AS BIGINT) AS per_metre FROM ({_SOLD.format('')}) WHERE k % 4 = 1")
def sales_from_feed(spark, d):
    """Sales written as JSON records, of one municipality, read by the feed's own price rule."""
    path = scratch_path(spark, "sales-json")
    raw = _sold(spark, d).selectExpr("'M' || (k % 4) AS MunicipalityCode", "'区' AS Municipality", "CAST(k AS STRING) AS DistrictName", f"{_PERIOD} AS Period", "CAST(yen AS STRING) AS TradePrice", "CAST(metres AS STRING) AS Area", "rooms AS FloorPlan", "built || '年' AS BuildingYear")
    files.export(raw, path, "json")
    s = files.feed(spark, path, "M1")
    return s.select(F.col("area_name").cast("long").alias("k"), F.col("transaction_year").alias("year"), F.col("transaction_quarter").alias("quarter"), F.col("transaction_price").alias("price"), F.col("price_per_sqm").alias("per_metre"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND contains(CAST(user_id AS VARCHAR), '7') ORDER BY ts DESC, event_id LIMIT 25")
def log_tail(spark, d):
    """The last lines of a JSON log of one level that hold a word."""
    path = scratch_path(spark, "log")
    files.export(table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" end")).alias("message"), F.col("event_type").alias("level"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")), path, "json")
    found = files.log_lines(spark, path, level="error").where(F.col("message").contains("7"))
    return files.tail(found, "at", 25, "event_id").select("event_id", "event_type")


@query("""WITH o AS (SELECT p_partkey AS k, p_size AS price, 'old' AS tag FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS price, 'new' AS tag FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL OR o.price <> n.price THEN n.price ELSE o.price END AS price, CASE WHEN o.k IS NULL OR o.price <> n.price THEN n.tag ELSE o.tag END AS tag FROM o FULL JOIN n ON o.k = n.k""")
def added_sales(spark, d):
    """New sales are added, known ones replaced only where the price changed."""
    p = table(spark, d, "part")
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("price"), F.lit("old").alias("tag"))
    new = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("price"), F.lit("new").alias("tag"))
    return files.add_new(old, new, "k", "price")


@query("SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def unseen_pages(spark, d):
    """List pages whose address was not fetched before."""
    p = table(spark, d, "pages")
    return html.not_seen(p, p.where("page_id % 4 = 0"), "url").select("url")


@query("SELECT unit_id, min(seen_at) AS first_seen FROM (SELECT l_partkey AS unit_id, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_shipdate - INTERVAL 3 DAY END AS published, l_shipdate AS seen, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_shipdate - INTERVAL 3 DAY END, l_shipdate) AS seen_at FROM lineitem) GROUP BY unit_id")
def earliest_dates(spark, d):
    """The earliest listing date, of each advert the published one before the one it was seen."""
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit_id"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_shipdate") - F.expr("INTERVAL 3 DAYS")).alias("published"), F.col("l_shipdate").alias("seen"))
    return timeline.first_seen(a, "unit_id", ["published", "seen"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END, coalesce(o_totalprice, 0), o_orderkey LIMIT 40")
def sorted_by_many(spark, d):
    """Several keys, missing ones as 0; ties by id."""
    k = vote.site_priority(F.col("o_orderpriority"), ["1-urgent", "2-high"])
    return table(spark, d, "orders").orderBy(k, F.coalesce("o_totalprice", F.lit(0.0)), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice")


@query(f"SELECT building, max(last_seen) AS last_seen, min(low) AS low, max(area) AS area, count(*) AS n FROM (SELECT unit_id, max(seen_at) AS last_seen, min(price) AS low FROM {ADVERTS} GROUP BY unit_id) JOIN {UNITS} USING (unit_id) GROUP BY building ORDER BY last_seen DESC, building")
def sorted_favourites(spark, d):
    """Groups sorted by the latest date of what they hold."""
    a = adverts(spark, d).groupBy("unit_id").agg(F.max("seen_at").alias("last_seen"), F.min("price").alias("low"))
    return a.join(units(spark, d), "unit_id").groupBy("building").agg(F.max("last_seen").alias("last_seen"), F.min("low").alias("low"), F.max("area").alias("area"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("last_seen"), "building")
