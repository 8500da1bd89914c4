"""Votes, series, clusters, lineage, sources and streams on hand-made frames: ties, NULLs, shuffled rows, excluded pairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import schema
from plumbline.functions import names
from plumbline.operators import cluster, lineage, match, similar, timeline, vote
from plumbline.operators.components import connected_components
from plumbline.operators.ranking import bucketed_prefix
from plumbline.sources import files, html
from plumbline.streaming import changes


def day(k):
    return dt.datetime(2024, 1, k)


def test_majority_ties_and_nulls(spark):
    rows = [(1, 5), (1, 7), (2, None), (2, 3), (3, None), (1, 7), (1, 5)]
    df = spark.createDataFrame(rows, "k int, p int")
    assert {r["k"]: (r["p"], r["votes"]) for r in vote.majority(df, ["k"], "p").collect()} == {1: (5, 2), 2: (3, 1)}
    assert {r["k"]: r["p"] for r in vote.majority(df.repartition(3), ["k"], "p", "highest").collect()} == {1: 7, 2: 3}


def test_site_breaks_ties(spark):
    df = spark.createDataFrame([(1, "b", "homes"), (1, "a", "other"), (1, None, "suumo"), (1, "", "suumo"), (2, "x", "nomu")], "k int, v string, s string")
    assert {r["k"]: r["v"] for r in vote.majority_by_site(df, ["k"], "v", "s").collect()} == {1: "b", 2: "x"}
    spelled = spark.createDataFrame([(1, "2LDK", "other"), (1, "２ＬＤＫ", "suumo"), (1, "3LDK", "homes")], "k int, v string, s string")
    assert vote.majority_spelling(spelled, ["k"], "v", names.narrowed(F.col("v")), "s").first()["v"] == "２ＬＤＫ"


def test_stations(spark):
    df = spark.createDataFrame([(1, "銀座線「銀座駅」徒歩5分、東銀座駅 徒歩3分"), (1, "銀座線「銀座駅」徒歩6分"), (1, "銀座線「銀座駅」徒歩6分"), (1, None), (1, "銀座線「銀座駅」徒歩5分")], "k int, t string")
    got = [(r["station"], r["minutes"], r["votes"]) for r in vote.stations(df, "k", "t").collect()]
    assert got == [("銀座駅", 5, 4)]


def test_final_price_falls_back(spark):
    h = spark.createDataFrame([(1, 100, day(1)), (1, 120, day(20)), (1, 110, day(21)), (2, 90, day(1)), (2, 80, day(2)), (3, 0, day(1))], "k int, p int, t timestamp_ntz")
    s = spark.createDataFrame([(k, day(25)) for k in (1, 2, 3)], "k int, sold timestamp_ntz")
    assert {r["k"]: (r["final_price"], r["confidence"]) for r in vote.final_price(h, s, "k", "p", "t", "sold").collect()} == {1: (120, 0.5), 2: (80, 0.5)}


def test_carry_forward(spark):
    h = spark.createDataFrame([(1, 10, day(2), 1), (1, 11, day(2), 2), (1, None, day(3), 3), (1, 12, day(5), 4), (2, 7, day(1), 5)], "k int, p int, t timestamp_ntz, id int")
    spans = spark.createDataFrame([(1, day(1), day(6), 9), (2, day(3), day(4), 1), (3, day(1), day(1), None)], "k int, start timestamp_ntz, end timestamp_ntz, now int")
    spans = spans.withColumns({c: F.to_date(c) for c in ("start", "end")})
    got = {(r["k"], r["day"].day): r["p"] for r in timeline.carry_forward(h, spans, ["k"], "p", "t", "id", "now").collect()}
    assert got == {(1, 1): 9, (1, 2): 11, (1, 3): 11, (1, 4): 11, (1, 5): 12, (1, 6): 12, (2, 3): 7, (2, 4): 7}
    daily = timeline.daily_majority(timeline.carry_forward(h, spans, ["k"], "p", "t", "id", "now"), ["k"], "p")
    assert [(r["change_date"].day, r["old_price"], r["new_price"], r["price_diff_rate"]) for r in timeline.changes(daily, ["k"], "p").orderBy("change_date").collect()] == [(2, 9, 11, 22.22), (5, 11, 12, 9.09)]


def test_prefix_sums_across_buckets(spark):
    rows = [(g, k % 3, k, k + 1) for g in (None, 1) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, b int, o int, v int").repartition(4)
    got = {(r["g"], r["o"]): r["before"] for r in bucketed_prefix(df, ["g"], "b", [F.col("o")], F.col("v"), "before").collect()}
    for g in (None, 1):
        total = 0
        for _, o, v in sorted((b, o, v) for h, b, o, v in rows if h == g):
            assert got[g, o] == total
            total += v


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}


def test_clusters_keep_excluded_apart(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.7), (3, 6, 0.95)], "a long, b long, similarity double")
    apart = spark.createDataFrame([(3, 1)], "a long, b long")
    got = {r["node"]: r["cluster"] for r in cluster.clusters(pairs, apart).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 6: 3, 4: 4, 5: 4}
    members = spark.createDataFrame(list(got.items()), "node long, cluster long")
    assert {r["cluster"]: r["primary"] for r in cluster.primaries(members, pairs).collect()} == {1: 1, 3: 3, 4: 4}
    assert cluster.cluster_confidence(members, pairs).count() == 3
    assert match.without_excluded(pairs, apart, "a", "b", "a", "b").count() == 4


def test_seed_groups_and_lookup(spark):
    df = spark.createDataFrame([("x", 1, "park house"), ("x", 2, "park hause"), ("x", 3, "tower"), ("y", 4, "park house")], "b string, k long, n string")
    assert {r["key"]: r["seed"] for r in similar.group_by_seed(df, "b", "k", "n", 0.8).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    s = lambda rows: spark.createDataFrame(rows, "q int, c int, score double")
    got = {r["q"]: (r["c"], r["held_back"]) for r in match.staged_lookup([s([(1, 7, 50.0)]), s([(1, 8, 99.0), (2, 9, 80.0), (2, 5, 78.0)])], "q", "c", "score").collect()}
    assert got == {1: (7, False), 2: (9, True)}


def test_alias_scores(spark):
    aliases = spark.createDataFrame([(1, "パークハウス渋谷", 2), (1, "PARKHOUSE渋谷", 1), (2, "タワー新宿", 1)], "building_id long, canonical_name string, occurrence_count long")
    wanted = spark.createDataFrame([("a", "パークハウス渋谷"), ("b", "パークハウス")], "q string, n string")
    got = {(r["q"], r["building_id"]): r["score"] for r in similar.alias_scores(wanted, aliases, "q", "n").collect()}
    assert got["a", 1] > got["b", 1] > 0 and len(got) == 2


def test_same_buildings_score(spark):
    r = spark.range(1).select(match.name_similarity(F.lit("A B"), F.lit("A B")), match.name_similarity(F.lit("A B"), F.lit("A C")), match.name_similarity(F.lit("A"), F.lit("A C")), match.building_similarity(F.lit(0.9), F.lit(0.9), F.lit(1.0), F.lit(3))).first()
    assert r[0] == 1.0 and r[1] <= 0.6 and r[2] <= 0.65 and r[3] == 0.3


def test_merge_and_revert(spark):
    units = spark.createDataFrame([(k, 1 if k < 4 else 2) for k in range(1, 7)], "unit long, building long")
    history = units.where("building = 2").select(F.lit(1).alias("merge_id"), "unit", F.col("building").alias("before"))
    merged = lineage.remap(units, "building", spark.createDataFrame([(2, 1)], "source long, target long"), "source", "target")
    assert merged.where("building = 1").count() == 6
    back, lost = lineage.revert(merged.where("unit <> 4"), history, "unit", "building", 1)
    assert {r["unit"]: r["building"] for r in back.collect()} == {1: 1, 2: 1, 3: 1, 5: 2, 6: 2} and [r["unit"] for r in lost.collect()] == [4]


def test_lineage_depth_and_rings(spark):
    got = {r["s"]: (r["direct"], r["final"], r["depth"]) for r in lineage.final_targets(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "s long, t long"), "s", "t").collect()}
    assert got == {1: (2, 4, 3), 2: (3, 4, 2), 3: (4, 4, 1), 7: (8, None, None), 8: (7, None, None)}  # rings are reported, without an end


def test_state_and_sale_are_idempotent(spark):
    now = F.lit(day(20)).cast("timestamp_ntz")
    listings = spark.createDataFrame([(1, 1, day(20), True, None), (2, 1, day(1), True, None), (3, 2, day(2), False, day(5)), (4, 2, None, True, None)], "id long, item long, last_confirmed_at timestamp_ntz, is_active boolean, delisted_at timestamp_ntz")
    once = lineage.listing_state(listings, now)
    assert [(r["id"], r["is_active"], r["delisted_at"]) for r in once.orderBy("id").collect()] == [(1, True, None), (2, False, day(20)), (3, False, day(5)), (4, False, day(20))]
    items = spark.createDataFrame([(1, day(3)), (2, None), (3, None)], "k long, sold_at timestamp_ntz")
    first = lineage.sold_state(items, once, "k", "item")
    assert {r["k"]: r["sold_at"] for r in first.collect()} == {1: None, 2: day(20), 3: None}
    assert sorted(first.collect()) == sorted(lineage.sold_state(first, once, "k", "item").collect())


def test_upsert_never_replaces_by_null(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k long, current_price int, n string")
    new = spark.createDataFrame([(1, None, "x"), (3, 5, None), (2, 21, "b")], "k long, current_price int, n string")
    assert {r["k"]: (r["current_price"], r["n"], r["change"]) for r in lineage.upsert(old, new, ["k"]).collect()} == {1: (10, "x", "other"), 2: (21, "b", "price"), 3: (5, None, "new")}
    r = spark.range(1).select(lineage.suspicious(F.lit(100.0), F.lit(20.0)), lineage.suspicious(F.lit(100.0), F.lit(50.0)), lineage.suspicious(F.lit(100.0), F.lit(None).cast("double"))).first()
    assert tuple(r) == (True, False, True)


def test_aliases_add_up(spark):
    adverts = spark.createDataFrame([(1, "つばきの杜", "A", day(1)), (1, "つばきの杜", "A", day(3)), (1, "TSUBAKI NO MORI", "B", day(2)), (2, None, "X", day(1))], "b long, n string, s string, t timestamp_ntz")
    a = lineage.rebuild_aliases(adverts, "b", "n", names.canonical_key(F.col("n")), "s", "t")
    assert {r["canonical_name"]: (r["occurrence_count"], r["source_sites"]) for r in a.collect()} == {"ツバキノ杜": (2, "A"), "tsubakinomori": (1, "B")}
    two = lineage.merge_aliases(a, a, "b")
    assert {r["occurrence_count"] for r in two.collect()} == {4, 2}


def test_schema_parses(spark):
    for ddl in schema.TABLES.values():
        assert spark.createDataFrame([], ddl).count() == 0


@pytest.mark.parametrize("encoding", ["cp932", "utf-8", "utf-8-sig"])
def test_sales_from_csv(spark, tmp_path, encoding):
    text = "種類,市区町村名,地区名,取引時期,取引価格（総額）,面積（㎡）,間取り,建築年\n中古マンション等,港区,芝浦,2023年第3四半期,35000000,55,２ＬＤＫ,平成20年\n中古マンション等,港区,芝浦,2023年第3四半期,,55,1K,\n"
    (tmp_path / "a.csv").write_bytes(text.encode(encoding))
    raw = files.csv_files(spark, f"file://{tmp_path}/*.csv", ["種類"])
    got = files.sales(raw).collect()
    assert [(r["transaction_price"], r["transaction_quarter"], r["layout"], r["built_year"], r["price_per_sqm"]) for r in got] == [(3500, 3, "2LDK", 2008, 636363)]


def test_html(spark):
    page = "<html><head><title> A &amp; B </title><script>var x='<td>'</script></head><body><h1>X <b>y</b></h1><table><tr><th>価格<td class=price>5,480万円</tr><tr><th>階</th><td>3階</td></tr></table><dl><dt>駅<dd>銀座</dl><a href='/p?x=1'>go</a><a href='/p?x=1'>again</a>"
    df = spark.createDataFrame([(1, "http://h.example/a/b", page), (2, None, None)], "page_id long, url string, html string")
    r = {x["page_id"]: x for x in html.parsed(df, "page_id", "url", "html").collect()}
    assert r[1]["title"] == "A & B" and r[1]["headings"] == ["X y"] and r[1]["links"] == ["http://h.example/p?x=1"]
    assert r[1]["values"]["階"] == "3階" and r[1]["values"]["価格"].startswith("5,480万円") and r[2]["title"] is None
    rows = html.records(df, "page_id", "html", lambda h: [{"n": k} for k in range(h.count("<td"))])
    assert rows.count() == page.count("<td")


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, 10, day(1)), (1, 10, day(1)), (1, 11, day(2)), (2, 5, day(1)), (9, 1, day(9))], "k long, p long, t timestamp_ntz")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = changes.daily_votes(stream, "k", "p", "t").writeStream.format("memory").queryName("votes").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["k"], r["p"]): r["votes"] for r in spark.table("votes").collect()} == {(1, 10): 2, (1, 11): 1, (2, 5): 1}
    seen = []
    handle = changes.recompute_touched(lambda: spark.read.parquet(f"{tmp_path}/in"), lambda found, keys: seen.append((found.collect(), {r["k"] for r in keys.collect()})), "k", "p", "t")
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert seen[0][1] == {1, 2, 9} and [(r["k"], r["old_price"], r["new_price"]) for r in seen[0][0]] == [(1, 10, 11)]
    q = changes.silent_listings(stream, "k", "t").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["k"], r["state"]) for r in spark.table("silent").collect()} >= {(1, "active"), (1, "inactive"), (2, "inactive"), (9, "active")}


def test_nearby_is_exact(spark):
    pts = [(k, 60.0 + (k * 37 % 100) / 2000, 10.0 + (k * 61 % 100) / 1000) for k in range(60)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r["a"], r["b"]) for r in match.nearby(df, "id", "lat", "lon", 1000.0).collect()}
    import math

    def metres(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and metres(p, q) <= 1000}
