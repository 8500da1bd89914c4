"""Text functions over every unit: each reads one text in many spellings, and NULL, with the SQL that says what it means."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import address, names, numbers
from plumbline.operators import filters
from plumbline.plans.base import KEYS, keys, meant, query, told
from plumbline.runtime import broadcast_checked, stage
from plumbline.sources.files import table

# text and meaning, for both engines; k is the unit, s its size, 1 to 50
PRICES = [
    ("s || '億' || (1000 + k % 9000) || '万円（税込）'", "s * 10000 + 1000 + k % 9000"), ("'売値 ' || s || ' 億円'", "s * 10000"), ("s || '億'", "s * 10000"), ("(100 + k % 900) || '万円'", "100 + k % 900"),
    ("s || ',' || (100 + k % 900) || '万円'", "s * 1000 + 100 + k % 900"), ("'１億２，３４５万円'", "12345"), ("'未定'", "NULL"), ("(1000 + k) || '円'", "NULL"), ("''", "NULL"),
]
FEES = [
    ("(1000 + k % 9000) || '円'", "1000 + k % 9000"), ("'管理費：' || s || ',' || (100 + k % 900) || '円/月'", "s * 1000 + 100 + k % 900"), ("(k % 9999 + 1) || '（円/月）'", "k % 9999 + 1"),
    ("s || '万' || (100 + k % 900) || '円'", "s * 10000 + 100 + k % 900"), ("s || '万円'", "s * 10000"), ("'賃料に込み'", "NULL"),
]
_POINT = "CAST(s || '.' || (k % 10) AS DOUBLE)"
AREAS = [("s || '.' || (k % 10) || '㎡'", _POINT), ("'専有 ' || s || '.' || (k % 10) || ' m2'", _POINT), ("s || 'm²'", "s"), ("s || '平米'", "s"), ("'約' || s || '平方メートル'", "s"), ("s || 'm'", "NULL"), ("'不明'", "NULL")]
FLOORS = [("s || '階'", "s"), ("s || '階/地上' || (s + 5) || '階建'", "s"), ("'地上' || s || '階建'", "NULL"), ("s || '階建'", "NULL"), ("'所在：' || s || '階'", "s"), ("'地下1階地上' || s || '階建'", "NULL"), ("'最上階'", "NULL")]
HEIGHTS = [
    ("'地上' || s || '階建'", "s", "0"), ("'RC' || s || '階地下2階建'", "s", "2"), ("s || '階建'", "s", "0"), ("'3階/鉄骨造' || s || '階'", "s", "0"), ("'地上' || s || '階地下3階建'", "s", "3"), ("'地下2階'", "NULL", "2"), ("''", "NULL", "NULL"),
]
UNIT_COUNTS = [("(1 + k % 900) || '戸'", "1 + k % 900"), ("'総戸数 1,' || (100 + k % 900) || ' 戸'", "1100 + k % 900"), ("'' || (1 + k % 900)", "1 + k % 900"), ("'99999戸'", "NULL"), ("'多数'", "NULL")]
YEARS = [
    ("(1950 + k % 70) || '年築'", "1950 + k % 70"), ("'築' || (1950 + k % 70) || '/' || (1 + k % 12)", "1950 + k % 70"), ("' ' || (1950 + k % 70) || ' '", "1950 + k % 70"), ("'平成' || (1 + k % 30) || '年'", "1989 + k % 30"),
    ("'昭和' || (30 + k % 30) || '年築'", "1955 + k % 30"), ("'令和' || (1 + k % 5) || '年'", "2019 + k % 5"), ("'不明'", "NULL"),
]
MONTHS = [("(1950 + k % 70) || '年' || (1 + k % 12) || '月'", "1 + k % 12"), ("(1950 + k % 70) || '/' || (1 + k % 12)", "1 + k % 12"), ("'2000年13月'", "NULL"), ("'2000年'", "NULL")]
LAYOUTS = [
    ("(1 + k % 5) || 'LDK'", "(1 + k % 5) || 'LDK'"), ("(1 + k % 5) || 'ＫＤＬ'", "(1 + k % 5) || 'LDK'"), ("'ワンルーム'", "'1R'"), ("(1 + k % 5) || 'LDK + 納戸'", "(1 + k % 5) || 'LDK+S'"), ("'LDK'", "'1LDK'"), ("(1 + k % 5) || 'R'", "(1 + k % 5) || 'R'"),
    ("(1 + k % 5) || 'DK+LK'", "(1 + k % 5) || 'DK+LK'"), ("'スタジオ'", "'STUDIO'"), ("'間取り ' || (1 + k % 5) || 'sldk'", "(1 + k % 5) || 'SLDK'"), ("'相談'", "NULL"),
]
SIDES = [("'南向き'", "'南'"), ("'窓：南東'", "'南東'"), ("'NW'", "'北西'"), ("'w'", "'西'"), ("'北東角'", "'北東'"), ("'中庭'", "NULL")]
FRAMES = [("'鉄骨鉄筋コンクリート造'", "'SRC'"), ("'RC造'", "'RC'"), ("'軽量鉄骨造'", "'軽量鉄骨'"), ("'鉄骨造'", "'S造'"), ("'木造2階建'", "'木造'"), ("'石造'", "NULL")]
_YMD = "make_date(CAST(2001 + k % 20 AS INTEGER), CAST(1 + k % 12 AS INTEGER), CAST(1 + k % 28 AS INTEGER))"
DATES = [
    ("(2001 + k % 20) || '年' || (1 + k % 12) || '月' || (1 + k % 28) || '日'", _YMD), ("'公開 ' || (2001 + k % 20) || '/' || (1 + k % 12) || '/' || (1 + k % 28)", _YMD), ("(2001 + k % 20) || '-' || (1 + k % 12) || '-' || (1 + k % 28) || ' 更新'", _YMD),
    ("'2023年2月30日'", "NULL"), ("'未定'", "NULL"),
]
WHOLE = [("'約' || k || '円'", "k"), ("'なし'", "NULL"), ("k || '.5 と ' || s", "k")]

_HEIGHT, _DEEP = [(t, v) for t, v, _ in HEIGHTS], [(t, v) for t, _, v in HEIGHTS]
_NUMBERS = [
    ("price", PRICES, "BIGINT"), ("fee", FEES, "BIGINT"), ("area", AREAS, "DOUBLE"), ("floor_number", FLOORS, "BIGINT"), ("total_floors", _HEIGHT, "BIGINT"), ("basement_floors", _DEEP, "BIGINT"), ("units", UNIT_COUNTS, "BIGINT"),
    ("built_year", YEARS, "BIGINT"), ("built_month", MONTHS, "BIGINT"), ("layout", LAYOUTS, "VARCHAR"), ("direction", SIDES, "VARCHAR"), ("structure", FRAMES, "VARCHAR"), ("day", DATES, "DATE"), ("first_number", WHOLE, "BIGINT"),
]


@query("SELECT k, " + ", ".join(f"{meant(forms, kind)} AS {name}" for name, forms, kind in _NUMBERS) + f" FROM {KEYS}")
def spoken_numbers(spark, d):
    """Every numeric and categorical text of an advert."""
    height = numbers.total_floors(told(_HEIGHT))
    return keys(spark, d).select(
        "k", numbers.price(told(PRICES)).alias("price"), numbers.monthly_fee(told(FEES)).alias("fee"), numbers.area(told(AREAS)).alias("area"), numbers.floor_number(told(FLOORS)).alias("floor_number"), height["total_floors"].alias("total_floors"),
        height["basement_floors"].alias("basement_floors"), numbers.total_units(told(UNIT_COUNTS)).alias("units"), numbers.built_year(told(YEARS)).alias("built_year"), numbers.built_year_month(told(MONTHS))["built_month"].alias("built_month"),
        numbers.layout(told(LAYOUTS)).alias("layout"), numbers.direction(told(SIDES)).alias("direction"), numbers.structure(told(FRAMES)).alias("structure"), numbers.date(told(DATES)).alias("day"), numbers.first_integer(told(WHOLE)).alias("first_number"),
    )


_RECORD = [("price", PRICES, "BIGINT"), ("area", AREAS, "DOUBLE"), ("layout", LAYOUTS, "VARCHAR"), ("built_year", YEARS, "BIGINT")]


@query("SELECT k, s, " + ", ".join(f"{meant(forms, kind)} AS {name}" for name, forms, kind in _RECORD) + f" FROM {KEYS}")
def normalized_records(spark, d):
    """Whole records: known fields read out of their texts, others passed through."""
    raw = keys(spark, d).select("k", "s", *[told(forms).alias(name) for name, forms, _ in _RECORD])
    return numbers.normalized(raw, {name: name for name, _, _ in _RECORD})


@query(f"""SELECT k, coalesce(p BETWEEN 100 AND 1000000, false) AS price_ok, coalesce(a BETWEEN 10 AND 1000, false) AS area_ok, coalesce(f >= 1 AND (t IS NULL OR f <= t), false) AS floor_ok, coalesce(y BETWEEN 1900 AND 2029, false) AS year_ok
FROM (SELECT k, CASE WHEN k % 6 <> 0 THEN k * 7 % 1200 * 1000 END AS p, CASE WHEN k % 7 <> 0 THEN CAST(k % 1100 AS DOUBLE) END AS a, CASE WHEN k % 5 <> 0 THEN s - 2 END AS f, CASE WHEN k % 4 <> 0 THEN 30 END AS t, CASE WHEN k % 8 <> 0 THEN 1890 + k % 150 END AS y FROM {KEYS})""")
def valid_fields(spark, d):
    v = keys(spark, d).selectExpr("k", "CASE WHEN k % 6 <> 0 THEN k * 7 % 1200 * 1000 END AS p", "CASE WHEN k % 7 <> 0 THEN CAST(k % 1100 AS DOUBLE) END AS a", "CASE WHEN k % 5 <> 0 THEN s - 2 END AS f", "CASE WHEN k % 4 <> 0 THEN 30 END AS t", "CASE WHEN k % 8 <> 0 THEN 1890 + k % 150 END AS y")
    today = F.lit("2024-06-30").cast("date")
    return v.select("k", numbers.valid_price(F.col("p")).alias("price_ok"), numbers.valid_area(F.col("a")).alias("area_ok"), numbers.valid_floor(F.col("f"), F.col("t")).alias("floor_ok"), numbers.valid_built_year(F.col("y"), today).alias("year_ok"))


# Closed sales -----------------------------------------------------------------------------------------------------------
PERIOD_YEARS = [("(2005 + k % 20) || '年第' || (1 + k % 4) || '四半期'", "2005 + k % 20"), ("'令和' || (1 + k % 6) || '年第' || (1 + k % 4) || '四半期'", "2019 + k % 6"), ("'時期不明'", "NULL")]
PERIOD_QUARTERS = [(PERIOD_YEARS[0][0], "1 + k % 4"), (PERIOD_YEARS[1][0], "1 + k % 4"), (PERIOD_YEARS[2][0], "NULL")]
SALE_PRICES = [("'' || (200000 + k * 1000)", "(200000 + k * 1000) // 10000"), ("s || ',500'", "s * 1000 + 500"), ("s || '億' || (k % 9000) || '万円'", "s * 10000 + k % 9000"), ("s || '億'", "s * 10000"), ("'非公開'", "NULL")]
FEED_PRICES = [("'' || (10000000 + k * 100)", "(10000000 + k * 100) // 10000"), ("'' || (s * 10)", "s * 10"), ("'9999'", "9999"), ("'-'", "NULL")]
DISTANCES = [("'徒歩' || s || '分'", "s"), ("s || '～' || (s + 5) || '分'", "s"), ("(s + 5) || '-' || s || 'm'", "s"), ("'近い'", "NULL")]
PERCENTS = [("s || '％'", "s"), ("'建ぺい率 ' || s || ' %'", "s"), ("'なし'", "NULL")]
GROUPS = [("(1 + k % 5) || 'LDK+S'", "(1 + k % 5) || 'LDK'"), ("(1 + k % 5) || 'SLDK'", "(1 + k % 5) || 'LDK'"), ("(1 + k % 5) || 'LD'", "(1 + k % 5) || 'LDK'"), ("(1 + k % 5) || 'K'", "(1 + k % 5) || 'DK'"), ("(1 + k % 5) || 'S+S'", "(1 + k % 5) || 'S+S'"), ("'1R'", "'1R'")]
_SALES = [("year", PERIOD_YEARS, "BIGINT"), ("quarter", PERIOD_QUARTERS, "BIGINT"), ("sale_price", SALE_PRICES, "BIGINT"), ("feed_price", FEED_PRICES, "BIGINT"), ("distance", DISTANCES, "BIGINT"), ("percent", PERCENTS, "BIGINT"), ("layout_group", GROUPS, "VARCHAR")]


@query("SELECT k, " + ", ".join(f"{meant(forms, kind)} AS {name}" for name, forms, kind in _SALES) + f", k || '_' || s || '_' AS sale_key FROM {KEYS}")
def spoken_sales(spark, d):
    """Texts of sale files and feeds."""
    p = numbers.sale_period(told(PERIOD_YEARS))
    return keys(spark, d).select(
        "k", p["year"].alias("year"), p["quarter"].alias("quarter"), numbers.sale_price(told(SALE_PRICES)).alias("sale_price"), numbers.sale_price_of_feed(told(FEED_PRICES)).alias("feed_price"), numbers.distance(told(DISTANCES)).alias("distance"),
        numbers.percent(told(PERCENTS)).alias("percent"), numbers.layout_group(told(GROUPS)).alias("layout_group"), numbers.transaction_key(F.col("k"), F.col("s"), F.lit(None)).alias("sale_key"),
    )


@query(f"""SELECT k, CASE WHEN a > 0 THEN CAST(floor(p * 10000 / a) AS BIGINT) END AS yen_per_metre, CASE WHEN a > 0 THEN CAST(round_even(p / (a / 3.30578), 0) AS BIGINT) END AS per_tsubo, p * 10000 AS yen, floor(a) AS area_step, round_even(a / 0.5, 0) * 0.5 AS half_step,
CASE WHEN p // 10000 > 0 AND p % 10000 > 0 THEN (p // 10000) || '億' || format('{{:,}}', p % 10000) || '万円' WHEN p // 10000 > 0 THEN (p // 10000) || '億円' ELSE format('{{:,}}', p) || '万円' END AS display
FROM (SELECT k, CAST(CASE WHEN k % 3 = 0 THEN s * 10000 ELSE s * 777 + k % 10000 END AS BIGINT) AS p, CASE WHEN k % 9 = 0 THEN 0.0 ELSE CAST(20 + k % 80 AS DOUBLE) + (k % 4) / 8.0 END AS a FROM {KEYS})""")
def price_units(spark, d):
    """Prices per square metre and per tsubo, in yen, for display; areas in steps."""
    v = keys(spark, d).selectExpr("k", "CAST(CASE WHEN k % 3 = 0 THEN s * 10000 ELSE s * 777 + k % 10000 END AS BIGINT) AS p", "CASE WHEN k % 9 = 0 THEN 0.0D ELSE CAST(20 + k % 80 AS DOUBLE) + (k % 4) / 8.0D END AS a")
    p, a = F.col("p"), F.col("a")
    return v.select(
        "k", numbers.unit_price(p.cast("double"), a).alias("yen_per_metre"), numbers.tsubo_price(p.cast("double"), a).alias("per_tsubo"), (p * 10_000).alias("yen"), numbers.area_bucket(a).alias("area_step"), numbers.area_bucket(a, 0.5).alias("half_step"),
        numbers.display_price(p).alias("display"),
    )


# Names --------------------------------------------------------------------------------------------------------------------
ADVERTISED = [
    ("'【ペット可】ガーデン' || k", "'ガーデン' || k"), ("'駅近 コート' || k || ' 新築'", "'コート' || k"), ("'★リノベーション★'", "''"), ("'タワー' || k || ' 5階'", "'タワー' || k"), ("'パーク' || k", "'パーク' || k"), ("'コート' || k || '（南向き）'", "'コート' || k"),
    ("'ヒル' || k || '（A棟）'", "'ヒル' || k || '(A棟)'"), ("''", "''"),
]
WINGS = [
    ("'ヒル' || k || ' EAST'", "'ヒル' || k || ' 東棟'"), ("'ヒル' || k || ' ウエスト棟'", "'ヒル' || k || ' 西棟'"), ("'ヒル' || k || ' N棟'", "'ヒル' || k || ' 北棟'"), ("'ヒル' || k || ' 弐番館'", "'ヒル' || k || ' 2番館'"), ("'EASTON' || k", "'EASTON' || k"), ("'ヒル' || k || ' TOWER'", "'ヒル' || k || 'タワー'"),
]
DISPLAYS = [
    ("'パーク　Ⅲ★' || k", "'パーク III ' || k"), ("'ｐａｒｋ' || k", "'PARK' || k"), ("'シティ―' || k || '〜館'", "'シティ-' || k || '~館'"), ("'ヒル' || k || ' イースト'", "'ヒル' || k || ' 東棟'"), ("'a・b' || k", "'A・B' || k"),
]
CANONICALS = [
    ("'パーク Ⅲ ' || k", "'パーク3' || k"), ("'ぱーく・' || k || ' 東'", "'パーク' || k || '東'"), ("'第二棟 ' || k", "'第2棟' || k"), ("'Tower XIV'", "'タワー14'"), ("'三田' || k", "'三田' || k"), ("'コート 十二号'", "'コート12号'"), ("''", "''"),
]
ROOMS = [("'ハイツ' || s || 'A' || (101 + k % 800)", "'ハイツ' || s || 'A'"), ("'コート ' || (101 + k % 800) || '号室'", "'コート'"), ("'ビル 3階'", "'ビル 3階'"), ("'館 ' || (1001 + k % 800) || '号'", "'館'")]
ROOM_NUMBERS = [(ROOMS[0][0], "'' || (101 + k % 800)"), (ROOMS[1][0], "'' || (101 + k % 800)"), (ROOMS[2][0], "NULL"), (ROOMS[3][0], "'' || (1001 + k % 800)")]
TAILS = [("'ハイツ' || k || '-' || s", "'ハイツ' || k"), ("'コート ' || s || '号室'", "'コート'"), ("'館' || k || 'X'", "'館' || k || 'X'"), ("'ビル　' || s", "'ビル'")]
KANA = [("'ひらがな' || k", "'ヒラガナ' || k"), ("'カタカナゔ'", "'カタカナヴ'"), ("'abc漢字'", "'abc漢字'")]
COMPARED = [("'ｐａｒｋ－' || k || ' （東）'", "'park' || k || '東'"), ("'A・B ' || k", "'ab' || k"), ("'_-!'", "''")]
_NAMES = [
    ("stripped", ADVERTISED), ("wings", WINGS), ("display", DISPLAYS), ("canonical", CANONICALS), ("without_room", ROOMS), ("room", ROOM_NUMBERS), ("tail_gone", TAILS), ("kana", KANA), ("compared", COMPARED),
]
#: NULL has an empty display form, canonical key, stripped name and name without a room, not NULL.
_EMPTY = {"stripped", "display", "canonical", "without_room"}


@query("SELECT k, " + ", ".join((f"coalesce({meant(f, 'VARCHAR')}, '')" if n in _EMPTY else meant(f, "VARCHAR")) + f" AS {n}" for n, f in _NAMES) + f", coalesce({meant(ADVERTISED, 'VARCHAR')}, '') <> '' AS is_name FROM {KEYS}")
def spoken_names(spark, d):
    """Building names: adverts, wings and room numbers taken off, display form and keys."""
    split = names.split_room(told(ROOMS))
    return keys(spark, d).select(
        "k", names.strip_adverts(told(ADVERTISED)).alias("stripped"), names.wing_name(told(WINGS)).alias("wings"), names.display_name(told(DISPLAYS)).alias("display"), names.canonical_key(told(CANONICALS)).alias("canonical"), split["name"].alias("without_room"),
        split["room"].alias("room"), names.without_room(told(TAILS), F.col("s")).alias("tail_gone"), names.katakana(told(KANA)).alias("kana"), names.comparison_key(told(COMPARED)).alias("compared"), names.valid_name(told(ADVERTISED)).alias("is_name"),
    )


#: Fixed values for the two dictionary queries below.
READINGS = {"白金": "しろかね", "高輪": "たかなわ", "白": "しろ"}
ENGLISH = {"park": "パーク", "house": "ハウス", "court": "コート"}
READ = [("'白金' || k", "'しろかね' || k"), ("'白高輪'", "'しろたかなわ'"), ("'白山'", "NULL"), ("'かな'", "'かな'")]
SPELLED = [("'PARK HOUSE ' || k", "'パークハウス' || k"), ("'Court'", "'コート'"), ("'Parker court'", "'Parkerコート'"), ("'ヒル'", "'ヒル'")]


@query(f"SELECT k, {meant(READ, 'VARCHAR')} AS reading, {meant(SPELLED, 'VARCHAR')} AS kana FROM {KEYS}")
def read_names(spark, d):
    """Readings by a dictionary, and English words in katakana."""
    return keys(spark, d).select("k", names.reading(READINGS)(told(READ)).alias("reading"), names.english_kana(told(SPELLED), ENGLISH).alias("kana"))


@query("""WITH v AS (SELECT p_brand AS building, 'コート' || repeat('館', CAST(p_partkey % 4 AS INTEGER)) || CASE WHEN p_partkey % 3 = 0 THEN '...' ELSE '' END AS name FROM part)
SELECT building, name FROM (SELECT DISTINCT building, name, row_number() OVER (PARTITION BY building ORDER BY length(regexp_replace(name, '[^一-龥]', '', 'g')) * 10 + length(name) + 50 - CASE WHEN name LIKE '%...' THEN 100 ELSE 0 END DESC, name) AS rn FROM (SELECT DISTINCT * FROM v)) WHERE rn = 1""")
def best_names(spark, d):
    """The best of a building's names: kanji and length count, names cut off by dots come last."""
    v = table(spark, d, "part").selectExpr("p_brand AS building", "'コート' || repeat('館', CAST(p_partkey % 4 AS INT)) || CASE WHEN p_partkey % 3 = 0 THEN '...' ELSE '' END AS name")
    return v.groupBy("building").agg(F.max_by("name", F.struct(names.name_quality(F.col("name")), F.lit(""))).alias("name"))


# Addresses and dates -----------------------------------------------------------------------------------------------------------
_T, _Y = "'東京都港区芝浦'", "'神奈川県横浜市西区みなとみらい'"
_B3 = "(1 + k % 5) || '-' || s || '-' || (1 + k % 9)"
ADDRESSES = [
    (f"{_T} || (1 + k % 5) || '丁目' || s || '番' || (1 + k % 9) || '号'", f"{_T} || {_B3}"), (f"'　東京都港区芝浦' || (1 + k % 5) || '－' || s || '－' || (1 + k % 9)", f"{_T} || {_B3}"), (f"{_T} || '四丁目２番３号'", f"{_T} || '4-2-3'"),
    (f"{_Y} || {_B3}", f"{_Y} || {_B3}"), ("'東京都 港区'", "'東京都港区'"), (f"{_T} || '十二丁目' || s || '番地3'", f"{_T} || '12-' || s || '-3'"),
]
_PLACES = [f"{_T} || {_B3} || 'タワー'", f"{_Y} || {_B3}", "'北海道札幌市中央区北'", "'東京都港区'", "'東京都'", "'芝浦' || s", "'?'"]
_PARTS = {
    "prefecture": ["'東京都'", "'神奈川県'", "'北海道'", "'東京都'", "'東京都'", "NULL", "NULL"], "city": ["NULL", "'横浜市'", "'札幌市'", "NULL", "NULL", "NULL", "NULL"], "ward": ["'港区'", "'西区'", "'中央区'", "'港区'", "NULL", "NULL", "NULL"],
    "area": ["'芝浦'", "'みなとみらい'", "'北'", "NULL", "NULL", "'芝浦'", "'?'"], "block": [_B3, _B3, "NULL", "NULL", "NULL", "'' || s", "NULL"], "building": ["'タワー'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL"],
    "level": ["4", "4", "3", "2", "1", "4", "3"], "label": ["'港区'", "'神奈川県横浜市'", "'北海道札幌市'", "'港区'", "'不明'", "'不明'", "'不明'"], "tokyo": ["'港区'", "NULL", "NULL", "'港区'", "NULL", "NULL", "NULL"],
    "candidates": [f"{_T}", f"{_Y}", "'北海道札幌市中央区北'", "'東京都港区'", "'その他'", "'その他'", "'その他'"], "key": [f"{_T} || {_B3}", f"{_Y} || {_B3}", "'北海道札幌市中央区北'", "'東京都港区'", "'東京都'", "'芝浦' || s", "'?'"],
    "upto_area": [f"{_T}", f"{_Y}", "'北海道札幌市中央区北'", "'東京都港区'", "'東京都'", "'芝浦'", "'?'"], "first_number": ["1 + k % 5", "1 + k % 5", "NULL", "NULL", "NULL", "s", "NULL"],
}
_PLACED = {name: list(zip(_PLACES, values, strict=True)) for name, values in _PARTS.items()}
_KIND = {"level": "INTEGER", "first_number": "INTEGER"}
#: What a NULL address gives, where that is not NULL.
_NONE = {"level": "0", "label": "'不明'", "candidates": "'その他'", "key": "''", "upto_area": "''"}
LISTED = [("'所在地：東京都港区芝浦' || s || ' [地図]'", "'東京都港区芝浦' || s"), ("'住所 東京都港区芝浦4-2'", "'東京都港区芝浦4-2'"), ("'東京都港区芝浦3丁目 駅近'", "'東京都港区芝浦3丁目'")]


@query(
    f"SELECT k, {meant(ADDRESSES, 'VARCHAR')} AS normal, {meant(LISTED, 'VARCHAR')} AS listed, " + ", ".join((f"coalesce({meant(f, _KIND.get(n, 'VARCHAR'))}, {_NONE[n]})" if n in _NONE else meant(f, _KIND.get(n, "VARCHAR"))) + f" AS {n}" for n, f in _PLACED.items()) + f", k % 8 < 4 AS has_address, 'A' || k AS head FROM {KEYS}"
)
def spoken_addresses(spark, d):
    """Addresses: one notation, components, levels, keys."""
    place = told(_PLACED["key"])
    p = address.address_parts(place)
    return keys(spark, d).select(
        "k", address.address_normal(told(ADDRESSES)).alias("normal"), address.address_end(told(LISTED)).alias("listed"), *[p[n].alias(n) for n in ("prefecture", "city", "ward", "area", "block", "building")], address.address_level(place).alias("level"),
        address.ward_label(place).alias("label"), address.tokyo_ward(place).alias("tokyo"), address.area_block(place).alias("candidates"), address.address_key(place).alias("key"), address.address_prefix(place, 3).alias("upto_area"),
        F.get(address.block_numbers(p["block"]), F.lit(0)).alias("first_number"), address.has_address(place).alias("has_address"), address.before_hyphen(F.concat(F.lit("A"), F.col("k"), F.lit("-1-2"))).alias("head"),
    )


@query(f"SELECT k, round(CASE k % 4 WHEN 0 THEN 1.0 WHEN 3 THEN (0.1 + 0.15) / 0.45 ELSE (0.1 + 0.15 + 0.2 + 0.3 * 2 / 3) / 0.75 END, 6) AS similarity FROM {KEYS}")
def similar_addresses(spark, d):
    """Weighted similarity: equal, another last number, a shorter block, another area without blocks."""
    a = F.when(F.col("k") % 4 == 3, F.lit("東京都港区芝浦")).otherwise(F.lit("東京都港区芝浦4-2-3"))
    b = F.expr("CASE k % 4 WHEN 0 THEN '東京都港区芝浦4-2-3' WHEN 1 THEN '東京都港区芝浦4-2-9' WHEN 2 THEN '東京都港区芝浦4-2' ELSE '東京都港区三田' END")
    rows = keys(spark, d).select("k", a.alias("a"), b.alias("b"))
    # two addresses are compared once, however many rows have them
    met = stage(rows.select("a", "b").distinct(), "addresses")
    scored = met.select("a", "b", F.round(address.address_similarity(address.address_parts(F.col("a")), address.address_parts(F.col("b"))), 6).alias("similarity"))
    return rows.join(broadcast_checked(stage(scored, "scored_addresses")), ["a", "b"]).select("k", "similarity")


_NOW = "2001-06-15 12:00:00"
LEASES = [("'借地権 残存' || (1 + k % 60) || '年' || (1 + k % 11) || 'ヶ月'", "12 * (1 + k % 60) + 1 + k % 11"), ("'残り' || (1 + k % 60) || '年'", "12 * (1 + k % 60)"), ("'所有権'", "NULL")]


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t, CAST(o_orderdate AS DATE) AS day, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-15') AS n, {meant(LEASES, 'INTEGER', 'o_orderkey').replace('k % ', 'o_orderkey % ')} AS m FROM orders)
SELECT k, CAST(floor(epoch(TIMESTAMP '{_NOW}' - t) / 86400) AS BIGINT) AS on_market, CASE WHEN n <= 0 THEN 'today' WHEN n < 7 THEN n || ' days' WHEN n < 30 THEN (n // 7) || ' weeks' WHEN n < 365 THEN (n // 30) || ' months' ELSE (n // 365) || ' years' END AS age,
CAST(year(day) * 4 + quarter(day) AS BIGINT) AS quarters, CAST(day + to_months(m) AS DATE) AS lease_end, 2001 - CAST(year(day) AS INTEGER) AS years_old, strftime(t, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS jst FROM o""")
def dates_of_sales(spark, d):
    """Days on the market, ages in words, quarters in a row, ends of leases, local time with its offset."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"), F.to_date("o_orderdate").alias("day"))
    now = F.lit(_NOW).cast("timestamp_ntz")
    return o.select(
        "k", address.days_on_market(F.col("t"), now).cast("long").alias("on_market"), address.age_text(F.col("day"), F.to_date(now)).alias("age"), address.quarter_number(F.year("day"), F.quarter("day")).alias("quarters"),
        address.lease_end(told(LEASES), F.col("day")).alias("lease_end"), numbers.age(F.year("day"), now).alias("years_old"), address.local_iso(F.col("t")).alias("jst"),
    )


# Filters ----------------------------------------------------------------------------------------------------------------------
TENURES = ["所有権", "旧法借地権", "一般定期借地権", "地上権（普）"]


@query(f"""SELECT k FROM (SELECT k, s, 1960 + k % 60 AS built, CASE k % 5 WHEN 0 THEN '所有権' WHEN 1 THEN '旧法借地権' WHEN 2 THEN '一般定期借地権' WHEN 3 THEN '地上権（普）' END AS tenure, CASE WHEN k % 7 <> 0 THEN s * 100 END AS low, CASE WHEN k % 7 <> 0 THEN s * 110 END AS high, s * 90 AS final FROM {KEYS})
WHERE built >= 2024 - 30 AND (contains(tenure, '借地権') OR contains(tenure, '地上権') OR contains(tenure, '賃借権')) AND coalesce(high, final) >= 1500 AND coalesce(low, final) <= 4000""")
def tenure_and_age(spark, d):
    """Filters by age, by kind of tenure, and by a price range that falls back to the final price."""
    v = keys(spark, d).selectExpr("k", "s", "1960 + k % 60 AS built", "CASE k % 5 WHEN 0 THEN '所有権' WHEN 1 THEN '旧法借地権' WHEN 2 THEN '一般定期借地権' WHEN 3 THEN '地上権（普）' END AS tenure", "CASE WHEN k % 7 <> 0 THEN s * 100 END AS low", "CASE WHEN k % 7 <> 0 THEN s * 110 END AS high", "s * 90 AS final")
    wanted = [filters.max_age(F.col("built"), 30, F.lit("2024-06-30").cast("date")), filters.tenure(F.col("tenure"), ["leased"]), filters.range_price(F.col("low"), F.col("high"), F.col("final"), 1500, 4000)]
    return v.where(filters.all_of(wanted)).select("k")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45))")
def searched_units(spark, d):
    """Every term must match a name, a brand or an alias: "red ring", where some units have the alias "RING"."""
    alias = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("building_id"), F.lit("RING").alias("normalized_name"))
    return filters.search(table(spark, d, "part"), "red　ring", ["p_name", "p_brand"], alias, "p_partkey").select("p_partkey")


@query("SELECT event_id, CAST(ts AS DATE) >= DATE '2024-01-30' AS d24, CAST(ts AS DATE) >= DATE '2024-01-29' AS d48, CAST(ts AS DATE) >= DATE '2024-01-28' AS d72 FROM events")
def since_hours(spark, d):
    """Hours are counted in calendar days."""
    now = F.lit("2024-01-30 15:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", *[filters.since_days(F.col("ts"), now, h).alias(f"d{h}") for h in (24, 48, 72)])


@query("SELECT s_suppkey FROM (SELECT s_suppkey, 35.6 + (s_suppkey * 37 % 1000) / 5000.0 AS lat, 139.6 + (s_suppkey * 91 % 1000) / 5000.0 AS lon FROM supplier) WHERE lat BETWEEN 35.65 AND 35.72 AND lon BETWEEN 139.65 AND 139.75")
def in_map_window(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (35.6 + (F.col("s_suppkey") * 37 % 1000) / 5000.0).alias("lat"), (139.6 + (F.col("s_suppkey") * 91 % 1000) / 5000.0).alias("lon"))
    return s.where(filters.in_box(F.col("lat"), F.col("lon"), 35.65, 35.72, 139.65, 139.75)).select("s_suppkey")
