"""Text extraction, names and addresses by example; each list is text → expected."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import address, names, numbers
from plumbline.operators import filters


def run(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [tuple(r["v"]) if hasattr(r["v"], "asDict") else r["v"] for r in rows]


CASES = [
    (numbers.price, {"3,210万円": 3210, "1億4500万円": 14500, "3億円": 30000, "4億": 40000, "売値 6,789 万円 (税別)": 6789, "土地建物１億０，０５０万": 10050, "７，６５４万円": 7654, "": None, "応相談": None, None: None, "2億と300万円": 20000, "8000円": None}),
    (numbers.area, {"61.7㎡": 61.7, "95.2m2": 95.2, "44.1m²": 44.1, "66平米": 66.0, "58.6平方メートル": 58.6, "室内 38.25 ㎡": 38.25, "広さ不明": None, "4.5.6㎡": None, "300m": None}),
    (numbers.floor_number, {"7階": 7, "6階/RC11階建": 6, "14階/25階建": 14, "部屋は 3階": 3, "地上31階建": None, "8階建": None, "地下1階地上9階建": None}),
    (numbers.total_floors, {"地上17階建": (17, 0), "RC14階地下2階建": (14, 2), "SRC33階建": (33, 0), "地上26階地下3階建": (26, 3), "11階建": (11, 0), "28階": (28, 0), "": None, "地下3階": (None, 3), "5階/鉄骨造8階建": (8, 0)}),
    (numbers.total_units, {"2,047戸": 2047, "130戸超": 130, "全戸数: 77": 77, "412": 412, "88888戸": None}),
    (numbers.layout, {"３ＬＤＫ": "3LDK", "ワンルーム": "1R", "1ルーム": "1R", "スタジオ": "STUDIO", "3SLDK": "3SLDK", "2SK": "2SK", "3R": "3R", "2LDK+S": "2LDK+S", "1LDK＋納戸": "1LDK+S", "3 LDK + Service Room": "3LDK+S", "DK": "1DK", "4KDL": "4LDK", "?": None, "1DK+2K": "1DK", "2DK+LK": "2DK+LK", None: None}),
    (numbers.direction, {"N": "北", "SW": "南西", "東向き": "東", "窓：北西向き": "北西", "": None}),
    (numbers.structure, {"RC造": "RC", "鉄骨鉄筋コンクリート造": "SRC", "鉄骨造": "S造", "木造": "木造", "軽量鉄骨造": "軽量鉄骨"}),
    (numbers.date, {"2023年4月9日": datetime.date(2023, 4, 9), "2023/04/09": datetime.date(2023, 4, 9), "2023-4-9": datetime.date(2023, 4, 9), "2023年2月30日": None, "期日未定": None}),
    (numbers.monthly_fee, {"7,300円": 7300, "修繕費：6,150円/月": 6150, "4,420（円/月）": 4420, "1万2600円": 12600, "5万円": 50000, "なし": None}),
    (numbers.built_year, {"2018年築": 2018, "完成：2009年11月": 2009, "1983/10": 1983, " 1996 ": 1996, "平成19年築": 2007, "令和4年築": 2022, "昭和61年": 1986, "不詳": None, "12018年": None}),
    (numbers.built_year_month, {"平成18年7月": (2006, 7), "1983/10": (1983, 10), "2018年14月": (2018, None), "": (None, None)}),
    (numbers.first_integer, {"約64円": 64, "": None, None: None}),
    (numbers.sale_period, {"2023年第3四半期": (2023, 3), "令和5年第1四半期": (2023, 1)}),
    (numbers.sale_price, {"35,000,000": 3500, "4,500": 4500, "1億2000万円": 12000}),
    (numbers.sale_price_of_feed, {"35000000": 3500, "4500": 4500, "12345": 1}),
    (numbers.layout_group, {"2LDK+S": "2LDK", "3SLDK": "3LDK", "2LD": "2LDK", "2K": "2DK", "2S+S": "2S+S"}),
    (numbers.squeezed, {"  a \n b ": "a b", "   ": None}),
    (names.display_name, {"白金ザ・スカイ EAST": "白金ザ・スカイ 東棟", "白金ザ・スカイ イースト棟": "白金ザ・スカイ 東棟", "白金ザ・スカイE棟": "白金ザ・スカイ 東棟", "パークⅡ★": "パークII", "イトーピア壱番館": "イトーピア1番館", "ＡＢＣ　タワー": "ABC タワー", None: ""}),
    (names.canonical_key, {"パークハウス　Ⅱ": "パークハウス2", "ぱーく・ハウス": "パークハウス", "三田マンション 三": "三田マンション3", "シティ第二棟": "シティ第2棟", "TOWER XIV": "タワー14"}),
    (names.split_room, {"パークハウス101": ("パークハウス", "101"), "東京タワー 2003号": ("東京タワー", "2003"), "ビル 3階": ("ビル 3階", None), "": ("", None)}),
    (names.strip_adverts, {"【ペット可】パークハウス渋谷": "パークハウス渋谷", "駅近 パークハウス渋谷 新築": "パークハウス渋谷", "★リノベーション★": "", "パークハウス渋谷 5階": "パークハウス渋谷"}),
    (address.address_normal, {"東京都港区芝浦四丁目２番３号": "東京都港区芝浦4-2-3", "港区三田1丁目2番地3": "港区三田1-2-3", "港区三田１－２－３": "港区三田1-2-3"}),
    (address.address_parts, {"東京都港区芝浦4-2-3タワー": ("東京都", None, "港区", None, "芝浦", "4-2-3", "タワー"), "神奈川県横浜市西区みなとみらい2-1": ("神奈川県", "横浜市", "西区", None, "みなとみらい", "2-1", None)}),
    (address.ward_label, {"東京都港区芝浦": "港区", "横浜市西区": "横浜市", "?": "不明", None: "不明"}),
    (address.area_block, {"東京都港区芝浦4-2": "東京都港区芝浦", "?": "その他"}),
    (address.address_level, {"東京都港区芝浦4-2": 4, "東京都港区": 2, "東京都": 1, "?": 3}),
    (address.address_end, {"所在地：東京都港区芝浦4-2-3 [地図]": "東京都港区芝浦4-2-3"}),
]


@pytest.mark.parametrize(("f", "cases"), CASES, ids=[f.__name__ for f, _ in CASES])
def test_examples(spark, f, cases):
    assert run(spark, f, list(cases)) == list(cases.values())


def test_validation(spark):
    df = spark.createDataFrame([(50, 5.0, 12, 10, 1850), (5000, 70.0, 3, 10, 2000), (None, None, None, None, None)], "p int, a double, f int, t int, y int")
    c = numbers.complaints(F.lit("2024-01-01").cast("date"), *[F.col(k) for k in "pafty"])
    assert [len(r[0]) for r in df.select(c).collect()] == [4, 0, 0]


def test_rooms_and_hash(spark):
    df = spark.createDataFrame([("みどりの館706", "706"), ("川辺コート 1203", "1203"), ("石垣ハイツ415号室", "415"), ("ザ 見本", "3301"), ("x", None)], "n string, r string")
    assert [r[0] for r in df.select(names.without_room(F.col("n"), F.col("r"))).collect()] == ["みどりの館", "川辺コート", "石垣ハイツ", "ザ 見本", "x"]
    h = df.select(names.item_hash({"a": F.lit(1), "b": F.lit(None)}), names.item_hash({"b": F.lit(""), "a": F.lit("1")})).first()
    assert h[0] == h[1] and len(h[0]) == 64


def test_address_similarity(spark):
    a, b = (address.address_parts(F.lit(t)) for t in ("東京都港区芝浦4-2-3", "東京都港区芝浦4-2-9"))
    r = spark.range(1).select(address.address_similarity(a, b), address.address_similarity(a, a), address.haversine(F.lit(35.0), F.lit(139.0), F.lit(35.0), F.lit(139.01))).first()
    assert 0.8 < r[0] < 0.9 and r[1] == 1.0 and r[2] == pytest.approx(910.9, abs=0.5)


def test_lease(spark):
    d = F.lit("2024-01-15").cast("date")
    r = spark.range(1).select(address.lease_end(F.lit("定期借地権 残存50年6ヶ月"), d).alias("e")).select("e", address.lease_left(F.col("e"), d)).first()
    assert r[0] == datetime.date(2074, 7, 15) and r[1] == "残存50年6ヶ月"


def test_reading_and_remarks(spark):
    read = names.reading({"白金": "しろかね", "白": "しろ", "高輪": "たかなわ"})
    df = spark.createDataFrame([("白金高輪",), ("白山",), (None,)], "n string")
    assert [r[0] for r in df.select(read("n")).collect()] == ["しろかねたかなわ", None, None]
    words = {"ペット": ("ペット可", "ペット不可")}
    assert names.facts(["ペット可です", "ペット不可", None, "角部屋", "角部屋"], words) == "ペット: 要確認 / 角部屋"


def test_search_terms(spark):
    assert filters.split_terms("白金ザ　タワー") == ["白金ザ", "白金", "ザ", "タワー"]
    assert "ＰＡＲＫ" in filters.variants("park".upper()) and "パーク" in filters.variants("ぱーく")
    b = spark.createDataFrame([(1, "つばきハウス渋谷"), (2, "ささの木新宿"), (3, None)], "id long, name string")
    alias = spark.createDataFrame([(1, "TSUBAKI HOUSE 渋谷"), (2, "100%_")], "building_id long, normalized_name string")
    found = lambda q: [r["id"] for r in filters.search(b, q, ["name"], alias).orderBy("id").collect()]
    assert (found("ツバキ"), found("新宿"), found("tsubaki"), found("ツバキ 新宿"), found("%")) == ([1], [2], [1], [], [2])


def test_state_price_and_hours(spark):
    rows = spark.createDataFrame([(True, 5, 9), (False, 5, 9), (None, 5, 9)], "a boolean, c int, f int")
    assert rows.where(filters.state_price(F.col("a"), F.col("c"), F.col("f"), 1, 6)).count() == 1
    assert rows.where(filters.state_price(F.col("a"), F.col("c"), F.col("f"), 0, None)).count() == 3
    ts = spark.createDataFrame([("2024-01-10 00:10:00",), ("2024-01-09 23:00:00",), ("2024-01-08 23:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    assert [ts.where(filters.since_days(F.col("t"), now, h)).count() for h in (24, 48, 72)] == [1, 2, 3]
