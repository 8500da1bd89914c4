"""Phrases taken off the ends of texts, against a search for each phrase by itself."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from plumbline.operators import phrases


def border(text, i):
    return i in (0, len(text)) or not phrases._kind(text[i]) or phrases._kind(text[i]) != phrases._kind(text[i - 1])


def plain_ends(text, table):
    """Tries every phrase at every place, one end after the other."""
    skip = lambda t, i: i < len(t) and not phrases._kind(t[i])
    left = at = 0
    while True:
        hits = []
        while not (hits := [len(p) for p in table if text.startswith(p, at) and border(text, at) and border(text, at + len(p))]) and skip(text, at):
            at += 1
        if not hits:
            break
        at = left = at + max(hits)
    while left and skip(text, left):
        left += 1
    right = at = len(text)
    while at > left:
        hits = [len(p) for p in table if text[:at].endswith(p) and border(text, at) and border(text, at - len(p))]
        if hits:
            if at - max(hits) < left:
                break
            at = right = at - max(hits)
        elif not phrases._kind(text[at - 1]):
            at -= 1
        else:
            break
    while left < right < len(text) and not phrases._kind(text[right - 1]):
        right -= 1
    return text[left:right]


def test_ends_are_those_of_single_searches():
    rng, table = random.Random(4), phrases.advert_phrases() + phrases.chained(["a", "b c", "de"])
    assert len(table) > 300
    strip = phrases.Stripper(table)
    bits = [*rng.sample(table, 60), "渋谷", "ハイツ", "パーク", "タワー", "ab", "de la", " ", "・", "!", "★", "10", "階"]
    for _ in range(3000):
        text = unicodedata.normalize("NFKC", "".join(rng.choice(bits) for _ in range(rng.randint(0, 7))))
        assert strip._ends(text) == plain_ends(text, table), text


@pytest.mark.parametrize(
    "text, left",
    [
        ("【新規価格変更】ハイツ渋谷", "ハイツ渋谷"), ("★リノベーション済み★パークタワー 駅徒歩5分", "パークタワー"), ("新築", ""), ("ハイツ新築渋谷", "ハイツ新築渋谷"), ("（角部屋（最上階））コート 築12年", "コート"),
        ("ハイツ（東棟）", "ハイツ(東棟)"), ("", ""), (None, None), ("新築渋谷ハイツ", "新築渋谷ハイツ"), ("ペット可 ・ パークハウス ・ ３階部分", "パークハウス"), ("値下げ/駅近", ""), ("「新築」", ""),
    ],
)
def test_examples(text, left):
    assert phrases.Stripper(phrases.advert_phrases()).strip(text) == left


def test_tables_of_phrases(spark):
    df = spark.createDataFrame([("red widget",), ("redwidget",), ("widget red red",), (None,), ("x" * 100_000 + " red",)], "n string")
    table = spark.createDataFrame([("red", 1), (None, 2), ("", 3)], "p string, k int")
    assert [r[0] and r[0][:9] for r in df.select(phrases.stripped(F.col("n"), table)).collect()] == ["widget", "redwidget", "widget", None, "x" * 9]
    assert [r[0] for r in df.limit(1).select(phrases.stripped(F.col("n"), table.limit(0))).collect()] == ["red widget"]
    with pytest.raises(ValueError):
        phrases.stripped(F.col("n"), spark.range(20).selectExpr("cast(id AS string)"), most=10)
