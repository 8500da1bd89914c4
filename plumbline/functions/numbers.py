"""Numbers, dates and categories out of listing text, as column expressions.

All functions take and return columns, stay inside code generation, and give NULL where nothing matches. Patterns are
tried in the order given; the first that matches decides.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms, limits, words for directions, structures and eras.
WIDE_DIGITS, DIGITS = "０１２３４５６７８９，", "0123456789,"
WIDE_LETTERS = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PRICE_RANGE, AREA_RANGE, FIRST_YEAR, YEARS_AHEAD, UNITS_RANGE = (100, 1_000_000), (10.0, 1000.0), 1900, 5, (1, 10_000)
DIRECTIONS = [("南東", "南東"), ("SE", "南東"), ("南西", "南西"), ("SW", "南西"), ("北東", "北東"), ("NE", "北東"), ("北西", "北西"), ("NW", "北西"), ("南", "南"), ("S", "南"), ("北", "北"), ("N", "北"), ("東", "東"), ("E", "東"), ("西", "西"), ("W", "西")]
STRUCTURES = [("鉄骨鉄筋コンクリート", "SRC"), ("鉄筋コンクリート", "RC"), ("SRC", "SRC"), ("RC", "RC"), ("軽量鉄骨", "軽量鉄骨"), ("鉄骨", "S造"), ("S", "S造"), ("木造", "木造"), ("W", "木造"), ("ALC", "ALC")]
ERAS = [("令和", 2018), ("平成", 1988), ("昭和", 1925)]
TSUBO = 3.30578


def narrow_digits(c: Column) -> Column:
    return F.translate(c, WIDE_DIGITS, DIGITS)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL without a match or if the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def whole(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match as a long, commas dropped."""
    return F.regexp_replace(found(c, pattern, group), ",", "").try_cast("long")


def within(c: Column, lo, hi) -> Column:
    return F.when(c.between(lo, hi), c)


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def measures(c: Column) -> Column:
    """The numbers of a text in order: array of struct(n, unit, lead).

    ``unit`` is what follows a number up to the next one, ``lead`` what stands before it. Wide forms are narrowed; commas
    and white space are dropped.
    """
    t = F.regexp_replace(F.translate(narrow_digits(c), "（）", "()"), r"[\s　,]+", "")
    cut = F.regexp_extract_all(t, F.lit(r"^[^0-9]+|[0-9]+(?:\.[0-9]+)*[^0-9]*"), F.lit(0))
    unit = lambda x: F.regexp_replace(x, r"^[0-9.]+", "")
    each = lambda parts: F.filter(F.transform(parts, lambda x, i: F.struct(F.regexp_extract(x, r"^[0-9.]+", 0).alias("n"), unit(x).alias("unit"), F.when(i > 0, unit(F.get(parts, i - 1))).otherwise("").alias("lead"))), lambda m: m["n"] != "")
    return bound(cut, each)


def first(tokens: Column, test) -> Column:
    """The number of the first token that passes."""
    return F.get(F.filter(tokens, test), 0)["n"].try_cast("long")


def two_units(tokens: Column, large: str, small: str) -> Column:
    """10,000 times the first number before ``large``, plus the number before ``small`` if it comes right after."""
    pairs = F.transform(tokens, lambda m, i: F.struct(m["n"].alias("n"), m["unit"].alias("unit"), F.get(tokens, i + 1).alias("next")))
    low = lambda p: F.when((p["unit"] == large) & F.coalesce(p["next"]["unit"].startswith(small), F.lit(False)), p["next"]["n"].try_cast("long"))
    return bound(F.get(F.filter(pairs, lambda p: p["unit"].startswith(large)), 0), lambda p: p["n"].try_cast("long") * 10_000 + F.coalesce(low(p), F.lit(0)))


def price(c: Column) -> Column:
    """Price in units of 10,000 yen: 億 with 万 right after it, 億 alone, else 万. A number without such a unit is no price."""
    return bound(measures(c), lambda ms: F.coalesce(two_units(ms, "億", "万"), first(ms, lambda m: m["unit"].startswith("万"))))


def monthly_fee(c: Column) -> Column:
    """Fee in yen: 万 with the rest right after it, else 円, also in brackets."""
    return bound(measures(c), lambda ms: F.coalesce(two_units(ms, "万", "円"), first(ms, lambda m: m["unit"].startswith("円") | m["unit"].startswith("(円"))))


def area(c: Column) -> Column:
    """Square metres: the first number before ㎡, m², m2, 平米 or 平方メートル."""

    def metres(ms: Column) -> Column:
        square = lambda u, after: u.startswith("㎡") | u.startswith("m²") | u.startswith("平米") | u.startswith("平方メートル") | ((u == "m") & F.coalesce(after == "2", F.lit(False)))
        marked = F.transform(ms, lambda m, i: F.struct(m["n"].alias("n"), square(m["unit"], F.get(ms, i + 1)["n"]).alias("ok")))
        return F.get(F.filter(marked, lambda m: m["ok"]), 0)["n"].try_cast("double")

    return bound(measures(c), metres)


def floor_number(c: Column) -> Column:
    """The floor of a unit: the first number before 階, but not one before 階建.

    A text that only tells how high the building is has none: no slash, and 階建 with 地上 or 地下.
    """
    building = ~c.contains("/") & c.contains("階建") & (c.contains("地上") | c.contains("地下"))
    return F.when(~building, bound(measures(c), lambda ms: first(ms, lambda m: m["unit"].startswith("階") & ~m["unit"].startswith("階建"))))


#: What stands before the number of floors where the structure is named.
STRUCTURE_ENDS = ["RC", "S造", "木造", "コンクリート造", "鉄骨造"]


def total_floors(c: Column) -> Column:
    """struct(total_floors, basement_floors); basement 0 if none is named, both NULL for empty text.

    The total is the number after 地上, else the one after a structure, else the one before 階建 (also with basement floors
    in between), else a floor that is not called 階部 or 階分; floors after 地下 are the basement's.
    """
    below = lambda m: m["lead"].endswith("地下")
    after = lambda m, words: functools.reduce(lambda x, y: x | y, [m["lead"].endswith(w) for w in words])
    floors = lambda m: m["unit"].startswith("階")

    def read(ms: Column) -> Column:
        total = F.coalesce(
            first(ms, lambda m: after(m, ["地上"]) & floors(m)),
            first(ms, lambda m: after(m, STRUCTURE_ENDS) & floors(m)),
            first(ms, lambda m: ~below(m) & (m["unit"].startswith("階建") | m["unit"].startswith("階地下"))),
            first(ms, lambda m: ~below(m) & floors(m) & ~m["unit"].startswith("階部") & ~m["unit"].startswith("階分")),
        )
        return F.struct(total.alias("total_floors"), F.coalesce(first(ms, lambda m: below(m) & floors(m)), F.lit(0)).alias("basement_floors"))

    return F.when(c.isNotNull() & (c != ""), bound(measures(c), read))


def total_units(c: Column) -> Column:
    """Units of a building, 1 to 10,000: the first number before 戸, else the first number."""
    valid = lambda x: within(x, *UNITS_RANGE)
    return bound(measures(c), lambda ms: F.coalesce(valid(first(ms, lambda m: m["unit"].startswith("戸"))), valid(first(ms, lambda m: F.lit(True)))))


def _era_year(ms: Column) -> Column:
    """The year of an era: 令和 before 平成 before 昭和."""
    of = lambda name: first(ms, lambda m: m["lead"].endswith(name) & m["unit"].startswith("年"))
    return F.coalesce(*[of(name) + before for name, before in ERAS])


def _western(m: Column) -> Column:
    return (F.length(m["n"]) == 4) & m["n"].try_cast("long").between(1900, 2099)


def _built_year(c: Column, ms: Column) -> Column:
    before_month = lambda m, i: _western(m) & (m["unit"] == "/") & F.get(ms, i + 1).isNotNull()
    bare = F.when(F.trim(narrow_digits(c)).rlike("^[0-9]{4}$"), first(ms, _western))
    return F.coalesce(first(ms, lambda m: _western(m) & m["unit"].startswith("年")), F.get(F.filter(ms, before_month), 0)["n"].try_cast("long"), bare, _era_year(ms))


def built_year(c: Column) -> Column:
    """Western year with 年, YYYY/MM, a bare year, or an era year."""
    return bound(measures(c), lambda ms: _built_year(c, ms))


def built_year_month(c: Column) -> Column:
    """struct(built_year, built_month): the month is the number before 月, else the one after a year and a slash."""

    def read(ms: Column) -> Column:
        slash = F.transform(ms, lambda m, i: F.struct(F.get(ms, i + 1)["n"].alias("n"), ((F.length(m["n"]) == 4) & m["unit"].startswith("/")).alias("ok")))
        month = F.coalesce(within(first(ms, lambda m: m["unit"].startswith("月")), 1, 12), within(F.get(F.filter(slash, lambda m: m["ok"]), 0)["n"].try_cast("long"), 1, 12))
        return F.struct(_built_year(c, ms).alias("built_year"), month.alias("built_month"))

    return bound(measures(c), read)


def age(year: Column, today: Column) -> Column:
    return F.year(today) - year


#: Names of service rooms after a plus sign.
SERVICE_ROOMS = ["サービスルーム", "SERVICEROOM", "S.R.", "SR", "納戸", "N", "WIC", "ウォークインクローゼット"]


def layout(c: Column) -> Column:
    """Room layout: wide forms narrowed, upper case, one room → 1R, service rooms → +S, letters in SLDK order, no number → 1.

    The first group of rooms counts, with what follows a plus sign: a service room, or more rooms, which stay as they are.
    """
    t = F.upper(F.translate(narrow_digits(c), WIDE_LETTERS + "＋　", LETTERS + "+ "))
    t = F.regexp_replace(F.regexp_replace(t, r"\s*\+\s*", "+"), r"SERVICE\s+ROOM", "SERVICEROOM")
    ordered = lambda x: F.concat(*[F.when(x.contains(k), k).otherwise("") for k in "SLDK"])

    def read(rooms: Column) -> Column:
        sides = F.split(rooms, r"\+", 2)
        base, extra = F.get(sides, 0), F.coalesce(F.get(sides, 1), F.lit(""))
        count, letters = F.coalesce(found(base, r"^([0-9]+)"), F.lit("1")), F.regexp_replace(base, r"[0-9\s]", "")
        service = functools.reduce(lambda x, y: x | y, [extra.startswith(w) for w in SERVICE_ROOMS])
        more = F.regexp_extract(extra, "^[SLDK]+", 0)
        return F.when(rooms.isNull() | (rooms == ""), None).when(letters == "R", F.concat(count, F.lit("R"))).when(service, F.concat(count, letters, F.lit("+S"))).when(more != "", F.concat(count, letters, F.lit("+"), more)).otherwise(F.concat(count, ordered(letters)))

    said = F.when(t.contains("ワンルーム") | t.contains("1ルーム"), "1R").when(t.contains("スタジオ") | t.contains("STUDIO"), "STUDIO")
    return F.coalesce(said, bound(F.regexp_extract(t, r"(?:[1-9][0-9]*\s*(?:[SLDK]+|R)|^[SLDK]+(?=\s|$|※|\+))(?:\+\S+)?", 0), read))


def contained(c: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first key that the text contains."""
    out = None
    for key, value in table:
        out = F.when(c.contains(key), value) if out is None else out.when(c.contains(key), value)
    return out


def direction(c: Column) -> Column:
    return contained(F.upper(c), DIRECTIONS)


def structure(c: Column) -> Column:
    return contained(c, STRUCTURES)


def date(c: Column) -> Column:
    """The first year, month and day, with 年月日, slashes or hyphens; NULL if there is no such day.

    All separators are made one first.
    """
    parts = F.split(F.regexp_extract(F.translate(c, "年月/", "---"), r"[0-9]{4}(-[0-9]{1,2}){2}", 0), "-")
    day = F.concat_ws("-", F.get(parts, F.lit(0)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    return day.try_cast("date")


def first_integer(c: Column) -> Column:
    return whole(c.cast("string"), r"(\d+)")


def valid_price(c: Column) -> Column:
    return F.coalesce(c.between(*PRICE_RANGE), F.lit(False))


def valid_area(c: Column) -> Column:
    return F.coalesce(c.between(*AREA_RANGE), F.lit(False))


def valid_floor(c: Column, total: Column | None = None) -> Column:
    ok = c >= 1
    return F.coalesce(ok if total is None else ok & F.coalesce(c <= total, F.lit(True)), F.lit(False))


def valid_built_year(c: Column, today: Column) -> Column:
    return F.coalesce(c.between(F.lit(FIRST_YEAR), F.year(today) + YEARS_AHEAD), F.lit(False))


def squeezed(c: Column) -> Column:
    """White space runs as one blank, trimmed; empty → NULL."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


# Closed sales -----------------------------------------------------------------------------------------------------------


def sale_period(c: Column) -> Column:
    """struct(year, quarter) of YYYY年第Q四半期, or of an era year."""
    t = narrow_digits(c)
    year = F.coalesce(whole(t, r"(\d{4})年"), whole(t, r"令和(\d+)年") + 2018)
    return F.struct(year.alias("year"), whole(t, r"第(\d)四半期").alias("quarter"))


def sale_price(c: Column) -> Column:
    """Sale price in 10,000 yen: 億 is split off; a bare number over 100,000 is yen."""
    t = F.regexp_replace(narrow_digits(c), "[,円万\\s]", "")
    oku = whole(t, r"^(\d+)億") * 10_000 + F.coalesce(whole(t, r"億(\d+)"), F.lit(0))
    plain = whole(t, r"^(\d+)$")
    return F.coalesce(oku, F.when(plain > 100_000, F.floor(plain / 10_000)).otherwise(plain))


def sale_price_of_feed(c: Column) -> Column:
    """The same for records of the JSON feed, where more than four characters mean yen."""
    n = c.try_cast("long")
    return F.when(F.length(c) > 4, F.floor(n / 10_000)).otherwise(n)


def unit_price(price_man: Column, square_metres: Column) -> Column:
    """Whole yen per square metre of a price in 10,000 yen; NULL without a positive area."""
    return F.when(square_metres > 0, F.floor(price_man * 10_000 / square_metres).cast("long"))


def distance(c: Column) -> Column:
    """Minutes or metres; of a range the smaller."""
    return F.least(whole(c, r"(\d+)"), F.coalesce(whole(c, r"[~〜～\-](\d+)"), whole(c, r"(\d+)")))


def percent(c: Column) -> Column:
    return whole(c, r"(\d+)")


def transaction_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def tsubo_price(price_man: Column, square_metres: Column) -> Column:
    """Whole 10,000 yen per tsubo, halves to even."""
    return F.when(square_metres > 0, F.bround(price_man / (square_metres / TSUBO)).cast("long"))


def display_price(c: Column) -> Column:
    """N億M万円, N億円 or M万円, with commas."""
    oku, man = F.floor(c / 10_000), c % 10_000
    return F.when(c.isNull(), None).when((oku > 0) & (man > 0), F.concat(oku.cast("string"), F.lit("億"), F.format_number(man, 0), F.lit("万円"))).when(oku > 0, F.concat(oku.cast("string"), F.lit("億円"))).otherwise(F.concat(F.format_number(c, 0), F.lit("万円")))


def layout_group(c: Column) -> Column:
    """Layouts that are compared as one: +X dropped, nSLDK and nLD → nLDK, nK → nDK; nS+S stays."""
    t = F.when(c.rlike(r"^\d+S\+S$"), c).otherwise(F.regexp_replace(c, r"\+.*$", ""))
    t = F.regexp_replace(t, r"^(\d+)SLDK$", "$1LDK")
    return F.regexp_replace(F.regexp_replace(t, r"^(\d+)LD$", "$1LDK"), r"^(\d+)K$", "$1DK")


def area_bucket(c: Column, step: float = 1.0) -> Column:
    """Whole square metres (floor), or the nearest multiple of a smaller step, halves to even."""
    return F.floor(c).cast("double") if step == 1.0 else F.bround(c / step) * step


def normalized(df, kinds: dict[str, str]):
    """``df`` with the named columns replaced by their parsed value; other columns pass. kinds: column → function name."""
    return df.withColumns({c: globals()[kind](F.col(c)) for c, kind in kinds.items()})


def complaints(today: Column, price_col: Column, area_col: Column, floor_col: Column, total_col: Column, year_col: Column) -> Column:
    """Array of the messages that apply; empty if the record is valid. NULL fields are not judged."""
    bad = lambda c, ok, text: F.when(c.isNotNull() & ~ok, F.lit(text))
    return F.array_compact(
        F.array(
            bad(price_col, valid_price(price_col), "price out of range"),
            bad(area_col, valid_area(area_col), "area out of range"),
            bad(floor_col, valid_floor(floor_col, total_col), "floor out of range"),
            bad(year_col, valid_built_year(year_col, today), "built year out of range"),
        )
    )
