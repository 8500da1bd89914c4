"""Predicates that are added only when their argument is given, and paging with total counts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import HIRAGANA, KATAKANA

# The words of each category of tenure.
TENURES = {"owned": ["所有権"], "leased": ["借地権", "地上権", "賃借権"], "fixed_lease": ["定期借地権"], "old_law": ["旧法"]}
# Particles that join names, sounds after which a middle dot may stand, signs used as hyphens.
PARTICLES, VOICED, HYPHENS = "ザノガデ", "ザダヴ", "ーｰ－—–−"
_SCRIPTS = re.compile("[一-龥々]+|[ぁ-ん]+|[ァ-ヿー]+|[A-Za-z]+|[0-9]+")


def all_of(conditions: Iterable[Column | None]) -> Column:
    return functools.reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


def if_given(value, make) -> Column | None:
    """``make(value)``, or nothing if the value is missing, 0 or empty: those mean "no filter"."""
    return make(value) if value else None


def between(c: Column, lo=None, hi=None) -> Column:
    return all_of([if_given(lo, lambda v: c >= v), if_given(hi, lambda v: c <= v)])


def one_of(c: Column, values=None) -> Column | None:
    return if_given(values, lambda v: c.isin(list(v)))


def contains_any(c: Column, words=None) -> Column | None:
    """Case-insensitive; % and _ are ordinary characters."""
    return if_given(words, lambda ws: any_of(F.lower(c).contains(w.lower()) for w in ws))


def comma_list(text: str | None) -> list[str]:
    """The entries of a comma list, trimmed; empty ones do not count."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def contains_all(c: Column, text: str | None) -> Column | None:
    """Every term of a text with blanks between them, in any order."""
    terms = (text or "").replace("　", " ").split()
    return if_given(terms, lambda ts: all_of(F.lower(c).contains(t.lower()) for t in ts))


def id_or_text(key: Column, c: Column, text: str) -> Column:
    """Digits alone are an id; other text must occur."""
    t = text.strip()
    return key == int(t) if t.isdigit() else F.lower(c).contains(t.lower())


def has_related(df: DataFrame, related: DataFrame, key: str, wanted: bool | None) -> DataFrame:
    """Rows that do, or do not, have a row in ``related``; all if nothing is wanted."""
    if wanted is None:
        return df
    return df.join(related.select(key).distinct(), key, "left_semi" if wanted else "left_anti")


def max_age(built_year: Column, years: int | None, today: Column) -> Column | None:
    return if_given(years, lambda n: built_year >= F.year(today) - n)


def tenure(c: Column, kinds=None) -> Column | None:
    return if_given(kinds, lambda ks: c.rlike("(?i)" + "|".join(w for k in ks for w in TENURES[k])))


def state_price(active: Column, current: Column, final: Column, lo=None, hi=None) -> Column:
    """The price that counts depends on the state: current if active, final if not; an unknown state matches neither."""
    if not lo and not hi:
        return F.lit(True)
    return (active & between(current, lo, hi)) | (~active & between(final, lo, hi))


def range_price(least: Column, most: Column, final: Column, lo=None, hi=None) -> Column:
    """Overlap of [least, most] with [lo, hi]; where no advert gives a price, the final price counts."""
    return all_of([if_given(lo, lambda v: F.coalesce(most, final) >= v), if_given(hi, lambda v: F.coalesce(least, final) <= v)])


def since_days(ts: Column, now: Column, hours: int) -> Column:
    """Hours by calendar day: 24 is today, 48 today and yesterday."""
    return F.to_date(ts) >= F.date_sub(F.to_date(now), max(hours // 24 - 1, 0))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def periods_between(year: Column, quarter: Column, first: tuple[int, int], last: tuple[int, int]) -> Column:
    return (year * 4 + quarter).between(first[0] * 4 + first[1], last[0] * 4 + last[1])


def split_terms(query: str) -> list[str]:
    """The terms of a search text: at blanks, and where the script changes; in order, each once."""
    words = [w for part in query.replace("　", " ").split() for w in [part, *_SCRIPTS.findall(part)] if part]
    return list(dict.fromkeys(w for w in words if w))


def script_terms(term: str) -> list[str]:
    """The parts of one term between changes of script, each once; a particle that begins a longer katakana part stands alone."""
    out: list[str] = []
    for part in _SCRIPTS.findall(term):
        alone = len(part) > 2 and part[0] in PARTICLES and "ァ" <= part[1] <= "ヿ"
        out += [part[0], part[1:]] if alone else [part]
    return list(dict.fromkeys(out)) or [term]


def variants(term: str) -> list[str]:
    """Spellings under which a term is looked for: raw, narrow and wide, lower and upper, hiragana and katakana; with a middle dot after
    a voiced sound, and without middle dots or hyphens."""
    narrow = "".join(chr(ord(k) - 0xFEE0) if 0xFF01 <= ord(k) <= 0xFF5E else k for k in term)
    wide = "".join(chr(ord(k) + 0xFEE0) if 0x21 <= ord(k) <= 0x7E else k for k in narrow)
    kana, hira = narrow.translate(str.maketrans(HIRAGANA, KATAKANA)), narrow.translate(str.maketrans(KATAKANA, HIRAGANA))
    dotted = re.sub(f"(?<=[{VOICED}])(?=[ァ-ヶー])", "・", kana)
    dash = re.sub(f"[{HYPHENS}]", "-", kana)
    forms = [term, narrow, wide, narrow.lower(), narrow.upper(), kana, hira, dotted, dash]
    return list(dict.fromkeys(x for x in [*forms, narrow.replace("・", ""), kana.replace("・", ""), dash.replace("-", "")] if x))


def search(df: DataFrame, query: str, columns: list[str], aliases: DataFrame | None = None, key: str = "id", alias_key: str = "building_id", alias_name: str = "normalized_name") -> DataFrame:
    """Rows that match every term of ``query`` (a blank between terms) in one of ``columns`` or in an alias."""
    for term in query.replace("　", " ").split():
        pattern = "(?i)" + "|".join(re.escape(v) for v in variants(term))
        hit = any_of(F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns)
        if aliases is None:
            df = df.where(hit)
        else:
            named = aliases.where(F.col(alias_name).rlike(pattern)).select(F.col(alias_key).alias("_alias")).distinct()
            df = df.join(named, df[key] == F.col("_alias"), "left").where(hit | F.col("_alias").isNotNull()).drop("_alias")
    return df


def ordered(df: DataFrame, allowed: dict[str, Column], by: str, descending: bool, default: str, tie: str) -> DataFrame:
    """Sorted by a column of ``allowed``, else ``default``; NULL last, ties by ``tie``."""
    c = allowed.get(by, allowed[default])
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a sorted frame."""
    return df.offset((number - 1) * size).limit(size)


def pages(df: DataFrame, size: int) -> tuple[int, int]:
    """Rows and pages in all."""
    n = df.count()
    return n, -(-n // size)
