"""Advert phrases by a table of any length: one automaton for all of them, trimmed from both ends of a text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The table goes to every worker; a longer one is refused.
MOST_PHRASES = 200_000
_PAIRS = ["()", "[]", "【】", "≪≫", "《》", "〈〉", "「」"]
_INNERMOST = re.compile("|".join(rf"\{a}[^{re.escape(''.join(_PAIRS))}]*\{b}" for a, b in _PAIRS))

# Parts of the phrases below; the table is every sentence that they form.
STATES = ["新築", "築浅", "未入居", "即入居可", "居住中", "空室", "賃貸中", "ペット可", "楽器可", "角部屋", "最上階", "南向き", "眺望良好", "日当たり良好", "駅近", "家具付き"]
CHANGES = ["価格変更", "値下げ", "価格改定", "再登場", "公開", "掲載開始", "受付開始", "販売開始", "内覧可", "内見予約"]
TIMES = ["", "新規", "期間限定", "先着", "緊急", "大幅", "近日", "最終"]
WORKS = ["リノベーション", "リフォーム", "リノベ", "フルリノベーション", "フルリフォーム"]
STAGES = ["", "済", "済み", "中", "予定", "物件", "完了"]


def advert_phrases() -> list[str]:
    """The usual phrases: states, changes with and without a time, works at each stage, and walks, ages and floors in numbers."""
    out = [*STATES, *(f"{s}物件" for s in STATES), *map("".join, product(TIMES, CHANGES)), *map("".join, product(WORKS, STAGES))]
    out += [f"{w}徒歩{n}分" for w in ("", "駅") for n in range(1, 31)] + [f"築{n}年" for n in range(1, 61)] + [f"{n}階部分" for n in range(1, 61)]
    return sorted(set(out))


def chained(words: list[str], most: int = 2) -> list[str]:
    """All phrases of up to ``most`` of some words."""
    return sorted({" ".join(p) for k in range(1, most + 1) for p in product(words, repeat=k)})


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    """What a character is part of: a word of letters and digits, kanji, hiragana, katakana; '' for all others."""
    if not c.isalnum() and c != "ー":
        return ""
    if "ぁ" <= c <= "ゖ":
        return "hiragana"
    if "ァ" <= c <= "ヿ":
        return "katakana"
    return "kanji" if unicodedata.name(c, "").startswith("CJK") else "word"


class Stripper:
    """Takes phrases off both ends of texts.

    A phrase counts where it begins and ends at the border of a word: an end of the text, a character that is neither letter
    nor digit, or a change of script. Of several at one place the longest goes; what stands between it and the end, neither
    letter nor digit, goes with it. Brackets that hold nothing but phrases go too, the innermost first. Nothing is taken from
    the middle of a text.
    """

    def __init__(self, phrases: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p in phrases:
            if p:
                self.automaton.add_word(p, len(p))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def _found(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of every phrase at borders, in one pass."""
        if not self.any:
            return []
        border = [i in (0, len(text)) or not (k := _kind(text[i])) or k != _kind(text[i - 1]) for i in range(len(text) + 1)]
        return [(e + 1 - n, e + 1) for e, n in self.automaton.iter(text) if border[e + 1 - n] and border[e + 1]]

    def _ends(self, text: str) -> str:
        found = self._found(text)
        if not found:
            return text
        longest, shortest = {}, {}
        for a, b in found:
            longest[a] = max(longest.get(a, 0), b)
            shortest[b] = min(shortest.get(b, a), a)
        inner = lambda i: bool(_kind(text[i]))
        at, left = 0, 0  # left: the end of what is taken off
        while True:
            while at < len(text) and not inner(at) and at not in longest:
                at += 1
            if at not in longest:
                break
            at = left = longest[at]
        while left and left < len(text) and not inner(left):
            left += 1
        at = right = len(text)
        while True:
            while at > left and not inner(at - 1) and at not in shortest:
                at -= 1
            if at not in shortest or shortest[at] < left:
                break
            at = right = shortest[at]
        while right < len(text) and right > left and not inner(right - 1):
            right -= 1
        return text[left:right]

    def strip(self, text: str | None) -> str | None:
        """The text without its phrases, '' if there is nothing else; NULL stays."""
        if not text:
            return text
        text = unicodedata.normalize("NFKC", text).strip()
        while True:
            shorter = _INNERMOST.sub(lambda m: m[0] if self._ends(m[0][1:-1]) else " ", text)
            if shorter == text:
                break
            text = shorter
        return self._ends(text).strip()


_strippers: dict[tuple[str, ...], Stripper] = {}


def stripped(c: Column, phrases: DataFrame | list[str] | None = None, most: int = MOST_PHRASES) -> Column:
    """A column without the phrases of a table (its first column; NULL and empty ones are ignored), of ``advert_phrases`` if None.

    The table is counted before it is sent to the workers; more than ``most`` phrases are an error.
    """
    if isinstance(phrases, DataFrame):
        rows = phrases.select(F.col(phrases.columns[0]).alias("p")).where("p <> ''").distinct().limit(most + 1).collect()
        phrases = [r["p"] for r in rows]
    phrases = advert_phrases() if phrases is None else phrases
    if len(phrases) > most:
        raise ValueError(f"the table has more than {most} phrases")
    key = tuple(sorted(phrases))

    @F.pandas_udf(StringType())
    def strip(texts: pd.Series) -> pd.Series:
        if key not in _strippers:
            _strippers.clear()
            _strippers[key] = Stripper(list(key))
        seen = {t: _strippers[key].strip(t) for t in texts.dropna().unique()}
        return texts.map(seen)

    return strip(c)
