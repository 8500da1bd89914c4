"""CSS selectors over pages: all selectors of a query are compiled once and matched in one pass over a page's tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_STEP = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*]?=)(?P<q>["']?)(?P<val>[^"'\]]*)(?P=q))?\]""")
_ALONE = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What the start of an element ends, if it is open within the same list, table or paragraph.
_ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "table", "dl", "select", "div", "article", "section", "body"}
_LINKS = {"href", "src", "action"}

_TESTS = {
    "=": lambda has, want: has == want, "~=": lambda has, want: want in has.split(), "^=": lambda has, want: want and has.startswith(want),
    "$=": lambda has, want: want and has.endswith(want), "*=": lambda has, want: want and want in has,
}


class Step:
    """One compound of a selector: a tag, an id, classes and attributes."""

    def __init__(self, text: str):
        self.tag, self.tests, at = None, [], 0
        while at < len(text):
            m = _STEP.match(text, at)
            if not m:
                raise ValueError(f"not a selector: {text!r}")
            at = m.end()
            if m["tag"]:
                self.tag = None if m["tag"] == "*" else m["tag"].lower()
            elif m["id"]:
                self.tests.append(("id", "=", m["id"]))
            elif m["cls"]:
                self.tests.append(("class", "~=", m["cls"]))
            else:
                self.tests.append((m["attr"].lower(), m["op"], m["val"]))

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag not in (None, tag):
            return False
        for name, op, want in self.tests:
            has = attrs.get(name)
            if has is None:
                return False
            if op and not _TESTS[op](has, want):
                return False
        return True


class Selector:
    """Compounds joined by a blank (somewhere inside) or > (directly inside); commas join alternatives."""

    def __init__(self, text: str):
        self.ways: list[list[tuple[Step, bool]]] = []
        for way in text.split(","):
            steps, child = [], False
            for part in way.replace(">", " > ").split():
                if part == ">":
                    child = True
                else:
                    steps.append((Step(part), child))
                    child = False
            if not steps or child:
                raise ValueError(f"not a selector: {text!r}")
            self.ways.append(steps)


class _Element:
    __slots__ = ("tag", "states", "found", "text")

    def __init__(self, tag: str):
        self.tag, self.states, self.found, self.text = tag, None, [], []


class _Match:
    __slots__ = ("which", "attrs", "text", "inside")

    def __init__(self, which: int, attrs: dict[str, str], inside: tuple[int, ...]):
        self.which, self.attrs, self.inside, self.text = which, attrs, inside, ""


class Matcher(HTMLParser):
    """Finds all matches of several selectors, in the order of their start tags.

    For each open element and each way of a selector it keeps how many compounds the element and those around it have
    matched; a start tag only looks at its parent's numbers. Elements that are never closed end with the page or where
    another one of their kind begins; end tags without a start are skipped. Text of scripts and styles is not text.
    """

    def __init__(self, selectors: list[Selector]):
        super().__init__(convert_charrefs=True)
        self.ways = [(i, way) for i, s in enumerate(selectors) for way in s.ways]

    def run(self, html: str) -> list[_Match]:
        self.matches: list[_Match] = []
        self.open: list[_Element] = []
        self.silent = 0
        self.reset()
        self.feed(html)
        self.close()
        while self.open:
            self._end()
        return self.matches

    def _end(self) -> None:
        e = self.open.pop()
        if e.tag in ("script", "style"):
            self.silent -= 1
        text = " ".join("".join(e.text).split()) if e.found else ""
        for m in e.found:
            self.matches[m].text = text

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag in _ENDS.get(tag, ()):
                if tag == "tr" or not any(e.tag in _HOLDS for e in self.open[k + 1 :]):
                    while len(self.open) > k:
                        self._end()
                continue
            if self.open[k].tag in _HOLDS:
                break
        said = {k.lower(): v or "" for k, v in reversed(attrs)}
        parent = self.open[-1].states if self.open else [((), ()) for _ in self.ways]
        e = _Element(tag)
        e.states, hits = [], []
        for (i, way), (inside, direct) in zip(self.ways, parent, strict=True):
            # inside: compounds matched somewhere around; direct: those that the parent itself ends
            now = tuple(n + 1 for n in sorted({0, *inside, *direct}) if n < len(way) and way[n][0].fits(tag, said) and (n == 0 or (n in direct if way[n][1] else True)))
            if len(way) in now and i not in hits:
                hits.append(i)
            e.states.append((tuple(sorted({*inside, *direct})), now))
        around = tuple(m for o in self.open for m in o.found)
        for i in hits:
            e.found.append(len(self.matches))
            self.matches.append(_Match(i, said, around))
        self.open.append(e)
        if tag in ("script", "style"):
            self.silent += 1
        if tag in _ALONE:
            self._end()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _ALONE:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open):
            while self.open[-1].tag != tag:
                self._end()
            self._end()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            for e in self.open:
                if e.found:
                    e.text.append(data)


def _value(match: _Match, attr: str | None, url: str | None) -> str | None:
    if attr is None:
        return match.text
    value = match.attrs.get(attr)
    if value is not None and attr in _LINKS:
        try:
            return urljoin(url or "", value.strip())
        except ValueError:
            return None
    return value


def selected(df: DataFrame, key: str, url: str, html: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(key, field, place, value): every match of each field's selector, its text or an attribute; places count from 0 for each field.

    Links become absolute. A page that is NULL or empty has no rows.
    """
    names, picks = list(fields), [a for _, a in fields.values()]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher([Selector(s) for s, _ in fields.values()])
        for pdf in batches:
            out = []
            for k, u, h in zip(pdf[key], pdf[url], pdf[html], strict=True):
                places = [0] * len(names)
                for m in matcher.run(h or ""):
                    out.append((k, names[m.which], places[m.which], _value(m, picks[m.which], u)))
                    places[m.which] += 1
            yield pd.DataFrame(out, columns=[key, "field", "place", "value"])

    return df.select(key, url, html).mapInPandas(rows, f"{key} {df.schema[key].dataType.simpleString()}, field string, place int, value string")


def listed(df: DataFrame, key: str, url: str, html: str, row: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(key, place, one column per field): a row for every match of ``row``, with the first match of each field's selector inside it.

    The selectors of the fields are matched against the whole page, and count for the innermost row around them; what a row
    does not hold is NULL. Links become absolute. A page without rows has none.
    """
    names, picks = list(fields), [a for _, a in fields.values()]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher([Selector(row), *(Selector(s) for s, _ in fields.values())])
        for pdf in batches:
            out = []
            for k, u, h in zip(pdf[key], pdf[url], pdf[html], strict=True):
                matches = matcher.run(h or "")
                table: dict[int, list] = {}
                for i, m in enumerate(matches):
                    if m.which == 0:
                        table[i] = [k, len(table), *[None] * len(names)]
                        continue
                    within = next((r for r in reversed(m.inside) if r in table), None)
                    if within is not None and table[within][m.which + 1] is None:
                        table[within][m.which + 1] = _value(m, picks[m.which - 1], u)
                out += table.values()
            yield pd.DataFrame(out, columns=[key, "place", *names])

    return df.select(key, url, html).mapInPandas(rows, f"{key} {df.schema[key].dataType.simpleString()}, place int, " + ", ".join(f"`{n}` string" for n in names))
