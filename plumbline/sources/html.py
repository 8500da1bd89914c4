"""Web pages as rows: titles, links, tables of names and values. Only parsing is Python, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that the start of the next one ends.
_CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_ALONE = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    """Title, headings, links and name-value cells of one page; broken markup ends the open cells."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.links, self.values, self.text = "", [], [], {}, []
        self._open: list[list] = []
        self._name: str | None = None
        self._silent = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self._silent += 1
        for cell in _CELLS.get(tag, ()):
            if any(t == cell for t, _ in self._open):
                self.handle_endtag(cell)
        if tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.links.append(href)
        if tag not in _ALONE:
            self._open.append([tag, []])

    def handle_data(self, data: str) -> None:
        if self._silent:
            return
        if data.strip():
            self.text.append(data.strip())
        for _, parts in self._open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._silent = max(0, self._silent - 1)
        while any(t == tag for t, _ in self._open):
            name, parts = self._open.pop()
            value = " ".join("".join(parts).split())
            if name == "title":
                self.title = self.title or value
            elif name in ("h1", "h2", "h3"):
                self.headings.append(value)
            elif name in ("th", "dt"):
                self._name = value
            elif name in ("td", "dd") and self._name:
                self.values.setdefault(self._name, value)
                self._name = None
            if name == tag:
                break


def parsed(df: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, title, headings, links, values, n_text): one row per page; links absolute and each once; NULL pages are empty."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [Page(h or "") for h in pdf[html]]
            yield pd.DataFrame({
                key: pdf[key], url: pdf[url], "title": [p.title or None for p in found], "headings": [p.headings for p in found],
                "links": [list(dict.fromkeys(urljoin(u or "", x) for x in p.links)) for u, p in zip(pdf[url], found, strict=True)],
                "values": [p.values for p in found], "n_text": [sum(map(len, p.text)) for p in found],
            })

    return df.select(key, url, html).mapInPandas(pages, f"{key} {df.schema[key].dataType.simpleString()}, {url} string, title string, headings array<string>, links array<string>, values map<string,string>, n_text long")


def records(df: DataFrame, key: str, html: str, parse) -> DataFrame:
    """List pages as rows: ``parse(html)`` gives any number of dicts; each becomes (key, place, fields)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, {n: str(v) for n, v in r.items() if v is not None}) for k, h in zip(pdf[key], pdf[html], strict=True) for i, r in enumerate(parse(h or ""))]
            yield pd.DataFrame(out, columns=[key, "place", "fields"])

    return df.select(key, html).mapInPandas(rows, f"{key} {df.schema[key].dataType.simpleString()}, place int, fields map<string,string>")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def not_seen(pages: DataFrame, seen: DataFrame, url: str) -> DataFrame:
    """Each URL once, and only if it was not seen before."""
    return pages.dropDuplicates([url]).join(seen.select(url).distinct(), url, "left_anti")
