"""Greedy clusters of rows told apart by their marks: what `cluster` makes of all pairs, without making the pairs."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of more rows than this are not gathered; a task holds the rows of one block, never its pairs.
MOST_ROWS = 2_000_000


class _Places:
    """Rows as bits, one for each place and mark: bits that meet a row's opposite marks within reach tell what it cannot join."""

    def __init__(self, at: np.ndarray, reach: int, marks: int):
        # places keep their distances up to the reach; longer gaps are cut to reach + 1
        known = np.unique(at)
        steps = np.minimum(np.diff(known), reach + 1) if len(known) else known
        self.index = dict(zip(known.tolist(), (reach + np.concatenate([[0], np.cumsum(steps)])).astype(int).tolist(), strict=True)) if len(known) else {}
        self.reach, self.marks = reach, marks
        self._apart: dict[tuple[int, int], int] = {}
        self._whole = (1 << marks) - 1

    def bit(self, p: int, r: int) -> int:
        return 1 << (p * self.marks + r)

    def apart(self, p: int, r: int) -> int:
        """All that a row at ``p`` with mark ``r`` is kept apart from."""
        if (p, r) not in self._apart:
            self._apart[p, r] = sum(self.bit(q, -r % self.marks) for q in range(p - self.reach, p + self.reach + 1))
        return self._apart[p, r]

    def beside(self, p: int) -> int:
        """All within reach of a place."""
        return sum(self._whole << (q * self.marks) for q in range(p - self.reach, p + self.reach + 1))


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _equal_kinds(rows: list[int], place: list[int], places: _Places, parent: list[int], own: list[int], apart: list[int]) -> None:
    """Joins rows of one kind, given from the largest key on (their numbers ascend with it): each with those before it, the largest first.

    At a place a cluster stands with its largest key only. What a row's cluster cannot join now it never can.
    """
    cells: dict[int, list[int]] = defaultdict(list)
    for i in rows:
        p, near = place[i], {}
        for q in range(p - places.reach, p + places.reach + 1):
            for b in cells.get(q, ()):
                root = _find(parent, b)
                if near.get(root, -1) < b and not own[root] & apart[i]:
                    near[root] = b
        me = None
        for root, _ in sorted(near.items(), key=lambda x: -x[1]):
            if me is None:
                me, other = root, i
            elif own[root] & apart[me]:
                continue
            else:
                other = root
            parent[other] = me
            own[me] |= own[other]
            apart[me] |= apart[other]
        me = i if me is None else me
        if all(_find(parent, c) != me for c in cells[p]):
            cells[p].append(i)


def _first_pair(x: list[int], y: list[int], place: list[int], reach: int) -> tuple[int, int] | None:
    """The last (a, b), a of ``x`` and b of ``y``, a < b, within reach; both lists ascend."""
    top: dict[int, int] = {place[b]: b for b in y}
    for k in range(bisect_left(x, y[-1]) - 1, -1, -1):
        a = x[k]
        b = max((top.get(q, -1) for q in range(place[a] - reach, place[a] + reach + 1)), default=-1)
        if b > a:
            return a, b
    return None


def _clusters(place: list[int], kind: list, mark: list[int], like: dict[tuple, float], places: _Places) -> list[int]:
    """The root of every row; rows are numbered by ascending keys."""
    n = len(place)
    parent, own, apart = list(range(n)), [places.bit(p, r) for p, r in zip(place, mark, strict=True)], [places.apart(p, r) for p, r in zip(place, mark, strict=True)]
    of_kind: dict = defaultdict(list)
    for i in range(n - 1, -1, -1):
        of_kind[kind[i]].append(i)
    for rows in of_kind.values():
        _equal_kinds(rows, place, places, parent, own, apart)
    held: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        held[_find(parent, i)].append(i)
    # clusters with the same bits are judged together
    alike: dict = defaultdict(lambda: defaultdict(list))
    for root in held:
        alike[kind[root]][own[root]].append(root)
    at_bits = {root: 0 for root in held}
    for root, rows in held.items():
        for p in {place[i] for i in rows}:
            at_bits[root] |= places.beside(p)
    edges = []
    for (x, y), s in like.items():
        if x == y or x not in alike or y not in alike:
            continue
        for bits, some in alike[x].items():
            for others in alike[y].values():
                if bits & apart[others[0]] or not bits & at_bits[others[0]]:
                    continue
                for c in some:
                    for d in others:
                        first = _first_pair(held[c], held[d], place, places.reach)
                        if first:
                            edges.append((s, *first, c, d))
    parts = {root: {kind[root]: [own[root], apart[root]]} for root in held}
    near: dict = defaultdict(set)
    for x, y in like:
        near[x].add(y)
    for _, _, _, c, d in sorted(edges, reverse=True):
        c, d = _find(parent, c), _find(parent, d)
        if c == d or any(bits & no for x, (bits, _) in parts[c].items() for y, (_, no) in parts[d].items() if x == y or y in near[x]):
            continue
        parent[d] = c
        for y, (bits, no) in parts.pop(d).items():
            mine = parts[c].setdefault(y, [0, 0])
            mine[0] |= bits
            mine[1] |= no
    return [_find(parent, i) for i in range(n)]


def _scored(root: np.ndarray, place: np.ndarray, kind: list, like: dict[tuple, float], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a row's likenesses to others of its cluster have which value, and the values, ascending."""
    values = sorted({*like.values(), 1.0})
    column = {v: k for k, v in enumerate(values)}
    counts = np.zeros((len(root), len(values)), dtype=np.int64)
    cells: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for i in range(len(root)):
        cells[root[i]][kind[i]][place[i]].append(i)
    cells = {c: {x: {p: np.asarray(rows) for p, rows in spots.items()} for x, spots in kinds.items()} for c, kinds in cells.items()}
    near = defaultdict(list)
    for x, y in like:
        near[x].append(y)
    for kinds in cells.values():
        for x, spots in kinds.items():
            for p, rows in spots.items():
                for y in near[x]:
                    there = kinds.get(y)
                    for q in range(p - reach, p + reach + 1) if there else ():
                        if q not in there:
                            continue
                        others = there[q]
                        before = np.searchsorted(others, rows)
                        counts[rows, column[like[y, x]]] += before
                        counts[rows, column[like[x, y]]] += len(others) - before
    counts[:, column[1.0]] -= 1  # itself
    return counts, np.asarray(values)


def _weighed(counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and largest values; added in one order, so that equal counts have equal means."""
    total, n = np.zeros(len(counts)), counts.sum(axis=1)
    for k, v in enumerate(values):
        total += counts[:, k] * v
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total / n
    top = np.where(n > 0, values[len(values) - 1 - np.argmax(counts[:, ::-1] > 0, axis=1)], np.nan)
    return mean, top


def of_block(rows: pd.DataFrame, likeness: pd.DataFrame, reach: int, marks: int) -> pd.DataFrame:
    """(node, cluster, mean, cluster_mean, cluster_max) of the rows of one block that are like any row they may join."""
    rows = rows.sort_values("node", ignore_index=True)
    like = dict(zip(zip(likeness.x, likeness.y, strict=True), likeness.similarity, strict=True))
    places = _Places(rows["at"].to_numpy(), reach, marks)
    place, kind = [places.index[v] for v in rows["at"].tolist()], rows.kind.tolist()
    mark = (rows.node % marks).tolist()
    root = np.asarray(_clusters(place, kind, mark, like, places), dtype=np.int64)
    taken = [places.bit(p, r) for p, r in zip(place, mark, strict=True)]
    # a row alone in its cluster is a member if it is like another that it is not kept apart from
    bits, twice = defaultdict(int), defaultdict(int)
    for (k, b), n in Counter(zip(kind, taken, strict=True)).items():
        bits[k] |= b
        twice[k] |= b if n > 1 else 0
    near = defaultdict(set)
    for x, y in like:
        near[x].add(y)
    sizes = np.bincount(root, minlength=len(rows))[root]
    keep = sizes > 1
    for i in np.flatnonzero(~keep):
        free = places.beside(place[i]) & ~places.apart(place[i], mark[i])
        keep[i] = any(bits[y] & free for y in near[kind[i]] if y != kind[i]) or bool((bits[kind[i]] & ~taken[i] | twice[kind[i]] & taken[i]) & free)
    counts, values = _scored(root, np.asarray(place), kind, like, reach)
    mean, _ = _weighed(counts, values)
    whole = pd.DataFrame(counts).groupby(root).sum()
    of_all, top = _weighed(whole.to_numpy(), values)
    at = np.searchsorted(whole.index.to_numpy(), root)
    first = rows.node.groupby(root).transform("min")
    out = pd.DataFrame({"node": rows.node, "cluster": first, "mean": mean, "cluster_mean": of_all[at], "cluster_max": top[at]})
    out = out[keep].astype(object)
    return out.where(out.notna(), None)


def clusters_by_marks(rows: DataFrame, likeness: DataFrame, reach: int, marks: int) -> DataFrame:
    """(node, cluster, mean, cluster_mean, cluster_max): what `clusters`, `primaries` and `cluster_confidence` see in all pairs.

    rows (block, at, kind, node), each node once; likeness (block, x, y, similarity) of the kinds of a block, 1 for a kind and
    itself, else below 1, both ways or neither. Rows of a block are a pair if their places differ by ``reach`` or less and the
    kind of the smaller node is like that of the larger one; a pair whose nodes add up to a multiple of ``marks`` is kept apart.
    The order of joining is that of `clusters`. A block's rows, up to ``MOST_ROWS``, are gathered; its pairs are never made.
    """
    form = "node long, cluster long, mean double, cluster_mean double, cluster_max double"
    return rows.groupBy("block").cogroup(likeness.groupBy("block")).applyInPandas(lambda a, b: of_block(a, b, reach, marks), form)


def fits(rows: DataFrame, likeness: DataFrame, most: int = MOST_ROWS) -> bool:
    """Whether `clusters_by_marks` may be used: every node once, no block too large, likeness both ways or neither."""
    if rows.groupBy("node").count().where("count > 1").limit(1).count() or rows.groupBy("block").count().where(F.col("count") > most).limit(1).count():
        return False
    back = likeness.select("block", F.col("y").alias("x"), F.col("x").alias("y"))
    return likeness.join(back, ["block", "x", "y"], "left_anti").limit(1).count() == 0 and likeness.where("similarity >= 1 AND x <> y").limit(1).count() == 0
