"""Ratcliff and Obershelp's ratio for all names of one list against all of another: a bound that loses nothing, then the ratio itself.

What the ratio matches is in the same order in both names, so it is at most their longest common subsequence. That is told for
a whole list at once, a character of the other name at a time (Hyyrö's bit vectors); only pairs that it leaves are compared.
"""

from __future__ import annotations

import numpy as np

#: Guards limits against the rounding of decimal fractions.
TINY = 1e-9
#: Bounds of what is held at once: bytes of a table of characters, cells of compared pairs.
TABLE, CELLS = 64_000_000, 400_000


def _codes(one: list[str], two: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both lists the characters as small numbers, a row for each name (-1 behind its end), and the names' lengths."""
    sizes = [np.array([len(n) for n in names], np.int64) for names in (one, two)]
    seen, flat = np.unique(np.frombuffer("".join([*one, *two]).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    out = []
    for size, part in zip(sizes, np.split(flat.astype(np.int16 if len(seen) < 32_000 else np.int32), [sizes[0].sum()]), strict=True):
        rows = np.full((len(size), size.max()), -1, part.dtype)
        rows[np.arange(size.max()) < size[:, None]] = part
        out.append((rows, size))
    return out


def _table(a: np.ndarray, alphabet: np.ndarray, kind: type) -> np.ndarray:
    """(character, word, name): bits for the places at which a name has a character."""
    width = np.dtype(kind).itemsize * 8
    out = np.zeros((len(alphabet), -(-a.shape[1] // width), len(a)), kind)
    place = np.full(int(max(a.max(), alphabet.max())) + 1, -1)
    place[alphabet] = np.arange(len(alphabet))
    for i in range(a.shape[1]):
        held = np.flatnonzero(a[:, i] >= 0)
        at = place[a[held, i]]
        held, at = held[at >= 0], at[at >= 0]
        out[at, i // width, held] |= kind(1) << kind(i % width)
    return out


def _common(table: np.ndarray, chars: list[int], room: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of one name and every name of a table."""
    v, u, t = room
    v.fill(~room.dtype.type(0))
    if len(v) == 1:
        v, u, t = v[0], u[0], t[0]
        for row in [table[c, 0] for c in chars]:
            np.bitwise_and(v, row, u)
            np.add(v, u, t)
            np.bitwise_xor(v, u, v)
            np.bitwise_or(t, v, v)
        return room.dtype.itemsize * 8 - np.bitwise_count(v).astype(np.int16)
    for c in chars:
        carry = None
        for k in range(len(v)):
            np.bitwise_and(v[k], table[c, k], u[k])
            np.add(v[k], u[k], t[k])
            if len(v) > 1:
                over = t[k] < u[k]
                if carry is not None:
                    t[k] += carry
                    over |= t[k] < carry
                carry = over.astype(room.dtype)
            np.bitwise_xor(v[k], u[k], v[k])
            np.bitwise_or(t[k], v[k], v[k])
    return (room.dtype.itemsize * 8 - np.bitwise_count(v).astype(np.int32)).sum(axis=0)


def _bounded(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, least: float, same: bool):
    """Arrays (i, j) of the pairs of which the bound allows a ratio of ``least``; ``same``: one list, each pair once. Sizes ascend."""
    shared = np.intersect1d(a, b)
    shared = shared[shared >= 0]
    if not len(shared):
        return
    place = np.full(int(max(a.max(), b.max())) + 1, -1)
    place[shared] = np.arange(len(shared))
    cuts = [0, *np.searchsorted(a_size, [32, *range(64, int(a_size[-1]) + 64, 64)], "right")]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        if first == last:
            continue
        longest = int(a_size[last - 1])
        kind = np.uint32 if longest <= 32 else np.uint64
        step = max(1, int(TABLE // (len(shared) * -(-longest // 32) * 4)))
        for start in range(first, last, step):
            size = a_size[start : min(start + step, last)]
            table = _table(a[start : start + len(size), :longest], shared, kind)
            room = np.empty((3, table.shape[1], len(size)), kind)
            need, of = None, None
            for j in range(len(b)):
                n = int(b_size[j])
                if n != of:
                    of, need = n, np.ceil(((size + n) * least - TINY) / 2)
                    near = np.flatnonzero(np.minimum(size, n) >= need)
                if not len(near):
                    continue
                lo, hi = int(near[0]), int(near[-1]) + 1
                if same:
                    hi = min(hi, j - start)
                if lo >= hi:
                    continue
                chars = place[b[j, :n]]
                n_common = _common(table[:, :, lo:hi], chars[chars >= 0].tolist(), room[:, :, lo:hi])
                hits = np.flatnonzero(n_common >= need[lo:hi])
                if len(hits):
                    yield start + lo + hits, np.full(len(hits), j)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and ends of the longest common part of each pair of columns, the first of equal ones in ``a``, then in ``b``."""
    m, k = b.shape
    step = 1 << int(m).bit_length()
    kind = np.int16 if (min(len(a), m) + 1) * step < 32_000 else np.int64
    base = (m - 1 - np.arange(m)).astype(kind)[:, None]  # larger for earlier places
    run, grown = np.broadcast_to(base, (m, k)).copy(), np.empty((m, k), kind)
    best, at = np.zeros(k, kind), np.zeros(k, np.int64)
    for i in range(len(a)):
        np.add(run[:-1], kind(step - 1), grown[1:])
        grown[0] = step + m - 1
        run = np.where(b == a[i], grown, base)
        top = run.max(axis=0)
        better = top // step > best // step
        best[better], at[better] = top[better], i + 1
    return (best // step).astype(np.int64), at, m - (best % step).astype(np.int64)


def _taken(rows: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, none: int) -> np.ndarray:
    """Columns with the characters from ``first`` to ``last`` of rows, ``none`` behind them."""
    at = first + np.arange(int((last - first).max()))[:, None]
    return np.where(at < last, rows[row, np.minimum(at, rows.shape[1] - 1)], rows.dtype.type(none))


def matched(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Matched characters of the pairs (i, j): the longest common part, and so on before and behind it."""
    out = np.zeros(len(i), np.int64)
    zero = np.zeros(len(i), np.int64)
    todo = np.stack([np.arange(len(i)), zero, a_size[i], zero, b_size[j]])
    while todo.shape[1]:
        todo = todo[:, np.argsort(todo[2] - todo[1] + todo[4] - todo[3], kind="stable")]
        more, start = [], 0
        while start < todo.shape[1]:
            # parts of one size or a little more: the last of them is the longest
            size = np.maximum(todo[2] - todo[1], todo[4] - todo[3])[start : start + CELLS]
            n = max(1, int(np.searchsorted(np.maximum.accumulate(size) * np.arange(1, len(size) + 1), CELLS, "right")))
            p, x, x2, y, y2 = todo[:, start : start + n]
            start += n
            length, x_end, y_end = _longest(_taken(a, i[p], x, x2, -1), _taken(b, j[p], y, y2, -2))
            np.add.at(out, p, length)
            x_end, y_end = x + x_end, y + y_end
            for part in (np.stack([p, x, x_end - length, y, y_end - length]), np.stack([p, x_end, x2, y_end, y2])):
                more.append(part[:, (length > 0) & (part[1] < part[2]) & (part[3] < part[4])])
        todo = np.concatenate(more, axis=1)
    return out


def close(one: list[str], two: list[str], least: float, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, ratio): places of the pairs with a ratio of ``least`` and more.

    ``ordered``: pairs of different names, told as (smaller, greater) by i of ``one + two``, each once; equal lists are one list.
    """
    same = ordered and one == two
    k1 = sorted(range(len(one)), key=lambda i: len(one[i]))
    k2 = k1 if same else sorted(range(len(two)), key=lambda i: len(two[i]))
    one, two = [one[i] for i in k1], [two[i] for i in k2]
    (a, a_size), (b, b_size) = _codes(one, two)
    k1, k2 = np.array(k1), np.array(k2)
    found, waiting, n = [], [], 0

    def compared() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        ratio = np.empty(len(i))
        turned = np.array([one[x] > two[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool) if ordered else np.zeros(len(i), bool)
        for flag, x, y in ((False, (a, a_size, i), (b, b_size, j)), (True, (b, b_size, j), (a, a_size, i))):
            part = turned == flag
            if part.any():
                rows = matched(x[0], x[1], y[0], y[1], x[2][part], y[2][part])
                ratio[part] = 2.0 * rows / (a_size[i[part]] + b_size[j[part]])
        keep = ratio >= least
        left, right = k1[i], k2[j] + (len(one) if ordered else 0)
        left, right = np.where(turned, right, left), np.where(turned, left, right)
        found.append((left[keep], right[keep], ratio[keep]))

    for pair in _bounded(a, a_size, b, b_size, least, same):
        waiting.append(pair)
        n += len(pair[0])
        if n >= CELLS:
            compared()
            waiting, n = [], 0
    if waiting:
        compared()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
