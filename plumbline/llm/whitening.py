"""Whitened embeddings from a covariance that is summed in double-double (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.runtime import stage, unstage

#: Rows of one exact product: slices of 21 bits, squared and added 2**10 times, stay below 2**53.
BLOCK, SLICE_BITS = 1024, 21
_WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64))
_LONG = (1 << 63) - 1


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list column are finite throughout, their x = floor(256 * entry) as longs, and their lengths.

    Shorter rows are padded with 0. An x beyond the long range is its nearest end.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    flat = column.flatten()
    raw = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL entries become NaN
    rows = np.repeat(np.arange(len(sizes)), sizes)
    good[rows[~np.isfinite(raw)]] = False
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(256.0 * raw)
        far = ~(np.abs(scaled) < 2.0**63)
        whole = np.where(far, 0, scaled).astype(np.int64)
    whole[far & (scaled > 0)] = _LONG
    whole[far & (scaled < 0)] = -_LONG - 1
    wide = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == wide).all():
        x = whole.reshape(len(sizes), wide)
    else:
        x = np.zeros((len(sizes), wide), np.int64)
        x[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return good, x, sizes


def coded(x: np.ndarray) -> list[bytes]:
    """Each row as its narrowest integers, little-endian, after a byte with their width; zeros at the end are left out.

    So vectors are equal if, and only if, their bytes are.
    """
    if not x.size:
        return [b"\x01"] * len(x)
    used = np.where((x != 0).any(1), x.shape[1] - (x != 0)[:, ::-1].argmax(1), 0)
    out: list[bytes] = [b""] * len(x)
    least, most = x.min(1), x.max(1)
    left = np.ones(len(x), bool)
    for width, kind in _WIDTHS:
        fits = left & (least >= np.iinfo(kind).min) & (most <= np.iinfo(kind).max)
        left &= ~fits
        narrow, mark = x[fits].astype(np.dtype(kind).newbyteorder("<")), bytes([width])
        for i, row, k in zip(np.flatnonzero(fits), narrow, used[fits], strict=True):
            out[i] = mark + row[:k].tobytes()
    return out


def decoded(rows: list[bytes], dims: int) -> np.ndarray:
    """The x vectors again, ``dims`` wide."""
    out = np.zeros((len(rows), dims), np.int64)
    marks = np.array([r[0] for r in rows], np.int64)
    for width, kind in _WIDTHS:
        which = np.flatnonzero(marks == width)
        if len(which) and dims:
            raw = b"".join(rows[i][1:].ljust(dims * width, b"\0") for i in which)
            out[which] = np.frombuffer(raw, np.dtype(kind).newbyteorder("<")).reshape(-1, dims)
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, x, _ = quantised(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([pa.array(coded(x[good]), pa.binary())], names=["x"])


def _length(mark: bytes) -> int:
    return (len(mark) - 1) // mark[0]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the sums of the upper and the lower halves of x, so that a task's sums stay in the long range."""
    high, low = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        rows = batch.column("x").to_pylist()
        wide = max(map(_length, rows), default=0)
        if wide > len(high):
            high, low = (np.concatenate((s, np.zeros(wide - len(s), np.int64))) for s in (high, low))
        x = decoded(rows, len(high))
        high += (x >> 32).sum(0)
        low += (x & 0xFFFFFFFF).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array(high), pa.array(low)], names=["dim", "high", "low"])


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double addition."""
    s, e = two_sum(high, more)
    return two_sum(s, e + (low + rest))


def _slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Values of a block as sums of slices of 21 bits on common grids; what is lost is under 2**-63 of the largest one."""
    top = np.abs(high).max()
    if not top:
        return []
    grid = np.exp2(np.ceil(np.log2(top)) - SLICE_BITS)
    out, rest = [], high
    for k in range(3):
        if k == 2:
            rest = rest + low
        out.append(np.rint(rest / grid) * grid)
        rest = rest - out[-1]
        grid /= 2.0**SLICE_BITS
    return out


def outer_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of all rows, in double-double.

    Products of slices are whole multiples of one unit, below 2**53 of them when added up, so each matrix product is exact
    in any order of addition; only the sums of these few matrices are rounded, and their errors are kept.
    """
    d = high.shape[1]
    total, errors = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(high), BLOCK):
        s = _slices(high[at : at + BLOCK], low[at : at + BLOCK])
        if not s:
            continue
        cross = {(i, j): s[i].T @ s[j] for i, j in ((1, 2), (0, 2), (1, 1), (0, 1), (0, 0))}
        for (i, j), m in cross.items():  # the smallest first
            total, errors = add(total, errors, m)
            if i != j:
                total, errors = add(total, errors, m.T)
    return total, errors


def centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x minus a double-double mean. x beyond 2**53 is split, so nothing of it is lost."""
    upper = x.astype(np.float64)
    over = upper >= 2.0**63
    lower = np.where(over, -1, x - np.where(over, 0, upper).astype(np.int64)).astype(np.float64) if np.abs(upper).max(initial=0) > 2.0**53 else 0.0
    s, e = two_sum(upper, -mean)
    return two_sum(s, e + (lower - rest))


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, rest: np.ndarray, basis: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One row per dimension: this task's sums of outer products, of centred or of whitened vectors, high and low parts."""
    d = len(mean) if basis is None else basis.shape[1]
    total, errors = np.zeros((d, d)), np.zeros((d, d))
    for batch in batches:
        high, low = centred(decoded(batch.column("x").to_pylist(), len(mean)), mean, rest)
        if basis is not None:
            high, low = high @ basis, low @ basis
        total, errors = add(total, errors, *outer_sum(high, low))
    lists = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), lists(total), lists(errors)], names=["dim", "high", "low"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the tasks' rows of each dimension, as they come: only one row per dimension is held."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, high, low in zip(batch.column("dim").to_pylist(), batch.column("high"), batch.column("low"), strict=True):
            high, low = np.asarray(high.values), np.asarray(low.values)
            held[dim] = add(*held[dim], high, low) if dim in held else (high, low)
    lists = lambda k: pa.array([v[k] for v in held.values()], pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), lists(0), lists(1)], names=["dim", "high", "low"])


_ROW = "dim int, high array<double>, low array<double>"


def covariance(fitted: DataFrame, n: int, mean: np.ndarray, rest: np.ndarray, basis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The covariance of the fit list, or of its vectors times ``basis``, as a double-double matrix, divisor ``n``.

    Tasks add exact block products; their rows, one per dimension, are shuffled by dimension and added there with their low
    parts. The driver gets one row per dimension, whatever the number of rows.
    """
    parts = bytewise.map_batches(fitted.select("x"), _products, _ROW, rows=8 * BLOCK, mean=mean, rest=rest, basis=basis)
    rows = sorted(bytewise.map_batches(parts.repartition("dim"), _merged, _ROW).collect(), key=lambda r: r["dim"])
    d = len(mean) if basis is None else basis.shape[1]
    high, low = (np.array([r[c] for r in rows]).reshape(d, d) for c in ("high", "low"))
    q = high / n
    return q, np.asarray((high.astype(np.longdouble) - q.astype(np.longdouble) * n + low) / n, np.float64)  # q * n has 64 bits at least


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns.

    LAPACK's symmetric solver reduces the matrix to a tridiagonal one and divides and conquers that; two steps against the
    residual of the double-double matrix then carry each vector to the precision of a double. Neighbours too close to be
    told apart stay as the solver gave them. The largest entry of a vector is positive.
    """
    values, vectors = np.linalg.eigh(high)
    a, v = high.astype(np.longdouble) + low.astype(np.longdouble), vectors.astype(np.longdouble)
    for _ in range(2):
        r = np.eye(len(a), dtype=np.longdouble) - v.T @ v
        s = v.T @ (a @ v)
        e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        close = np.abs(gap) <= 1e-13 * np.abs(e).max(initial=0)
        step = np.where(close, r / 2, (s + r * e[None, :]) / np.where(close, 1, gap))
        v = v + v @ step
    e = np.sum(v * (a @ v), axis=0) / np.sum(v * v, axis=0)
    order = np.argsort(-e, kind="stable")
    v = v[:, order] / np.sqrt(np.sum(v * v, axis=0))[order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1) if v.size else v
    return e[order].astype(np.float64), v.astype(np.float64)


@dataclass
class Whitening:
    """What the fit list taught: its size, exact sums, the basis (unit vectors over sqrt(e)) and figures of each component."""

    n: int
    sums: list[int]
    basis: np.ndarray
    defined: np.ndarray
    explained: np.ndarray
    identity_error: float | None


def fit(embeddings: DataFrame, components: int = 4) -> Whitening:
    """Learn from the distinct x vectors of ``embeddings``.

    Equal vectors are counted once: their codes, not the vectors, are shuffled, copies are dropped before. A component
    whose eigenvalue is within rounding of zero has no scale; it is marked as not defined.
    """
    fitted = stage(bytewise.map_batches(embeddings.select("embedding"), _vectors, "x binary").distinct(), "fit_list")
    n = fitted.count()
    found = bytewise.map_batches(fitted, _sums, "dim int, high long, low long").groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).collect()
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(found, key=lambda r: r["dim"])]
    if not n or not sums:
        unstage(fitted)
        k = min(components, len(sums))
        return Whitening(n, sums, np.zeros((len(sums), k)), np.zeros(k, bool), np.zeros(k), None)
    mean = np.array([s / n for s in sums])
    rest = np.array([float((s * m[1] - m[0] * n) / (n * m[1])) for s, m in zip(sums, (float(v).as_integer_ratio() for v in mean), strict=True)])
    high, low = covariance(fitted, n, mean, rest)
    values, vectors = eigen(high, low)
    trace = float(np.trace(high.astype(np.longdouble) + low))
    values, vectors = values[:components], vectors[:, :components]
    defined = values > max(trace, 0) * 1e-14 * len(sums)
    basis = np.where(defined, vectors / np.sqrt(np.where(defined, values, 1)), 0)
    error = None
    if defined.any():
        own = basis[:, defined]
        q, r = covariance(fitted, n, mean, rest, own)
        error = float(np.abs(q + r - np.eye(own.shape[1])).max())
    unstage(fitted)
    return Whitening(n, sums, basis, defined, values / trace if trace > 0 else np.zeros(len(values)), error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum of (n * x - S)^2, exactly; None where it exceeds the long range."""
    reach = n * max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) + max(map(abs, sums), default=0)
    if reach * reach * max(1, len(sums)) <= _LONG:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    out = []
    for row in x.tolist():
        total = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
        out.append(total if total <= _LONG else None)
    return out


def _apply(batches: Iterator[pa.RecordBatch], own: list[str], model: Whitening) -> Iterator[pa.RecordBatch]:
    d, k, n = len(model.sums), model.basis.shape[1], model.n
    s_high = np.array([float(s // n) if n else 0.0 for s in model.sums])
    s_low = np.array([(s % n) / n if n else 0.0 for s in model.sums])
    for batch in batches:
        good, x, _ = quantised(batch.column("embedding"))
        rows = np.flatnonzero(good)
        x = np.pad(x[rows][:, :d], ((0, 0), (0, max(0, d - x.shape[1]))))
        # the whole part of the mean goes first, without rounding for x up to 2**53
        white = ((x.astype(np.float64) - s_high) - s_low) @ model.basis
        take, number = pa.array(np.repeat(rows, k)), np.tile(np.arange(k), len(rows))
        values = pa.array(white.reshape(-1), pa.float64(), mask=~model.defined[number])
        deviation = pa.array(deviations(x, n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in own), pa.array(number + 1, pa.int32()), pa.array(np.full(len(number), n), pa.int64()), deviation, values, pa.array(model.explained[number], pa.float64()), pa.array([model.identity_error] * len(number), pa.float64())],
            names=[*own, "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(embeddings: DataFrame, model: Whitening) -> DataFrame:
    """The columns of ``embeddings`` but the vector, once per component, with n, deviation, whitened, explained, identity_error.

    Rows whose vector is NULL or holds a NULL, NaN or infinite entry are left out. Vectors shorter than the longest are padded
    with zeros, empty ones too. Equal vectors get equal rows; repeated rows stay. whitened is NULL for a component without
    spread (one vector only, or equal ones), deviation where it exceeds the long range. No usable vector: no rows.
    """
    names = ["embedding", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    others = [f for f in embeddings.schema.fields if f.name not in names]
    own = [f.name for f in others]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others) + "component int, n long, deviation long, whitened double, explained double, identity_error double"
    return bytewise.map_batches(embeddings.select(*(f"`{c}`" for c in own), "embedding"), _apply, schema, own=own, model=model)


def op11_whitened_embeddings(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(rows, fit(rows))
