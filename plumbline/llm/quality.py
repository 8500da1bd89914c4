"""Quality rules: a hashed n-gram logistic regression beside plain counts (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.runtime import broadcast_checked

#: Hash buckets of words and of 3-grams of characters.
WORDS, GRAMS = 2048, 4096
#: Labelled rows used for training, at most: a sample by hash of doc_id.
TRAIN_ROWS = 2000
#: A document is kept if its calibrated probability of being good is this or more.
THRESHOLD = 0.3
#: Symbols that the base columns count.
SYMBOLS = b"#*$%&|<>"


def _features(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray):
    """Bucket numbers of the words, those of the 3-grams of characters (bucket -1 where one would leave its text), and the
    characters before each row."""
    words = (bytewise.mix(hashes) >> np.uint64(64 - 11)).astype(np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    bounds = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    grams = np.full(len(points), -1, np.int64)
    if len(points) >= 3:
        three = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
        grams[:-2] = (three * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
        for back in (1, 2):
            at = bounds[1:] - back
            grams[at[at >= 0]] = -1
    return words, grams, bounds


@dataclass
class Scorer:
    """A fitted model: weights of relative frequencies, bias, and the two numbers of the calibration."""

    word_weights: np.ndarray
    gram_weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -500, 500)))


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more in its row; is it an occurrence after the first."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    mixed = bytewise.mix(keys + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    s = mixed[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice = later.copy()
    twice[order[:-1][same]] = True
    return twice, later


def _rows_of(data: np.ndarray, offsets: np.ndarray, scorer: Scorer | None, features: bool) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = bytewise.word_bounds(data, offsets)
    spans = bytewise.SpanHash(data)
    hashes = spans.of(starts, ends)
    first = np.searchsorted(rows, np.arange(n + 1))
    out = {"n_words": np.diff(first)}
    chars = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
    out["word_chars"] = _segment_sums(chars[ends] - chars[starts], first)
    marked = np.zeros(256, np.int64)
    marked[list(SYMBOLS)] = 1
    out["n_symbols"] = _segment_sums(marked[data], offsets)
    # lines: cut at \n and at the ends of rows
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - (data[line_end - 1] == 10) if len(line_start) else line_end[:0]
    word_before = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    full = word_before[1] > word_before[0]
    line_start, line_end = line_start[full], line_end[full]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    _, later = _repeats(spans.of(line_start, line_end), line_row)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    # windows of five words
    repeated = np.zeros(len(starts), np.int64)
    if len(starts) >= 5:
        whole = np.flatnonzero(rows[4:] == rows[:-4])
        key = hashes[:-4].copy()
        for k in range(1, 5):
            key = bytewise.mix(key) + hashes[k : len(hashes) - 4 + k]
        twice, _ = _repeats(key[whole], rows[whole])
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, whole[twice], 1)
        np.add.at(edge, whole[twice] + 5, -1)
        repeated = (np.cumsum(edge[:-1]) > 0).astype(np.int64)
    out["n_repeat_words"] = _segment_sums(repeated, first)
    if scorer is not None or features:
        words, grams, chars = _features(data, offsets, hashes)
        n_grams = np.maximum(1, _segment_sums((grams >= 0).astype(np.int64), chars))
        n_words = np.maximum(1, out["n_words"])
        if features:
            matrix = np.zeros((n, WORDS + GRAMS), np.float32)
            np.add.at(matrix, (rows, words), 1)
            matrix[:, :WORDS] /= n_words[:, None]
            at = np.flatnonzero(grams >= 0)
            np.add.at(matrix, (np.searchsorted(chars, at, side="right") - 1, WORDS + grams[at]), 1)
            matrix[:, WORDS:] /= n_grams[:, None]
            out["features"] = matrix
        if scorer is not None:
            gram_weights = np.append(scorer.gram_weights, 0.0)  # bucket -1 is the last
            margin = _segment_sums(scorer.word_weights[words], first) / n_words + _segment_sums(gram_weights[grams], chars) / n_grams + scorer.bias
            out["probability"] = scorer.probability(margin)
    return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(batches: Iterator[pa.RecordBatch], scorer: Scorer, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))
        parts = [_rows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], scorer, False) for i, j in bytewise.blocks(offsets, 1 << 20)]
        if not parts:
            continue
        r = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        failed = (r["n_words"] < 10) | (100 * r["n_repeat_words"] > 20 * r["n_words"])
        kept = ~failed & (r["probability"] >= threshold)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(kept), pa.array(r["probability"])], names=["doc_id", *BASE, "base_failed", "kept", "probability"])


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))
        for i, j in bytewise.blocks(offsets, 1 << 20):
            m = _rows_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], None, True)["features"]
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(i, j - i).cast(pa.int32()), pa.array([x.astype("<f2").tobytes() for x in m], pa.binary())], names=["quality", "x"])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean log loss, classes weighted alike."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    theta, bias = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta + bias, -30, 30)))
        err = (p - y) * weight
        g = np.append(x.T @ err + penalty * theta, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta, bias = (theta - step[:-1]).astype(np.float32), bias - step[-1]
    return theta, float(bias)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid, scale and shift, for smoothed targets: damped Newton steps on the standardized margin."""
    mid, unit = float(margin.mean()), float(margin.std()) or 1.0
    z = (margin - mid) / unit
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    loss = lambda t: float((np.logaddexp(0, t[0] * z + t[1]) - target * (t[0] * z + t[1])).sum())
    t = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(t[0] * z + t[1])))
        g, q = np.array([((p - target) * z).sum(), (p - target).sum()]), p * (1 - p)
        h = np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(t - size * step) > loss(t):
            size /= 2
        t = t - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(t[0] / unit), float(t[1] - t[0] * mid / unit)


def fit_matrix(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> Scorer:
    """Fit on four fifths of the rows, calibrate on the rest (Platt's sigmoid with smoothed targets)."""
    if len(y) == 0 or y.min() == y.max():
        return Scorer(np.zeros(WORDS), np.zeros(GRAMS), 0.0, 0.0, 10.0 if len(y) == 0 or y.max() == 1 else -10.0)
    fold = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[fold])) < 2 or len(np.unique(y[~fold])) < 2:
        fold = np.zeros(len(y), bool)
    mean, std = x[~fold].mean(0), x[~fold].std(0) + 1e-4
    theta, bias = _logistic((x[~fold] - mean) / std, y[~fold], penalty)
    w = theta / std
    b = bias - float(mean @ w)
    held = fold if fold.any() else ~fold
    margin, yy = x[held] @ w + b, y[held]
    a, c = calibrate(margin, yy)
    return Scorer(w[:WORDS].astype(np.float64), w[WORDS:].astype(np.float64), b, float(a), float(c))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Scorer:
    """Train on at most ``most`` labelled documents (the smallest hashes of doc_id); their features alone reach the driver.

    Labels without a document, or with a NULL text only, take no place among them. A doc_id that occurs twice counts once, with its text of the smallest hash and its better label.
    """
    lab = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    lab = lab.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")
    lab = broadcast_checked(lab.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most).drop("_h"), most)
    rows = docs.select("doc_id", "text").join(lab, "doc_id").where("text IS NOT NULL")
    once = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_one")).select("quality", "_one.text")
    got = bytewise.map_batches(once, _train_rows, "quality int, x binary").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["quality"]))
    x = np.stack([np.frombuffer(r["x"], "<f2") for r in got]).astype(np.float32) if got else np.zeros((0, WORDS + GRAMS), np.float32)
    y = np.array([r["quality"] for r in got], np.int64)
    order = np.random.default_rng(5).permutation(len(y))
    return fit_matrix(x[order], y[order])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) for every row.

    NULL and empty texts have no words and fail the base rule; repeated rows are judged each; labels that are NULL or
    whose document is missing are not used; without usable labels of both classes the model keeps (or, with bad ones
    only, rejects) all that pass the base rule.
    """
    scorer = fit(docs, labels)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, probability double"
    return bytewise.map_batches(docs.select("doc_id", "text"), _score, schema, scorer=scorer, threshold=threshold)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
