"""Language by a string kernel (operator 8).

Blended-spectrum presence kernel: two texts share as many features as n-grams (n = 1, 2, 3, of lower-case letters, other
characters one blank) occur in both, divided by the geometric mean of their numbers. Nyström landmarks turn it into
coordinates; a kernel ridge regression per language, against the rest, is scored by one matrix product per batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.runtime import broadcast_checked, stage

#: n-grams are hashed to this many features.
FEATURES = 8192
#: Training rows for each language, at most (smallest hashes), and for all; landmarks among them.
PER_LANGUAGE, TRAIN_ROWS, LANDMARKS = 500, 3000, 128
#: Characters whose n-grams are hashed together, or one longer text's.
BLOCK_CHARS = 1 << 18
_PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


_blank_table: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code points as they count in n-grams: letters and marks themselves, all others 0."""
    if "t" not in _blank_table:
        t = np.arange(0x110000, dtype=np.uint32)
        keep = np.zeros(0x110000, bool)
        keep[:0x30000] = [unicodedata.category(chr(c))[0] in "LM" for c in range(0x30000)]
        t[~keep] = 0
        _blank_table["t"] = t
    return _blank_table["t"]


def presence(texts: list[str | None]) -> np.ndarray:
    """One row of 0 and 1 for each text: which hashed n-grams occur in it."""
    out = np.zeros((len(texts), FEATURES), np.uint8)
    table = _letters()
    offsets = np.cumsum([0] + [len(t or "") for t in texts])
    for at, upto in bytewise.blocks(offsets, BLOCK_CHARS):
        part = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts[at:upto]]
        sizes = np.array([len(p) // 4 for p in part])
        code = table[np.frombuffer(b"".join(part), "<u4")].astype(np.uint32)
        if not len(code):
            continue
        row = np.repeat(np.arange(at, upto, dtype=np.int32), sizes)
        h = code.copy()
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) ^ code[n - 1 :]
                if not len(h):
                    break
            real = row[: len(h)] == row[n - 1 :]
            key = ((h * np.uint32(n * 2 + 1)) * np.uint32(2654435769)) >> np.uint32(32 - 13)
            out[row[: len(h)][real], key[real]] = 1
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(1.0, x.sum(1, dtype=np.int64)))
    return (x.astype(np.float32) @ landmarks.T) / sizes[:, None].astype(np.float32) / landmark_sizes[None, :]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks, self.sizes) @ self.weights + self.bias


def fit_matrix(x: np.ndarray, languages: list[str], ridge: float = 1e-2, landmarks: int = LANDMARKS) -> Model:
    """Landmarks are spread evenly over the languages; Nyström coordinates, then one ridge regression to +1 / -1 each."""
    names = sorted(set(languages))
    lang = np.array([names.index(v) for v in languages], np.int64)
    turn = np.zeros(len(lang), np.int64)
    for k in range(len(names)):
        turn[lang == k] = np.arange((lang == k).sum())
    chosen = np.lexsort((lang, turn))[: max(landmarks, len(names))]  # by turns: every language has one
    marks = x[chosen].astype(np.float32)
    sizes = np.sqrt(np.maximum(1.0, marks.sum(1))).astype(np.float32)
    if not len(names):
        return Model([], np.zeros((0, FEATURES), np.float32), sizes, np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    values, vectors = np.linalg.eigh(kernel(x[chosen], marks, sizes).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel(x, marks, sizes).astype(np.float64) @ root
    mean = phi.mean(0)
    y = np.where(lang[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve((phi - mean).T @ (phi - mean) + ridge * len(lang) * np.eye(phi.shape[1]) / phi.shape[1], (phi - mean).T @ (y - y.mean(0)))
    return Model(names, marks, sizes, (root @ w).astype(np.float32), (y.mean(0) - mean @ w).astype(np.float32))


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for at in range(0, len(texts), 256):
            x = presence(texts.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(at, 256), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["lang", "bits"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = TRAIN_ROWS) -> Model:
    """Learn from rows with text and lang: of each ``per_language`` different texts at most, chosen by the texts' hashes.

    Where all languages together would exceed ``most`` rows each gets the same share of them. The text with a language's
    smallest hash is always among its rows, so no language is lost, whatever its rows and their ids look like. Copies of a
    text count once. What reaches the driver are the presence bits of those rows, 1 KB each.
    """
    point = F.expr("pmod(_hash, 1000000007) / 1000000007D")
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("_hash"))
    counted = stage(rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_n"), F.min(point).alias("_least")), "languages")
    share = max(1, min(per_language, most // max(1, counted.count())))
    # a bounded number of rows for each language is left before they are ranked
    near = rows.join(broadcast_checked(counted, 10_000), "lang").where((point - F.col("_least")) * F.col("_n") < 3 * share + 30)
    some = near.dropDuplicates(["lang", "_hash"])
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(point, "text"))).where(F.col("_rank") <= share)
    bits = bytewise.map_batches(ranked.select("lang", "text"), _bits, "lang string, bits binary").orderBy(F.xxhash64("bits"), "lang").collect()
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in bits]) if bits else np.zeros((0, FEATURES), np.uint8)
    return fit_matrix(x, [r["lang"] for r in bits])


def _predict(batches: Iterator[pa.RecordBatch], model: Model, own: list[str]) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages + ["und"], object)
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            texts = batch.column("text").to_pylist()
            found = np.array([has_letter(t) for t in texts])
            best, top = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if model.languages and found.any():
                s = model.scores(presence([t for t, f in zip(texts, found, strict=True) if f]))
                best[found], top[found] = s.argmax(1), np.clip((s.max(1) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(names[best].tolist(), pa.string()), pa.array(top, pa.float64())], names=[*own, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs``, text only if ``keep_text``, with lang_pred and score, for every row.

    ``und`` with score 0 if the text is NULL or has no letter, or if nothing could be learned. The score is the winning
    regression's value, moved from -1..1 to 0..1 and cut there. Texts that equal each other get equal results.
    """
    others = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score")]
    own = [f.name for f in others] + ["text"] * keep_text
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *["text string"] * keep_text, "lang_pred string, score double"])
    return bytewise.map_batches(docs.select(*(f"`{f.name}`" for f in others), "text"), _predict, schema, model=model, own=own)


def least_score(docs: DataFrame, model: Model, steps: int = 10_000) -> float:
    """The score below which a text is in no language of ``model``, from labelled rows ``docs`` that it was not fitted to.

    Targets are +1 and -1, so the outputs for a text add up to 2 - K and the best of K languages never scores below 1 / K.
    The limit lies halfway between that and the score that 99 of 100 rightly told texts reach, of all different ones, to
    1 / ``steps``. One language alone always scores 1; without rows to learn from the limit is halfway to 1. Texts are told
    where they are and scores counted by steps; only the counts, ``steps`` and one at most, are gathered.
    """
    floor = 1 / max(1, len(model.languages))
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text", F.lit(1)).alias("_hash"))
    told = predict(rows, model).where("lang = lang_pred").groupBy("lang", "_hash").agg(F.min("score").alias("score"))
    counts = sorted(told.groupBy(F.floor(F.col("score") * steps).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    ends = np.cumsum([r["n"] for r in counts])
    # the step that holds the text at a hundredth of all
    low = counts[int(np.searchsorted(ends, 0.01 * (ends[-1] - 1), side="right"))]["step"] / steps if counts else 1.0
    return floor + low / 2 - floor / 2


def held_out():
    """True for documents that training must not see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
