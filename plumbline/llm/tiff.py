"""TIFF media columns: pages out of files, and files out of samples (operator 3).

Baseline grey images of 8-bit samples: strips or tiles, uncompressed, PackBits, LZW or deflate, with or without horizontal
differencing. Reading walks the chain of image directories and gives one row per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewise

# Fixed values of the format: tag numbers, compression numbers, field sizes by type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MOST = 256, 257, 258, 4096


class TiffError(ValueError):
    """The file is not one that can be read; the message says why."""


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 2:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k == 128:
            i += 1
        else:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; a code grows one entry early."""
    acc, bits, out = LZW_CLEAR, 9, bytearray()
    held, width = 9, 9
    table, size, prefix = {}, LZW_FIRST, -1

    def emit(code: int) -> None:
        nonlocal acc, held
        acc = (acc << width) | code
        held += width
        while held >= 8:
            held -= 8
            out.append((acc >> held) & 255)
        acc &= (1 << held) - 1

    out.append(acc >> 1)
    acc, held = acc & 1, 1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        table[key] = size
        size += 1
        if size == LZW_MOST - 1:
            emit(LZW_CLEAR)
            table, size, width = {}, LZW_FIRST, 9
        elif size + 1 > 1 << width and width < 12:
            width += 1
        prefix = b
    if prefix >= 0:
        emit(prefix)
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    emit(LZW_END)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    fixed = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, acc, held, out, last = list(fixed), 9, 0, 0, bytearray(), None
    for byte in data:
        acc = (acc << 8) | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == LZW_CLEAR:
            table, width, last = list(fixed), 9, None
            continue
        if code == LZW_END or len(out) >= size:
            break
        if last is None:
            if code >= len(table):
                raise TiffError("LZW code before its entry")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW code before its entry")
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out[:size])


def _pack(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[how](raw)


def _unpack(stored: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        out = stored[:size]
    elif how == PACKBITS:
        out = packbits_decode(stored, size)
    elif how == LZW:
        out = lzw_decode(stored, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(stored, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    else:
        raise TiffError(f"compression {how} is not known")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out


def encode_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: bool = False, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of 8-bit grey pages, in strips, or in tiles of (height, width); ``order``: < for little-endian, > for big."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w = page.shape
        if tile:
            th, tw = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw), np.uint8)
            padded[:h, :w] = page
            parts = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        at, sizes = [], []
        for p in parts:
            if predictor:
                p = np.concatenate((p[:, :1], np.diff(p, axis=1)), axis=1)
            stored = _pack(p.tobytes(), compression)
            at.append(len(out))
            sizes.append(len(stored))
            out += stored
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
        fields += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, at), (TILE_SIZES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, at), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_SIZES, 4, sizes)]
        fields += [(PREDICTOR, 3, [2])] * predictor
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                spot = struct.pack(order + "I", len(out))
                out += body + b"\0" * (len(body) % 2)
            else:
                spot = body.ljust(4, b"\0")
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + spot
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(raw: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The fields of each image directory, along the chain; a directory is visited once."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8 or struct.unpack_from(order + "H", raw, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", raw, 4)[0], set()
    while at:
        if at in seen or at + 2 > len(raw):
            raise TiffError("the chain of directories is broken")
        seen.add(at)
        n = struct.unpack_from(order + "H", raw, at)[0]
        if at + 6 + 12 * n > len(raw):
            raise TiffError("a directory is cut off")
        fields = {}
        for k in range(n):
            spot = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", raw, spot)
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code is None:
                continue
            where = spot + 8 if count * FIELD_BYTES[kind] <= 4 else struct.unpack_from(order + "I", raw, spot + 8)[0]
            if where + count * FIELD_BYTES[kind] > len(raw):
                raise TiffError("a field points outside the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{code}", raw, where)
        yield fields
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]


def read_pages(raw: bytes) -> Iterator[np.ndarray]:
    """The samples of each page: (height, width), or (height, width, samples) if there are several per pixel."""
    for f in _directories(raw):
        one = lambda tag, default=None: f[tag][0] if f.get(tag) else default  # noqa: E731, B023
        w, h, how, samples = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, NONE), one(SAMPLES, 1)
        if set(f.get(BITS, (1,))) != {8} or not w or not h:
            raise TiffError("not an image of 8-bit samples")
        if samples > 1 and one(PLANES, 1) != 1:
            raise TiffError("samples in separate planes")
        tiled = TILE_OFFSETS in f
        pw, ph = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (w, min(h, one(ROWS_PER_STRIP, h)))
        at, sizes = f.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), f.get(TILE_SIZES if tiled else STRIP_SIZES, ())
        if not pw or not ph or len(at) != len(sizes) or len(at) != -(-h // ph) * -(-w // pw):
            raise TiffError("strips or tiles do not fit the image")
        rows = []
        across = -(-w // pw)
        for y in range(-(-h // ph)):
            tall = ph if tiled else min(ph, h - y * ph)
            line = []
            for x in range(across):
                k = y * across + x
                stored = raw[at[k] : at[k] + sizes[k]]
                part = np.frombuffer(_unpack(stored, how, tall * pw * samples), np.uint8).reshape(tall, pw, samples)
                if one(PREDICTOR, 1) == 2:
                    part = np.cumsum(part, axis=1, dtype=np.uint8)
                line.append(part)
            rows.append(np.concatenate(line, axis=1)[:, :w] if across > 1 else line[0][:, :w])
        page = (np.concatenate(rows) if len(rows) > 1 else rows[0])[:h]
        yield page[:, :, 0] if samples == 1 else page


def _others(df: DataFrame, *taken: str):
    return [f for f in df.schema.fields if f.name not in taken]


def form_of(text: bytes) -> dict:
    """How a text is stored, by its own hash: each compression, predictor, layout and byte order gets its share of texts."""
    h = zlib.crc32(text)
    return {"compression": (PACKBITS, LZW, DEFLATE)[h % 3], "predictor": bool(h >> 8 & 1), "tile": (16, 32) if h >> 9 & 1 else None, "order": "<>"[h >> 10 & 1]}


def _store(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            payload = np.zeros(max(width, -(-(b - a) // width) * width), np.uint8)
            payload[: b - a] = data[a:b]
            out.append(encode_pages([payload.reshape(-1, width)], **form_of(data[a:b].tobytes())))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.diff(offsets)), pa.array(out, pa.binary())], names=[*names, "n_bytes", "media"])


def store_text(docs: DataFrame, width: int = 64) -> DataFrame:
    """The columns of ``docs`` but text, with n_bytes and media: each whole UTF-8 text as the samples of a one-page TIFF.

    The text is filled up with bytes 0 to a positive multiple of ``width``, the image's width. A hash of the text, whatever
    its size, decides between PackBits, LZW and deflate, plain samples and differences, strips and tiles, and both byte
    orders, so equal texts have equal files. NULL is stored as empty; repeated rows are stored each.
    """
    others = _others(docs, "text", "n_bytes", "media")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_bytes long, media binary"])
    return bytewise.map_batches(docs.select(*(f"`{f.name}`" for f in others), "text"), _store, schema, rows=500, width=width)


def grid_feature(page: np.ndarray) -> str:
    """16 hex digits: of 8 x 8 areas of the page, is the mean above the page's; by whole numbers only."""
    h, w = page.shape[:2]
    flat = page.reshape(h, w, -1).sum(2, dtype=np.int64)
    ys, xs = (np.arange(9) * h) // 8, (np.arange(9) * w) // 8
    total = np.zeros((h + 1, w + 1), np.int64)
    total[1:, 1:] = flat.cumsum(0).cumsum(1)
    area = np.diff(ys)[:, None] * np.diff(xs)[None, :]
    sums = np.diff(np.diff(total[np.ix_(ys, xs)], axis=0), axis=1)
    return np.packbits((sums * (h * w) > area * total[-1, -1]).reshape(-1)).tobytes().hex()


def _pages(batches: Iterator[pa.RecordBatch], with_pixels: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "media"]
        media, got = batch.column("media"), {k: [] for k in ("row", "page", "width", "height", "pixels", "pixels_sha256", "tail", "feature", "error")}

        def add(row, page, error=None, pixels=None, got=got):
            raw = pixels.tobytes() if pixels is not None else None
            for k, v in (("row", row), ("page", page), ("error", error), ("width", pixels.shape[1] if raw is not None else None), ("height", pixels.shape[0] if raw is not None else None), ("pixels", raw if with_pixels else None), ("pixels_sha256", hashlib.sha256(raw).hexdigest() if raw is not None else None), ("tail", raw[-64:] if raw is not None else None), ("feature", grid_feature(pixels) if raw is not None else None)):
                got[k].append(v)

        for row in range(len(media)):
            n, raw = 0, media[row].as_py()
            if raw is None:
                continue
            try:
                for page in read_pages(raw):
                    add(row, n, pixels=page)
                    n += 1
            except TiffError as e:
                add(row, n, error=str(e))
        where = pa.array(got.pop("row"), pa.int64())
        kinds = {"page": pa.int32(), "width": pa.int32(), "height": pa.int32(), "pixels": pa.binary(), "pixels_sha256": pa.string(), "tail": pa.binary(), "feature": pa.string(), "error": pa.string()}
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in names), *(pa.array(got[k], kinds[k]) for k in kinds)], names=[*names, *kinds])


def tiff_pages(files: DataFrame, pixels: bool = True) -> DataFrame:
    """One row per page of the TIFF files in column ``media``, with the other columns.

    page (from 0), width, height, pixels (samples by rows; NULL if ``pixels`` is False), pixels_sha256, tail (last 64
    samples), feature, error. A file that cannot be read on gives a last row with the reason in ``error``: a broken chain or
    strip, no TIFF at all, and what is not read here, which is samples of other than 8 bits, samples in separate planes,
    other compressions, and BigTIFF. NULL media give no row.
    """
    made = ("page", "width", "height", "pixels", "pixels_sha256", "tail", "feature", "error")
    others = _others(files, "media", *made)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "page int, width int, height int, pixels binary, pixels_sha256 string, tail binary, feature string, error string"])
    return bytewise.map_batches(files.select(*(f"`{f.name}`" for f in others), "media"), _pages, schema, rows=500, with_pixels=pixels)


def op3_tiff_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = store_text(docs)
    kept = files.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return tiff_pages(kept, pixels=False).select(
        "doc_id", "n_bytes", (F.col("width").cast("long") * F.col("height")).alias("payload_bytes"), F.col("pixels_sha256").alias("payload_sha256"), F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256", "feature"
    )
