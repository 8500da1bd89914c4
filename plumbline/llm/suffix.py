"""Repeated byte strings by run-length Burrows-Wheeler indexes (operator 4).

A string of ``length`` bytes is repeated if it starts in two places of the corpus. To bring equal strings together, each
window of that length is assigned to its least hashed ``gram``-byte substring (its anchor). Consecutive windows with the
same anchor form a piece; equal windows have equal anchors, so each anchor's pieces are a small, repetitive corpus:

1. pieces whose anchor occurs once are dropped by a pre-aggregated count;
2. of pieces that are equal as a whole one is kept, with its number of places, and its text is fetched;
3. a run-length index over a shard of anchors streams matching statistics: windows that match ``length`` bytes elsewhere, or
   whose piece has several places, are marked;
4. anchors with very many different pieces are not gathered: their pieces are cut by longer anchors around the old ones, whose
   pieces are indexed alike, in rounds. In the last round the anchor is the window itself, and has one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.runtime import stage, unstage

GRAM = 32
#: Text of one index, and of one block of windows, about.
SHARD_BYTES, BLOCK_BYTES = 1 << 20, 1 << 19
#: Anchors with more different pieces than this are cut by longer anchors, into so many parts at a time.
MOST_PIECES, PARTS = 2000, 4
#: Never part of UTF-8: ends the pieces of an index.
END = 255


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def _pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in the data, size, anchor hash, content hash) of the pieces of rows of bytes."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    spans = bytewise.SpanHash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = bytewise.mix(spans.raw(at, at + gram))
    low = np.uint64((1 << 24) - 1)  # a block is shorter than this
    least = (_least_in_windows((hashes & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    open_ends = np.zeros(len(data) + 1, np.int64)  # windows must end in their row
    np.add.at(open_ends, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(open_ends, offsets[1:], -1)
    starts = np.flatnonzero(np.cumsum(open_ends)[: len(least)] == 0)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchor = least[starts]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1))))
    begin, end = starts[first], starts[np.append(first[1:], len(starts)) - 1] + length
    return np.searchsorted(offsets, begin, side="right") - 1, begin, end - begin, hashes[anchor[first]].astype(np.int64), spans.of(begin, end).astype(np.int64)


def _cut_up(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))

        def rows(part: np.ndarray, bounds: np.ndarray, row: int, shift: int, batch=batch) -> pa.RecordBatch:
            r, start, size, anchor, content = _pieces_of(part, bounds, length, gram)
            where = pa.array(r + row)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("_th").take(where), pa.array((start - bounds[r] + shift).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor), pa.array(content)], names=["doc_id", "_th", "start", "size", "anchor", "content"])

        for i, j in bytewise.blocks(offsets, BLOCK_BYTES):
            a, b = int(offsets[i]), int(offsets[j])
            if j == i + 1 and b - a > 2 * BLOCK_BYTES:
                for k in range(0, b - a, BLOCK_BYTES):  # the windows that start in this stretch
                    part = data[a + k : min(b, a + k + BLOCK_BYTES + length - 1)]
                    yield rows(part, np.array([0, len(part)]), i, k)
            else:
                yield rows(data[a:b], offsets[i : j + 1] - a, i, 0)


class RunLengthIndex:
    """A Burrows-Wheeler transform of pieces as runs of bytes, with text positions sampled at both ends of each run.

    The transform is walked backwards from the ends of all pieces at once. A row and its neighbour step to neighbours as
    long as both are in one run, and what they share grows by one byte; at the end of a run the nearest row with the same byte
    is the end of the next run of that byte, and the samples there tell what the two share. ``weights``: places of a piece.
    """

    def __init__(self, pieces: list[bytes], weights: list[int] | None = None):
        self.sizes = np.array([len(p) + 1 for p in pieces])
        self.weights = np.array(weights if weights is not None else [1] * len(pieces))
        self.text = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
        n = len(self.text)
        self.ends = np.cumsum(self.sizes) - 1
        #: Bytes from a position to the end of its piece: no match goes beyond.
        self.room = np.repeat(self.ends, self.sizes) - np.arange(n)
        order = self._sort(np.repeat(np.arange(len(pieces)), self.sizes))
        before = self.text[order - 1]
        change = (before[1:] != before[:-1]) | (before[1:] == END)
        self.heads, self.tails = np.flatnonzero(np.concatenate(([True], change))), np.flatnonzero(np.concatenate((change, [True])))
        self.n_runs = len(self.heads)
        self.run_bytes = before[self.heads]
        self.run_lengths = self.tails - self.heads + 1
        head_at, tail_at = order[self.heads], order[self.tails]
        # rows whose suffix starts with a run's byte follow each other as the runs do
        by_byte = np.argsort(self.run_bytes, kind="stable")
        self.shift = -self.heads
        self.shift[by_byte] += np.cumsum(self.run_lengths[by_byte]) - self.run_lengths[by_byte]
        above, below = by_byte[:-1], by_byte[1:]
        same = (self.run_bytes[above] == self.run_bytes[below]) & (self.run_bytes[above] != END)
        above, below = above[same], below[same]
        #: Shared with the nearest row of the same byte over a run's head and under its tail, that byte included.
        self.over, self.under = np.zeros(self.n_runs, np.int64), np.zeros(self.n_runs, np.int64)
        self.over[below] = self.under[above] = self._shared(tail_at[above], head_at[below]) + 1

    def _sort(self, piece: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling the sorted prefix of those still tied; the ends of pieces all differ, by piece."""
        n = len(self.text)
        padded = np.concatenate((self.text, np.full(8, END, np.uint8)))
        key = np.zeros(n, np.uint64)
        for k in range(8):
            here = padded[k : k + n].astype(np.uint64)
            key = (key << np.uint64(8)) | np.where(self.room >= k, here, np.uint64(0))
        tie = np.where(self.room < 8, piece + 1, 0)
        order = np.lexsort((tie, key))
        rank = np.zeros(n, np.int64)
        k, t = key[order], tie[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        step = 8
        alone = np.concatenate((new[1:], [True])) & new
        slots = np.flatnonzero(~alone)
        while len(slots):
            tied = order[slots]
            pair = (rank[tied].astype(np.uint64) << np.uint64(32)) | rank[tied + step].astype(np.uint64)
            by = np.argsort(pair, kind="stable")
            tied, pair = tied[by], pair[by]
            order[slots] = tied
            new = np.concatenate(([True], pair[1:] != pair[:-1]))
            rank[tied] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            alone = np.concatenate((new[1:], [True])) & new
            slots = slots[~alone]
            step *= 2
        return order

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and at b have in common, within their pieces."""
        most = np.minimum(self.room[a], self.room[b])
        padded = np.concatenate((self.text, np.zeros(8, np.uint8)))
        words = np.ndarray((len(self.text),), "<u8", padded.tobytes(), strides=(1,))
        got = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            x = words[a[live] + got[live]] ^ words[b[live] + got[live]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
            got[live] += same
            live = live[(same == 8) & (got[live] < most[live])]
        return np.minimum(got, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the length of the longest string from there that also starts at another place."""
        out = np.zeros(len(self.text), np.int64)
        by_size = np.argsort(-self.sizes, kind="stable")
        sizes, at = self.sizes[by_size], self.ends[by_size]
        row = len(self.text) - len(sizes) + by_size  # the ends of pieces come last, by piece
        over, under = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        run_of = np.repeat(np.arange(self.n_runs, dtype=np.int32), self.run_lengths)
        live = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=1)), side="left")  # pieces with more bytes left
        for back, m in enumerate(live.tolist(), 1):
            row = row[:m]
            run = run_of[row]
            over = np.where(row == self.heads[run], self.over[run], over[:m] + 1)
            under = np.where(row == self.tails[run], self.under[run], under[:m] + 1)
            row = row + self.shift[run]
            out[at[:m] - back] = np.maximum(over, under)
        return np.where(np.repeat(self.weights > 1, self.sizes), self.room, out)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _mark(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an index is built whenever whole anchors fill a shard."""
    held: list[tuple[int, int, int, bytes]] = []

    def index(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        rows = list({r[:2]: r for r in rows}.values())
        found = RunLengthIndex([r[3] for r in rows], [r[2] for r in rows])
        starts, ends = _runs(found.matching_statistics() >= length)
        which = np.searchsorted(found.ends, starts)
        begin = found.ends[which] + 1 - found.sizes[which]
        keys = np.array([r[:2] for r in rows], np.int64)[which]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array((starts - begin).astype(np.int32)), pa.array((ends - 1 - begin + length).astype(np.int32))], names=["anchor", "content", "lo", "hi"])

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "piece")), strict=True):
            if size > SHARD_BYTES and held[-1][0] != row[0]:
                yield index(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield index(held)


def _anchored_at(spans: bytewise.SpanHash, offsets: np.ndarray, anchor: np.ndarray, gram: int) -> np.ndarray:
    """Where the anchor of each piece starts in it: the first of its substrings with that hash."""
    start = np.arange(offsets[-1] - gram + 1)
    hits = np.flatnonzero(bytewise.mix(spans.raw(start, start + gram)).astype(np.int64) == anchor.repeat(np.diff(offsets))[: len(start)])
    return hits[np.searchsorted(hits, offsets[:-1])] - offsets[:-1]


def _cut_longer(batches: Iterator[pa.RecordBatch], length: int, gram: int, width: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of pieces: in each part the anchor starts in one of ``width`` places of the windows, so all have more around it in common."""
    for batch in batches:
        data, offsets = _bytes(batch.column("piece"))
        spans, size = bytewise.SpanHash(data), np.diff(offsets)
        at = _anchored_at(spans, offsets, batch.column("anchor").to_numpy(), gram) if first else batch.column("at").to_numpy().astype(np.int64)
        raw = data.tobytes()
        for nearest in range(0, length - gram + 1, width):
            lo, hi = np.maximum(at - nearest - width + 1, 0), np.minimum(at - nearest, size - length)
            rows = np.flatnonzero(lo <= hi)
            begin, end = (offsets[:-1] + lo)[rows], (offsets[:-1] + hi + length)[rows]
            core = (offsets[:-1] + at - nearest)[rows]
            where = pa.array(rows)
            anchor, content = bytewise.mix(spans.raw(core, core + length - width + 1)), spans.of(begin, end)
            start = lo[rows] + (0 if first else batch.column("start").to_numpy()[rows])
            text = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            root = [batch.column(c).take(where) for c in (("anchor", "content") if first else ("root", "whole"))]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(content.astype(np.int64)), batch.column("n").take(where), pa.array((core - begin).astype(np.int32)), *root, pa.array(start.astype(np.int32)), text], names=["anchor", "content", "n", "at", "root", "whole", "start", "piece"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("pieces")
        each = lists.flatten()
        start, size = each.field("start").to_numpy(), each.field("size").to_numpy()
        data, offsets = bytewise.text_bytes(batch.column("text"))
        begin = offsets[:-1].repeat(lists.value_lengths().to_numpy()) + start
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(each.field(n) for n in ("anchor", "content", "n", "crowded")), pa.array(found, pa.binary())], names=["anchor", "content", "n", "crowded", "piece"])


_RANGE = "anchor long, content long, lo int, hi int"


def _indexed(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, content, lo, hi): the repeated ranges of different ``pieces`` (anchor, content, n, piece), told by run-length indexes."""
    rows = pieces.select("anchor", "content", "n", "piece").repartition("anchor").sortWithinPartitions("anchor", "content")
    return bytewise.map_batches(rows, _mark, _RANGE, length=length)


def _crowded_ranges(pieces: DataFrame, length: int, gram: int, most: int) -> list[DataFrame]:
    """The repeated ranges of pieces of crowded anchors; each round's anchors are longer, up to whole windows."""
    out, rows, first = [], pieces, True
    while gram < length:
        width = -(-(length - gram + 1) // PARTS)
        schema = "anchor long, content long, n long, at int, root long, whole long, start int, piece binary"
        cut = stage(bytewise.map_batches(rows, _cut_longer, schema, length=length, gram=gram, width=width, first=first), "cut")
        one = stage(cut.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min("piece").alias("piece")), "one")
        anchors = stage(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("_places")).where("_places > 1").select("anchor", "kinds"), "anchors")
        marked = stage(_indexed(one.join(anchors.where(F.col("kinds") <= most), "anchor", "left_semi"), length), "marked")
        found = cut.select("anchor", "content", "root", "whole", "start").join(marked, ["anchor", "content"])
        out.append(stage(found.select(F.col("root").alias("anchor"), F.col("whole").alias("content"), (F.col("lo") + F.col("start")).alias("lo"), (F.col("hi") + F.col("start")).alias("hi")), "of_crowded"))
        again = anchors.where(F.col("kinds") > most)
        gram, last = (length if again.isEmpty() else length - width + 1), rows
        rows = stage(cut.join(again, "anchor", "left_semi"), "rows") if gram < length else None
        unstage(last, cut, one, anchors, marked)
        first = False
    return out


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, most: int = MOST_PIECES) -> DataFrame:
    """(doc_id, _th, spans): for rows with repeats, the byte ranges [lo, hi) covered by repeated strings, in no order.

    Every range may overlap others. Rows that share doc_id and text share one result; their texts repeat each other.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = stage(bytewise.map_batches(keyed, _cut_up, f"doc_id {kind}, _th long, start int, size int, anchor long, content long", length=length, gram=gram), "pieces")
    # tables of keys are staged: a join with a staged side is split where a key is hot
    again = stage(pieces.groupBy("anchor").count().where("count > 1").select("anchor"), "again")
    likely = stage(pieces.join(again, "anchor", "left_semi"), "likely")
    unstage(pieces, again)
    different = stage(likely.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_th", "start", "size")).alias("one")), "different")
    crowd = stage(different.groupBy("anchor").count().where(F.col("count") > most).select("anchor", F.lit(True).alias("_crowd")), "crowd")
    sought = different.join(crowd, "anchor", "left").select("anchor", "content", "n", "one.*", F.col("_crowd").isNotNull().alias("crowded"))
    lists = sought.groupBy(F.col("doc_id").alias("_id"), F.col("_th").alias("_t")).agg(F.collect_list(F.struct("anchor", "content", "n", "crowded", "start", "size")).alias("pieces"))
    texts = keyed.join(lists, keyed["doc_id"].eqNullSafe(lists["_id"]) & (keyed["_th"] == lists["_t"]))
    fetched = stage(bytewise.map_batches(texts.select("text", "pieces"), _fetch, "anchor long, content long, n long, crowded boolean, piece binary", rows=500), "fetched")
    marked = _indexed(fetched.where("NOT crowded"), length)
    parts = [] if crowd.isEmpty() else _crowded_ranges(fetched.where("crowded").dropDuplicates(["anchor", "content"]), length, gram, most)
    for part in parts:
        marked = marked.union(part)
    ranges = stage(marked.groupBy("anchor", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    found = likely.join(ranges, ["anchor", "content"]).select("doc_id", "_th", F.expr("transform(ranges, r -> struct(r.lo + start AS lo, r.hi + start AS hi))").alias("ranges"))
    spans = stage(found.groupBy("doc_id", "_th").agg(F.flatten(F.collect_list("ranges")).alias("spans")), "spans")
    unstage(likely, different, crowd, fetched, ranges, *parts)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _inward(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The range without the characters that it only holds in part."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _remove(batches: Iterator[pa.RecordBatch], whole_characters: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n not in ("text", "spans")]
        removed, kept = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            cuts = merged(spans)
            if whole_characters:
                cuts = [c for c in (_inward(raw, a, b) for a, b in cuts) if c[0] < c[1]]
            at, parts = 0, []
            for a, b in cuts:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            removed.append([{"lo": a, "hi": b} for a, b in cuts])
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(removed, span), pa.array(kept, pa.binary())], names=[*names, "removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, whole_characters: bool = False, **how) -> DataFrame:
    """The columns of ``docs`` with ``removed`` (maximal byte ranges [lo, hi), in order) and ``kept`` (the other bytes).

    Removed is each byte in a string of ``length`` bytes that starts at two or more places of all texts, judged on the
    input; matches never cross documents. With ``whole_characters`` a character is removed only if all its bytes
    are. NULL counts as empty; texts under ``length`` bytes keep all; equal rows remove each other's bytes and stay.
    """
    others = [f for f in docs.schema.fields if f.name not in ("text", "removed", "kept", "spans")]
    spans = repeated_spans(docs, length, **how).withColumnsRenamed({"doc_id": "_id", "_th": "_t"})
    rows = docs.select(*(f"`{f.name}`" for f in others), "text", F.xxhash64("text").alias("__th"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_id"]) & (rows["__th"] == spans["_t"]), "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "removed array<struct<lo: int, hi: int>>, kept binary"])
    return bytewise.map_batches(joined.select(*(f"`{f.name}`" for f in others), "text", "spans"), _remove, schema, rows=500, whole_characters=whole_characters)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n_removed = F.expr("aggregate(removed, 0L, (a, r) -> a + r.hi - r.lo)")
    return out.select("doc_id", (F.octet_length("kept") + n_removed).alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
