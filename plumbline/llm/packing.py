"""Packing documents into sequences by bin completion (operator 6).

Only the lengths matter to the search, and there are at most ``capacity`` different ones. So the corpus is reduced to a
histogram of lengths, fillings are found on it and used as many times as the counts allow, and each document finds its
place by its rank among those of its length. Token ids never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.llm.tokenizing import MOST, encoder, text_blocks, tokenizer_path
from plumbline.operators.ranking import bucketed_prefix
from plumbline.runtime import broadcast_checked, stage

#: A use of one filling: how often, and its lengths with their numbers.
Filling = tuple[int, list[tuple[int, int]]]


def _sums(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """For each place in ``lengths``, a word whose bit s is set if some of the lengths from there on add up to s."""
    mask, out = (1 << (room + 1)) - 1, [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        n, k, reach, some = lengths[i], min(left[lengths[i]], room // lengths[i]), out[i + 1], 1
        while k > 0:
            reach |= (reach << (n * min(some, k))) & mask
            k, some = k - some, 2 * some
        out[i] = reach
    return out


def _dominated(items: dict[int, int], space: int, left: dict[int, int]) -> bool:
    """Whether lengths left over could stand in for some of a filling's: each alone, or two or three of them together.

    Then the larger ones would be packed and smaller ones kept, which never needs more bins.
    """
    spare = [n for n, c in left.items() if c > items.get(n, 0)]
    each = [n for n, k in items.items() for _ in range(min(k, 3))]
    sums = {sum(c) for r in (1, 2, 3) for c in combinations(each[-12:], r)} | {0}
    singles = set(each)
    return any(b <= n <= b + space and (n > b or b not in singles) for n in spare for b in sums if n - b >= 0)


def fillings(counts: dict[int, int], largest: int, capacity: int, waste: int = 0) -> Iterator[list[tuple[int, int]]]:
    """Undominated fillings around ``largest``, those with the largest other lengths first.

    Their waste is at most ``waste`` more than the least one possible, so no branch is entered that does not end in a
    filling: the sums that the smaller lengths can reach are known. Lengths are tried from the largest down, each as
    often as fits first.
    """
    room = capacity - largest
    left = {n: c - (n == largest) for n, c in counts.items() if n <= room and c - (n == largest) > 0}
    lengths = sorted(left, reverse=True)
    sums = _sums(lengths, left, room)
    least = max(0, min(sums[0].bit_length() - 1, room - waste))
    todo: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, room, ())]
    first = True
    while todo:
        i, space, used = todo.pop()
        while i < len(lengths) and lengths[i] > space:
            i += 1
        if i == len(lengths):
            items = dict(used)
            if first or not _dominated(items, space, left):
                first = False
                items[largest] = items.get(largest, 0) + 1
                yield sorted(items.items(), reverse=True)
            continue
        n = lengths[i]
        for k in range(min(left[n], space // n) + 1):  # the largest number is tried first: it is on top
            rest, need = space - k * n, max(0, least - room + space - k * n)
            if (sums[i + 1] >> need) & ((1 << (rest - need + 1)) - 1):
                todo.append((i + 1, rest, (*used, (n, k)) if k else used))


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that every packing needs: for each limit, lengths above half the capacity need one each, and what lengths from
    the limit to half the capacity cannot find beside them needs more."""
    best = 0
    for limit in [0, *(n for n in counts if 2 * n <= capacity)]:
        large = sum(c for n, c in counts.items() if 2 * n > capacity)
        beside = sum(c * (capacity - n) for n, c in counts.items() if capacity < 2 * n <= 2 * (capacity - limit))
        small = sum(c * n for n, c in counts.items() if limit <= n and 2 * n <= capacity)
        best = max(best, large + max(0, -((beside - small) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """The first incumbent: the largest length left, then always the one that fits best into what is left, as many such bins as
    the counts allow. (Taking the largest that fits, bin by bin, gives each bin the best fit among the lengths left.)"""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        space, used = capacity, {}
        for n in sorted(left, reverse=True):
            k = min(left[n], space // n)
            if k:
                used[n], space = k, space - k * n
            if not space:
                break
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


#: Waste that fillings may have over the least possible, tried in this order.
TOLERATED = (0, 8, 4, 16, 2, 32, 1, 64, 6, 12, 24)


def complete_bins(counts: dict[int, int], capacity: int, budget: int = 5000, options: int = 3) -> list[Filling]:
    """Few bins of ``capacity`` for ``counts`` items of each length, by branch and bound over fillings.

    A descent fills bins around the largest length left with its first undominated filling, as many times as the counts
    allow; it ends where its waste rules out fewer bins than the incumbent has. Descents start from the root for
    each of the tolerated wastes: little waste uses up small lengths early, more keeps them for the end. Then steps are
    revised one at a time, from the first one on, by their next ``options`` fillings, each followed by a descent; a better
    packing is the new incumbent, and its own steps are revised. Ends at the lower bound, or after ``budget`` fillings:
    the search is bounded, the incumbent is always whole.
    """
    counts = {n: c for n, c in counts.items() if c}
    total, bound, spent = sum(n * c for n, c in counts.items()), lower_bound(counts, capacity), 0
    best = best_fit(counts, capacity)
    n_best = sum(t for t, _ in best)
    steps: list[tuple[dict[int, int], list[Filling], int, int]] = []

    def descend(state: dict[int, int], done: list[Filling], wasted: int, waste: int, option: int = 0) -> bool:
        """Go down to the end from ``state``; whether a better packing was found, whose steps are then in ``steps``."""
        nonlocal best, n_best, spent, steps
        trail, done = [], list(done)
        while state and wasted <= (n_best - 1) * capacity - total and spent < budget:
            filling = next(islice(fillings(state, max(state), capacity, waste), option, None), None)
            spent += 1
            if filling is None:
                return False
            trail.append((state, list(done), wasted, waste))
            option, times = 0, min(state[n] // k for n, k in filling)
            state = {n: c for n, c in ((n, c - times * dict(filling).get(n, 0)) for n, c in state.items()) if c}
            done.append((times, filling))
            wasted += times * (capacity - sum(n * k for n, k in filling))
        found = sum(t for t, _ in done)
        if state or found >= n_best:
            steps = steps or trail
            return False
        best, n_best, steps = done, found, trail
        return True

    for waste in TOLERATED:
        if n_best > bound:
            descend(counts, [], 0, waste)
    improved = True
    while improved and n_best > bound and spent < budget:
        revised, improved = steps, False
        for state, done, wasted, waste in revised:
            improved = any(n_best > bound and descend(state, done, wasted, waste, k) for k in range(1, options + 1))
            if improved or spent >= budget:
                break
    return best


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str | None, name: str | None, capacity: int, end_id: int, cache: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer or tokenizer_path(name), cache).encode
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts, row, piece, start, length, crc = batch.column("text"), [], [], [], [], []
        for at, upto in text_blocks(texts):
            for r, ids in enumerate(encode(texts.slice(at, upto - at)), at):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k in range(len(cuts) - 1):
                    row.append(r)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(ids[4 * cuts[k] : 4 * cuts[k + 1]]))
        where = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("_th").take(where), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "_th", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, name: str = "byte_bpe_50k.json", tokenizer: str | None = None, cache: int = MOST) -> DataFrame:
    """(doc_id, _th, piece, start, length, ids_crc32): whole texts as ids and the end id, cut only where they exceed ``capacity``.

    The first piece takes what is left over, all others are full. NULL texts count as empty: one piece, the end id.
    ``cache``: chunks in each of the two generations that a Python worker keeps; ids do not depend on it.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th long, piece int, start long, length long, ids_crc32 long"
    return bytewise.map_batches(rows, _pieces, schema, rows=10_000, tokenizer=tokenizer, name=name, capacity=capacity, end_id=end_id, cache=cache)


def slots(spark: SparkSession, plan: list[Filling]) -> DataFrame:
    """(_len, lo, hi, base, per, offset0): items of length _len and rank lo..hi-1 go, ``per`` to a bin, to bins from ``base``."""
    rows, rank, base = [], {}, 0
    for times, items in plan:
        offset = 0
        for n, k in items:
            lo = rank.get(n, 0)
            rank[n] = lo + k * times
            rows.append((n, lo, rank[n], base, k, offset))
            offset += n * k
        base += times
    return spark.createDataFrame(rows, "_len long, lo long, hi long, base long, per long, offset0 long")


def pack(items: DataFrame, capacity: int = 1024, per_bucket: int = 50_000) -> DataFrame:
    """``items`` (with ``length`` 1..capacity, doc_id, _th, piece) with sequence_id and offset; sequences are gapless from 0.

    Only the histogram, at most ``capacity`` rows, comes to the driver, and the slots made of it are bounded likewise: each
    step uses up one length's count but for a remainder. Equal rows take different places; without rows, none.
    """
    items = stage(items, "pieces")
    hist = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    places = slots(items.sparkSession, complete_bins(hist, capacity))
    buckets = 1 << max(0, (max(hist.values(), default=0) // per_bucket).bit_length())
    ranked = items.withColumn("_order", F.xxhash64("doc_id", "_th", "piece")).withColumn("_bucket", F.expr(f"pmod(_order, {buckets})"))
    ranked = bucketed_prefix(ranked, ["length"], "_bucket", [F.col("_order"), F.col("doc_id")], F.lit(1), "_rank")
    joined = ranked.join(broadcast_checked(places), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    return joined.select(*items.columns, (F.col("base") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"), (F.col("offset0") + (nth % F.col("per")) * F.col("length")).alias("offset"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs)).drop("_th")
