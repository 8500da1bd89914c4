"""Near duplicates by SimHash fingerprints and BK-trees (operator 5).

Texts become fingerprints; distinct fingerprints are routed to shards in which any two within the radius are sure to meet
(equal in one of radius + 1 blocks of bits); each shard's BK-tree, its children keyed by integer Hamming distance to their
parent, is searched along the edges within the radius; links join in connected components. A shard's tree goes to its
queries by the shuffle: the trees of all shards grow with the data, so they are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.operators.components import connected_components
from plumbline.runtime import stage, unstage

#: Shards with more fingerprints than this are divided by further bits.
MOST_IN_SHARD = 4096
#: For each byte, four 16-bit counters in one word: of its low and of its high bits.
_COUNT = np.array([[sum(((b >> (4 * half + i)) & 1) << (16 * i) for i in range(4)) for half in (0, 1)] for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, width: int) -> Iterator[int]:
    """XXH64 (seed 42) of the word shingles of a UTF-8 text, A-Z lower-cased; fewer words: the whole sequence."""
    import xxhash

    words = text.lower().split()
    if not words:
        return iter(())
    joined = b" ".join(words)
    if len(words) <= width:
        return iter((xxhash.xxh64_intdigest(joined, 42),))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), repeat(42))


def fold(hashes: np.ndarray, bounds: np.ndarray, lanes: int) -> np.ndarray:
    """Majority fingerprints, ``lanes`` 64-bit words each, of rows of hashes; rows without hashes are zero."""
    out = np.zeros((len(bounds) - 1, lanes), np.uint64)
    sizes = np.diff(bounds)
    for lane in range(lanes):
        h = hashes if lane == 0 else bytewise.mix(hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15))
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        # a counter has 16 bits: longer rows are added up in pieces
        cuts = np.unique(np.concatenate([np.arange(a, b, 60_000) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a] or [np.zeros(0, np.int64)]))
        if not len(cuts):
            break
        owner = np.searchsorted(bounds, cuts, side="right") - 1
        counts = np.zeros((len(bounds) - 1, 64), np.int64)
        parts = np.stack([np.add.reduceat(_COUNT[:, half][octets], cuts, axis=0) for half in (0, 1)], axis=2)
        np.add.at(counts, owner, parts.view(np.uint16).reshape(len(cuts), 64).astype(np.int64))
        out[:, lane] = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch], width: int, lanes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))
        found = []
        for i, j in bytewise.blocks(offsets, 1 << 20):
            rows = [np.fromiter(shingle_hashes(data[offsets[r] : offsets[r + 1]].tobytes(), width), np.uint64) for r in range(i, j)]
            found.append(fold(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))), lanes))
        f = np.concatenate(found) if found else np.zeros((0, lanes), np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_th"), *(pa.array(f[:, k].astype(np.int64)) for k in range(lanes))], names=["doc_id", "_th", *(f"f{k}" for k in range(lanes))])


def fingerprints(docs: DataFrame, width: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, _th, f0, f1, ...): the SimHash of every whole text; ``_th`` is the text's hash, for rows that share an id."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th long, " + ", ".join(f"f{k} long" for k in range(lanes))
    return bytewise.map_batches(rows, _fingerprint, schema, width=width, lanes=lanes)


class BKTree:
    """A BK-tree of 64-bit codes: a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.root: list | None = None

    def add(self, code: int, radius: int) -> list[int]:
        """Insert a code; the codes within ``radius`` that were there before."""
        if self.root is None:
            self.root = [code, {}]
            return []
        near, todo = [], [self.root]
        while todo:
            at, children = todo.pop()
            d = (code ^ at).bit_count()
            if d <= radius:
                near.append(at)
            if children:
                todo.extend(child for k, child in children.items() if d - radius <= k <= d + radius)
        node = self.root
        while True:
            d = (code ^ node[0]).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = [code, {}]
                return near
            node = child


def _shard_links(ids: np.ndarray, codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of one shard's codes, one row of lanes each: as many as codes at most."""
    if len(ids) > 64 and radius > 8:
        return _dense_links(ids, codes, radius)
    values = codes[:, 0].tolist() if codes.shape[1] == 1 else [int.from_bytes(row.tobytes(), "little") for row in codes]
    tree, named, parent, out = BKTree(), {}, {}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for name, code in zip(ids.tolist(), values, strict=True):
        if code in parent:
            continue
        parent[code], named[code] = code, name
        for other in tree.add(code, radius):
            a, b = top(code), top(other)
            if a != b:
                parent[a] = b
                out.append((name, named[other]))
    return out


def _dense_links(ids: np.ndarray, codes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same by whole levels: with a wide radius nearly every edge is followed, so distances are taken at once."""
    left, out = np.arange(len(ids)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(codes[left] ^ codes[at]).sum(1, dtype=np.int64) <= radius
            if near.any():
                out += [(int(ids[at]), int(c)) for c in ids[left[near]]]
                front, left = np.concatenate((front, left[near])), left[~near]
    return out


def _search(batches: Iterator[pa.RecordBatch], radius: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard can go on in the next batch. The first column names a code, the others are its lanes."""
    held_keys, held = np.zeros(0, np.int64), np.zeros((0, len(names)), np.int64)

    def links(keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(keys))
        codes = rows[:, int(len(names) > 1) :].astype(np.uint64)
        out: list[tuple[int, int]] = []
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            out += _shard_links(rows[a:b, 0], codes[a:b], radius)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    for batch in batches:
        keys = np.concatenate((held_keys, batch.column("key").to_numpy()))
        rows = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in names], axis=1)))
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        held_keys, held = keys[cut:], rows[cut:]
        if cut:
            yield links(keys[:cut], rows[:cut])
    if len(held):
        yield links(held_keys, held)


def _split(rows: DataFrame, parts: int) -> DataFrame:
    """Every row once per block of its remaining bits (``rem``, ``n_rem`` of them); its key gains that block."""
    width = F.floor((F.col("n_rem") + F.lit(parts - 1) - F.col("i")) / F.lit(parts)).cast("int")
    start = F.floor(F.col("n_rem") / F.lit(parts)).cast("int") * F.col("i") + F.least(F.col("i"), F.col("n_rem") % F.lit(parts))
    ones = lambda n: F.expr(f"shiftleft(1L, {n}) - 1L")
    return (
        rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .withColumn("_w", width)
        .withColumn("_s", start)
        .withColumn("_v", F.expr("shiftrightunsigned(rem, _s)").bitwiseAND(ones("_w")))
        .select(
            F.xxhash64("key", "i", "_v").alias("key"),
            F.col("rem").bitwiseAND(ones("_s")).bitwiseOR(F.expr("CASE WHEN _s + _w >= 64 THEN 0L ELSE shiftleft(shiftrightunsigned(rem, _s + _w), _s) END")).alias("rem"),
            (F.col("n_rem") - F.col("_w")).alias("n_rem"),
            "f0",
        )
    )


def hamming_links(codes: DataFrame, radius: int, most: int = MOST_IN_SHARD) -> DataFrame:
    """(src, dst): links that span the components of distinct 64-bit codes ``f0`` under "at most ``radius`` bits differ".

    Exact: two such codes agree in one of radius + 1 blocks, and are sent to the shard of that block's value. A shard of
    more than ``most`` codes is divided again by blocks of the bits left, for which the same holds.
    """
    rows = _split(codes.select(F.lit(0).cast("long").alias("key"), F.col("f0").alias("rem"), F.lit(64).alias("n_rem"), "f0"), radius + 1)
    found = None
    for _ in range(4):
        crowded = rows.groupBy("key").count().where(F.col("count") > most).select("key")
        crowded = stage(crowded, "crowded")
        any_left = crowded.limit(1).count() > 0
        calm = rows.join(crowded, "key", "left_anti") if any_left else rows
        part = _searched(calm, radius)
        found = part if found is None else found.union(part)
        if not any_left:
            return found
        full = rows.join(crowded, "key", "left_semi")
        # codes that share all but ``radius`` bits are all linked: to one of them each
        ends = full.where(F.col("n_rem") <= radius)
        one = ends.groupBy("key").agg(F.min("f0").alias("src"))
        found = found.union(ends.join(one, "key").where("f0 <> src").select("src", F.col("f0").alias("dst")))
        rows = stage(_split(full.where(F.col("n_rem") > radius), radius + 1), "shards")
    return found.union(_searched(rows, radius))


def _searched(rows: DataFrame, radius: int, names: tuple[str, ...] = ("f0",)) -> DataFrame:
    shards = rows.select("key", *names).repartition("key").sortWithinPartitions("key", names[0])
    return bytewise.map_batches(shards, _search, "src long, dst long", rows=10_000, radius=radius, names=list(names))


def components_of(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(f0, component_id): for every distinct fingerprint, the smallest doc_id that it reaches."""
    least = prints.groupBy("f0").agg(F.min("doc_id").alias("least"))
    cc = connected_components(links)
    named = stage(least.join(cc.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "least", F.coalesce("component", "f0").alias("c")), "named")
    lows = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return named.join(lows, "c").select("f0", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_copies) for every row of ``docs``.

    Texts are folded to 64-bit SimHash fingerprints over shingles of ``width`` words; fingerprints that differ in at most
    ``radius`` bits are linked, transitively. NULL and empty texts have fingerprint zero and link like any other; NULL
    ids never name a component unless all its ids are NULL; repeated rows each stay; other columns are ignored.
    """
    prints = stage(fingerprints(docs, width), "prints")
    codes = stage(prints.groupBy("f0").agg(F.count(F.lit(1)).alias("n_copies")), "codes")
    links = stage(hamming_links(codes, radius), "links")
    named = components_of(prints, links).join(codes, "f0")
    return prints.join(named, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


def _sets(batches: Iterator[pa.RecordBatch], width: int, similarity: float, lanes: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text: the hash of its set of shingles, the set's size, fingerprint and prefix."""
    import xxhash

    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))
        codes, sizes, prints, prefixes = [], [], [np.zeros((0, lanes), np.uint64)], []
        for i, j in bytewise.blocks(offsets, 1 << 20):
            rows = [np.unique(np.fromiter(shingle_hashes(data[offsets[r] : offsets[r + 1]].tobytes(), width), np.uint64)) for r in range(i, j)]
            prints.append(fold(np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows]))), lanes))
            codes += [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]
            sizes += [len(r) for r in rows]
            for r in rows:
                common = hot[np.minimum(np.searchsorted(hot, r), len(hot) - 1)] == r if len(hot) else np.zeros(len(r), bool)
                n = len(r) - int(np.ceil(similarity * len(r) - 1e-9)) + 1 if len(r) else 0
                prefixes.append(np.concatenate((r[~common], r[common]))[:n].astype(np.int64))
        f = np.concatenate(prints)
        ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
        arrays = [pa.array(np.array(codes, np.uint64).astype(np.int64)), pa.array(np.array(sizes, np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))]
        arrays += [pa.array(f[:, k].astype(np.int64)) for k in range(lanes)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_th"), *arrays], names=["doc_id", "_th", "code", "n", "prefix", *(f"f{k}" for k in range(lanes))])


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = np.unique(np.fromiter(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), width), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], names=["shingle"])


def common_shingles(docs: DataFrame, width: int, sample: int = 8192, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, sorted. They only decide the order in which prefixes are taken."""
    every = max(1, docs.count() // sample)
    some = docs.where(F.expr(f"pmod(xxhash64(text), {every}) = 0")).select("text").distinct()
    counts = bytewise.map_batches(some, _shingles, "shingle long", width=width).groupBy("shingle").count().where(F.col("count") >= least)
    return np.unique(np.array([r["shingle"] for r in counts.orderBy(F.desc("count"), "shingle").limit(most).collect()], np.int64).astype(np.uint64))


def _in_pairs(rows: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """Rows of a key in one block as they are; of a larger key, each row once for every pair of its own with any block.

    So every two rows of a key still meet under one of the new keys, and no key holds more than two blocks.
    """
    own = rows.withColumn("_g", blocks.cast("int")).withColumn("_b", F.expr("cast(pmod(xxhash64(code, 1), _g) as int)"))
    met = own.withColumn("_o", F.explode(F.expr("sequence(0, _g - 1)")))
    return met.select(F.when(F.col("_g") > 1, F.xxhash64("key", F.least("_b", "_o"), F.greatest("_b", "_o"))).otherwise(F.col("key")).alias("key"), *columns)


def _set_bytes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "code", "total"]
    for batch in batches:
        data, offsets = bytewise.text_bytes(batch.column("text"))
        for i, j in bytewise.blocks(offsets, 1 << 20):
            sets = [np.unique(np.fromiter(shingle_hashes(data[offsets[r] : offsets[r + 1]].tobytes(), width), np.uint64)).tobytes() for r in range(i, j)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])


def _exact_links(codes: list[int], sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links that span the components of sets under Jaccard similarity, found from the whole sets."""
    first = {c: k for k, c in reversed(list(enumerate(codes)))}
    ids, picked = np.array(list(first), np.int64), [np.frombuffer(sets[k], np.uint64) for k in first.values()]
    picked, ids = [s for s in picked if len(s)], ids[[len(s) > 0 for s in picked]]
    if len(ids) < 2:
        return []
    sizes = np.array([len(s) for s in picked], np.int64)
    _, number = np.unique(np.concatenate(picked), return_inverse=True)
    ends = np.cumsum(sizes)
    mark, left, out = np.zeros(int(number.max()) + 1, bool), np.arange(len(ids)), []
    flat, starts = number, ends - sizes
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            own = number[ends[at] - sizes[at] : ends[at]]
            fits = left[(sizes[left] >= similarity * sizes[at] - 1e-9) & (sizes[at] >= similarity * sizes[left] - 1e-9)]
            if not len(fits):
                continue
            mark[own] = True
            # only the sets that are left and fit in size are looked up, one after the other in one flat array
            n = sizes[fits]
            where = np.repeat(starts[fits] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            both = np.add.reduceat(mark[flat[where]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            near = fits[both >= similarity * (n + sizes[at] - both) - 1e-9]
            if len(near):
                out += [(int(ids[at]), int(c)) for c in ids[near]]
                front += near.tolist()
                left = left[~np.isin(left, near)]
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key can go on in the next batch."""
    key, codes, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = np.array(_exact_links(codes, sets, similarity), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    for batch in batches:
        for k, c, s in zip(*(batch.column(n).to_pylist() for n in ("key", "code", "shingles")), strict=True):
            if k != key:
                if len(codes) > 1:
                    yield links()
                key, codes, sets = k, [], []
            codes.append(c)
            sets.append(s)
    if len(codes) > 1:
        yield links()


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, lanes: int = 4, deviations: float = 6.5, most: int = MOST_IN_SHARD, most_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, _th, group_id): texts whose sets of word shingles have Jaccard ``similarity`` or more, transitively; ``group_id`` is an opaque number.

    Equal sets are one group without a search. Candidates: under one order of all shingles, two such sets share one of the
    first (1 - similarity) of their shingles, so they meet in that shingle's shard; frequent shingles come last in the order.
    There two texts are candidates if their ``64 * lanes`` bits differ by no more than is expected at ``similarity`` and
    ``deviations`` standard deviations. Candidates join, transitively, and in each of these candidate groups all pairs are
    compared by their whole sets; only links found so count. Shards and groups of any size are compared block by block.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * lanes
    radius = int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))
    wide = [f"f{k}" for k in range(lanes)]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th long, code long, n long, prefix array<long>, " + ", ".join(f"{c} long" for c in wide)
    prints = stage(bytewise.map_batches(rows, _sets, schema, width=width, similarity=similarity, lanes=lanes, hot=common_shingles(docs, width)), "prints")
    codes = stage(prints.dropDuplicates(["code"]), "codes")
    posted = codes.select("code", F.explode("prefix").alias("key"))
    # counted map-side and joined, not counted in a window: a frequent shingle's rows are never in one task
    shared = stage(posted.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shared")
    met = posted.join(shared, "key")
    shards = _in_pairs(met.join(codes.select("code", *wide), "code"), F.when(F.col("_n") > most, F.ceil(F.col("_n") * 2 / most)).otherwise(1), "code", *wide)
    maybe = stage(_searched(shards, radius, ("code", *wide)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "maybe")
    members = codes.select("code", "doc_id", "_th", "n").join(connected_components(maybe).select(F.col("node").alias("code"), F.col("component").alias("key")), "code")
    members = stage(members.join(members.groupBy("key").agg(F.sum("n").alias("total")), "key"), "members")
    texts = rows.join(members.withColumnRenamed("doc_id", "_id").withColumnRenamed("_th", "_own"), (F.col("_th") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = bytewise.map_batches(texts.select("key", "code", "total", "text"), _set_bytes, "key long, code long, total long, shingles binary", width=width)
    dealt = _in_pairs(sets, F.when(F.col("total") > most_shingles, F.ceil(F.col("total") * 2 / most_shingles)).otherwise(1), "code", "shingles")
    found = bytewise.map_batches(dealt.repartition("key").sortWithinPartitions("key"), _verify, "src long, dst long", rows=500, similarity=similarity)
    links = stage(found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    unstage(codes, shared, maybe, members)
    cc = connected_components(links).withColumnRenamed("node", "code")
    groups = stage(prints.join(cc, "code", "left").select("doc_id", "_th", F.coalesce("component", "code").alias("group_id")), "groups")
    unstage(prints, links)
    return groups


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their group: the smallest (doc_id, text hash), once."""
    lead = groups.groupBy("group_id").agg(F.min(F.struct("doc_id", "_th")).alias("lead")).select("lead.*")
    rows = docs.withColumn("_key", F.xxhash64("text"))
    return rows.join(lead, rows["doc_id"].eqNullSafe(lead["doc_id"]) & (rows["_key"] == lead["_th"]), "left_semi").dropDuplicates(["doc_id", "_key"]).drop("_key")
