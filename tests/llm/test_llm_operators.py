"""Each operator against a plain version of what it promises, on texts with every odd case, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import langid, mixing, packing, quality, repair, sharding, simhash, suffix, tiff, tokencount

WORD = re.compile("[^\x20\x09-\x0d]+")


def data(text):
    return (text or "").encode()


def as_set(rows):
    return Counter(map(tuple, rows))


def test_mixing_meets_targets(docs, corpus, empty):
    got = mixing.assign(docs).collect()
    assert len(got) == len(corpus)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r[3]] += size(r[1])
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: [3, 1, 2][i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"]) and len(r["positions"]) == len(r["takes"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    assert as_set((r["doc_id"], r["text"], r["taken"]) for r in got) == as_set((r["doc_id"], r["text"], r["taken"]) for r in mixing.assign(docs.repartition(2)).collect())
    assert mixing.assign(empty).count() == 0


def test_positions_invert_the_demand(docs):
    for r in mixing.assign(docs).collect():
        for k, p in zip(r["takes"], r["positions"], strict=True):
            shares = [(1.5 * p - 0.5 * p * p), (0.5 * p + 0.5 * p * p)]  # integrals of 1.5 - t and 0.5 + t
            assert min(abs(s - k["middle"] / r["target"]) for s in shares) < 1e-9


def test_mix_sorts_by_position(docs):
    got = mixing.mix(docs).collect()
    at = [r["position"] for r in got]
    assert at == sorted(at)
    assert {r["text"] for r in got} >= {"", None}


def test_a_writer_that_dies_leaves_the_store_whole(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    store = sharding.ShardStore(spark, path)
    store.append(docs)

    class Dead(Exception):
        pass

    class DeadlyFs:  # the process ends between writing the commit and renaming it
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, *_):
            raise Dead

    fs = store._fs
    monkeypatch.setattr(store, "_fs", DeadlyFs(fs))
    with pytest.raises(Dead):
        store.append(docs)
    (tmp_path / "store" / "commits" / ".half").write_bytes(b"")  # and one that ended before it wrote a byte
    again = sharding.ShardStore(spark, path)
    assert again.version() == 1 and again.read().count() == docs.count()
    assert again.append(docs) == 2 and again.read().count() == 2 * docs.count()
    assert len(again.vacuum(hours=0)) == 1 and again.read().count() == 2 * docs.count()
    assert not (tmp_path / "store" / "commits" / ".half").exists()


def test_two_writers_both_end_up_in_the_store(spark, docs, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    store.append(docs)
    version, asked = store.version, []

    def late():  # the other writer commits after this one has looked at the version
        asked.append(version())
        if len(asked) == 2:
            other.append(docs)
        return asked[-1]

    monkeypatch.setattr(store, "version", late)
    assert store.append(docs) == 3
    assert other.read().count() == 3 * docs.count()


def test_columns_of_a_store_can_grow(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    sharding.ShardStore(spark, path).append(spark.createDataFrame([], "a long, b string"))
    empty = sharding.ShardStore(spark, path).read()
    assert empty.columns == ["a", "b"] and empty.count() == 0
    store = sharding.ShardStore(spark, path)
    store.append(spark.createDataFrame([(1, None)], "a long, b string"))
    store.append(spark.createDataFrame([("x", 2)], "c string, a long"))
    with pytest.raises(ValueError, match="column a"):
        store.append(spark.createDataFrame([("x",)], "a string"))
    for _ in range(2):
        store.append(spark.createDataFrame([(1, None)], "a long, b string"))
    want = Counter({(1, None, None): 3, (2, None, "x"): 1})
    assert as_set(store.read().select("a", "b", "c").collect()) == want
    store.compact()
    assert len(store.runs()) == 1 and as_set(sharding.ShardStore(spark, path).read().collect()) == want


def test_sharding_keeps_rows_and_versions(spark, docs, tmp_path, empty):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read().count() == 0 and store.read().columns == []
    assert store.append(empty) == 1 and store.append(empty) == 1 and store.read().count() == 0
    for k in range(5):
        assert store.append(docs) == k + 2
    before = store.manifest(4).count()
    assert len(store.runs()) == 5
    last = store.compact()
    assert last == 7 and len(store.runs()) == 1
    assert store.manifest(4).count() == before and store.read(4).count() == 3 * docs.count()
    assert as_set(store.read().select(docs.columns).collect()) == Counter({k: 5 * v for k, v in as_set(docs.collect()).items()})
    assert store.vacuum() == []  # files younger than a day may belong to a writer on its way
    assert len(store.vacuum(hours=0)) == 5 and store.read().count() == 5 * docs.count()
    assert len(store._list("manifests")) == 1
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.manifest(), store.schema(), 6)
    assert store.version() == 7
    waves = sharding.ShardStore(spark, f"file://{tmp_path}/waves")
    waves.append(docs, "source")
    assert len(waves.runs()) == len({r["source"] for r in docs.collect()})
    assert as_set(waves.read().select(docs.columns).collect()) == as_set(docs.collect())


@pytest.mark.parametrize("how", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(how, predictor, tile):
    rng = np.random.default_rng(how)
    pages = [rng.integers(0, 256, (h, w), dtype=np.uint8) for h, w in ((1, 1), (37, 50), (300, 64))] + [np.zeros((200, 90), np.uint8), np.repeat(np.arange(120, dtype=np.uint8), 100).reshape(120, 100)]
    raw = tiff.encode_pages(pages, how, predictor, 11, tile)
    got = list(tiff.read_pages(raw))
    assert len(got) == len(pages) and all((a == b).all() for a, b in zip(got, pages, strict=True))


def test_lzw_known_bytes():
    # by hand from the format: clear, 45, 55, 55, 55, 151, 258, 55, 6, 6, 6 ... as nine-bit codes, highest bit first
    data_in = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes, acc, n = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0, 0
    for c in codes:
        acc, n = (acc << 9) | c, n + 9
    assert tiff.lzw_encode(data_in) == (acc << (-n % 8)).to_bytes((n + 7) // 8, "big")
    long = bytes(np.random.default_rng(1).integers(0, 200, 60_000, dtype=np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(long), len(long)) == long


def test_tiff_media(spark, docs, corpus, empty):
    from pyspark.sql import functions as F

    files = tiff.store_text(docs)
    got = tiff.tiff_pages(files).collect()
    assert len(got) == len(corpus) and all(r["error"] is None for r in got)
    want = as_set((r[0], len(data(r[1])), data(r[1]).ljust(max(64, -(-len(data(r[1])) // 64) * 64), b"\0")) for r in corpus)
    assert as_set((r["doc_id"], r["n_bytes"], bytes(r["pixels"])) for r in got) == want
    assert all(hashlib.sha256(r["pixels"]).hexdigest() == r["pixels_sha256"] and len(r["feature"]) == 16 for r in got)
    assert tiff.tiff_pages(tiff.store_text(empty)).count() == 0
    forms = Counter(tuple(tiff.form_of((t or "").encode()).items()) for t in {r[1] for r in corpus})
    assert len(forms) >= 18  # of the 24 ways to store a text
    multi = tiff.encode_pages([np.zeros((3, 4), np.uint8), np.ones((2, 9), np.uint8)])
    bad = spark.createDataFrame([(1, multi), (2, b"nonsense"), (3, multi[:-20]), (4, None)], "k int, media binary")
    out = {(r["k"], r["page"]): r for r in tiff.tiff_pages(bad.withColumn("page", F.lit("x"))).collect()}
    assert (out[1, 0]["height"], out[1, 0]["width"], out[1, 1]["width"]) == (3, 4, 9)
    assert out[2, 0]["error"] and any(k == 3 and r["error"] for (k, _), r in out.items()) and not any(k == 4 for k, _ in out)


def brute_repeats(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length if i + length < len(hit) else -1] -= 1
        out.append(np.cumsum(hit[:-1]) > 0 if len(t) else np.zeros(0, bool))
    return out


@pytest.mark.parametrize(("length", "gram", "most"), [(200, 32, 2000), (200, 32, 1), (40, 8, 3)])
def test_suffix_removal(docs, corpus, length, gram, most):
    got = suffix.remove_repeats(docs, length, gram=gram, most=most).collect()
    texts = [data(r[1]) for r in corpus]
    marks = brute_repeats(texts, length)
    want = []
    for r, t, m in zip(corpus, texts, marks, strict=True):
        lo, hi = suffix._runs(m)
        want.append((r[0], tuple(zip(lo.tolist(), hi.tolist(), strict=True)), np.frombuffer(t, np.uint8)[~m].tobytes()))
    assert as_set((r["doc_id"], tuple((s["lo"], s["hi"]) for s in r["removed"]), bytes(r["kept"])) for r in got) == as_set(want)
    assert sum(m.any() for m in marks) > 5


def test_suffix_long_text_and_empty(spark, empty, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 4096)
    rng = np.random.default_rng(0)
    body = bytes(rng.integers(97, 123, 30_000, dtype=np.uint8))
    text = body + body[5_000:5_400] + b"x" + body[9_900:10_600]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.decode()])], names=["doc_id", "_th", "text"])
    pieces = [r for b in suffix._cut_up(iter([batch]), 200, 32) for r in b.to_pylist()]
    covered = Counter(p["start"] + k for p in pieces for k in range(p["size"] - 199))
    assert covered == Counter(range(len(text) - 199))
    for p in pieces[:50]:
        assert p["start"] + p["size"] <= len(text)
    assert suffix.remove_repeats(empty).count() == 0


def test_run_length_index_statistics():
    rng = np.random.default_rng(4)
    base = bytes(rng.integers(97, 99, 400, dtype=np.uint8))
    pieces = [base[int(a) : int(a) + 90] for a in rng.integers(0, 300, 30)] + [b"a", b"", b"zz"]
    pieces = [p for p in pieces if p]
    index = suffix.RunLengthIndex(pieces)
    suffixes = [(k, p[i:]) for k, p in enumerate(pieces) for i in range(len(p))]
    stats = index.matching_statistics()
    at = 0
    for k, p in enumerate(pieces):
        for i in range(len(p)):
            mine, best = p[i:], 0
            for j, (q, s) in enumerate(suffixes):
                if (q, len(s)) != (k, len(mine)):
                    n = 0
                    while n < min(len(s), len(mine)) and s[n] == mine[n]:
                        n += 1
                    best = max(best, n)
            assert stats[at + i] == best
        at += len(p) + 1
    assert index.run_lengths.sum() == len(index.text) and index.n_runs < len(index.text)
    weighted = suffix.RunLengthIndex(pieces, [2 if k == 3 else 1 for k in range(len(pieces))])
    placed = np.repeat(np.arange(len(pieces)), weighted.sizes) == 3
    assert (weighted.matching_statistics() == np.where(placed, weighted.room, stats)).all()
    assert suffix.RunLengthIndex([b"alone" * 3], [1]).matching_statistics()[:2].tolist() == [10, 9]


def test_longer_anchors_cover_every_window_once():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 103, 3000, dtype=np.uint8)).decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["doc_id", "_th", "text"])
    cut = [r for b in suffix._cut_up(iter([batch]), 200, 32) for r in b.to_pylist()]
    rows = pa.RecordBatch.from_arrays([pa.array([r["anchor"] for r in cut]), pa.array([r["content"] for r in cut]), pa.array([3] * len(cut)), pa.array([text[r["start"] : r["start"] + r["size"]].encode() for r in cut])], names=["anchor", "content", "n", "piece"])
    whole, gram, first = {r["content"]: text[r["start"] : r["start"] + r["size"]].encode() for r in cut}, 32, True
    want = Counter((r["content"], k) for r in cut for k in range(r["size"] - 199))
    while gram < 200:
        width = -(-(201 - gram) // suffix.PARTS)
        rows = pa.Table.from_batches(suffix._cut_longer(iter([rows]), 200, gram, width, first)).combine_chunks().to_batches()[0]
        got = rows.to_pylist()
        assert Counter((r["whole"], r["start"] + k) for r in got for k in range(len(r["piece"]) - 199)) == want
        assert all(whole[r["whole"]][r["start"] :].startswith(r["piece"]) and r["n"] == 3 for r in got)
        by_anchor = {}
        for r in got:  # an anchor stands for its bytes
            by_anchor.setdefault(r["anchor"], set()).add(r["piece"][r["at"] : r["at"] + 201 - width])
        assert all(len(v) == 1 and len(next(iter(v))) == 201 - width for v in by_anchor.values())
        gram, first = 201 - width, False
    assert all(len(r["piece"]) == 200 for r in got)


def brute_fingerprint(text, width=3):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in data(text)))
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


def brute_components(keys, linked):
    comp = list(range(len(keys)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                comp[top(i)] = top(j)
    return [top(i) for i in range(len(keys))]


@pytest.mark.parametrize("most", [4096, 1])
def test_simhash(docs, corpus, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_IN_SHARD", most)
    monkeypatch.setattr(simhash.hamming_links, "__defaults__", (most,))
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(r[1]) for r in corpus]
    comp = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for r, c in zip(corpus, comp, strict=True):
        if r[0] is not None:
            least[c].append(r[0])
    want = as_set((r[0], f"{p:016x}", min(least[c])) for r, p, c in zip(corpus, prints, comp, strict=True))
    assert as_set((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_hamming_links_are_exact(spark):
    rng = np.random.default_rng(8)
    codes = [int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for c in list(codes):
        for _ in range(3):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            codes.append(x)
    codes = sorted(set(codes))
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    want = brute_components(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    for most in (4096, 1):
        links = simhash.hamming_links(spark.createDataFrame(signed, "f0 long"), 2, most).collect()
        pairs = {(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in links}
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        got = brute_components(codes, lambda a, b, pairs=pairs: (a, b) in pairs or (b, a) in pairs)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_similar_groups(spark, empty):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(40)]
    rows, family = [], []
    for k, b in enumerate(base):
        for v in range(4):
            t = list(b)
            for _ in range(3 * (v > 0)):
                t[rng.randrange(300)] = "edited"
            rows.append((len(rows), " ".join(t)))
            family.append(k)
    got = {r["doc_id"]: r["group_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    mixed = {(g, family[d]) for d, g in got.items()}
    assert len({g for g, _ in mixed}) == len(mixed)  # no group joins two families
    assert len(mixed) <= 44  # and hardly any copy is missed
    assert simhash.similar_groups(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def byte_bpe():
    from tokenizers import Tokenizer

    from plumbline.llm.tokenizing import tokenizer_path

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_packing(docs, corpus, empty):
    tok = byte_bpe()
    got = packing.pack(packing.pieces(docs)).collect()
    want = Counter()
    for r in corpus:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert as_set((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and sum(b[-1]) <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 1
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_bin_completion():
    rng = np.random.default_rng(2)
    for trial in range(40):
        cap = int(rng.integers(10, 60))
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, cap + 1, 12), rng.integers(0, 6, 12))}
        plan = packing.complete_bins(counts, cap)
        used = Counter()
        for t, items in plan:
            assert sum(n * k for n, k in items) <= cap
            for n, k in items:
                used[n] += n and k * t
        assert used == Counter({n: c for n, c in counts.items() if c})
        assert sum(t for t, _ in plan) <= sum(t for t, _ in packing.best_fit(counts, cap))
    # best fit needs four bins here, three are enough
    assert sum(t for t, _ in packing.complete_bins({6: 1, 5: 2, 4: 2, 3: 2}, 10)) == 3


def test_bin_completion_saves_bins_on_many_lengths():
    rng = np.random.default_rng(4)
    for low, high, least in ((100, 500, 10), (200, 700, 10)):
        values, n = np.unique(rng.integers(low, high, 3000), return_counts=True)
        counts = dict(zip(values.tolist(), n.tolist(), strict=True))
        bins = sum(t for t, _ in packing.complete_bins(counts, 1024))
        assert packing.lower_bound(counts, 1024) <= bins <= sum(t for t, _ in packing.best_fit(counts, 1024)) - least


def fewest_bins(items, cap):
    """By trying every place for every item, the largest first."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= cap and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_bin_completion_and_its_bound_against_all_packings():
    rng, off = np.random.default_rng(8), 0
    for _ in range(60):
        items = sorted(rng.integers(3, 21, rng.integers(1, 11)).tolist(), reverse=True)
        counts = dict(Counter(items))
        want, got = fewest_bins(items, 20), sum(t for t, _ in packing.complete_bins(counts, 20))
        assert packing.lower_bound(counts, 20) <= want <= got
        off += got - want
    assert off == 0


@pytest.mark.parametrize("chunk", [16_384, 300])
def test_token_counts(docs, corpus, empty, chunk):
    import sentencepiece

    from plumbline.llm.tokenizing import tokenizer_path

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = tokencount.token_counts(docs, limit=100, chunk=chunk, overlap=64).collect()
    want = as_set((r[0], len(data(r[1])), n := len(sp.encode(r[1] or "")), n > 100) for r in corpus)
    assert as_set((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokencount.token_counts(empty).count() == 0


def test_huge_texts_are_spliced_and_overlaps_widen(monkeypatch):
    from plumbline.llm.tokenizing import tokenizer_path

    sp, splits = tokencount.model(tokenizer_path("piece_bpe_32k.model"))
    assert splits
    encoded, real = [], tokencount._offsets
    monkeypatch.setattr(tokencount, "_offsets", lambda sp, text: encoded.append(len(text)) or real(sp, text))
    rng = np.random.default_rng(5)
    prose = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(4000))
    assert tokencount.count_huge(sp, prose, 2048, 128) == len(sp.encode(prose))
    assert len(encoded) >= len(prose) // 2200 and max(encoded) <= 2048 + 128  # no chunk had to grow
    # long stretches without a space: overlaps are doubled, up to chunks that are encoded as one
    for gap in (100, 300, 1900, 5000):
        encoded.clear()
        text = (prose[:1500] + " " + "x" * gap + " ") * 4
        assert tokencount.count_huge(sp, text, 2048, 32) == len(sp.encode(text))
        assert gap < 1900 or max(encoded) > 2048 + 32
    assert tokencount.count_huge(sp, "y" * 9000, 2048, 32) == len(sp.encode("y" * 9000))


def test_most_text_of_long_documents_is_spliced(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sum(len(t) for t in texts if len(t) > 2 * 2048) > 0.4 * sum(map(len, texts))


def test_no_language_is_lost_among_many(spark):
    rng = np.random.default_rng(2)
    alphabets = ["".join(map(chr, range(0x4E00 + 9 * k, 0x4E09 + 9 * k))) for k in range(200)]
    rows = [(k * 10 + i, " ".join("".join(rng.choice(list(alphabets[k]), 5)) for _ in range(20)), f"l{k:03d}") for k in range(200) for i in range(4)]
    rows += [(10_000 + i, f"hot language {i} of many rows", "hot") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=50, most=300)
    assert len(model.languages) == 201 and len(model.landmarks) >= 201
    got = langid.predict(docs.where("lang <> 'hot'"), model).where("lang = lang_pred").count()
    assert got >= 0.8 * 800


def test_language_model(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! ²"), (4, "é"), (4, "é")], "doc_id long, text string")
    by = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd, model).orderBy("doc_id").collect()]
    assert [p for _, p in by[:3]] == ["und"] * 3 and by[3] == by[4] and by[3][1] != "und"
    none = langid.fit(empty)
    assert langid.predict(empty, none).count() == 0 and langid.predict(odd, none).where("lang_pred <> 'und'").count() == 0


def test_presence_kernel_is_exact_but_for_hashing():
    a, b = "abc abd", "abx"
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    x = langid.presence([a, b, "", None])
    assert x[0].sum() <= len(grams(a)) and (x[0] & x[1]).sum() >= len(grams(a) & grams(b)) - 1 and x[2:].sum() == 0


def test_quality_base_columns(docs, corpus, spark):
    labels = spark.createDataFrame([(0, 1), (7, 1), (14, 0), (21, 0), (9999, 1), (None, 0), (28, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    want = Counter()
    for r in corpus:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = [any(grams[tuple(w[i : i + 5])] > 1 for i in range(max(0, j - 4), min(j, len(w) - 5) + 1)) for j in range(len(w))]
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        failed = len(w) < 10 or 100 * sum(rep) > 20 * len(w)
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(rep), failed] += 1
    assert as_set((r["doc_id"], *(r[k] for k in quality.BASE), r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_character_grams_are_of_characters():
    texts = ["aé日b", "日", "", "xy", "éé日本語 ab"]
    raw = b"".join(map(data, texts))
    offsets = np.cumsum([0] + [len(data(t)) for t in texts])
    _, grams, bounds = quality._features(np.frombuffer(raw, np.uint8), offsets, np.zeros(0, np.uint64))
    assert bounds.tolist() == np.cumsum([0] + [len(t) for t in texts]).tolist()
    seen = {}
    for t, a in zip(texts, bounds, strict=False):
        for i in range(len(t)):
            assert (grams[a + i] >= 0) == (i + 3 <= len(t))
            assert i + 3 > len(t) or seen.setdefault(t[i : i + 3], grams[a + i]) == grams[a + i]


def test_training_does_not_depend_on_the_order_of_repeated_labels(spark):
    rng = np.random.default_rng(3)
    words = {0: ["bad", "junk", "spam", "é"], 1: ["good", "fine", "clear", "ñ"]}
    rows = [(i % 60, " ".join(rng.choice(words[i % 60 % 2], 12)), "x") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i % 60, i % 60 % 2) for i in range(200)], "doc_id long, quality int")
    models = [quality.fit(docs.repartition(n), labels.repartition(n), 40) for n in (1, 3, 5)]
    for m in models[1:]:
        assert (m.gram_weights == models[0].gram_weights).all() and m.shift == models[0].shift


def test_quality_learns(spark, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = quality.quality(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.9 * len(got)
    assert quality.quality(empty, labels.limit(0)).count() == 0


def test_token_files(docs, corpus, empty):
    from tokenizers import Tokenizer

    from plumbline.llm.tokenizing import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    shards = repair.write_shards(docs, shard_ids=3000)
    got = repair.read_documents(shards).collect()
    ids = {r[1]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in corpus}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert as_set((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == as_set((r[0], len(ids[r[1]]), crc(ids[r[1]])) for r in corpus)
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert repair.read_documents(repair.write_shards(empty)).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(6)
    ids = rng.choice(rng.integers(0, 49_000, 300), 40_000).astype(np.uint32)
    ids = np.concatenate((ids, np.full(5000, 7, np.uint32), ids[:9000], np.tile([1, 2, 3], 3000))).astype(np.uint32)
    g = repair.compress(ids)
    assert len(g.left) and len(g.sequence) < 0.9 * len(ids) and (repair.expand(g, g.lengths(), g.sequence) == ids).all()
    shard = repair.from_bytes(repair.to_bytes(g, np.array([len(ids)])))
    for start, n in ((0, 1), (100, 5000), (len(ids) - 3, 3), (44_990, 30), (5, 0)):
        assert (shard.ids(start, n) == ids[start : start + n]).all()
    for few in (np.zeros(0, np.uint32), np.array([5], np.uint32)):
        g = repair.compress(few)
        assert (repair.expand(g, g.lengths(), g.sequence) == few).all()


def most_repeats(sequence):
    """Occurrences of the most frequent pair that do not overlap, counted from the left."""
    found, last = {}, {}
    for i, pair in enumerate(zip(sequence[:-1], sequence[1:], strict=True)):
        if last.get(pair) != i - 1:
            found[pair] = found.get(pair, 0) + 1
            last[pair] = i
    return max(found.values(), default=0)


def test_repair_leaves_no_pair_twice():
    rng = np.random.default_rng(1)
    for t in range(150):
        ids = rng.integers(0, rng.integers(1, 20), rng.integers(0, 400)).astype(np.uint32)
        ids = [ids, np.repeat(ids, 3), np.tile(ids, 4)][t % 3]
        g = repair.compress(ids)
        assert (repair.expand(g, g.lengths(), g.sequence) == ids).all()
        assert most_repeats(g.sequence.tolist()) < 2
        assert most_repeats(repair.compress(ids, 5).sequence.tolist()) < 5


def test_repair_grammars_are_as_small_as_those_of_single_replacements():
    rng = np.random.default_rng(2)
    for _ in range(5):
        ids = rng.zipf(1.3, 1500).clip(0, 200).tolist()
        seq, rules = list(ids), 0
        while True:  # textbook Re-Pair: the most frequent pair of all, one after the other
            counts = {}
            for i, pair in enumerate(zip(seq[:-1], seq[1:], strict=True)):
                n, last = counts.get(pair, (0, -2))
                if last != i - 1:
                    counts[pair] = (n + 1, i)
            pair, (n, _) = max(counts.items(), key=lambda x: x[1][0])
            if n < 2:
                break
            rules, out, i = rules + 1, [], 0
            while i < len(seq):
                both = i + 1 < len(seq) and (seq[i], seq[i + 1]) == pair
                out.append(1000 + rules if both else seq[i])
                i += 2 if both else 1
            seq = out
        g = repair.compress(np.array(ids, np.uint32))
        assert len(g.sequence) + 2 * len(g.left) <= 1.1 * (len(seq) + 2 * rules)


def test_token_files_keep_ids_of_any_type(spark):
    rows = [("b", "x y", 1), ("a", None, 2), (None, "z", 3), ("a", "", 4)]
    got = repair.read_documents(repair.write_shards(spark.createDataFrame(rows, "doc_id string, text string, part int"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "a", "b"] and got[0]["start"] == 0


def test_labels_of_absent_documents_take_no_place(spark):
    rows = [(k, ("good plain words " if k % 2 else "buy now cheap ") * 5 + str(k)) for k in range(40)] + [(900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = [(k, k % 2) for k in range(40)]
    alone = quality.fit(docs, spark.createDataFrame(own, "doc_id long, quality int"), most=40)
    among = quality.fit(docs, spark.createDataFrame([*own, *((k, 1) for k in range(900, 3000))], "doc_id long, quality int"), most=40)
    assert (alone.word_weights == among.word_weights).all() and (alone.scale, alone.shift) == (among.scale, among.shift)
    assert np.abs(among.word_weights).sum() > 0
