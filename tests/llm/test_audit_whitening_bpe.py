"""Operators 11 to 13 against plain versions: exact fractions, a walk through every order, the tiktoken library."""

import hashlib
import random
import re
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import audit, backtrack, whitening

# ---------------------------------------------------------------- 11: whitening


def vectors(spark, rows, kind="vec_id long, embedding array<float>, label int, n string"):
    return spark.createDataFrame(rows, kind)


def plain_x(v, d):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v))


def checked(spark, rows, d):
    """Holds n, deviations, components and the identity against exact fractions; returns the rows."""
    df = vectors(spark, rows).repartition(3)
    out = whitening.whiten(df, whitening.fit(df)).collect()
    good = [(i, plain_x(v, d)) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(a, n) for a in s]
    off = [[x - m for x, m in zip(row, mean, strict=True)] for row in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in off) / n) for j in range(d)] for i in range(d)])
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert sorted((r["vec_id"], r["component"]) for r in out) == sorted((i, c + 1) for i, _ in good for c in range(min(4, d)))
    by_id = {i: x for i, x in good}
    assert all(r["n"] == n and r["deviation"] == sum((n * x - t) ** 2 for x, t in zip(by_id[r["vec_id"]], s, strict=True)) for r in out)
    spread = [c for c in range(min(4, d)) if values[c] > 1e-12 * max(values[0], 1)]
    for c in range(min(4, d)):
        mine = {r["vec_id"]: r for r in out if r["component"] == c + 1}
        if c not in spread:
            assert all(r["whitened"] is None for r in mine.values())
            continue
        told = np.array([mine[i]["whitened"] for i, _ in good])
        want = np.array([[float(x - m) for x, m in zip(row, mean, strict=True)] for _, row in good]) @ basis[:, c] / np.sqrt(values[c])
        gap = min((abs(values[c] - values[k]) for k in range(d) if k != c), default=1)
        if gap > 1e-6 * values[0]:
            assert min(np.abs(told - want).max(), np.abs(told + want).max()) < 1e-9
        assert abs(next(iter(mine.values()))["explained"] - values[c] / values.sum()) < 1e-10
    if spread:
        assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-10
    return out


def test_whitened_vectors_match_exact_fractions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1]).tolist(), 1, "x") for i in range(120)]
    rows += [(200, rows[0][1], 2, "copy"), (200, rows[0][1], 2, "copy"), (201, None, 1, ""), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, ""), (203, [float("nan")] * 6, 1, ""), (204, [float("inf")] + [0.0] * 5, 1, "")]
    rows += [(205, [0.5, -0.25], 1, "short"), (206, [0.5, -0.25, 0.0], 1, "the same, padded"), (207, [], 1, "empty"), (None, [-0.0] * 6, None, None)]
    out = checked(spark, [r for r in rows if r[0] is not None and r[3] != "copy"] + rows[120:121], 6)
    assert {"label", "vec_id"} <= set(out[0].asDict())


def test_a_small_spread_on_a_large_offset_is_kept(spark):
    rng = np.random.default_rng(6)
    base = [30000.0, -20000.0, 10000.0]
    rows = [(i, [b + float(e) / 256 for b, e in zip(base, rng.integers(0, 3, 3), strict=True)], 0, "") for i in range(60)]
    checked(spark, rows, 3)


def test_degenerate_embeddings(spark):
    none = vectors(spark, [])
    assert whitening.whiten(none, whitening.fit(none)).collect() == []
    nulls = vectors(spark, [(1, None, 1, "a"), (2, [None], 1, "a")])
    assert whitening.whiten(nulls, whitening.fit(nulls)).collect() == []
    one = checked(spark, [(1, [0.5, 0.25], 1, ""), (2, [0.5, 0.25], 1, "")], 2)
    assert {(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one} == {(1, 0, None, None)}
    wide = vectors(spark, [(1, [1e30, 0.0], 1, ""), (2, [-1e30, 1.0], 1, ""), (3, [5.0, 2.0], 1, "")])
    out = whitening.whiten(wide, whitening.fit(wide)).collect()
    assert len(out) == 6 and all(r["deviation"] is None for r in out if r["vec_id"] < 3)


def test_outer_products_are_summed_in_double_double():
    rng = np.random.default_rng(1)
    high = rng.normal(size=(3000, 4)) * np.exp2(rng.integers(-12, 12, (3000, 1)))
    low = high * 2.0**-55 * rng.normal(size=high.shape)
    total, errors = whitening.outer_sum(high, low)
    exact = [[Fraction(a) + Fraction(b) for a, b in zip(r, s, strict=True)] for r, s in zip(high.tolist(), low.tolist(), strict=True)]
    for i in range(4):
        for j in range(4):
            want = sum(r[i] * r[j] for r in exact)
            size = float(sum(abs(r[i] * r[j]) for r in exact))
            assert abs(float(Fraction(total[i, j]) + Fraction(errors[i, j]) - want)) <= 2.0**-56 * size * 2**-4


def test_codes_are_equal_just_for_equal_vectors():
    x = np.array([[1, 2, 0], [1, 2, 0], [0, 0, 0], [300, 1, 1], [1 << 40, 0, -5], [-(1 << 63), (1 << 63) - 1, 0]], np.int64)
    rows = whitening.coded(x)
    assert rows[0] == rows[1] == whitening.coded(x[:1, :2])[0] and len(set(rows)) == 5
    assert (whitening.decoded(rows, 3) == x).all()


# ---------------------------------------------------------------- 12: filter audit


def plain_audit(docs, labels):
    """Walks through every order, one filter after the other, document by document."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    rows = []
    for d, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shap = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for o in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(o):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shap[x] += len(gone)
                out[part, o, k + 1] = [len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(shap[o[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit_matches_a_walk_through_all_orders(spark, docs, corpus):
    rng = random.Random(2)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in corpus if rng.random() < 0.7] + [(None, 1, 1), (99999, 1, 1), (corpus[0][0], 1, 0), (corpus[0][0], 0, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(0)).withColumn("part", F.lit("x"))
    out = audit.interactions(docs, table).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in out}
    assert len(found) == len(out) and found == plain_audit([r[:3] for r in corpus], labels)


def test_filter_audit_of_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(empty, none).collect() == []
    assert audit.interactions(docs.where("text IS NULL"), none).count() == 600 * docs.where("text IS NULL").selectExpr("coalesce(lang, '') p").distinct().count()


# ---------------------------------------------------------------- 13: byte-pair encoding


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def library(request):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path(request.param)
    ranks = backtrack.read_ranks(path)
    return request.param, path, tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_backtracking_makes_the_merges_of_any_bytes(library):
    coder = backtrack.Backtracker(backtrack.read_ranks(library[1]))
    rng, tokens = random.Random(4), list(coder.ranks)
    kinds = [
        lambda: b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))),
        lambda: bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 60))),
        lambda: bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))),
        lambda: rng.choice([b"a", b" ", b"-", b"=", b"\xc3\xa9"]) * rng.randint(1, 300),
    ]
    for k in range(4000):
        piece = kinds[k % 4]()
        assert coder.encode(piece) == (library[3]._encode_single_piece(piece) if piece else [])


def test_a_vocabulary_with_tokens_that_merging_cannot_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"bcd": 258, b"xyzw": 259}
    coder, rng = backtrack.Backtracker(ranks), random.Random(9)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abcdxyzw") for _ in range(rng.randint(1, 14)))
        assert coder.encode(piece) == ([ranks[piece]] if piece in ranks else backtrack.merged(piece, ranks))


def test_whole_texts_round_trip(spark, docs, corpus, library):
    name, _, _, encoding = library
    coded = backtrack.encode(docs.drop("n_chars"), name)
    want = sorted((r[0] if r[0] is not None else -1, encoding.encode_ordinary(r[1] or "")) for r in corpus)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["ids"])) for r in coded.select("doc_id", "ids").collect()) == want
    back = backtrack.decode(coded.select("doc_id", "ids"), name).collect()
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in back) == sorted((r[0] or -1, (r[1] or "").encode()) for r in corpus)
    digests = {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in backtrack.fingerprints(coded, name).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == {(len(ids := encoding.encode_ordinary(r[1] or "")), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode())) for r in corpus}


def test_encoding_of_nothing_and_of_other_patterns(spark, empty, docs):
    assert backtrack.fingerprints(backtrack.encode(empty)).collect() == []
    coded = backtrack.encode(docs.select("doc_id", "text"), pattern=r"\p{L}+|\P{L}")
    assert {bytes(r["decoded"]) for r in backtrack.decode(coded).collect()} == {(r["text"] or "").encode() for r in docs.select("text").collect()}
    missing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in backtrack.decode(missing).collect()] == [b"", b""]


def test_the_cache_may_be_small(library, corpus):
    coder = backtrack.PieceEncoder(library[1], library[2], most=5)
    texts = pa.array([r[1] for r in corpus], pa.string())
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [library[3].encode_ordinary(r[1] or "") for r in corpus]
