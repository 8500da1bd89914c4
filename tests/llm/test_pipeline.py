"""The pipeline's stages on sf0.001 with planted cases, each against a plain version of its decision."""

import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import suffix

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.where("n_chars > 1500").orderBy("doc_id").limit(3).collect()
    words = some[0]["text"].split(" ")
    words[20] = "edited"
    passage = " ".join(some[2]["text"].split(" ")[:60])[::-1]
    around = [" ".join(x["text"].split(" ")[30:180])[::-1] for x in docs.where("n_chars > 1500 AND lang = 'en'").orderBy(docs.doc_id.desc()).limit(2).collect()]
    extra = [
        (900001, some[0]["text"], "en", "src1", 1), (900002, " ".join(words), "en", "src1", 1), (900003, None, None, None, None),
        (900004, "1234 ## !!", "en", "src2", 10), (900005, "", "en", None, 0),
        (900006, "These words came first. " + around[0] + " " + passage, "en", "src3", 1), (900007, passage + " " + around[1] + " and those last.", "en", "src4", 1),
        (None, some[1]["text"] + " end", "en", None, 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    out, at = {"documents": docs}, str(tmp_path_factory.mktemp("stages"))
    for name, f in p.STAGES:
        f(spark, docs, "").write.parquet(f"{at}/{name}")
        docs = out[name] = spark.read.parquet(f"{at}/{name}")
    return {k: v.collect() for k, v in out.items()}, {k: v.columns for k, v in out.items()}, passage


def test_columns(steps):
    rows, columns, _ = steps
    for name in list(columns)[:-1]:
        assert columns[name] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_rejects_only_what_has_no_language(steps):
    rows, _, _ = steps
    gone = {r["doc_id"] for r in rows["documents"]} - {r["doc_id"] for r in rows["language_id"]}
    assert gone >= {900003, 900004, 900005}
    texts = {r["doc_id"]: r["text"] for r in rows["documents"]}
    assert all(sum(c.isalpha() for c in texts[d] or "") < 20 for d in gone)


def test_near_dedup_keeps_one_of_each_group(steps):
    rows, _, _ = steps
    before, after = rows["language_id"], rows["near_dedup"]
    kept = {(r["doc_id"], r["text"]) for r in after}
    assert len(kept) == len(after)
    shingles = {}
    for r in before:
        w = r["text"].lower().split()
        shingles[r["doc_id"], r["text"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    first = {}
    for r in before:
        if r["doc_id"] is not None:
            first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    for k in shingles:
        if k not in kept:  # something like it was kept, directly or through others
            assert max(jaccard(shingles[k], s) for q, s in shingles.items() if q != k) > 0.7
    assert all(sum(t == text for _, t in kept) <= 1 for _, text in kept)
    assert not {900001, 900002} & {d for d, _ in kept}


def test_repeats_go_and_the_rest_stays(steps):
    rows, _, passage = steps
    texts = [(r["text"] or "").encode() for r in rows["near_dedup"]]
    after = {r["doc_id"]: r for r in rows["repeat_removal"]}
    assert len(after) == len(texts)
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for r, t in zip(rows["near_dedup"], texts, strict=True):
        spans = [{"lo": i, "hi": i + 200} for i in range(len(t) - 199) if count[t[i : i + 200]] > 1]
        keep, at = b"", 0
        for a, b in suffix.merged(spans):
            a, b = suffix._inward(t, a, b)
            keep, at = keep + t[at:a], b
        assert after[r["doc_id"]]["text"] == (keep + t[at:]).decode()
    assert after[900006]["text"].startswith("These words") and passage not in after[900006]["text"] and passage not in after[900007]["text"]


def test_mix_takes_whole_documents(steps):
    rows, _, _ = steps
    before = {r["doc_id"]: r for r in rows["repeat_removal"]}
    size = lambda r: len(WORD.findall(r["text"] or ""))
    taken, total = defaultdict(int), defaultdict(int)
    for r in rows["source_mix"]:
        assert before[r["doc_id"]]["text"] == r["text"]
        taken[r["source"]] += size(r)
    for r in before.values():
        total[r["source"]] += size(r)
    assert max(Counter(r["doc_id"] for r in rows["source_mix"]).values()) <= 2
    assert all(taken[s] <= 2 * total[s] for s in total)
    biggest = max(size(r) for r in before.values())
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= len(total) * biggest


def test_packing_holds_every_document(steps):
    rows, _, _ = steps
    assert Counter(r["doc_id"] for r in rows["best_fit_packing"] if r["piece"] == 0) == Counter(r["doc_id"] for r in rows["source_mix"])
    used = defaultdict(int)
    for r in rows["best_fit_packing"]:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 1
