"""Token counts of whole texts, huge ones by overlapping chunks (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.llm.tokenizing import tokenizer_path

_models: dict[str, object] = {}
MARK = "▁"


def model(path: str):
    """The worker's sentencepiece model, and whether a piece never goes on after white space (no mark inside a piece)."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
        _models[path] = sp, not inner
    return _models[path]


def _offsets(sp, text: str) -> list[int]:
    """The character at which each token of ``text`` begins (the library gives bytes)."""
    begins = np.array([p.begin for p in sp.encode(text, return_type="proto").pieces], np.int64)
    first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    return np.append(np.cumsum(first) - 1, len(text))[begins].tolist()


def _boundaries(text: str, begins: list[int], shift: int, lo: int, hi: int) -> dict[int, int]:
    """Stable boundaries in ``lo``..``hi`` of the document, with the tokens before each.

    Stable: the token begins at a single space between two words. If no piece has a mark after other characters, no merge
    joins the two sides, whatever else the chunk holds.
    """
    out = {}
    for k, b in enumerate(begins):
        at = b + shift
        if lo <= at < hi and k and 0 < b < len(text) - 1 and text[b] == " " and not text[b - 1].isspace() and not text[b + 1].isspace():
            out[at] = k
    return out


def count_huge(sp, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text: chunks overlap, and are spliced at a stable boundary that both have.

    Where two chunks have none in common their overlap is doubled; if it reaches the chunk, both are encoded as one.
    """
    total, start, taken = 0, 0, 0  # tokens before the splice are in total; ``taken`` of this chunk's precede it
    end = min(len(text), start + chunk)
    part = text[start:end]
    begins = _offsets(sp, part)
    while end < len(text):
        wide = overlap
        while True:
            nxt = max(start, end - wide)
            if nxt == start:  # no common boundary: encode this chunk and the next as one
                end = min(len(text), end + chunk)
                part, begins = text[start:end], _offsets(sp, text[start:end])
                splice = None
                break
            nxt_end = min(len(text), nxt + chunk + wide)
            other = text[nxt:nxt_end]
            other_begins = _offsets(sp, other)
            a = _boundaries(part, begins, start, nxt + 1, end)
            b = _boundaries(other, other_begins, nxt, nxt + 1, end)
            common = sorted(x for x in a.keys() & b.keys() if a[x] >= taken)
            if common:
                splice = common[len(common) // 2]
                total += a[splice] - taken
                taken = b[splice]
                start, end, part, begins = nxt, nxt_end, other, other_begins
                break
            wide *= 2
        if splice is None:
            continue
    return total + len(begins) - taken


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str | None, name: str | None, limit: int, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    sp, splits = model(tokenizer or tokenizer_path(name))
    for batch in batches:
        texts, sizes, counts = batch.column("text"), [], []
        for at in range(0, len(texts), 200):
            part = ["" if t is None else t for t in texts.slice(at, 200).to_pylist()]
            sizes += [len(t.encode()) for t in part]
            plain = [t for t in part if len(t) <= 2 * chunk or not splits]
            short = iter(sp.encode(plain, num_threads=1)) if plain else iter(())
            counts += [len(next(short)) if len(t) <= 2 * chunk or not splits else count_huge(sp, t, chunk, overlap) for t in part]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, limit: int = 4096, chunk: int = 2048, overlap: int = 128, name: str = "piece_bpe_32k.model", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row.

    Texts over two ``chunk`` characters are encoded in chunks that overlap by ``overlap`` and more, wherever they can be
    spliced; others as a whole, as all texts of a model with pieces that go on after white space. NULL and empty texts
    have no tokens; repeated rows are counted each; other columns are ignored.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return bytewise.map_batches(docs.select("doc_id", "text"), _count, schema, tokenizer=tokenizer, name=name, limit=limit, chunk=chunk, overlap=overlap)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
