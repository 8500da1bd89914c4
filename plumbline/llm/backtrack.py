"""Byte-pair encoding by longest matches and backtracking, and decoding (operator 13)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm import bytewise
from plumbline.llm.tokenizing import ChunkEncoder, Kept, ragged, text_blocks, tokenizer_path

#: Words that the cache holds in each of its two generations, and pairs of tokens whose compatibility is remembered.
WORDS, PAIRS = 250_000, 1_000_000
#: The pattern for which texts may be cut at single spaces between other characters: none of its matches spans such a cut.
# Fixed value: the pattern of the rank files, as their package states it.
_CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: on each line the token in base64 and its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding by its definition: merge the pair of lowest rank, the first of equal ones, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = lambda i: ranks.get(parts[i] + parts[i + 1], _NEVER)
    costs = [rank(i) for i in range(len(parts) - 1)]
    while costs and (best := min(costs)) != _NEVER:
        at = costs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del costs[at]
        if at:
            costs[at - 1] = rank(at - 1)
        if at < len(costs):
            costs[at] = rank(at)
    return [ranks[p] for p in parts]


class Backtracker:
    """Encodes one piece of text as merging would, without merging.

    A sequence of tokens is what merging yields if, and only if, each token and each two neighbours are what merging makes
    of their own bytes. So the encoder takes the longest token at each place, shortens it while it does not go with the one
    before, and steps back where none does. A place that turned out to lead nowhere is never entered again: the steps grow
    with the length. Tokens at all places come from one pass of an Aho-Corasick automaton over the bytes, read as Latin-1.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.sizes = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        if token not in self.shorter:
            piece = self.tokens[token]
            self.shorter[token] = next((self.ranks[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ranks), -1)
        return self.shorter[token]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives these two; with -1 on the left, whether the other is its own result.

        Not every vocabulary can reach all of its tokens by merging.
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        alone = left < 0
        found = merged(self.tokens[right] if alone else self.tokens[left] + self.tokens[right], self.ranks) == ([right] if alone else [left, right])
        self.pairs[left, right] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece; every byte must be a token. A piece that is itself a token is this one token."""
        if not piece:
            return []
        if piece in self.ranks:
            return [self.ranks[piece]]
        sizes, known, n = self.sizes, self.pairs.get, len(piece)
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token  # later ends are longer
        dead = bytearray(n + 1)
        out: list[int] = []
        at, left, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    fits = known((left, token))
                    if fits or (fits is None and self._fits(left, token)):
                        break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                left = token
                at += sizes[token]
                token = longest[at] if at < n else -1
            elif not out:
                raise ValueError("a byte of the text is no token")
            else:  # nothing goes on from here
                dead[at] = 1
                token = out.pop()
                left = out[-1] if out else -1
                at -= sizes[token]
        return out


class PieceEncoder(ChunkEncoder):
    """Whole texts to ids: the pattern's matches, each by ``Backtracker``, with the cache of words of its parent.

    For the one pattern that is known to allow it, texts are cut at single spaces, and words are looked up in the cache
    before anything is encoded. Texts with other white space, and all texts under another pattern, are matched whole.
    Strings of special tokens are plain text.
    """

    def __init__(self, path: str, pattern: str, most: int = WORDS):
        self.pattern = regex.compile(pattern)
        self.coder = Backtracker(read_ranks(path))
        self.rule = "lead" if pattern == _CUTTABLE else None
        self.lead, self.most = True, most
        self.young, self.old = Kept.none(), Kept.none()
        self.tails: dict[str, list[int]] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [[i for m in self.pattern.finditer(t) for i in self.coder.encode(m.group().encode())] for t in texts]

    def _word(self, word: str) -> list[int]:
        return self.coder.encode(b" " + word.encode())


class Spelling:
    """What ids stand for: their bytes, and their decimal forms, each end to end."""

    def __init__(self, path: str):
        tokens = {i: t for t, i in read_ranks(path).items()}
        self.bytes, self.byte_ends = self._table([tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)])
        self.names, self.name_ends = self._table([b"%d " % i for i in range(len(self.byte_ends))])

    @staticmethod
    def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])[1:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return ragged(self.bytes, self.byte_ends, ids)[0].tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """Ids in decimal, joined by one space."""
        return ragged(self.names, self.name_ends, ids)[0].tobytes()[:-1]


_encoders: dict[tuple[str, str], PieceEncoder] = {}
_spellings: dict[str, Spelling] = {}


def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """The encoder of this Python worker; its cache outlives a task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = PieceEncoder(path, pattern)
    return _encoders[path, pattern]


def spelling(path: str) -> Spelling:
    if path not in _spellings:
        _spellings[path] = Spelling(path)
    return _spellings[path]


def _encode(batches: Iterator[pa.RecordBatch], own: list[str], tokenizer: str | None, name: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    coder = piece_encoder(tokenizer or tokenizer_path(name), pattern)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for i, j in text_blocks(texts):
            ids = [np.frombuffer(x, "<u4") for x in coder.encode(texts.slice(i, j - i))]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in own), lists], names=[*own, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], own: list[str], tokenizer: str | None, name: str, digests: bool) -> Iterator[pa.RecordBatch]:
    table = spelling(tokenizer or tokenizer_path(name))
    for batch in batches:
        column = batch.column("ids")
        ids = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in column]
        kept = [batch.column(c) for c in own]
        if digests:
            hexes = lambda rows: pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(map(len, ids), pa.int64()), hexes(map(table.listed, ids)), hexes(map(table.decode, ids))], names=[*own, "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            yield pa.RecordBatch.from_arrays([*kept, pa.array(map(table.decode, ids), pa.binary())], names=[*own, "decoded"])


def _others(df: DataFrame, *taken: str) -> tuple[list[str], str]:
    found = [f for f in df.schema.fields if f.name not in taken]
    return [f.name for f in found], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in found)


def encode(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``docs`` with ids array<int> in place of text, for every row.

    Each match of ``pattern`` (the rank files' own if None) in the whole text is encoded by itself, as the tiktoken library
    would without special tokens. NULL and empty texts have no ids; equal texts have equal ids; a column named ids is
    replaced. A block of texts of 4 MB, or one longer text, is in memory at a time.
    """
    own, kinds = _others(docs, "text", "ids")
    return bytewise.map_batches(docs.select(*(f"`{c}`" for c in own), "text"), _encode, kinds + "ids array<int>", own=own, tokenizer=tokenizer, name=name, pattern=pattern)


def decode(coded: DataFrame, name: str = "byte_bpe_50k.tiktoken", tokenizer: str | None = None) -> DataFrame:
    """The columns of ``coded`` with decoded binary in place of ids; NULL and empty lists have no bytes."""
    own, kinds = _others(coded, "ids", "decoded")
    return bytewise.map_batches(coded.select(*(f"`{c}`" for c in own), "ids"), _decode, kinds + "decoded binary", rows=200, own=own, tokenizer=tokenizer, name=name, digests=False)


def fingerprints(coded: DataFrame, name: str = "byte_bpe_50k.tiktoken", tokenizer: str | None = None) -> DataFrame:
    """The columns of ``coded`` with, in place of ids, their number and the hashes of their list and of what they decode to."""
    own, kinds = _others(coded, "ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return bytewise.map_batches(coded.select(*(f"`{c}`" for c in own), "ids"), _decode, kinds + "n_tokens long, ids_sha256 string, decoded_sha256 string", rows=200, own=own, tokenizer=tokenizer, name=name, digests=True)


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return fingerprints(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
