"""Ids by the tokenizers library, with a bounded cache of chunks that it encodes independently of their neighbours."""

from __future__ import annotations

import json
import os
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm import bytewise

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words longer than this are encoded but not kept; the cache holds two generations of so many words each.
LONGEST, MOST = 48, 400_000
#: Chunks that are encoded in one call.
TOGETHER = 2_000
#: Texts with runs of white space, white space at an end, other white space than " " and "\n", or the mark of first chunks.
_ODD = r"  |\n\n| \n|\n |[ \n]\z|\A[ \n]|[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Below U+0300 nothing composes, and all letters but one have a lower case of one character.
_NOT_PLAIN = r"[^\x00-\x{12f}\x{131}-\x{2ff}]|<\|"
#: A word of lower or plain letters, and punctuation after it: both tokenizers' patterns cut between the two.
_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{2af}]"
_LETTERS, _WORD = rf"\A{_LETTER}+\z", rf"\A(?P<head>{_LETTER}+)(?P<tail>[.,;:!?*$%&#]*)\z"
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from U+0100 on, in turn.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLING = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
# The normalizers and pre-tokenizers, as their files state them, for which the rules above hold.
_LEAD = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_DROP = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


def cut_rule(tokenizer) -> str | None:
    """How a tokenizer, by its own description, treats the space between two words.

    "drop": it drops white space and case; "lead": it binds one space to the word after it. None for every other
    description, extra models or added tokens that are not special: such a tokenizer's texts are encoded whole.
    """
    told = json.loads(tokenizer.to_str())
    model = told["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and all(t["special"] and t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
    shape = (told["normalizer"], told["pre_tokenizer"])
    return {True: "lead"}.get(plain and shape == _LEAD) or ("drop" if plain and shape == _DROP else None)


def ragged(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``which`` of many that lie end to end, again end to end, and their ends."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    n = (ends - begins)[which]
    out = np.cumsum(n)
    return ids[np.repeat(begins[which] - (out - n), n) + np.arange(int(n.sum()))], out


@dataclass
class Kept:
    """Words and their ids, end to end."""

    keys: pa.Array
    ids: np.ndarray
    ends: np.ndarray

    @classmethod
    def none(cls) -> Kept:
        return cls(pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def find(self, words: pa.Array) -> np.ndarray:
        """The places of ``words``, -1 where they are missing."""
        if not len(self.keys) or not len(words):
            return np.full(len(words), -1, np.int64)
        return pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def plus(self, keys: pa.Array, ids: np.ndarray, ends: np.ndarray) -> Kept:
        return Kept(pa.concat_arrays([self.keys, keys]), np.concatenate((self.ids, ids)), np.concatenate((self.ends, ends + len(self.ids))))


def _flat(lists: list[list[int] | array]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(array("I", x).tobytes() for x in lists)
    return np.frombuffer(raw, "<u4"), np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))


class ChunkEncoder:
    """Encodes whole texts to little-endian unsigned 32-bit ids.

    Text is cut where the tokenizer's own pre-tokenizer always cuts (``cut_rule``), so ids of chunks laid end to end are the
    ids of the text. With "lead", a text with runs of white space or unusual white space is encoded whole; tokenizers
    without a rule encode every text whole. Words in use move to the younger generation of the cache; when that is full
    the older one is dropped, so rare words go and frequent ones stay.
    """

    def __init__(self, path: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.rule = cut_rule(self.tokenizer)
        self.lead = self.rule == "lead"
        self.merge = self.tokenizer.model.tokenize if self.rule else None
        self.most = most
        self.young, self.old = Kept.none(), Kept.none()
        self.tails: dict[str, list[int]] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), TOGETHER) for e in self.tokenizer.encode_batch_fast(texts[at : at + TOGETHER], add_special_tokens=False)]

    def _word(self, word: str) -> list[int]:
        """Ids of letters that need no normalizing and no cutting: the merges alone decide."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELLING)
        return [t.id for t in self.merge("Ġ" + spelled if self.lead else spelled)]

    def _tail(self, tail: str) -> list[int]:
        if tail not in self.tails:
            if len(self.tails) > self.most:
                self.tails.clear()
            self.tails[tail] = self._ids([tail])[0] if tail else []
        return self.tails[tail]

    def _parts(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """What is looked up for different chunks: words, and for each chunk its word and its punctuation (numbers; -1: none).

        A plain word is its letters; every other chunk is one word as it stands, without punctuation of its own.
        """
        cut = pc.extract_regex(chunks, _WORD)
        plain = pc.is_valid(cut)
        if not self.lead:
            plain = pc.and_(plain, pc.equal(chunks, pc.utf8_lower(chunks)))
        words = pc.if_else(plain, cut.field("head"), chunks).dictionary_encode()
        tails = pc.if_else(plain, cut.field("tail"), "").dictionary_encode()
        return words.dictionary, np.stack((words.indices.to_numpy(), tails.indices.to_numpy()), axis=1), tails.dictionary.to_pylist()

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: plain ones by the merges, all others by the whole path of the library."""
        plain = pc.match_substring_regex(words, _LETTERS)
        if not self.lead:
            plain = pc.and_(plain, pc.equal(words, pc.utf8_lower(words)))
        plain = plain.to_numpy(zero_copy_only=False)
        own = lambda w: w if not self.lead or w[:1] == "\n" else w[1:] if w[:1] == "\0" else " " + w
        rest = self._ids([own(w) for w in words.filter(pa.array(~plain)).to_pylist()])
        place = np.empty(len(words), np.int64)
        place[plain], place[~plain] = np.arange(plain.sum()), plain.sum() + np.arange(len(rest))
        return ragged(*_flat([*map(self._word, words.filter(pa.array(plain)).to_pylist()), *rest]), place)

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, from the cache as far as it has them."""
        if len(self.young.keys) > self.most:
            self.young, self.old = Kept.none(), self.young
        which = self.young.find(words)
        lost = np.flatnonzero(which < 0)
        if not len(lost):
            return ragged(self.young.ids, self.young.ends, which)
        again = self.old.find(words.take(pa.array(lost)))
        moved, fresh = lost[again >= 0], lost[again < 0]
        table = self.young
        which[moved] = len(table.keys) + np.arange(len(moved))
        table = table.plus(words.take(pa.array(moved)), *ragged(self.old.ids, self.old.ends, again[again >= 0]))
        new = words.take(pa.array(fresh))
        which[fresh] = len(table.keys) + np.arange(len(fresh))
        ids, ends = self._learn(new)
        short = pc.less_equal(pc.binary_length(new), LONGEST).to_numpy(zero_copy_only=False)
        whole = table.plus(new, ids, ends)
        self.young = whole if short.all() else table.plus(new.filter(pa.array(short)), *ragged(ids, ends, np.flatnonzero(short)))
        return ragged(whole.ids, whole.ends, which)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different chunks: those of their words, then those of the punctuation after them."""
        words, pairs, tails = self._parts(chunks)
        ids, ends = self._known(words)
        more, more_ends = _flat([self._tail(t) for t in tails])
        pairs[:, 1] += len(ends)
        ids, ends = ragged(np.concatenate((ids, more)), np.concatenate((ends, more_ends + len(ids))), pairs.reshape(-1))
        return ids, ends[1::2]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a batch; NULL has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.rule:
            return [array("I", x).tobytes() for x in self._ids(texts.to_pylist())]
        if self.lead:
            odd = pc.match_substring_regex(texts, _ODD)
            ready = pc.if_else(odd, None, pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", " \n"))
        else:
            odd = pa.nulls(0, pa.bool_())
            ready = pc.replace_substring(pc.if_else(pc.match_substring_regex(texts, _NOT_PLAIN), texts, pc.utf8_lower(texts)), "\n", " ")
        chunks = pc.split_pattern(ready, " ")
        coded = chunks.flatten().dictionary_encode()
        ids, ends = self._chunks(coded.dictionary)
        raw, ends = ragged(ids, ends, coded.indices.to_numpy())
        raw = raw.astype("<u4", copy=False).tobytes()
        counts = pc.fill_null(pc.list_value_length(chunks), 0).to_numpy().astype(np.int64)
        bounds = (4 * np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]).tolist()
        out = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist() if len(odd) else []
        for i, found in zip(whole, self._ids([texts[i].as_py() for i in whole]), strict=True):
            out[i] = array("I", found).tobytes()
        return out


def text_blocks(texts: pa.Array, limit: int = 4 << 20):
    """Row ranges of a batch with at most ``limit`` bytes of text each, or one longer row."""
    return bytewise.blocks(bytewise.text_bytes(texts)[1], limit)


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, most: int = MOST) -> ChunkEncoder:
    """The encoder of this Python worker; its cache outlives a task."""
    if (path, most) not in _encoders:
        _encoders[path, most] = ChunkEncoder(path, most)
    return _encoders[path, most]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, looked up where it is used."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
