"""Token ids in files of Re-Pair grammars (operator 10).

Ids of whole documents in ascending doc_id order are cut into shards; in each, frequent pairs of neighbours are replaced by
nonterminals until none is left that would pay for its rule. A shard keeps its rules, the length that each symbol expands to, the sequence left over and
its documents' lengths, so any range of ids is decoded from the symbols that cover it alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import bytewise
from plumbline.llm.tokenizing import encoder, text_blocks, tokenizer_path
from plumbline.runtime import broadcast_checked, stage

MAGIC = b"RPG1"
#: Ids in a shard, about: a shard ends with the document that fills it.
SHARD_IDS = 1 << 19
#: A rule takes three words of a shard and each replacement saves one: from four occurrences on it makes the file smaller.
LEAST = 4
#: Text that is encoded at a time, about, in bytes.
BLOCK = 8 << 20
#: Ids that a reader decodes at a time, about: whole documents, one at least.
READ_IDS = 1 << 17


@dataclass
class Grammar:
    """first: number of the first nonterminal. Rule k (nonterminal first + k) expands to left[k] right[k]."""

    first: int
    left: np.ndarray
    right: np.ndarray
    sequence: np.ndarray

    def lengths(self) -> np.ndarray:
        """Ids that each nonterminal expands to; a rule refers to earlier ones only."""
        out = np.zeros(len(self.left), np.int64)
        size = lambda s: np.where(s < self.first, 1, out[np.maximum(s.astype(np.int64) - self.first, 0)])
        done = 0
        while done < len(out):  # a run of rules that refer to finished ones is done at once
            later = np.flatnonzero(np.maximum(self.left[done:], self.right[done:]).astype(np.int64) >= self.first + done)
            upto = done + (int(later[0]) if len(later) else len(out) - done)
            out[done:upto] = size(self.left[done:upto]) + size(self.right[done:upto])
            done = upto
        return out


def _grouped(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of pairs, equal pairs side by side, and where each group of equal pairs begins.

    If a pair and its place fit in 64 bits, as they do for shards of usual size, one sort of such words is all it takes.
    """
    half, low = symbols.bit_length(), len(left).bit_length()
    if 2 * half + low <= 64:
        key = (left.astype(np.uint64) << np.uint64(half + low)) | (right.astype(np.uint64) << np.uint64(low))
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        order, pair = (key & np.uint64((1 << low) - 1)).astype(np.int64), key >> np.uint64(low)
    else:
        pair = (left.astype(np.uint64) << np.uint64(32)) | right
        order = np.argsort(pair)
        pair = pair[order]
    return order, np.concatenate(([0], np.flatnonzero(pair[1:] != pair[:-1]) + 1))


#: An odd factor and its inverse modulo 2**32: the order of pairs that are equally frequent.
_MIX, _UNMIX = np.uint64(0x9E3779B1), np.uint64(pow(0x9E3779B1, -1, 1 << 32))
_LOW32 = np.uint64(0xFFFFFFFF)


def compress(ids: np.ndarray, least: int = 2) -> Grammar:
    """Re-Pair: replaces frequent pairs of neighbours by nonterminals until no pair occurs ``least`` times without overlap.

    Pairs are counted exactly. A round takes every pair that is more frequent than both pairs it overlaps, the most frequent
    one of all among them; ties are broken at random, so long copies shrink by a share in each round. In a run of
    overlapping occurrences every other one counts, from the left. An occurrence that is the only one of its pair
    stays so until a neighbour changes, for replacements make new symbols only: later rounds leave it out.
    """
    seq = ids.astype(np.uint32)
    first = int(ids.max()) + 1 if len(ids) else 0
    left, right, nxt = [], [], first
    live = np.ones(len(seq), bool)
    while len(at := np.flatnonzero(live[:-1])) >= least:
        twin = np.flatnonzero(seq[at] == seq[at + 1])
        if len(twin):  # in a run of one symbol the second, fourth, ... pair overlaps the one before
            begins = np.diff(at[twin], prepend=-2) != 1
            nth = np.arange(len(twin)) - np.maximum.accumulate(np.where(begins, np.arange(len(twin)), 0))
            counted = np.ones(len(at), bool)
            counted[twin[nth % 2 == 1]] = False
            at = at[counted]
        order, begin = _grouped(seq[at], seq[at + 1], nxt)
        count = np.diff(np.append(begin, len(order)))
        many = count >= least
        often = np.repeat(many, count)
        live[at[order[~often]]] = False
        if not many.any():
            break
        # a place's rank: how often its pair occurs, then a number of its own
        number = (np.arange(len(begin), dtype=np.uint64) * _MIX) & _LOW32
        rank = np.zeros(len(at), np.uint64)
        rank[order[often]] = np.repeat((count.astype(np.uint64) << np.uint64(32)) | number, count)[often]
        at, rank = at[rank > 0], rank[rank > 0]
        apart = np.diff(at) > 1
        best = np.ones(len(at), bool)
        best[1:] &= apart | (rank[1:] > rank[:-1])
        best[:-1] &= apart | (rank[:-1] >= rank[1:])
        at, code = at[best], (((rank[best] & _LOW32) * _UNMIX) & _LOW32).astype(np.int64)
        used = np.bincount(code, minlength=len(begin))
        rules = np.flatnonzero(used >= least)
        symbol = np.zeros(len(begin), np.uint32)
        symbol[rules] = nxt + np.arange(len(rules))
        taken = used[code] >= least
        at, code = at[taken], code[taken]
        example = np.zeros(len(begin), np.int64)
        example[code] = at
        left.append(seq[example[rules]])
        right.append(seq[example[rules] + 1])
        nxt += len(rules)
        seq[at] = symbol[code]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, live = seq[keep], live[keep]
        now = at - np.arange(len(at))  # every replacement before has shortened the sequence by one
        live[now] = True
        live[np.maximum(now - 1, 0)] = True
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return Grammar(first, join(left), join(right), seq)


def expand(grammar: Grammar, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """All ids that ``symbols`` stand for. Each nonterminal's two sides go to their places in the result; ids are done."""
    size = np.ones(len(symbols), np.int64)
    size[symbols >= grammar.first] = lengths[symbols[symbols >= grammar.first].astype(np.int64) - grammar.first]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    todo, at = symbols, ends - size
    while len(todo):
        done = todo < grammar.first
        out[at[done]] = todo[done]
        rule, at = todo[~done].astype(np.int64) - grammar.first, at[~done]
        left = grammar.left[rule]
        step = np.ones(len(rule), np.int64)
        step[left >= grammar.first] = lengths[left[left >= grammar.first].astype(np.int64) - grammar.first]
        todo, at = np.concatenate((left, grammar.right[rule])), np.concatenate((at, at + step))
    return out


def to_bytes(grammar: Grammar, doc_sizes: np.ndarray) -> bytes:
    """Magic; first nonterminal, numbers of rules, symbols, documents; rules, expansion lengths, sequence, document sizes; crc32."""
    body = struct.pack("<4sIIII", MAGIC, grammar.first, len(grammar.left), len(grammar.sequence), len(doc_sizes))
    body += b"".join(np.asarray(x, "<u4").tobytes() for x in (grammar.left, grammar.right, grammar.lengths(), grammar.sequence, doc_sizes))
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Shard:
    """A stored shard; ``ends``: the ids up to and with each symbol of the sequence; ``lengths``: those of nonterminals."""

    grammar: Grammar
    lengths: np.ndarray
    ends: np.ndarray
    doc_sizes: np.ndarray

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` .. ``start + n - 1`` of the shard: only the symbols over them are expanded."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.ends, start, side="right"))
        b = int(np.searchsorted(self.ends, start + n - 1, side="right"))
        before = int(self.ends[a - 1]) if a else 0
        return expand(self.grammar, self.lengths, self.grammar.sequence[a : b + 1])[start - before : start - before + n]


def from_bytes(raw: bytes) -> Shard:
    if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a whole shard of token ids")
    _, first, rules, symbols, docs = struct.unpack_from("<4sIIII", raw)
    parts, at = [], 20
    for n in (rules, rules, rules, symbols, docs):
        parts.append(np.frombuffer(raw, "<u4", n, at))
        at += 4 * n
    left, right, lengths, seq, sizes = parts
    size = np.ones(len(seq), np.int64)
    size[seq >= first] = lengths[seq[seq >= first].astype(np.int64) - first]
    return Shard(Grammar(first, left, right, seq), lengths, np.cumsum(size), sizes.astype(np.int64))


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str | None, name: str | None, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer or tokenizer_path(name)).encode
    end = np.array([end_id], "<u4").tobytes()
    part, seq, keys, ids, n, kind = TaskContext.get().partitionId(), 0, [], [], 0, None

    def shard() -> pa.RecordBatch:
        nonlocal seq, keys, ids, n
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        payload = to_bytes(compress(np.frombuffer(b"".join(ids), "<u4"), LEAST), sizes)
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys], pa.list_(kind)), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], names=["part", "seq", "doc_ids", "n_ids", "payload"])
        seq, keys, ids, n = seq + 1, [], [], 0
        return out

    for batch in batches:
        texts, doc_ids, kind = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("doc_id").type
        for at, upto in text_blocks(texts, BLOCK):
            for r, x in enumerate(encode(texts.slice(at, upto - at)), at):
                keys.append(doc_ids[r])
                ids.append(x + end)
                n += len(x) // 4 + 1
                if n >= shard_ids:
                    yield shard()
    if ids:
        yield shard()


def write_shards(docs: DataFrame, end_id: int = 2, name: str = "word_bpe_49k.json", tokenizer: str | None = None, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """A staged table of shards (part, seq, doc_ids, n_ids, payload), in ascending doc_id order over (part, seq).

    Texts, NULL as empty, each with the end id after it. Rows are range-partitioned by doc_id (NULL first) with the text's
    hash to break ties, so one id that many rows share is spread as well; equal rows stay, side by side. Ids keep their
    type, whatever it is, and are ordered by it; without rows there are no shards. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_th")]
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = bytewise.map_batches(sorted_rows, _write, f"part int, seq int, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, n_ids long, payload binary", rows=10_000, tokenizer=tokenizer, name=name, end_id=end_id, shard_ids=shard_ids)
    return stage(made, "token-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            shard = from_bytes(batch.column("payload")[r].as_py())
            ends = np.concatenate(([0], np.cumsum(shard.doc_sizes)))
            crc = []
            for i, j in bytewise.blocks(ends, READ_IDS):
                ids = shard.ids(int(ends[i]), int(ends[j] - ends[i])).astype("<u4", copy=False).tobytes()
                cuts = (4 * (ends[i : j + 1] - ends[i])).tolist()
                crc += [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            start = batch.column("start")[r].as_py() + ends[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[r].values, pa.array(start), pa.array(shard.doc_sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from its shard; start counts all ids before it.

    A shard's start is the ids of earlier partitions (one sum for each) and of earlier shards in its own.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", "n_ids").withColumn("_own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("_own") + F.col("_before")).alias("start"))
    return bytewise.map_batches(shards.join(broadcast_checked(starts), ["part", "seq"]).select("doc_ids", "payload", "start"), _read, f"doc_id {shards.schema['doc_ids'].dataType.elementType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
