"""Token-ID output: ids in a Re-Pair grammar for each shard, with random access to documents.

A shard is one row of a Parquet table in the shared folder; its payload (magic RPG1) holds the rules
(pairs of symbols), every rule's expansion length, and each document's symbols.  No rule crosses a
document's end, so a document is read by expanding its own symbols only, and its number of ids is
the sum of their expansion lengths.

Compression runs in rounds: all pairs of a shard are counted exactly (of a run of one symbol, every
second pair, as they overlap), the most frequent ones whose left and right symbols do not clash, so
that no two of them can overlap, become nonterminals, and their occurrences are replaced at once.
Rounds go on until no pair is held MIN_COUNT times.  A rule costs 12 bytes, so rarer pairs save
little: on 1,042,173 ids a minimum of 24, 8 and 4 left 61, 58 and 105 % of the plain bytes, in 0.15,
0.17 and 0.20 s (below 8 the symbols outgrow 16 bits).

Edge cases: a null text is empty (only the end id); null ids come first; repeated rows and equal ids
are kept apart, by the hash of their text and else in any order, and are dealt to several tasks where
there are many; a very long text is one document of one shard, which
then is larger than SHARD_IDS and is held by one task; an empty table gives an empty table; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ready, staged_path, table, tokenizer_file
from .encoding import encoder, joined

MAGIC = b"RPG1"
SHARD_IDS = 1 << 20
#: A pair that a shard holds less often gets no rule: a rule takes 12 bytes, each of its uses saves 2.
MIN_COUNT = 8
CELL_BITS, SPREAD = 18, np.uint64(0x9E3779B97F4A7C15)
SHARDS = "part int, shard int, start long, n_tokens long, payload binary"


def _overlapping(seq: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Places of pairs of equal ids that overlap the pair before them: every second one of a run."""
    at = np.flatnonzero((seq[:-1] == seq[1:]) & free)
    if not len(at):
        return at
    first = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], at, 0))
    return at[(at - first) % 2 == 1]


def _cells(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * SPREAD) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _found(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The place of each pair among the sorted keys; -1 for one that isn't there."""

    def sought(some: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        return np.where(keys[at] == some, at, -1)

    if len(pairs) < 1 << CELL_BITS - 3:
        return sought(pairs)
    own, cells = _cells(keys), _cells(pairs)
    slot = np.full(1 << CELL_BITS, -1, np.int32)
    slot[own] = np.arange(len(keys))
    found = slot[cells]
    found[keys[found] != pairs] = -1
    # Keys that share a cell with a later one are sought for.
    shared = np.zeros(1 << CELL_BITS, bool)
    shared[own[slot[own] != np.arange(len(keys))]] = True
    again = np.flatnonzero((found < 0) & shared[cells])
    found[again] = sought(pairs[again])
    return found


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules [n, 2], symbols, symbols of each document) for ids below base, cut into documents by lengths."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    # Places whose pair may still be frequent: a pair that is not can become so only with a new symbol in it.
    alive = np.ones(len(seq), bool)
    rules: list[np.ndarray] = []
    size = base
    while len(seq) > 1:
        shift = np.uint64(int(size).bit_length())
        over = _overlapping(seq, ~last[:-1])
        alive[over], held = False, over[alive[over]]
        where = np.flatnonzero(alive[:-1] & ~last[:-1])
        pair = (seq[where].astype(np.uint64) << shift) | seq[where + 1]
        keys, counts = np.unique(pair, return_counts=True)
        keys, counts = keys[counts >= min_count], counts[counts >= min_count]
        lefts, rights = set(), set()
        chosen = np.zeros(len(keys), bool)
        first, second = (keys >> shift).tolist(), (keys & np.uint64((1 << int(shift)) - 1)).tolist()
        for i in np.argsort(-counts, kind="stable").tolist():
            a, b = first[i], second[i]
            if a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights)):
                lefts.add(a)
                rights.add(b)
                chosen[i] = True
        if not len(keys):
            break
        found = _found(keys, pair)
        known = np.flatnonzero(found >= 0)
        where, found = where[known], found[known]
        taken = chosen[found]
        at = where[taken]
        alive[:] = False
        alive[held] = alive[where] = True
        seq[at] = (size + np.cumsum(chosen) - 1)[found[taken]]
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))
        seq, last, alive = seq[keep], last[keep], alive[keep]
        alive[new] = alive[np.maximum(new - 1, 0)] = True
        rules.append(np.stack([keys[chosen] >> shift, keys[chosen] & np.uint64((1 << int(shift)) - 1)], 1).astype(np.uint32))
        size += int(chosen.sum())
    ends = np.flatnonzero(last) + 1
    own = np.zeros(len(lengths), np.uint32)
    own[lengths > 0] = np.diff(np.r_[0, ends])
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq, own


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; rules refer to ids and to earlier rules only."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, np.uint32)


def rule_ids(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each rule's ids begin and the last end, all rules' ids): all rules are rewritten at once, level by level."""
    flat = rules.ravel().astype(np.uint32)
    while (rule := flat >= base).any():
        at = np.repeat(np.arange(len(flat)), np.where(rule, 2, 1))
        second = np.r_[False, at[1:] == at[:-1]]
        flat = np.where(rule[at], rules[np.where(rule, flat - base, 0)[at], second.astype(np.intp)], flat[at])
    return np.r_[0, np.cumsum(lengths, dtype=np.int64)], flat


def expand(symbols: np.ndarray, starts: np.ndarray, flat: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for, by the result of rule_ids."""
    rule = symbols >= base
    which = symbols[rule].astype(np.int64) - base
    sizes = np.ones(len(symbols), np.int64)
    sizes[rule] = inner = starts[which + 1] - starts[which]
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    out[(ends - sizes)[~rule]] = symbols[~rule]
    within = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
    out[np.repeat((ends - sizes)[rule], inner) + within] = flat[np.repeat(starts[which], inner) + within]
    return out


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, base: int, **options) -> bytes:
    rules, symbols, own = compress(ids, lengths, base, **options)
    wide = base + len(rules) > 1 << 16
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = struct.pack("<4sIIIQB", MAGIC, base, len(doc_ids), len(rules), len(symbols), 4 if wide else 2)
    parts = (rules.astype("<u4"), expansion_lengths(rules, base).astype("<u4"), np.array([x or 0 for x in doc_ids], "<i8"), known, own.astype("<u4"), symbols.astype("<u4" if wide else "<u2"))
    return head + b"".join(x.tobytes() for x in parts)


class Shard:
    """Random access to the documents of one payload."""

    def __init__(self, payload: bytes):
        magic, self.base, n, n_rules, n_symbols, width = struct.unpack_from("<4sIIIQB", payload)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sIIIQB")

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(payload, dtype, count, at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        values, known = take("<i8", n), take("u1", n)
        self.doc_ids = [int(v) if k else None for v, k in zip(values, known, strict=True)]
        self.ends = np.cumsum(take("<u4", n), dtype=np.int64)
        self.symbols = take("<u2" if width == 2 else "<u4", n_symbols)

    @cached_property
    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        return rule_ids(self.rules, self.lengths, self.base)

    def sizes(self) -> np.ndarray:
        """Ids of each document, from expansion lengths alone."""
        each = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.base
        each[rule] = self.lengths[self.symbols[rule].astype(np.int64) - self.base]
        total = np.r_[0, np.cumsum(each)]
        return total[self.ends] - total[np.r_[0, self.ends[:-1]]] if len(self.ends) else np.zeros(0, np.int64)

    def document(self, i: int) -> np.ndarray:
        low = self.ends[i - 1] if i else 0
        return expand(self.symbols[low : self.ends[i]], *self.expanded, self.base)

    def all(self) -> np.ndarray:
        return expand(self.symbols, *self.expanded, self.base)


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS, **options) -> None:
    """Encode docs and write their ids, in ascending doc_id order, as shards at path."""
    spark = docs.sparkSession
    ready(spark)
    file = tokenizer_file(vocabulary)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(file)
        base = enc.tokenizer.get_vocab_size()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, start, size
            payload = pack_shard(names, np.concatenate(held), np.concatenate(sizes), base, **options)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start]), pa.array([size]), pa.array([payload], pa.binary())], ["part", "shard", "start", "n_tokens", "payload"])
            number, start, size = number + 1, start + size, 0
            for x in (held, sizes, names):
                x.clear()
            return row

        for batch in batches:
            for low, raw in enc.encode_all(batch.column(1)):
                ids, own = joined(raw, enc.dtype)
                known = batch.column(0).slice(low, len(raw)).to_pylist()
                ends = np.r_[0, np.cumsum(own)]
                a = 0
                while a < len(own):
                    b = min(len(own), int(np.searchsorted(ends, ends[a] + shard_ids - size)))  # the document that fills the shard is its last
                    held.append(ids[ends[a] : ends[b]])
                    sizes.append(own[a:b])
                    names += known[a:b]
                    size += int(ends[b] - ends[a])
                    a = b
                    if size >= shard_ids:
                        yield flush()
        if names:
            yield flush()

    # Rows of one id, or without one, are told apart by their text and by a number, so any number of them is dealt to several tasks.
    order = ["doc_id", "__hash", "__nth"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__nth"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(shards, SHARDS).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from shards at path; with digest, the ids' crc32 (ids_crc32) instead of them."""
    ready(spark)
    rows = spark.read.schema(SHARDS).parquet(path)
    totals = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    # A number for each writing task; it does not grow with the rows.
    base = dict(zip([p for p, _ in totals], accumulate([0, *[n for _, n in totals[:-1]]]), strict=True)) if totals else {}

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                shard = Shard(batch.column(4)[i].as_py())
                ids, sizes = shard.all().astype("<u4"), shard.sizes()
                ends = np.cumsum(sizes)
                begins = ends - sizes
                offsets = np.r_[0, ends] * 4
                for a in range(0, len(sizes), 4096):
                    b = min(a + 4096, len(sizes))
                    own = offsets[a : b + 1]
                    if digest:
                        last = pa.array([crc32(ids[x:y]) for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)], pa.int64())
                    else:
                        data = ids[begins[a] : ends[b - 1]].tobytes()
                        last = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((own - own[0]).astype(np.int32).tobytes()), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[a:b], pa.int64()), pa.array(begins[a:b] + start + base[part]), pa.array(sizes[a:b]), last], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token-shards")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, digest=True)
