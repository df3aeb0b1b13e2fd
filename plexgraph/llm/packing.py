"""Packing by concatenate and cut, with offsets from two passes.

Pass one encodes the documents where they lie and stores ids with each document's start inside its
partition; the partitions' totals, a number for each task, give every partition's global offset by a
prefix sum.  Pass two cuts each document at the multiples of the window, so a piece knows its
sequence and offset without seeing its neighbours; pieces that begin or end inside a document carry
boundary marks.  No text or id is shuffled.

Edge cases: a null text is empty (only the end id); null ids, repeated rows and ties keep separate
pieces; a text of any length is cut like any other and is held by one task with its ids (about four
times its bytes); an empty table gives no pieces; other columns, whatever their names, are ignored.
All sequences are full but the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ready, stage, table, tokenizer_file
from .encoding import encoder, joined

WINDOW = 1024
ROWS = "part int, start long, doc_id long, width int, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, continues boolean, continued boolean"


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Pass one: ids of each document, with its start among the ids of its partition."""
    ready(docs.sparkSession)
    file = tokenizer_file(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = encoder(file), TaskContext.get().partitionId(), 0
        width = enc.dtype.itemsize
        for batch in batches:
            for low, ids in enc.encode_all(batch.column(1)):
                n = len(ids)
                sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // width
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(at + np.cumsum(sizes) - sizes), batch.column(0).slice(low, n), pa.array(np.full(n, width, np.int32)), ids], [x.split()[0] for x in ROWS.split(", ")])
                at += int(sizes.sum())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, ROWS)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece; ids are little-endian unsigned 32-bit."""
    ids = stage(encoded(docs, vocabulary), "packing-ids")
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum((F.octet_length("ids") / F.col("width")).cast("long")).alias("n")).collect())
    base = dict(zip([p for p, _ in totals], accumulate([0, *[n for _, n in totals[:-1]]]), strict=True)) if totals else {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                batch = whole.slice(low, 4096)
                own, n = joined(batch.column(4), f"<u{batch.column(3)[0].as_py()}")
                at = batch.column(1).to_numpy() + np.array([base[p] for p in batch.column(0).to_pylist()], np.int64)
                first, past = at // window, (at + n - 1) // window + 1
                doc = np.repeat(np.arange(len(n)), past - first)
                sequence = np.arange(len(doc)) + np.repeat(first - (np.cumsum(past - first) - (past - first)), past - first)
                start = np.maximum(sequence * window - at[doc], 0)
                size = np.minimum((sequence + 1) * window - at[doc], n[doc]) - start
                # The pieces follow each other as the documents' ids do.
                bounds = np.r_[0, 4 * np.cumsum(size)].astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(own.astype("<u4").tobytes())])
                columns = [batch.column(2).take(pa.array(doc)), start, size, data, n[doc], sequence, at[doc] + start - sequence * window, start > 0, start + size < n[doc]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return ids.mapInArrow(cut, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
