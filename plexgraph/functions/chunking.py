"""Boundary-aware chunks of bounded size with overlap: a sequential fold, so an Arrow UDF."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, which decide where chunks begin: paragraph, line, sentence, white space; after them, single characters.
LADDER = tuple(re.compile(x) for x in (r"\n\s*\n", r"\n", r"[.!?。?！][\s\"'”’)\]]*\s+", r"\s+"))


def atoms(text: str, size: int, level: int = 0):
    """Pieces of at most size characters that concatenate to text, cut at the coarsest boundary that does."""
    if len(text) <= size:
        if text:
            yield text
        return
    if level == len(LADDER):
        yield from text
        return
    at = 0
    for m in LADDER[level].finditer(text):
        if m.end() > at:
            yield from atoms(text[at : m.end()], size, level + 1)
            at = m.end()
    if at < len(text):
        yield from atoms(text[at:], size, level + 1)


def chunk_text(text: str | None, size: int, overlap: int = 0, strict: bool = False) -> list[str]:
    """Greedy chunks; the last pieces of one, up to overlap characters, begin the next.

    A chunk can exceed size by its overlap; strict drops overlap until it does not."""
    return list(each_chunk(text, size, overlap, strict))


def each_chunk(text: str | None, size: int, overlap: int = 0, strict: bool = False):
    """The chunks of chunk_text, one at a time."""
    held: list[str] = []
    total = 0
    for piece in atoms(text or "", size):
        if held and total + len(piece) > size:
            yield "".join(held)
            first = 0
            while first < len(held) and (total > overlap or (strict and total + len(piece) > size)):
                total -= len(held[first])
                first += 1
            held = held[first:]
        held.append(piece)
        total += len(piece)
    if held:
        yield "".join(held)


def chunks(text: Column, size: int, overlap: int = 0, strict: bool = False) -> Column:
    """The chunks of a text column, as an array."""

    def own(texts: pa.Array) -> pa.Array:
        return pa.array([chunk_text(x.as_py(), size, overlap, strict) for x in texts], pa.list_(pa.string()))

    return F.arrow_udf(own, "array<string>")(text)


def chunk_count(text: Column, size: int, overlap: int = 0, strict: bool = False) -> Column:
    """The number of chunks of a text column; no chunk is kept."""

    def own(texts: pa.Array) -> pa.Array:
        return pa.array([sum(1 for _ in each_chunk(x.as_py(), size, overlap, strict)) for x in texts], pa.int32())

    return F.arrow_udf(own, "int")(text)
