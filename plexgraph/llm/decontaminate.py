"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items, as sequences of normalised words, form one automaton.  Each document's words
are streamed through it and the longest match that ends at each word is tracked: where it reaches
the window, the last `window` words are hit, and the state gives the items.  Items shorter than the
window are hit as a whole.  Stretches in which fewer consecutive word pairs than a window needs occur
in the benchmark at all are passed over, as no window can lie in them.

One automaton holds at most AUTOMATON_WORDS words, unless one item has more, as flat arrays and
a table of windows (about 210 bytes a word, checked against AUTOMATON_BYTES), and is the only thing sent to the executors; a larger
benchmark is cut into several that are made one at a time, and the documents pass through one after
the other.  Building and scanning take linear time: each state knows the state of its window.

Edge cases: null texts and texts without words have no words and no hits; a text of any length is
scanned whole by one task; an item without words occurs nowhere; equal items, which tie, are all
reported; a null item_id marks words but is not listed or counted; an empty benchmark leaves all
clean; an empty document table gives no rows; repeated document rows are judged alike; an input column
named like the result column is replaced, all others are kept, and decontaminate keeps every column.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, ready, stage, table, unused

WINDOW = 10
AUTOMATON_WORDS, AUTOMATON_BYTES = 500_000, 256 << 20
#: A document with this share of hit words is dropped; of any other, the hit spans are cut out.
DROP_COVERAGE = 0.5
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<low:long,high:long>>>"


def _table() -> bytes:
    """Lower-cases A-Z and turns every other ASCII character that is not a word's into a space."""
    low = bytes(range(256)).lower()
    return bytes(c if c >= 0x80 or c in KEPT else 0x20 for c in low)


NORMAL = _table()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split(b" ") if text else []


def normal_words(text: str | None) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Automaton:
    """Of all items' word sequences: transitions, suffix links and longest lengths; items of each state.

    Once built it is a set of flat arrays: a state's transitions are a sorted range of `codes`, with
    their `targets`."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[object] = []
        pairs: set[int] = set()
        ends: list[tuple[int, int]] = []  # (state, item) at each prefix of each item
        self.shortest = window
        whole: list[tuple[int, int, int]] = []
        for name, words in items:
            if not words:
                continue
            item = len(self.names)
            self.names.append(name)
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            pairs.update(a << 32 | b for a, b in zip(codes, codes[1:], strict=False))
            self.shortest = min(self.shortest, len(codes))
            last = 0
            for n, c in enumerate(codes, 1):
                last = self._extend(last, c)
                if len(codes) >= window and n >= window:
                    ends.append((last, item))
            if len(codes) < window:
                whole.append((last, len(codes), item))
        self.pairs = np.array(sorted(pairs), np.int64)
        # The nearest of each state and its suffix links whose lengths include the window's; -1 where all are shorter.
        link, length = self.link, self.length
        self.at = array("i", [-1]) * len(link)
        order = np.argsort(np.frombuffer(length, np.intc), kind="stable").tolist()
        for state in order[1:]:
            if length[state] >= window:
                self.at[state] = state if length[link[state]] < window else self.at[link[state]]
        found: dict[int, set[int]] = defaultdict(set)
        for state, item in ends:
            found[self.at[state]].add(item)
        self.at_window = {s: tuple(sorted(v)) for s, v in found.items()}
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for state, n, item in whole:
            while length[link[state]] >= n:  # fewer steps than the window has words
                state = link[state]
            short[state][n].append(item)
        # Every state knows the nearest suffix link (itself first) where short items end.
        self.ends = array("i", [-1]) * len(link)
        self.short = {s: dict(v) for s, v in short.items()}
        if short:
            for state in order[1:]:
                self.ends[state] = state if state in short else self.ends[link[state]]
        self._flatten()

    def _flatten(self) -> None:
        sizes = [len(x) for x in self.next]
        self.first = array("i", np.r_[0, np.cumsum(sizes)].astype(np.intc).tobytes())
        codes, targets = array("i"), array("i")
        for state, x in enumerate(self.next):
            for c in sorted(x):
                codes.append(c)
                targets.append(x[c])
            self.next[state] = None
        self.codes, self.targets = codes, targets
        del self.next

    def nbytes(self) -> int:
        """Bytes of the flat arrays, and an estimate of the words' and items' tables."""
        flat = sum(len(x) * x.itemsize for x in (self.link, self.length, self.at, self.ends, self.first, self.codes, self.targets))
        return flat + self.pairs.nbytes + 160 * (len(self.ids) + len(self.at_window) + len(self.names) + len(self.short))

    def step(self, state: int, c: int) -> int:
        """The state after c; -1 where there is none."""
        high = self.first[state + 1]
        at = bisect_left(self.codes, c, self.first[state], high)
        return self.targets[at] if at < high and self.codes[at] == c else -1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges that can hold a match of the shortest length that counts."""
        if self.shortest < 2:
            known = codes > 0
        else:
            known = np.zeros(len(codes), bool)
            both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
            pair = (codes[both].astype(np.int64) << 32) | codes[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
            if len(self.pairs):
                known[both[self.pairs[at] == pair]] = True
        edge = np.flatnonzero(np.diff(np.r_[False, known, False]))
        low, high = edge[::2], edge[1::2]
        if self.shortest >= 2:
            high = high + 1
        wide = high - low >= self.shortest
        return list(zip(low[wide].tolist(), high[wide].tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges, in order, and the items whose windows occur."""
        get = self.ids.get
        codes = np.array([get(w, 0) for w in words], np.int64)
        if len(codes) < self.shortest or not codes.any():
            return [], set()
        hits: list[tuple[int, int]] = []
        windows: set[int] = set()
        shorts: set[tuple[int, int]] = set()
        window, step, link, length, short = self.window, self.step, self.link, self.length, self.short
        for low, high in self.stretches(codes):
            state, n = 0, 0
            for i, c in enumerate(codes[low:high].tolist(), low):
                after = step(state, c)
                while after < 0 and state:
                    state = link[state]
                    n = length[state]
                    after = step(state, c)
                if after >= 0:
                    state, n = after, n + 1
                if n >= window:
                    # A longer match may lie in a state above the window's: its links lead there.
                    hits.append((i - window + 1, i + 1))
                    windows.add(self.at[state])
                at = self.ends[state]
                while at > 0:
                    for size in short[at]:
                        if size <= n:
                            hits.append((i - size + 1, i + 1))
                            shorts.add((at, size))
                    at = self.ends[link[at]]
        return hits, {x for s in windows for x in self.at_window.get(s, ())} | {x for s, size in shorts for x in short[s][size]}


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS) -> Iterator[Automaton]:
    """The benchmark, a table of test items that a driver reads by its nature, as automata of bounded size, one after the other.

    An item of more than `most` words (at least two windows) is cut into parts that overlap by a window less one word, so each window lies in one."""
    items, size, made, most = [], 0, False, max(most, 2 * window)
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = normal_words(row[1])
        for low in range(0, max(1, len(words) - window + 1), most - window + 1) if len(words) > most else (0,):
            part = words[low : low + most]
            if items and size + len(part) > most:
                yield Automaton(items, window)
                items, size, made = [], 0, True
            items.append((row[0], part))
            size += len(part)
    if items or not made:
        yield Automaton(items, window)


def sent(spark: SparkSession, machine: Automaton):
    """The automaton as a broadcast, its size checked in bytes."""
    if machine.nbytes() > AUTOMATON_BYTES:
        raise ValueError(f"an automaton of {machine.nbytes()} bytes; lower `most`, the words of one automaton")
    return spark.sparkContext.broadcast(machine)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS, name: str = "contamination", machines: Iterator[Automaton] | None = None) -> DataFrame:
    """docs with the column name: n_words, n_hit, items (sorted) and spans (hit word ranges).

    With several automata the documents are staged between them, so that a worker holds one."""
    spark = docs.sparkSession
    ready(spark)

    def step(shared):
        def own(texts: pa.Array, before: pa.Array) -> pa.Array:
            machine = shared.value
            rows = []
            for text, old in zip(texts, before.to_pylist(), strict=True):
                words = normal_words(text.as_py())
                hits, items = machine.scan(words)
                spans = [(x["low"], x["high"]) for x in (old or {}).get("spans") or ()]
                names = {machine.names[i] for i in items} | set((old or {}).get("items") or ())
                spans = union(spans + hits)
                rows.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(x for x in names if x is not None), "spans": [{"low": a, "high": b} for a, b in spans]})
            return pa.array(rows, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))]))

        return F.arrow_udf(own, FOUND).asNondeterministic()  # else a filter on it would run it twice

    out = docs.select(*columns(docs, name), F.lit(None).cast(FOUND).alias(name))
    for i, machine in enumerate(machines or automata(benchmark, window, most)):
        if i:
            out = stage(out, "contamination")
        out = out.withColumn(name, step(sent(spark, machine))(F.col("text").cast("string"), F.col(f"`{name}`")))
    return out


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of spans and what lies between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    parts, done = [], 0
    for low, high in spans:
        parts.append(text[done : at[low][0]])
        done = at[high - 1][1]
    return "".join([*parts, text[done:]])


LOWER = {c: c + 32 for c in range(65, 91)}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_coverage: float = DROP_COVERAGE, most: int = AUTOMATON_WORDS) -> DataFrame:
    """docs without the spans that occur in the benchmark, and without documents that mostly do; all columns as before."""
    spark = docs.sparkSession
    ready(spark)
    made = automata(benchmark, window, most)
    machines = list(islice(made, 2))
    found_name, clean = unused(docs, "contamination", "clean")
    if len(machines) > 1:
        found = matched(docs, benchmark, window, most, found_name, chain(machines, made))
        cut_ = F.arrow_udf(lambda texts, spans: _cut_all(texts.to_pylist(), spans.to_pylist(), drop_coverage), CLEAN).asNondeterministic()(F.col("text").cast("string"), F.col(f"{found_name}.spans"))
        out = found.withColumn(clean, cut_)
    else:  # one pass: a task needs one Python worker
        shared = sent(spark, machines[0])

        def own(texts: pa.Array) -> pa.Array:
            texts = texts.to_pylist()
            return _cut_all(texts, [[{"low": a, "high": b} for a, b in union(shared.value.scan(normal_words(t))[0])] for t in texts], drop_coverage)

        out = docs.withColumn(clean, F.arrow_udf(own, CLEAN).asNondeterministic()(F.col("text").cast("string")))
    text, was_cut = F.col(f"{clean}.text"), F.col(f"{clean}.text").isNotNull()
    new = {"text": F.when(was_cut, text).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(was_cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.where(f"{clean}.keep").select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


#: text is null where nothing was cut.
CLEAN = "struct<keep:boolean,text:string>"


def _cut_all(texts: list[str | None], spans: list[list[dict] | None], drop_coverage: float) -> pa.Array:
    rows = []
    for text, found in zip(texts, spans, strict=True):
        own = [(x["low"], x["high"]) for x in found or ()]
        n_hit = sum(b - a for a, b in own)
        keep = not n_hit or n_hit <= drop_coverage * len(normal_words(text))
        rows.append({"keep": keep, "text": cut(text, own) if own and keep else None})
    return pa.array(rows, pa.struct([("keep", pa.bool_()), ("text", pa.string())]))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = "contamination."
    return out.select("doc_id", F.col(c + "n_words").alias("n_words"), F.col(c + "n_hit").alias("n_hit"), F.size(c + "items").cast("long").alias("n_items"), F.sha2(F.array_join(c + "items", ","), 256).alias("items_sha256"), (F.col(c + "n_hit") > 0).alias("contaminated"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN wins x ON x.n = p.n AND x.win = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
