"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `order` bytes with counts of the bytes that follow.
A byte that a context has seen c times of n, with q different ones, has the probability c / (n + q);
what is left, q / (n + q), is the escape, which the next shorter context shares out among the bytes
that this one has not seen; below the empty context all 256 byte values are alike.  The statistics are
frozen after learning, so every context's probabilities are worked out once, sum to one, and a text's
exact code length in a language is the sum over its bytes.  The language with the shortest code wins;
the score is its share of 2 ** -length among all languages.

With frozen trees, the union of all languages' contexts is one automaton: its state is the longest
known context that the text so far ends with, and a table holds each state's and byte's code length in
every language.  A state depends on `order` bytes only, so texts are cut into pieces that are read side
by side, each after a run-in over the bytes before it; the sums are those of an uncut reading.

The trees are learned from a bounded sample: at most about `sample` labelled rows of each language, by a
hash of the id, read whole.  Tasks count, and the driver gets the contexts that occur at least
LEAST times in the sample, so their number is bounded by the sample's bytes and the languages'.  Texts are
lower-cased before both.

Edge cases: texts that are null or have no letter are und, with score 0, and so is everything if no
language could be learned; rows with null id are scored but not learned from, and are not held out;
null languages are ignored; of languages with equal code lengths the first by name wins; repeated
rows and equal texts get equal results; a text of any length is scored whole, in linear time, by one
task; bytes that no sample had are alike in every language; an empty table gives no rows; other
columns, whatever their names, are kept, and one named like the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, ready, table

ORDER, SAMPLE, LEAST = 3, 2000, 8
NONE = "und"
#: Bytes that a lane reads, and that are read side by side; bytes of the sample that are counted at once.
LANE, BLOCK, COUNTED = 1024, 8 << 20, 4 << 20
FOUND = "struct<lang:string,score:double,bits:array<double>>"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of the lower-cased texts, where each begins and the last ends); a null text is empty."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset :]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, "right")))
        yield low, high
        low = high


def grams(raw: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and next byte as one number, count) of all contexts of exactly this many bytes; none crosses a text's bounds."""
    n = bounds[-1] - bounds[0] - order
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = raw[bounds[0] : bounds[-1]]
    value = np.zeros(n, np.int64)
    for i in range(order + 1):
        value = value << 8 | own[i : i + n]
    # A window that starts less than `order` bytes before a text's end would reach into the next one.
    ends = bounds[1:] - bounds[0]
    whole = np.ones(n + order + 1, bool)
    for i in range(1, order + 1):
        whole[np.maximum(ends - i, 0)] = False
    return np.unique(value[whole[:n]], return_counts=True)


class Trees:
    """Every language's code lengths, as one automaton over the union of their contexts."""

    def __init__(self, counts: dict[str, list[tuple[int, int, list[tuple[int, int]]]]], order: int):
        """counts: for each language (length, context as a number, [(next byte, count)])."""
        self.order, self.languages = order, sorted(counts)
        every = sorted({(length, context) for own in counts.values() for length, context, _ in own} | {(0, 0)})
        number = {x: i for i, x in enumerate(every)}
        used = sorted({b for own in counts.values() for _, _, after in own for b, _ in after})
        # Bytes of the sample have a class each, all others share the last.
        self.classes = np.full(256, len(used), np.int32)
        self.classes[used] = np.arange(len(used))
        alike = np.ones(len(used) + 1)
        alike[-1] = 256 - len(used)
        lengths = np.array([x[0] for x in every])
        rows = [np.flatnonzero(lengths == n) for n in range(order + 1)]
        parent = np.array([number[(n - 1, c & (1 << 8 * (n - 1)) - 1)] if n else 0 for n, c in every])
        self.width = len(alike)
        self.goto = np.zeros((len(every), self.width), np.int32)
        above: list[list[tuple[int, int, int]]] = [[] for _ in range(order + 1)]
        for i, (n, c) in enumerate(every):
            if n:
                above[n - 1].append((number[(n - 1, c >> 8)], int(self.classes[c & 255]), i))
        for n, own in enumerate(rows):
            if n:
                self.goto[own] = self.goto[parent[own]]
            for state, byte, to in above[n]:
                self.goto[state, byte] = to
        self.bits = np.zeros((len(every), self.width, len(self.languages)), np.float32)
        for k, language in enumerate(self.languages):
            seen = np.zeros((len(every), self.width))
            for n, c, after in counts[language]:
                seen[number[(n, c)], self.classes[[b for b, _ in after]]] = [x for _, x in after]
            self.bits[:, :, k] = -np.log2(self._chances(seen, rows, parent, alike))

    @staticmethod
    def _chances(seen: np.ndarray, rows: list[np.ndarray], parent: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """The probability of one byte of each class after each context; a context that a language lacks is its next shorter one."""
        out = np.full(seen.shape, 1 / 256)
        for n, own in enumerate(rows):
            below = out[parent[own]] if n else out[own]
            count = seen[own]
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            rest = (below * alike * (count == 0)).sum(1, keepdims=True)
            escapes = rest > 1e-12
            scale = np.maximum(total + np.where(escapes, kinds, 0), 1)
            shared = np.where(escapes, kinds / scale / np.where(escapes, rest, 1), 0) * below
            out[own] = np.where(total > 0, np.where(count > 0, count / scale, shared), below)
        return out

    def lengths(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Code lengths in bits, a row for each text and a column for each language."""
        n, wide = len(bounds) - 1, len(self.languages)
        if not wide:
            return np.zeros((n, 0))
        sizes = np.diff(bounds)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(n), lanes)
        low = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        size = np.minimum(sizes[text] - low, LANE)
        # The longest lanes first, so that those still at work are always the first ones.
        turn = np.argsort(-size, kind="stable")
        text, low, size = text[turn], low[turn], size[turn]
        start = bounds[text] + low
        state, cost = np.zeros(len(text), np.int64), np.zeros((len(text), wide))
        goto, bits = self.goto.ravel(), self.bits.reshape(-1, wide)
        for back in range(self.order, 0, -1):  # the run-in; a text's first bytes have none
            on = np.flatnonzero(low >= back)
            state[on] = goto[state[on] * self.width + self.classes[raw[start[on] - back]]]
        alive = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        for step, k in enumerate(alive.tolist()):
            at = state[:k] * self.width + self.classes[raw[start[:k] + step]]
            cost[:k] += bits.take(at, 0)
            state[:k] = goto.take(at)
        out = np.zeros((n, wide))
        np.add.at(out, text, cost)
        return out


def learn(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE, least: int = LEAST) -> Trees:
    """Trees from text and lang of the rows that are not held out."""
    ready(docs.sparkSession)
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("roll"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A row for each language.
    shares = sizes.select("lang", (F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * (1 << 30)).alias("most"))
    chosen = usable.join(F.broadcast(shares), "lang").where("roll < most").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang))
                for low, high in blocks(own, COUNTED):
                    raw, bounds = lowered(own.slice(low, high - low))
                    for n in range(order + 1):
                        value, times = grams(raw, bounds, n)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(np.full(len(value), n, np.int32)), pa.array(value >> 8), pa.array((value & 255).astype(np.int32)), pa.array(times)], ["lang", "length", "context", "byte", "n"])

    counted = chosen.mapInArrow(count, "lang string, length int, context long, byte int, n long").groupBy("lang", "length", "context", "byte").agg(F.sum("n").alias("n"))
    trees = counted.groupBy("lang", "length", "context").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("byte", "n"))).alias("after")).where((F.col("all") >= least) | (F.col("length") == 0))
    counts: dict[str, list] = {}
    for r in trees.collect():
        counts.setdefault(r.lang, []).append((r.length, r.context, [(x.byte, x.n) for x in r.after]))
    return Trees(counts, order)


def identified(docs: DataFrame, trees: Trees, name: str = "language") -> DataFrame:
    """docs with the column name: lang, score (0 to 1), and the code lengths in bits, by the languages' order."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(trees)

    def own(texts: pa.Array, letters: pa.Array) -> pa.Array:
        known, rows = shared.value, []
        for low, high in blocks(texts, BLOCK):
            bits = known.lengths(*lowered(texts.slice(low, high - low)))
            if known.languages:
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            for i, good in enumerate(letters.slice(low, high - low).to_pylist()):
                able = good and known.languages
                rows.append({"lang": known.languages[best[i]] if able else NONE, "score": float(score[i]) if able else 0.0, "bits": bits[i].tolist()})
        return pa.array(rows, pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits", pa.list_(pa.float64()))]))

    text = F.col("text").cast("string")
    return docs.select(*columns(docs, name), F.arrow_udf(own, FOUND)(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False))).alias(name))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identified(docs.drop("lang"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
