"""Toxicity by maximum-scoring segments.

Model: the rate of toxic documents among those that hold a token, with a Dirichlet prior (two classes,
`prior` documents) centred on the token's parent: a word's parent is its longest telling prefix, a
prefix's parent the next shorter one, and the root is the base rate.  A token's score is its
log-odds against the base rate, less a drift that makes ordinary text score below zero.

Scoring: one linear scan finds all maximal scoring segments of a text.  On texts without toxic labels
the best segment of n tokens follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x));
a segment counts with the part of lambda s that exceeds ln(K n / significance).  The sum over all
segments is turned into a probability by a logistic fit on documents that the token counts did not
see.

The model is fitted on a bounded sample: at most about SAMPLE labelled documents, by a hash of the
id, of which a quarter only calibrates.  Counts are made by the executors; the driver gets those
tokens that at least MIN_DOCUMENTS of the sample hold and that speak for toxicity, or have a prefix
that does, so their number is bounded by the sample as well.

Edge cases: null and empty texts have no tokens and get the score of a text without segments; rows
with a null id are scored, not held out, and never training data; labels with null are ignored; without labels
of both classes all scores are 0; repeated rows and equal texts get equal scores; a text of any
length is scanned once, in linear time, by one task; an empty table gives no rows; an input column
named like the result column is replaced, and those of any other name are kept (without_toxic keeps
all of them).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, drop_staged, ready, stage, table, unused
from .encoding import Generations

SAMPLE, MIN_DOCUMENTS, PRIOR, DRIFT = 40_000, 3, 10.0, 1.6
SIGNIFICANCE, THRESHOLD = 0.05, 0.7
PREFIXES = (4, 5, 6, 7)
WORD = re.compile(r"[^\W_]+")
TABLE_ENTRIES = 120_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """The word and its prefixes (marked by a star), longest first."""
    return [word, *[word[:n] + "*" for n in reversed(PREFIXES) if n < len(word)]]


class Model:
    """Token scores and the calibration of their segments."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int, prior: float = PRIOR, drift: float = DRIFT):
        self.drift = drift
        root = (toxic + 1) / (toxic + clean + 2)
        rates: dict[str, float] = {}
        parents: dict[str, float] = {}
        for name in sorted(counts, key=lambda x: (not x.endswith("*"), len(x))):
            a, b = counts[name]
            parents[name] = next((rates[p] for p in features(name.rstrip("*"))[1:] if p in rates), root)
            rates[name] = (a + prior * parents[name]) / (a + b + prior)

        def score(rate: float) -> float:
            """Above zero for a token that speaks for toxicity, else zero: then it counts as drift."""
            return max(0.0, math.log(rate / (1 - rate)) - math.log(root / (1 - root)) - drift)

        # What scores zero below a parent that does so too need not be known.
        self.scores = {x: score(r) for x, r in rates.items() if score(r) or score(parents[x])}
        self.decay, self.scale, self.slope, self.level = 1.0, 1.0, 1.0, 0.0
        self.fitted = toxic > 0 and clean > 0
        self._known = Generations(self._score, TABLE_ENTRIES)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._known = Generations(self._score, TABLE_ENTRIES)

    def _score(self, word: str) -> float:
        """The word's score, or that of its longest known prefix."""
        return next((self.scores[x] for x in features(word) if x in self.scores), 0.0)

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """(tokens, [(score, first token, end)]): all maximal scoring segments, in one pass."""
        words = tokens(text)
        each = list(map(self._known.__getitem__, words))
        return len(words), maximal_segments(np.flatnonzero(np.array(each)).tolist() if each else [], each, self.drift)

    def evidence(self, n: int, found: list[tuple[float, int, int]]) -> float:
        bar = math.log(max(self.scale * max(n, 1) / SIGNIFICANCE, 1e-9))
        return sum(max(0.0, self.decay * s - bar) for s, _, _ in found)

    def probability(self, n: int, found: list[tuple[float, int, int]]) -> float:
        if not self.fitted:
            return 0.0
        x = self.slope * math.log1p(self.evidence(n, found)) + self.level
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))

    def calibrate(self, rows: list[tuple[int, int, list[float]]]) -> None:
        """rows: (label, tokens, segment scores) of documents that the counts did not see."""
        best = np.array([max(s, default=0.0) for y, _, s in rows if y == 0])
        size = np.log([max(n, 1) for y, n, _ in rows if y == 0])
        if len(best) and best.std() > 0:
            # Method of moments for the extreme-value law, the length's part taken off.
            decay = 1.0
            for _ in range(50):
                rest = best - size / decay
                decay = 0.5 * (decay + math.pi / math.sqrt(6) / max(float(rest.std()), 1e-6))
            rest = best - size / decay
            self.decay = decay
            self.scale = math.exp(decay * (float(rest.mean()) - 0.5772156649 / decay))
        x = np.array([math.log1p(self.evidence(n, [(v, 0, 0) for v in s])) for _, n, s in rows])
        y = np.array([float(r[0]) for r in rows])
        self.fitted = self.fitted and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        w = np.zeros(2)
        a = np.stack([x, np.ones(len(x))], 1)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
            w += np.clip(step, -5, 5)
        self.slope, self.level = float(w[0]), float(w[1])


def maximal_segments(places: list[int], each: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, where tokens outside places score -drift and those at places each[i].

    Linear: every held candidate knows the nearest one before it with a lower total, and what lies
    between the two is never looked at again."""
    # Candidates as (low, high, first, end, earlier): the running total before and after each.
    held: list[tuple[float, float, int, int, int]] = []
    total, before = 0.0, -1
    for i in places:
        low = total - drift * (i - before - 1)
        high = low + each[i]
        total, before = high, i
        first = i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= low:
                j = held[j][4]
            if j < 0 or held[j][1] >= high:
                held.append((low, high, first, i + 1, j))
                break
            low, first = held[j][0], held[j][2]
            del held[j:]
    return [(b - a, f, e) for a, b, f, e, _ in held]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_documents: int = MIN_DOCUMENTS) -> Model:
    """A model from labels.toxic of the rows that are not held out."""
    ready(docs.sparkSession)
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "toxic")
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    roll = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = usable.where(roll < int(share * (1 << 20))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0).alias("check"))
    # Bounded by sample: a few dozen bytes for each chosen label.
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            names = list(by[0].keys() | by[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][x] for x in names], pa.int64()), pa.array([by[0][x] for x in names], pa.int64())], ["name", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by[label].update({f for w in set(tokens(text.as_py())) for f in features(w)})
                by[label][""] += 1
                if len(by[0]) + len(by[1]) > TABLE_ENTRIES:
                    yield told()
                    by[0].clear()
                    by[1].clear()
        yield told()

    counted = read.where("not check").select("toxic", "text").mapInArrow(count, "name string, toxic long, clean long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = stage(counted.where((F.col("name") == "") | (F.col("toxic") + F.col("clean") >= min_documents)), "token-counts")
    every = counted.where("name = ''").first()
    toxic, clean = (every.toxic, every.clean) if every else (0, 0)
    # A token can only score if its own rate does, or that of a prefix: the driver needs those tokens alone.
    odds = (toxic + 1) / (clean + 1) * math.exp(DRIFT)
    telling = counted.where((F.col("name") != "") & (F.col("toxic") > F.lit(odds) * F.col("clean")))
    heads = telling.where(F.endswith("name", F.lit("*"))).select(F.col("name").alias("head"))
    stem = F.rtrim("name", F.lit("*"))
    parents = F.filter(F.array(*[F.when(F.length(stem) > n, F.concat(F.substring(stem, 1, n), F.lit("*"))) for n in PREFIXES]), lambda x: x.isNotNull())
    below = counted.select("name", "toxic", "clean", F.explode(parents).alias("head")).join(heads, "head", "left_semi")
    rows = telling.unionByName(below.select("name", "toxic", "clean")).distinct().collect()
    counts = {r.name: (r.toxic, r.clean) for r in rows}
    model = Model(counts, toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.segments(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for s, _, _ in x] for _, x in found], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    model.calibrate([(r.toxic, r.n, r.scores) for r in read.where("check").select("toxic", "text").mapInArrow(segments, "toxic int, n long, scores array<double>").collect()])
    shared.unpersist()
    drop_staged(counted)
    return model


FOUND = "struct<score:double,passages:array<struct<score:double,low:int,high:int>>>"


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with the column name: score (0 to 1) and passages (significant segments as token ranges)."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    def own(texts: pa.Array) -> pa.Array:
        machine = shared.value
        rows = []
        for text in texts:
            n, found = machine.segments(text.as_py())
            good = [{"score": s, "low": a, "high": b} for s, a, b in found if machine.evidence(n, [(s, a, b)]) > 0]
            rows.append({"score": machine.probability(n, found), "passages": good})
        return pa.array(rows, pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("score", pa.float64()), ("low", pa.int32()), ("high", pa.int32())])))]))

    return docs.select(*columns(docs, name), F.arrow_udf(own, FOUND)(F.col("text").cast("string")).alias(name))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least threshold; all columns as they were."""
    (name,) = unused(docs, "toxicity")
    return scored(docs, learn(docs, labels), name).where(F.col(f"{name}.score") < threshold).select(*columns(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"))
