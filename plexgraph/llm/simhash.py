"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within radius / 2 bits of both, so every
distinct fingerprint emits its whole ball of half the radius and fingerprints that meet on a variant
are linked: by the triangle inequality such a meeting is itself the proof, and each variant's
owners are linked to their least one, never pair by pair.  A fingerprint travels once for each
bucket (leading bits) that its ball touches; the variants are made, sorted and compared inside the
bucket, in slices of bounded size, so they are never stored or shuffled.

Edge cases: null or blank texts have fingerprint zero and are linked like any other; texts of fewer
words than a shingle hash the whole sequence; a text of any length is hashed whole by one task, in
parts; a bit that exactly half of the hashes set is 0; repeated rows and equal texts share a
fingerprint and are one node; a null id belongs to its component but names it only if it has no other
id; an empty table gives no rows; an input column named like a result column (fp, component_id) is
replaced, all others are kept, and keep_one keeps every column.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import columns, drop_staged, hot_keys, ready, spread_join, stage, table

SHINGLE, RADIUS, SEED = 4, 4, 42
BITS = 64
#: Variants that a bucket holds on average, and at most at once.
BUCKET_VARIANTS, SLICE_VARIANTS = 4_000_000, 6_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        said = [b" ".join(words)]
    else:
        said = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), said), np.uint64, max(1, len(words) - shingle + 1))
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), 65_536):
        some = hashes[low : low + 65_536]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with fp, a signed 64-bit fingerprint."""
    ready(docs.sparkSession)

    def own(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), shingle, seed) for x in texts], pa.int64())

    return docs.withColumn("fp", F.arrow_udf(own, "long")(F.col("text").cast("string")))


def flips(bits: int, most: int) -> np.ndarray:
    """All masks with up to `most` of the lowest `bits` bits set."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def _meetings(values: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """[(least owner, other owner)] of each value that several owners share."""
    ordered = np.sort(values)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros((0, 2), np.int64)
    mark = np.zeros(1 << 20, bool)
    spread = np.uint64(0x9E3779B97F4A7C15)
    mark[(shared * spread) >> np.uint64(44)] = True
    maybe = np.flatnonzero(mark[(values * spread) >> np.uint64(44)])
    at = np.searchsorted(shared, values[maybe])
    maybe = maybe[shared[np.minimum(at, len(shared) - 1)] == values[maybe]]
    order = maybe[np.lexsort((owners[maybe], values[maybe]))]
    value, owner = values[order], owners[order]
    head = np.r_[True, value[1:] != value[:-1]]
    least = owner[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
    pairs = np.stack([least, owner], 1)[least != owner]
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def links(prints: np.ndarray, bucket: int, prefix: int, half: int = RADIUS // 2) -> np.ndarray:
    """Links among prints that meet on a variant whose leading `prefix` bits are `bucket`."""
    low = BITS - prefix
    used = np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(bucket)) if prefix else np.zeros(len(prints), np.int64)
    prints, used = prints[used <= half], used[used <= half]
    if len(prints) < 2:
        return np.zeros((0, 2), np.int64)
    sizes = [int((used == n).sum()) * len(flips(low, half - n)) for n in range(half + 1)]
    if sum(sizes) > SLICE_VARIANTS and prefix < BITS - 8:
        return np.concatenate([links(prints, bucket << 4 | x, prefix + 4, half) for x in range(16)])
    values, owners = [], []
    tail = prints & np.uint64((1 << low) - 1)
    for n in range(half + 1):
        own = np.flatnonzero(used == n)
        masks = flips(low, half - n)
        values.append((tail[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(prints[own].view(np.int64), len(masks)))
    return _meetings(np.concatenate(values), np.concatenate(owners))


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among the distinct fingerprints of prints (column fp); their closure is that of all pairs within radius bits."""
    ready(prints.sparkSession)
    half = radius // 2
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even")
    ball = len(flips(BITS, half))
    n = prints.count()
    prefix = max(8, int(np.ceil(np.log2(max(1, n * ball / BUCKET_VARIANTS)))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = flips(prefix, half)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bucket = ((own >> np.uint64(BITS - prefix))[:, None] ^ near[None, :]).ravel()
            order = np.argsort(bucket, kind="stable")
            bucket, own = bucket[order], np.repeat(own, len(near))[order]
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int64)), pa.array([x.tobytes() for x in np.split(own, heads[1:])] if len(heads) else [], pa.binary())], ["bucket", "prints"])

    def met(key: tuple, group: pa.Table) -> pa.Table:
        own = np.unique(np.frombuffer(b"".join(x.as_py() for x in group.column("prints")), np.uint64))
        found = links(own, key[0].as_py(), prefix, half)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return prints.select("fp").mapInArrow(dealt, "bucket long, prints binary").groupBy("bucket").applyInArrow(met, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node's least connected node, by alternating large and small stars.

    Every round is staged in the shared folder, and the round before it deleted; a node of very many
    links is dealt to several tasks."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both, least, ["a"], F.col("a"), hot_keys(least, F.col("a"), total), "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, low, ["a"], F.col("a"), hot_keys(low, F.col("a"), total), "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, now = now, stage(small, "links")
        drop_staged(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)


def _placed(known: DataFrame, radius: int) -> DataFrame:
    """Staged rows (with fp and doc_id) with __root, the component's least fingerprint, and component_id.

    A fingerprint that very many rows share is dealt to several tasks."""
    prints = stage(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    root = components(ball_links(prints, radius))
    placed = prints.join(root, prints["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("__root"))
    named = placed.groupBy("__root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    rows, distinct = prints.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    of_print = spread_join(placed, named.drop("n"), ["__root"], F.col("__root"), hot_keys(named, F.col("__root"), distinct), "inner").select("fp", "__root", "component_id")
    return spread_join(known, of_print, ["fp"], F.col("fp"), hot_keys(prints, F.col("fp"), rows), "inner")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, text: bool = True) -> DataFrame:
    """docs (without text, where that is false, so that no text is moved) with fp and component_id, the smallest doc_id that links reach."""
    kept = columns(docs, "fp", "component_id", *([] if text else ["text"]))
    known = fingerprints(docs.select(F.struct(*kept).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, seed).drop("text")
    out = _placed(stage(known, "fingerprints"), radius).select("__row", F.col("fp").alias("__fp"), F.col("component_id").alias("__id"))
    return out.select("__row.*", F.col("__fp").alias("fp"), F.col("__id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One document of each component with all of docs' columns: the one whose id names it (any, where no document has an id); of several such rows that of the least text hash.

    Texts are shuffled once, by a number of their own, to meet the numbers that stay."""
    rows = docs.select(F.struct(*columns(docs)).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__nth"))
    known = stage(fingerprints(rows, shingle, seed).drop("text"), "fingerprints")
    placed = _placed(known.select("doc_id", "fp", "__hash", "__nth"), radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = placed.groupBy("__root").agg(F.min(F.struct("__hash", "__nth")).alias("least")).select(F.col("least.__nth").alias("__nth"))
    return known.join(stay, "__nth", "left_semi").select("__row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
