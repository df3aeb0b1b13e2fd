"""Sharding by histogram sort, in DataFrame operations only.

Documents are ordered by one 63-bit key: bits of the text's hash, then of the id's, then of that of the
row's own number.  Equal texts are neighbours, yet a group of any size, even of equal rows, still has
distinct keys, so no key is hot.  Shards are cut between groups of equal texts; where none ends within
the tolerance of the even cut, a group lies in two shards.
Exact byte counts below a set of probes are taken over all partitions, the probes around every
unsettled splitter are refined, and only when all splitters are within tolerance are the documents
exchanged, once.  The driver sees counts per probe, whose number does not depend on the input.

Edge cases: a null text counts as empty (16 bytes); null ids share one hash; repeated rows, which
tie, keep separate slots; a very long text makes its shard larger by as much; an empty table gives no
rows; fewer documents than shards leave shards empty; an input column named like a result column
(shard, slot) is replaced, all others are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import columns, stage, table

KEY_BITS, FIRST_BITS = 63, 12
TEXT_BITS, ID_BITS = 24, 24
#: Keys of equal texts lie in one range of this size that starts at a multiple of it.
GROUP = 1 << KEY_BITS - TEXT_BITS
OVERHEAD = 16


def _size():
    return F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")) + F.lit(OVERHEAD)


def _key(nth):
    """63 bits: the text's hash, the id's, and that of the row's own number, which tells equal rows apart."""
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - TEXT_BITS), KEY_BITS - TEXT_BITS)
    middle = F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ID_BITS), KEY_BITS - TEXT_BITS - ID_BITS)
    return high.bitwiseOR(middle).bitwiseOR(F.shiftrightunsigned(F.xxhash64(nth), 64 - (KEY_BITS - TEXT_BITS - ID_BITS)))


def _slice(key):
    return F.shiftright(key, KEY_BITS - FIRST_BITS)


def _cell_of(key, bounds):
    """Number of lower bounds at or below the key, less one: the cell inside its slice."""
    return F.size(F.filter(bounds, lambda b: b <= key)) - 1


def _split(low: int, high: int, parts: int) -> list[int]:
    """At most about `parts` bounds inside low to high: at the edges of equal texts' groups while there are any."""
    unit = GROUP if (low | GROUP - 1) < high else 1
    first = -(-(low + 1) // unit) * unit
    step = -(-max(1, -(-(high - low + 1) // parts)) // unit) * unit
    return list(range(first, high + 1, step))


def histogram_cells(keys: DataFrame, n_shards: int, tolerance: float, probes: int, hot_share: int) -> list[tuple[int, int, int]]:
    """[(lower bound, rows, bytes)], in key order: exact counts of cells fine enough to cut at and to sort in one task."""
    spark = keys.sparkSession
    first = keys.groupBy(_slice("key").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    cells = {r.slice << (KEY_BITS - FIRST_BITS): (r.n, r.b, r.lo, r.hi) for r in first}
    rows, total = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
    goal = total / n_shards
    while True:  # every round cuts cells that hold several keys, so it ends
        order = sorted(cells)
        ends = list(accumulate(cells[x][1] for x in order))
        again: dict[int, int] = {}
        for i in range(1, n_shards):
            at = bisect_left(ends, i * goal)
            if at < len(order):
                low = order[at]
                _, size, lo, hi = cells[low]
                if lo < hi and min(ends[at] - i * goal, i * goal - ends[at] + size) > tolerance * goal:
                    again[low] = probes
        for low, (n, _, lo, hi) in cells.items():
            if lo < hi and n > max(1, rows // hot_share):
                again.setdefault(low, 64)
        if not again:
            break
        bounds: dict[int, list[int]] = {}
        for low, parts in again.items():
            _, _, lo, hi = cells.pop(low)
            bounds.setdefault(low >> (KEY_BITS - FIRST_BITS), []).extend([low, *_split(lo, hi, parts)])
        for low in cells:
            if (s := low >> (KEY_BITS - FIRST_BITS)) in bounds:
                bounds[s].append(low)
        for s in bounds:
            for low in bounds[s]:
                cells.pop(low, None)
        probe = spark.createDataFrame([(s, sorted(b)) for s, b in bounds.items()], "slice long, bounds array<long>")
        found = (
            keys.withColumn("slice", _slice("key"))
            .join(F.broadcast(probe), "slice")
            .groupBy("slice", F.element_at("bounds", _cell_of(F.col("key"), F.col("bounds")) + 1).alias("low"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        )
        cells |= {r.low: (r.n, r.b, r.lo, r.hi) for r in found.collect()}
    return [(x, cells[x][0], cells[x][1]) for x in sorted(cells)]


def shard_documents(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002, probes: int = 256, hot_share: int = 256) -> DataFrame:
    """docs with shard (0 to n_shards - 1, near equal in bytes) and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    kept = columns(docs, "shard", "slot")
    # Written once, so that a row's number is the same in every pass.
    rows = docs.select(F.struct(*kept).alias("row"), _size().alias("size"), "text", "doc_id", F.monotonically_increasing_id().alias("nth"))
    rows = stage(rows.select("row", "size", _key("nth").alias("key"), "nth"), "shard-rows")
    cells = histogram_cells(rows.select("key", "size"), n_shards, tolerance, probes, hot_share)
    starts = [0, *accumulate(b for _, _, b in cells)]
    cuts, at = [], 0
    edges = [i for i, (low, _, _) in enumerate(cells) if low % GROUP == 0] + [len(cells)]
    for i in range(1, n_shards):
        goal = i * starts[-1] / n_shards
        while at < len(cells) and abs(starts[at + 1] - goal) <= abs(starts[at] - goal):
            at += 1
        # Between two groups of equal texts, if one such place is as near as the tolerance asks.
        near = bisect_left(edges, at)
        near = min((edges[x] for x in (near - 1, near) if 0 <= x < len(edges)), key=lambda x: abs(starts[x] - goal))
        cuts.append(max(near if abs(starts[near] - goal) <= tolerance * starts[-1] / n_shards else at, cuts[-1] if cuts else 0))
    plan: dict[int, list[tuple[int, int, int]]] = {}
    shard, filled = 0, 0
    for i, (low, n, _) in enumerate(cells):
        while shard < len(cuts) and cuts[shard] <= i:
            shard, filled = shard + 1, 0
        plan.setdefault(low >> (KEY_BITS - FIRST_BITS), []).append((low, shard, filled))
        filled += n
    # At most 2 ** FIRST_BITS rows, with the probes' bounds: a size that does not grow with the input.
    route = spark.createDataFrame([(s, [x[0] for x in c], c) for s, c in plan.items()], "slice long, bounds array<long>, cells array<struct<low:long,shard:int,base:long>>")
    routed = rows.withColumn("slice", _slice("key")).join(F.broadcast(route), "slice")
    routed = routed.select("row", "key", "nth", F.element_at("cells", _cell_of(F.col("key"), F.col("bounds")) + 1).alias("cell"))
    order = Window.partitionBy("cell.low").orderBy("key", F.col("row.doc_id"), "nth")
    return routed.withColumn("rank", F.row_number().over(order)).select("row.*", F.col("cell.shard").alias("shard"), (F.col("cell.base") + F.col("rank") - 1).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", _size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
