"""Blocks of near vectors, and the pairs of blocks that may hold a pair above a threshold.

The angle between unit vectors is a metric, so for any pivot r the angle of x and y is at least the
difference of their angles to r.  Rows of one nearest pivot are ordered by their angle to it and cut into
blocks, and each block knows the least and the greatest angle to every pivot: two blocks whose ranges
lie further apart for some pivot than the threshold's angle hold no pair, and never meet.  That is
exact; a zero vector, at a right angle to everything, obeys the same bound."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .vectors import units

PIVOTS = 16
#: Rows of a group that are read for its pivots, on average.
SAMPLED = 64
#: Angles are told apart from here on; rounding of their cosines is far below.
SLACK = 1e-6


def with_angles(rows: DataFrame, sizes: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """rows (g, k, u, ...) of groups whose n sizes tells, with angles to the group's pivots, nearest and least."""
    own = rows.join(sizes.select("g", "n"), "g")
    roll = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 40))
    # About SAMPLED different keys of each group, and no fewer than one: the least of all is always there.
    some = own.where(roll < F.lit(float((1 << 40) * SAMPLED)) / F.col("n")).groupBy("g", roll.alias("roll")).agg(F.min("u").alias("u"))
    few = some.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("roll", "u"))), 1, pivots).alias("few"))
    least = own.groupBy("g").agg(F.min(F.struct(roll.alias("roll"), "u"))["u"].alias("first"))
    chosen = least.join(few, "g", "left").select("g", F.coalesce(F.transform("few", lambda x: x["u"]), F.array("first")).alias("pivots"))

    def angles(groups: pa.Array, vectors: pa.Array, around: pa.Array) -> pa.Array:
        unit, places = units(pa.chunked_array([vectors])), {}
        for i, g in enumerate(groups.to_pylist()):
            places.setdefault(g, []).append(i)
        out: list[list[float]] = [[]] * len(vectors)
        for at in places.values():
            own = np.array(around[at[0]].as_py(), float)
            size = np.linalg.norm(own, axis=1, keepdims=True)
            found = np.arccos(np.clip(unit[at] @ (own / np.where(size == 0, 1, size)).T, -1, 1))
            for i, row in zip(at, found.tolist(), strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.float64()))

    placed = own.join(chosen, "g").withColumn("angles", F.arrow_udf(angles, "array<double>").asNondeterministic()("g", "u", "pivots")).drop("pivots", "n")
    return placed.withColumn("least", F.array_min("angles")).withColumn("nearest", F.array_position("angles", F.col("least")))


def celled(rows: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """rows, written once, with block: runs of at most block_rows of one group and nearest pivot, in the order of their angle to it."""
    placed = numbered(with_angles(rows, sizes), "g", "nearest", "least", "k", name="place")
    first = placed.groupBy(F.col("g").alias("of_g"), F.col("nearest").alias("of_nearest")).agg(F.min("place").alias("first"))  # PIVOTS rows for each group
    met = placed.join(first, (F.col("g") == F.col("of_g")) & (F.col("nearest") == F.col("of_nearest")))
    return met.withColumn("block", F.col("first") + F.floor((F.col("place") - F.col("first")) / block_rows)).drop("place", "nearest", "least", "first", "of_g", "of_nearest")


def meeting(blocks: DataFrame, low: float) -> DataFrame:
    """(g, p, q), p <= q: the pairs of one group's blocks that may hold a cosine above low.  A row for each block is compared with its group's."""
    ranges = blocks.select("g", "block", F.posexplode("angles").alias("pivot", "angle")).groupBy("g", "block", "pivot").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    ranges = ranges.groupBy("g", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pivot", "lo", "hi"))), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("r"))
    there = ranges.select("g", F.col("block").alias("q"), F.col("r").alias("s"))
    there = there.toDF(*there.columns)
    both = ranges.withColumnRenamed("block", "p").join(there, "g").where("p <= q")
    apart = F.array_max(F.zip_with("r", "s", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"])))
    return both.where(apart <= math.acos(max(-1.0, min(1.0, low))) + SLACK).select("g", "p", "q")
