"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots (largest inner product first).  Rows are
indexed in blocks; a block's inverted file lists, for each pivot, the rows that have it among their
`row_pivots` nearest and its place there.  A query reads the lists of its own `query_pivots` nearest
pivots, which yields every row's footrule distance over them, takes the share of a block's rows with
the least distances (the same share at every size, 2 k rows of a block at least) and all whose order
is almost its own, and ranks these by the exact inner product.

The file is divided by rows, not by pivots: vectors without clusters need lists that hold a fifth of
all rows and more (of 51,282 vectors, 16 lists of 1024 hold 20 % of the rows and 85 % of the true
neighbours), so lists that lie with their pivot would move most of the index once for each query,
while here a query moves once for each block.  Both ways the work grows with queries x rows.

Equal vectors are indexed once with their smallest ids, as no more than k of a group can be among
k neighbours; so a vector that a third of all rows share is one row of the index.  The pivots are
a bounded sample of distinct vectors; every row is indexed.  Queries visit blocks in a join on the
block, both sides dealt in groups of bounded size; nothing is broadcast but the pivots.

Recall against brute force is measured by tests (0.9 at least); scores are exact.

Edge cases: null, zero and empty vectors and those with null or non-finite components take no part,
nor do rows with a null id or a width other than the most common one; repeated rows of one id are
one candidate; fewer candidates than k give fewer rows; ties go to the smaller id; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import ready, stage, table

PIVOTS, ROW_PIVOTS, QUERY_PIVOTS = 1024, 256, 64
SHARE, ALIKE = 0.1, 0.15
BLOCK_ROWS, QUERY_ROWS = 16_384, 16_384
K = 20


class Pivots:
    def __init__(self, vectors: np.ndarray, row_pivots: int = ROW_PIVOTS, query_pivots: int = QUERY_PIVOTS):
        self.vectors = vectors
        self.row_pivots, self.query_pivots = min(row_pivots, len(vectors)), min(query_pivots, len(vectors))

    def order(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """Each vector's n nearest pivots, nearest first."""
        near = vectors @ self.vectors.T
        return np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)


class Block:
    """Rows with their inverted file."""

    def __init__(self, vectors: np.ndarray, pivots: Pivots):
        self.vectors, self.pivots = vectors, pivots
        near = np.concatenate([pivots.order(vectors[a : a + 2048], pivots.row_pivots) for a in range(0, len(vectors), 2048)])
        flat = near.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows = (by // near.shape[1]).astype(np.int32)
        self.places = (by % near.shape[1]).astype(np.int32)
        self.starts = np.searchsorted(flat[by], np.arange(len(pivots.vectors) + 1))

    def distances(self, near: np.ndarray) -> np.ndarray:
        """Footrule distances of all rows over a query's pivots; a pivot that a row lacks has the last place."""
        last = self.pivots.row_pivots
        out = np.full(len(self.vectors), int(np.abs(last - np.arange(len(near))).sum()), np.int32)
        for rank, pivot in enumerate(near.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            out[self.rows[a:b]] += np.abs(self.places[a:b] - rank) - abs(last - rank)
        return out

    def candidates(self, near: np.ndarray, share: float, least: int, alike: float) -> np.ndarray:
        n = max(least, int(share * len(self.vectors)))
        if n >= len(self.vectors):
            return np.arange(len(self.vectors))
        far = self.distances(near)
        bound = max(int(np.partition(far, n)[n]), int(alike * len(near) * self.pivots.row_pivots))
        return np.flatnonzero(far <= bound)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec of the rows that take part."""
    value = F.col("vec")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & value.isNotNull() & (F.size("vec") > 0))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(finite & F.exists(value, lambda x: x != 0))
    width = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("vec") == (width.n if width else 0))


def nearest(
    vectors: DataFrame, query_ids, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, row_pivots: int = ROW_PIVOTS, query_pivots: int = QUERY_PIVOTS,
    share: float = SHARE, alike: float = ALIKE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of largest inner product found for every row whose id satisfies query_ids(column)."""
    spark = vectors.sparkSession
    ready(spark)
    rows = stage(usable(vectors, id_col, vector_col).distinct(), "vectors")
    # One row of the index for each distinct vector: k + 1 ids, as a query is no neighbour of itself.
    # A group of any size is summed up in 64 parts first.
    halves = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64))).groupBy("vec", "part").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    distinct = halves.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).withColumn("spread", F.xxhash64("vec"))
    index = stage(distinct, "index")
    n = index.count()
    queries = rows.where(query_ids(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r.vec for r in index.orderBy("spread").select("vec").limit(pivots).collect()])
    shared = spark.sparkContext.broadcast(Pivots(sample, row_pivots, query_pivots))
    blocks = max(1, -(-n // block_rows))
    groups = max(1, -(-queries.count() // query_rows))
    dealt = index.select(F.pmod("spread", F.lit(blocks)).cast("int").alias("block"), "vec", "ids")
    # A block meets every group of queries: both sides are copied to the cells of the grid of blocks and groups.
    left = dealt.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("block", "team")
    right = queries.withColumn("team", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block", "team")

    def search(have: pa.Table, ask: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not have.num_rows or not ask.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})

        def matrix(column: pa.ChunkedArray) -> np.ndarray:
            return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), -1)

        block = Block(matrix(have.column("vec")), shared.value)
        ids = have.column("ids").to_pylist()
        asked, vec = ask.column("query_id").to_pylist(), matrix(ask.column("q"))
        near = shared.value.order(vec, shared.value.query_pivots)
        out: list[tuple[int, int, float]] = []
        for q, v, order in zip(asked, vec, near, strict=True):
            at = block.candidates(order, share, 2 * k, alike)
            score = block.vectors[at] @ v
            if len(at) > k + 1:
                bound = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                # A rounding's width below, so that ties in another order of summation stay in.
                keep = score >= bound - 1e-9 * max(1.0, abs(bound))
                at = at[keep]
            exact = [(float(np.sum(block.vectors[i] * v)), i) for i in at.tolist()]
            best = sorted((-s, x) for s, i in exact for x in ids[i] if x != q)[:k]
            out += [(q, x, -s) for s, x in best]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = left.cogroup(right).applyInArrow(search, "query_id long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast(T.IntegerType()).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.far")).alias("score"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
