"""Chunk vectors: upsert, delete, exact top-k and batched ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector_math import cosine
from .scope import in_scope

KEY = ["source_id", "chunk_idx"]
#: Rows of a block: two of them make one matrix product of 32 MB.
BLOCK_ROWS = 2048


def upsert_chunks(state: DataFrame, batch: DataFrame) -> DataFrame:
    """A row replaces that of its key; of several new ones the greatest text stays."""
    new = batch.groupBy(*KEY).agg(F.max_by(F.struct(*state.columns), "text").alias("row")).select("row.*")
    return state.join(batch.select(*KEY).distinct(), KEY, "left_anti").select(*state.columns).unionByName(new)


def delete_chunks(state: DataFrame, source_id: str | None = None, collection: str | None = None) -> DataFrame:
    if source_id is not None:
        state = state.where(~F.col("source_id").eqNullSafe(F.lit(source_id)))
    return state if collection is None else state.where(~F.col("collection").eqNullSafe(F.lit(collection)))


def top_k(vectors: DataFrame, query: list[float], k: int = 12, scope: list[str] | None = None, vector: str = "embedding", key: tuple[str, ...] = ("source_id", "chunk_idx")) -> DataFrame:
    """The k rows of greatest cosine, ties by key: a distributed top-k, no global sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return in_scope(vectors, scope).withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), *key).limit(k)


def batched_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k of many queries: a stated query set against all rows, block by block.

    Each pair of blocks (rows, queries) is one matrix product that keeps k for each query; then the blocks'
    are ranked.  Ranks follow the full score, ties the lesser key; the score shown has six digits."""
    kind, asks = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    rows = blocked(vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("u")), "key", block_rows)
    asked = blocked(queries.select(F.col(query_key).alias("query"), F.col(vector).cast("array<double>").alias("q")), "query", block_rows)
    left = rows[0].withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(asked[1] - 1)))).groupBy("block", "team")
    right = asked[0].withColumnRenamed("block", "team").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(rows[1] - 1)))).groupBy("block", "team")

    def search(have: pa.Table, ask: pa.Table) -> pa.Table:
        names, numbers = have.column("key").combine_chunks(), ask.column("query").combine_chunks()
        if not len(names) or not len(numbers):
            return pa.table({"query": numbers.slice(0, 0), "key": names.slice(0, 0), "score": pa.array([], pa.float64())})
        score = units(ask.column("q")) @ units(have.column("u")).T
        score[np.equal.outer(np.array(numbers.to_pylist(), object), np.array(names.to_pylist(), object))] = -np.inf
        bound = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)]
        q, r = np.nonzero((score >= bound[:, None]) & (score > -np.inf))
        return pa.table({"query": numbers.take(pa.array(q)), "key": names.take(pa.array(r)), "score": pa.array(score[q, r])})

    found = left.cogroup(right).applyInArrow(search, f"query {asks}, key {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_key), "rank", F.col("key").alias(key), F.round("score", 6).alias("score"))


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)


def units(column: pa.ChunkedArray) -> np.ndarray:
    """Rows as unit vectors; a zero one stays zero."""
    flat = doubles(column)
    size = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(size == 0, 1, size)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows of x and y, summed in the order of their components: to the last bit those of vector_math and of SQL."""
    dot = lambda a, b: sum((a[:, k] * b[:, k] for k in range(a.shape[1])), np.zeros(len(a)))
    size = [np.sqrt(dot(a, a)) for a in (x, y)]
    return dot(x, y) / (np.where(size[0] == 0, 1, size[0]) * np.where(size[1] == 0, 1, size[1]))


def blocked(df: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """df with block, and the number of blocks: as many as its rows need."""
    n = max(1, -(-df.count() // block_rows))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def count_chunks(vectors: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return in_scope(vectors, scope).groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"))


def source_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select("source_id").distinct()
