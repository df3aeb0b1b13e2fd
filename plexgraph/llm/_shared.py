"""Plumbing the training-data operators share: staging, column names, joins that deal hot keys to several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop, drop_staged, shared_folder, stage, staged_path
from ..workers import ready

__all__ = ["CRC_TABLE_SQL", "columns", "crc32_sql", "drop", "drop_staged", "hot_keys", "lower_ascii", "ready", "shared_folder", "spread_join", "stage", "staged_path", "table", "tokenizer_file", "unused"]

#: Where the public tokenizer vocabularies lie; a parameter of every operator that tokenizes.
BYTE_BPE = "byte_bpe_50k.json"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, *left_out: str) -> list[Column]:
    """df's columns, whatever signs their names hold, without those left out."""
    names = {x.lower() for x in left_out}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]


#: Rows of one key that a task may get in a join, at least; beyond it, and beyond this part of all rows, a key is dealt to several tasks.
HOT_ROWS, HOT_PARTS = 1 << 16, 512


def hot_keys(counts: DataFrame, key: Column, total: int, least: int = HOT_ROWS, parts: int = HOT_PARTS) -> list[tuple[int, int]]:
    """(key, tasks to deal it to) of the keys (a long) with more rows (column n of counts) than least and than the total's share of a part: fewer than `parts` keys."""
    bound = max(least, total // parts)
    if total <= bound:
        return []
    return [(r[0], -(-r[1] // bound)) for r in counts.where(F.col("n") > bound).select(key, "n").collect()]


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: Column, hot: list[tuple[int, int]], how: str) -> DataFrame:
    """many joined with one on keys; rows of a hot key (by is its column on both sides) are dealt to several tasks, and one's row of it goes to each."""
    if not hot:
        return many.join(one, keys, how)
    tasks = F.broadcast(many.sparkSession.createDataFrame(hot, "__by long, __tasks int"))
    left = many.join(tasks, by == F.col("__by"), "left").withColumn("__salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), "__tasks"), F.lit(0)).cast("int")).drop("__by", "__tasks")
    right = one.join(tasks, by == F.col("__by"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1))).drop("__by", "__tasks")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokenizer_file(path: str | None) -> str:
    """path, or else the installed public byte-level BPE vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


#: A DuckDB table t of CRC-32's steps for each byte, by its definition: eight shifts each.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(list_reduce(list_prepend(byte, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY byte) AS t
  FROM (SELECT CAST(range AS BIGINT) AS byte FROM range(256))
)"""


def crc32_sql(hexed: str) -> str:
    """DuckDB SQL for the CRC-32 of bytes given by their hex digits, where crc_table's t is at hand."""
    each = f"list_transform(range(CAST(length({hexed}) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS INTEGER) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
