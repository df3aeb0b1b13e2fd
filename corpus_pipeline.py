"""A training-data pipeline: five of the operators, each on what its predecessor kept.

Every stage is (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet in the shared
folder and read again as the next stage's docs, so a lost executor costs a stage's tasks at most.

toxicity       documents that score 0.7 or more go
simhash        one document of each near-duplicate component stays, that of the smallest id
substrings     bytes of 200-byte strings that start more than once go
decontaminate  benchmark windows go; a document that is mostly such windows goes whole
packing        ids in sequences of 1024, one row for each piece

Edge cases: a null or empty text passes all stages (null and blank texts are near duplicates of each
other, so one of them stays) and is packed as its end id; rows with a null id are judged like others,
and are near duplicates by their texts; repeated rows and equal texts count once after the second
stage; of rows that tie there, the least id stays, then the least text hash; a very long text is
handled whole by one task in each stage; columns of any other name, those of the stages' own results
included, are kept up to the last stage; an empty documents table gives no pieces, an empty labels or
benchmark table removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexgraph.llm import decontaminate, packing, simhash, substrings, toxicity
from plexgraph.llm._shared import drop_staged, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substrings", cut_repeats), ("decontaminate", cut_benchmark), ("packing", pack)]

#: The stages' models, fingerprints and ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
