"""Entity resolution: equal keys, similar vectors, blacklists and merge plans, one collection at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..staging import stage
from ..workers import ready
from .cells import celled, meeting
from .graph import add_aliases, both_ways, contexts, degrees, merge_entities, resolve_merges
from .vectors import BLOCK_ROWS, cosines, doubles, units

#: No cosine of a matrix product is further from the one summed in the order of the components.
NOISE = 1e-10


def canonical_blacklist(blacklist: DataFrame) -> DataFrame:
    return blacklist.select("collection", F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("hi")).distinct()


def not_blacklisted(pairs: DataFrame, blacklist: DataFrame | None, a: str = "keep", b: str = "drop") -> DataFrame:
    if blacklist is None:
        return pairs
    own = pairs.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    return own.join(canonical_blacklist(blacklist), ["collection", "lo", "hi"], "left_anti").select(*pairs.columns)


def add_blacklist(blacklist: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows whose pair, in either order, is already there are ignored."""
    new = batch.select("collection", F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b"), "reason").groupBy("collection", "node_a", "node_b").agg(F.min("reason").alias("reason"))
    fresh = new.withColumn("lo", F.col("node_a")).withColumn("hi", F.col("node_b")).join(canonical_blacklist(blacklist), ["collection", "lo", "hi"], "left_anti")
    return blacklist.unionByName(fresh.select(*blacklist.columns))


def remove_blacklist(blacklist: DataFrame, batch: DataFrame) -> DataFrame:
    own = blacklist.withColumn("lo", F.least("node_a", "node_b")).withColumn("hi", F.greatest("node_a", "node_b"))
    return own.join(canonical_blacklist(batch), ["collection", "lo", "hi"], "left_anti").select(*blacklist.columns)


def normalized_duplicates(entities: DataFrame, relations: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """(collection, keep, drop) within groups of equal keys: keep is the best connected, then shorter, then greater name."""
    keyed = entities.select("collection", "name", name_key(F.col("name")).alias("key")).where("key <> ''").join(degrees(relations), ["collection", "name"], "left")
    best = keyed.groupBy("collection", "key").agg(F.max_by("name", F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.length("name")).alias("l"), F.col("name").alias("n"))).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = keyed.join(best, ["collection", "key"]).where("name <> keep").select("collection", "keep", F.col("name").alias("drop"))
    return not_blacklisted(pairs, blacklist)


def similar_pairs(vectors: DataFrame, low: float, high: float | None = None, key: str = "name", vector: str = "vector", group: str | None = "collection", apart: str | None = None, block_rows: int = BLOCK_ROWS, digits: int | None = None) -> DataFrame:
    """Pairs a < b of one group with low < cosine (<= high), of different values of apart if given: exact.

    With digits the cosine is rounded to that many places first, half away from zero, and the bounds hold for what
    is then shown.  Where the order of a sum may tell the last place, it is that of the components, as in SQL.

    A group of more than block_rows rows is cut into blocks of near vectors (cells.py); a row goes to the
    cells where its block meets another that may hold a pair with it, and a cell is one matrix product, so
    a large group is spread over many tasks and most of a clustered one's cells are never made."""
    ready(vectors.sparkSession)
    places = 0.0 if digits is None else 10.0**digits
    shown, slack = F.col("score") if digits is None else F.round(F.col("score") * places) / places, 0.0 if digits is None else 10.0**-digits
    within = (shown > low) if high is None else (shown > low) & (shown <= high)
    low, high = low - slack, None if high is None else high + slack  # what may round into the bounds
    own = vectors.select(*([F.col(group).alias("g")] if group else [F.lit("").alias("g")]), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("u"), *([F.col(apart).cast("string").alias("x")] if apart else []))
    sizes = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # A group of one block is one cell; larger ones lie in blocks of near vectors, and only those meet that may hold a pair.
    many = sizes.where(F.col("n") > block_rows)
    single = own.join(sizes.where(F.col("n") <= block_rows).select("g"), "g", "left_semi").withColumn("p", F.lit(-1).cast("long")).withColumn("q", F.lit(-1).cast("long"))
    if many.isEmpty():
        left, right = single, single.where("false")
    else:
        blocks = celled(own.join(many.select("g"), "g", "left_semi"), many, block_rows)
        pairs = stage(meeting(blocks, low), "cell-pairs")
        rows = blocks.drop("angles")
        left = single.unionByName(rows.withColumnRenamed("block", "p").join(pairs, ["g", "p"]))
        right = rows.withColumnRenamed("block", "q").join(pairs.where("p < q"), ["g", "q"])
    right = right.toDF(*right.columns)  # columns of its own, not those of left
    kinds = [own.schema[c].dataType.simpleString() for c in ("g", "k")]

    def cell(here: pa.Table, there: pa.Table) -> pa.Table:
        inner = here.num_rows and here.column("p")[0].as_py() == here.column("q")[0].as_py()
        there = here if inner else there
        names = [x.column("k").combine_chunks() for x in (here, there)]
        if not here.num_rows or not there.num_rows:
            i = j = score = np.zeros(0, np.int64)
        else:
            score = units(here.column("u")) @ units(there.column("u")).T
            good = score > low if high is None else (score > low) & (score <= high)
            if inner:
                good &= np.triu(np.ones(score.shape, bool), 1)
            if apart:
                good &= np.not_equal.outer(*[np.array(x.column("x").to_pylist(), object) for x in (here, there)])
            i, j = np.nonzero(good)
            score = score[i, j]
            if digits is not None:
                near = np.flatnonzero(np.abs(score * places % 1 - 0.5) <= places * NOISE)
                score[near] = cosines(doubles(here.column("u"))[i[near]], doubles(there.column("u"))[j[near]])
        groups = (here if here.num_rows else there).column("g").combine_chunks()
        return pa.table({"g": groups.take(pa.array(np.zeros(len(i), np.int64))), "a": names[0].take(pa.array(i)), "b": names[1].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    met = left.groupBy("g", "p", "q").cogroup(right.groupBy("g", "p", "q")).applyInArrow(cell, f"g {kinds[0]}, a {kinds[1]}, b {kinds[1]}, score double").where("a <> b")
    if digits is not None:
        met = met.where(within).withColumn("score", shown)
    return met.select(*([F.col("g").alias(group)] if group else []), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def merge_candidates(vectors: DataFrame, relations: DataFrame, threshold: float = 0.92, blacklist: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(collection, keep, drop, score) above threshold; keep is the best connected, then shorter, then lesser name."""
    return not_blacklisted(_kept(similar_pairs(vectors, threshold, digits=digits), relations), blacklist)


def _kept(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    d = degrees(relations)
    of = lambda c: d.select("collection", F.col("name").alias(c), F.col("degree").alias(f"d{c}"))
    both = pairs.join(of("a"), ["collection", "a"], "left").join(of("b"), ["collection", "b"], "left")
    rank = lambda c: F.struct((-F.coalesce(f"d{c}", F.lit(0))).alias("d"), F.length(c).alias("l"), F.col(c).alias("n"))
    first = rank("a") < rank("b")
    return both.select("collection", F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"), "score")


def review_candidates(vectors: DataFrame, entities: DataFrame, relations: DataFrame, low: float = 0.80, high: float = 0.92, blacklist: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The band between the thresholds, with both contexts, best first."""
    pairs = not_blacklisted(_kept(similar_pairs(vectors, low, high, digits=digits), relations), blacklist)
    told = contexts(entities, relations)
    of = lambda c: told.select("collection", F.col("name").alias(c), F.struct("description", "lines", "n_relations").alias(f"{c}_context"))
    return pairs.join(of("keep"), ["collection", "keep"], "left").join(of("drop"), ["collection", "drop"], "left").select("collection", "keep", "drop", "score", "keep_context", "drop_context").orderBy(F.desc("score"), "collection", "keep", "drop")


def bridge_candidates(vectors: DataFrame, bridges: DataFrame, threshold: float = 0.90, block_rows: int = BLOCK_ROWS, digits: int | None = None) -> DataFrame:
    """Pairs of different collections above threshold that no bridge joins; vectors: collection, name, vector."""
    own = vectors.select(F.struct("collection", "name").alias("k"), F.col("vector"), "collection")
    pairs = similar_pairs(own, threshold, key="k", group=None, apart="collection", block_rows=block_rows, digits=digits)
    flat = pairs.select(F.col("a.collection").alias("collection"), F.col("a.name").alias("name"), F.col("b.collection").alias("other_collection"), F.col("b.name").alias("other_name"), "score")
    return flat.join(both_ways(bridges), ["collection", "name", "other_collection", "other_name"], "left_anti")


def apply_merges(entities: DataFrame, relations: DataFrame, bridges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph after all pairs (collection, keep, drop): chains followed to their end, each dropped name an alias of what stays."""
    plan = resolve_merges(pairs)
    surface = plan.select("collection", F.col("keep").alias("name"), F.col("drop").alias("alias"))
    return merge_entities(add_aliases(entities, surface), relations, bridges, plan)


def review_decisions(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merges, blacklist rows) of decided: collection, keep, drop, approved, reason."""
    return decided.where("approved").select("collection", "keep", "drop"), decided.where("not approved").select("collection", F.col("keep").alias("node_a"), F.col("drop").alias("node_b"), "reason")


def apply_review(entities: DataFrame, relations: DataFrame, bridges: DataFrame, blacklist: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The graph with the approved merges, and the blacklist with the rejected pairs."""
    merges, rejected = review_decisions(decided)
    return *apply_merges(entities, relations, bridges, merges), add_blacklist(blacklist, rejected)
