"""Collections: the wall between them, and the tree above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_staged, stage


def in_scope(df: DataFrame, scope: list[str] | None, column: str = "collection") -> DataFrame:
    """None is all collections, a list those named; an empty list is none."""
    return df if scope is None else df.where(F.col(column).isin(*scope)) if scope else df.where(F.lit(False))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(collection, descendant) for every collection and all below it, itself included.

    Path doubling: each round joins the closure with itself, so a chain of n levels takes about
    log2 n rounds; cycles end when a round adds nothing."""
    edges = hierarchy.where("parent is not null").select(F.col("parent").alias("collection"), F.col("collection").alias("descendant")).distinct()
    every = hierarchy.select("collection").unionByName(hierarchy.where("parent is not null").select(F.col("parent").alias("collection"))).distinct()
    reach = edges.unionByName(every.select("collection", F.col("collection").alias("descendant"))).distinct()
    n, before = -1, None
    while True:
        reach = stage(reach, "descendants")
        if before is not None:
            drop_staged(before)
        now = reach.count()
        if now == n:
            return reach
        n, before = now, reach
        step = reach.alias("a").join(reach.alias("b"), F.col("a.descendant") == F.col("b.collection")).select("a.collection", "b.descendant")
        reach = reach.unionByName(step).distinct()


def descendants_of(hierarchy: DataFrame, collection: str) -> list[str]:
    """One collection and all below it; an unknown one is alone.  Level by level, so only what is below is read."""
    seen, level = [collection], [collection]
    while level:
        below = [r[0] for r in hierarchy.where(F.col("parent").isin(*level)).select("collection").distinct().orderBy("collection").collect()]
        level = [x for x in below if x not in seen]
        seen += level
    return seen


def expand_scope(hierarchy: DataFrame, names: str | None) -> list[str] | None:
    """A comma-separated list with all descendants, each once, in order; nothing given is all."""
    out: list[str] = []
    for name in (x.strip() for x in (names or "").split(",")):
        if name:
            out += [x for x in descendants_of(hierarchy, name) if x not in out]
    return out or None


def set_parent(hierarchy: DataFrame, collection: str, parent: str) -> DataFrame:
    """One parent for each collection; refuses itself and its own descendants."""
    if parent == collection or parent in descendants_of(hierarchy, collection):
        raise ValueError("a collection can't be below itself")
    row = hierarchy.sparkSession.createDataFrame([(collection, parent)], "collection string, parent string")
    return unset_parent(hierarchy, collection).unionByName(row)


def unset_parent(hierarchy: DataFrame, collection: str) -> DataFrame:
    return hierarchy.where(F.col("collection") != collection)


def resolve_scope(scope: list[str] | None, entities: DataFrame, documents: DataFrame) -> list[str]:
    """The collections that a scope means: those named, else all that hold a document or an entity, in order."""
    return scope if scope is not None else [r[0] for r in known_collections(entities, documents).collect()]


def children(hierarchy: DataFrame, parent: str) -> DataFrame:
    return hierarchy.where(F.col("parent") == parent).select("collection").orderBy("collection")


def parent_of(hierarchy: DataFrame, collection: str) -> DataFrame:
    return hierarchy.where(F.col("collection") == collection).select("parent")


def tree(hierarchy: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Each collection with its parent (null for roots), its own counts, not its children's, and whether it is a root."""
    names = entities.select("collection").unionByName(documents.select("collection")).unionByName(hierarchy.select("collection")).distinct()
    up = hierarchy.join(names.select(F.col("collection").alias("parent")), "parent", "left_semi").select("collection", "parent")
    n_entities = entities.groupBy("collection").agg(F.count(F.lit(1)).alias("n_entities"))
    n_documents = documents.groupBy("collection").agg(F.count(F.lit(1)).alias("n_documents"))
    out = names.join(up, "collection", "left").join(n_entities, "collection", "left").join(n_documents, "collection", "left")
    return out.select("collection", "parent", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.col("parent").isNull().alias("is_root"))


def known_collections(entities: DataFrame, documents: DataFrame) -> DataFrame:
    return entities.select("collection").unionByName(documents.select("collection")).distinct().orderBy("collection")
