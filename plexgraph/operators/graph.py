"""The property graph as DataFrames: entities (collection, name) and their relations and bridges.

All writes are set-based: a batch with an order column `seq` is folded into the state, and within a key
the greatest seq wins.  Nothing joins across collections but bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import drop_staged, stage
from .numbering import numbered
from .scope import in_scope

NODE = ["collection", "name"]
EDGE = ["collection", "source", "target", "predicate", "valid_from"]
#: Numbers of so many drops may go to every task in each round of resolve_merges.
BROADCAST_DROPS = 100_000


def _aliases(df: DataFrame) -> DataFrame:
    return df if "aliases" in df.columns else df.withColumn("aliases", F.array().cast("array<string>"))


# Writes


def upsert_entities(state: DataFrame, batch: DataFrame, keep_nonempty: bool = False, tasks: int | None = None) -> DataFrame:
    """Last writer wins on type and description, an empty description too unless keep_nonempty; aliases stay.

    tasks: how many share the writes, if the caller knows their number; each sorts its part in memory."""
    old = _aliases(state).select(*NODE, "type", "description", "aliases", F.lit(None).cast("string").alias("seq0"), F.lit(0).alias("turn"))
    new = batch.select(*NODE, "type", "description", F.lit(None).cast("array<string>").alias("aliases"), "seq", F.lit(1).alias("turn"))
    seq = new.schema["seq"].dataType
    both = old.withColumn("seq", F.lit(None).cast(seq)).drop("seq0").unionByName(new)
    both = both.repartition(tasks, *NODE) if tasks else both
    order = F.struct("turn", "seq")
    description = F.max_by("description", F.when(F.coalesce("description", F.lit("")) != "", order)) if keep_nonempty else F.max_by("description", order)
    return both.groupBy(*NODE).agg(F.max_by("type", order).alias("type"), F.coalesce(description, F.lit("")).alias("description"), F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("aliases"))), F.array().cast("array<string>")).alias("aliases"))


def update_descriptions(state: DataFrame, new: DataFrame) -> DataFrame:
    """new: collection, name, description."""
    fresh = new.select(*NODE, F.col("description").alias("fresh"))
    return state.join(fresh, NODE, "left").withColumn("description", F.coalesce("fresh", "description")).drop("fresh").select(*state.columns)


def add_aliases(state: DataFrame, new: DataFrame) -> DataFrame:
    """new: collection, name, alias; unknown names are ignored, known aliases stay in place."""
    more = new.groupBy(*NODE).agg(F.array_sort(F.collect_set("alias")).alias("more"))
    return state.join(more, NODE, "left").withColumn("aliases", F.array_union("aliases", F.coalesce("more", F.array().cast("array<string>")))).drop("more").select(*state.columns)


def upsert_relations(state: DataFrame, batch: DataFrame, entities: DataFrame, tasks: int | None = None) -> DataFrame:
    """Last writer wins on source_doc; relations with a missing end are skipped.

    Writes are dealt by their source and folded there; only what is left of them meets the targets.
    tasks: how many share the writes, if the caller knows their number."""
    names = entities.select(*NODE).distinct()
    known = lambda end: names.select("collection", F.col("name").alias(end), F.lit(True).alias(f"has_{end}"))
    old = state.select(*EDGE, "source_doc", F.lit(None).cast(batch.schema["seq"].dataType).alias("seq"), F.lit(0).alias("turn"))
    both = old.unionByName(batch.select(*EDGE, "source_doc", "seq", F.lit(1).alias("turn")))
    held = F.when(F.col("turn") == 0, F.struct("source_doc"))
    dealt = both.repartition(*([tasks] if tasks else []), "collection", "source")
    last = dealt.groupBy(*EDGE).agg(F.max_by("source_doc", F.struct("turn", "seq")).alias("new"), F.max(held).alias("held"))
    met = last.join(known("source"), ["collection", "source"], "left").join(known("target"), ["collection", "target"], "left")
    both_ends = F.col("has_source").isNotNull() & F.col("has_target").isNotNull()
    return met.where(both_ends | F.col("held").isNotNull()).select(*EDGE, F.when(both_ends, F.col("new")).otherwise(F.col("held.source_doc")).alias("source_doc"))


def _without_nodes(relations: DataFrame, gone: DataFrame) -> DataFrame:
    keys = gone.select(*NODE).distinct()
    return relations.join(keys.withColumnRenamed("name", "source"), ["collection", "source"], "left_anti").join(keys.withColumnRenamed("name", "target"), ["collection", "target"], "left_anti").select(*relations.columns)


def _without_bridges(bridges: DataFrame, gone: DataFrame) -> DataFrame:
    for side in ("lo", "hi"):
        bridges = bridges.join(gone.select(F.col("collection").alias(f"collection_{side}"), F.col("name").alias(f"name_{side}")).distinct(), [f"collection_{side}", f"name_{side}"], "left_anti")
    return bridges.select("collection_lo", "name_lo", "collection_hi", "name_hi")


def delete_entities(entities: DataFrame, relations: DataFrame, bridges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without gone (collection, name) and everything that hangs on it."""
    return entities.join(gone.select(*NODE).distinct(), NODE, "left_anti").select(*entities.columns), _without_nodes(relations, gone), _without_bridges(bridges, gone)


def delete_collection(entities: DataFrame, relations: DataFrame, bridges: DataFrame, collection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keep = F.col("collection") != collection
    return entities.where(keep), relations.where(keep), bridges.where((F.col("collection_lo") != collection) & (F.col("collection_hi") != collection))


def delete_relations_of(relations: DataFrame, source_doc: str) -> DataFrame:
    return relations.where(~F.col("source_doc").eqNullSafe(F.lit(source_doc)))


def resolve_merges(pairs: DataFrame) -> DataFrame:
    """(collection, drop, keep) with chains followed to their end, by pointer jumping: about log2 of the longest chain in rounds.

    pairs: collection, keep, drop.  Of several keeps for one drop the least stays; a cycle goes to its least name.
    Rounds move numbers of drops, not names; the least number that was passed is the least name, as numbers follow their order."""
    drops = numbered(pairs.where("keep <> drop").groupBy("collection", "drop").agg(F.min("keep").alias("keep")), "collection", "drop")
    n = drops.count()
    dealt = (lambda df: df) if n <= BROADCAST_DROPS else (lambda df: df.hint("merge"))  # many numbers do not go through the driver
    of = drops.select("collection", F.col("drop").alias("keep"), F.col("id").alias("up"))
    start = stage(drops.join(dealt(of), ["collection", "keep"], "left").select("id", "up", F.when(F.col("up").isNull(), F.col("keep")).alias("goal")), "merges")
    now, reach, moved = stage(start.select("id", F.coalesce("up", "id").alias("up"), F.col("id").alias("least")), "merges"), 1, n > 0
    while moved and reach < n:
        there = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("least").alias("passed"))
        before, now = now, stage(now.join(dealt(there), "up").select("id", F.col("next").alias("up"), F.least("least", "passed").alias("least"), (F.col("next") != F.col("up")).alias("moved")), "merges")
        drop_staged(before)
        reach, moved = reach * 2, now.agg(F.max("moved")).first()[0]
    heads = now.select(F.col("id").alias("up"), F.col("least").alias("head")).join(dealt(start.select(F.col("id").alias("up"), "goal")), "up")
    ends = now.select("id", "up").join(dealt(heads), "up").join(dealt(drops.select(F.col("id").alias("head"), F.col("drop").alias("name"))), "head").select("id", F.coalesce("goal", "name").alias("end"))
    return drops.select("id", "collection", "drop").join(dealt(ends), "id").where("end <> drop").select("collection", "drop", F.col("end").alias("keep"))


def merge_entities(entities: DataFrame, relations: DataFrame, bridges: DataFrame, pairs: DataFrame, carry_over: bool = False, drop_self_loops: bool = False, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Re-point the relations of each dropped entity to the kept one, and delete it.

    Of relations that become equal the least source_doc stays.  carry_over also moves aliases (with the
    dropped name) and bridges, which are otherwise lost with the dropped entity.  tasks: how many share the
    relations, if the caller knows their number."""
    names = entities.select(*NODE)
    plan = pairs.join(names.withColumnRenamed("name", "drop"), ["collection", "drop"], "left_semi").join(names.withColumnRenamed("name", "keep"), ["collection", "keep"], "left_semi").select("collection", "drop", "keep")

    def moved(df: DataFrame, column: str, collection: str = "collection") -> DataFrame:
        to = plan.select(F.col("collection").alias(collection), F.col("drop").alias(column), F.col("keep").alias("__to"))
        return df.join(to, [collection, column], "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

    pointed = moved(moved(relations, "source"), "target")
    edges = (pointed.repartition(tasks, *EDGE) if tasks else pointed).groupBy(*EDGE).agg(F.min("source_doc").alias("source_doc"))
    if drop_self_loops:
        edges = edges.where("source <> target")
    gone = plan.select("collection", F.col("drop").alias("name"))
    kept = entities.join(gone, NODE, "left_anti").select(*entities.columns)
    if not carry_over:
        return kept, edges, _without_bridges(bridges, gone)
    own = entities.join(plan.withColumnRenamed("drop", "name"), NODE).select("collection", F.col("keep").alias("name"), F.explode(F.array_append("aliases", F.col("name"))).alias("alias"))
    both = bridges
    for side in ("lo", "hi"):
        both = moved(both, f"name_{side}", f"collection_{side}")
    return add_aliases(kept, own.where("alias <> name")), edges, canonical_bridges(both.select(F.col("collection_lo").alias("collection_a"), F.col("name_lo").alias("name_a"), F.col("collection_hi").alias("collection_b"), F.col("name_hi").alias("name_b")), kept)


def canonical_bridges(batch: DataFrame, entities: DataFrame) -> DataFrame:
    """Undirected bridges, once each, between different entities that exist; batch: collection_a, name_a, collection_b, name_b."""
    one = F.struct(F.col("collection_a").alias("collection"), F.col("name_a").alias("name"))
    two = F.struct(F.col("collection_b").alias("collection"), F.col("name_b").alias("name"))
    both = batch.select(F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi")).where("lo <> hi")
    ends = both.select(*[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("lo", "hi") for c in ("collection", "name")]).distinct()
    for side in ("lo", "hi"):
        ends = ends.join(entities.select(F.col("collection").alias(f"collection_{side}"), F.col("name").alias(f"name_{side}")).distinct(), [f"collection_{side}", f"name_{side}"], "left_semi")
    return ends.select("collection_lo", "name_lo", "collection_hi", "name_hi")


def add_bridges(state: DataFrame, batch: DataFrame, entities: DataFrame) -> DataFrame:
    return state.unionByName(canonical_bridges(batch, entities)).distinct()


def remove_bridges(state: DataFrame, batch: DataFrame) -> DataFrame:
    """In either order."""
    a = batch.select("collection_a", "name_a", "collection_b", "name_b").toDF("collection_lo", "name_lo", "collection_hi", "name_hi")
    b = batch.select("collection_b", "name_b", "collection_a", "name_a").toDF("collection_lo", "name_lo", "collection_hi", "name_hi")
    return state.join(a.unionByName(b).distinct(), state.columns, "left_anti")


# Reads


def outgoing(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """One hop out from nodes (collection, name)."""
    return relations.join(nodes.select("collection", F.col("name").alias("source")).distinct(), ["collection", "source"], "left_semi").select("collection", F.col("source").alias("name"), "predicate", F.col("target").alias("other"), "valid_from", "source_doc")


def incoming(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    return relations.join(nodes.select("collection", F.col("name").alias("target")).distinct(), ["collection", "target"], "left_semi").select("collection", F.col("target").alias("name"), "predicate", F.col("source").alias("other"), "valid_from", "source_doc")


def lookup(entities: DataFrame, keys: DataFrame) -> DataFrame:
    return entities.join(keys.select(*NODE).distinct(), NODE, "left_semi").select(*entities.columns)


def existing(entities: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(entities.select(*NODE).distinct(), NODE, "left_semi")


def canonical_names(entities: DataFrame, wanted: DataFrame, stripped: bool = False) -> DataFrame:
    """(collection, candidate, name): the exact name first, else the least name that has it as an alias; with stripped, then without its particle; else null."""
    from ..functions.text import strip_particle

    exact = entities.select("collection", F.col("name").alias("form"), "name", F.lit(0).alias("rank"))
    alias = entities.select("collection", F.explode("aliases").alias("form"), "name", F.lit(1).alias("rank"))
    forms = exact.unionByName(alias)
    tried = wanted.select("collection", "candidate").distinct().withColumn("form", F.col("candidate")).withColumn("step", F.lit(0))
    if stripped:
        bare = strip_particle(F.col("candidate"))
        tried = tried.unionByName(tried.where(bare != F.col("candidate")).select("collection", "candidate", bare.alias("form"), F.lit(1).alias("step")))
    return tried.join(forms, ["collection", "form"], "left").groupBy("collection", "candidate").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("step", "rank", "name"))).alias("name"))


def ends(relations: DataFrame) -> DataFrame:
    """(collection, name) once for each end of each relation: a loop has two."""
    return relations.select("collection", F.explode(F.array("source", "target")).alias("name"))


def degrees(relations: DataFrame) -> DataFrame:
    return ends(relations).groupBy(*NODE).agg(F.count(F.lit(1)).alias("degree"))


def isolated(entities: DataFrame, relations: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Entities without any relation, in no order; bridges do not count."""
    return in_scope(entities, scope).select(*NODE).join(ends(in_scope(relations, scope)).distinct(), NODE, "left_anti")


def drop_isolated(entities: DataFrame, relations: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return entities.join(isolated(entities, relations, scope), NODE, "left_anti").select(*entities.columns)


def both_ways(bridges: DataFrame) -> DataFrame:
    there = bridges.toDF("collection", "name", "other_collection", "other_name")
    return there.unionByName(bridges.select("collection_hi", "name_hi", "collection_lo", "name_lo").toDF("collection", "name", "other_collection", "other_name"))


def bridged(bridges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (collection_a, name_a, collection_b, name_b) that a bridge joins, in either order."""
    there = both_ways(bridges).toDF("collection_a", "name_a", "collection_b", "name_b").distinct()
    return pairs.join(there, there.columns, "left_semi").select(*pairs.columns)


def bridge_neighbours(bridges: DataFrame, nodes: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    out = both_ways(bridges)
    if nodes is not None:
        out = out.join(nodes.select(*NODE).distinct(), NODE, "left_semi")
    return in_scope(out, scope, "other_collection")


def contexts(entities: DataFrame, relations: DataFrame, limit: int = 3) -> DataFrame:
    """Each entity with its description, first `limit` relations as lines, and number of relations (a loop counts once)."""
    line = F.concat("source", F.lit(" -["), "predicate", F.lit("]-> "), "target")
    each = relations.select("collection", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"), line.alias("line"), F.struct("source", "predicate", "target", "valid_from").alias("order"))
    first = Window.partitionBy(*NODE).orderBy("order")
    top = each.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit).groupBy(*NODE).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("lines"))
    n = each.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_relations"))
    return entities.select(*NODE, "description").join(top, NODE, "left").join(n, NODE, "left").select(*NODE, "description", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"))


def counts(entities: DataFrame, relations: DataFrame, scope: list[str] | None = None) -> DataFrame:
    e = in_scope(entities, scope).groupBy("collection").agg(F.count(F.lit(1)).alias("n_entities"))
    r = in_scope(relations, scope).groupBy("collection").agg(F.count(F.lit(1)).alias("n_relations"))
    return e.join(r, "collection", "full").select("collection", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_relations", F.lit(0)).alias("n_relations"))
