"""Hierarchical communities: seeded Leiden for each collection, with content-addressed ids.

Collections never interact.  A graph is aggregated by distributed rounds (leiden.py) until its edges
are few enough to gather, and finished by the local algorithm below; a collection of few edges is
gathered as it is.  A task holds numbered edges in arrays, and a graph's names once."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..schema import COMMUNITIES
from ..staging import drop_staged, moved_by_key, stage
from ..workers import ready
from .leiden import kept, met_by, partition
from .numbering import numbered
from .scope import in_scope

#: Distinct edges of a graph that one task gathers (about 800 MB and 100 s at five million); an aggregate of them is far smaller.
GATHER_EDGES = 2_000_000
#: The parent of a gathered graph's communities that lies outside it.
OUTER = -1


def weighted_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(collection, a, b, weight): parallel relations add up; ends that are no entities are dropped."""
    names = entities.select("collection", "name").distinct()
    both = relations
    for end in ("source", "target"):
        both = both.join(moved_by_key(names.withColumnRenamed("name", end)), ["collection", end], "left_semi")
    return both.groupBy("collection", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def graph_signatures(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(collection, graph_signature): equal for equal graphs, whatever order their rows have; combines row hashes by sums, so nothing is gathered."""
    words = lambda *c: [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *c), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    e = entities.groupBy("collection").agg(F.count(F.lit(1)).cast("string").alias("n"), *[w.cast("string").alias(f"e{i}") for i, w in enumerate(words("name"))])
    r = relations.groupBy("collection").agg(F.count(F.lit(1)).cast("string").alias("m"), *[w.cast("string").alias(f"r{i}") for i, w in enumerate(words("source", "predicate", "target", "valid_from"))])
    return e.join(r, "collection", "left").select("collection", F.sha2(F.concat_ws("|", "collection", "n", *[f"e{i}" for i in range(5)], F.coalesce("m", F.lit("0")), *[f"r{i}" for i in range(5)]), 256).alias("graph_signature"))


def community_id(collection: str, level: int, members: list[str]) -> str:
    """The first 16 hex digits of the SHA-256 of a JSON object of collection, level and sorted members."""
    return hashlib.sha256(json.dumps({"collection": collection, "level": level, "members": sorted(members)}, ensure_ascii=False).encode()).hexdigest()[:16]


def leiden(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """A partition by modularity: local moves, refinement inside each community, aggregation, until nothing moves."""
    rng = np.random.default_rng(seed)
    part = np.arange(n) if start is None else start
    total = float(w.sum())
    if not total:
        return part
    ids = np.arange(n)  # the aggregate node of each node
    size_a, size_b, size_w, m = a, b, w, n
    start = part
    while True:  # ends: every round has fewer nodes
        moved, labels = _local(m, size_a, size_b, size_w, total, start, rng)
        part = labels[ids]
        if not moved and len(np.unique(labels)) == m:
            break
        fine = _refine(m, size_a, size_b, size_w, total, labels, rng)
        names, own = np.unique(fine, return_inverse=True)
        if len(names) == m:
            break
        start = np.zeros(len(names), np.int64)
        start[own] = labels
        start = np.unique(start, return_inverse=True)[1]
        ids = own[ids]
        x, y = np.minimum(own[size_a], own[size_b]), np.maximum(own[size_a], own[size_b])
        keys, at = np.unique(x * len(names) + y, return_inverse=True)
        size_a, size_b, size_w, m = keys // len(names), keys % len(names), np.bincount(at, size_w), len(names)
    return np.unique(part, return_inverse=True)[1]


class _Near:
    """Each node's neighbours and weights, in the order of the edges."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        apart = a != b
        x, y = a[apart], b[apart]
        ends = np.stack([x, y], 1).ravel()
        order = np.argsort(ends, kind="stable")
        self.to = np.stack([y, x], 1).ravel()[order]
        self.weight = np.repeat(w[apart], 2)[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))]).tolist()

    def __getitem__(self, v: int) -> list[tuple[int, float]]:
        i, j = self.start[v], self.start[v + 1]
        return list(zip(self.to[i:j].tolist(), self.weight[i:j].tolist(), strict=True))


def _adjacent(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[_Near, np.ndarray]:
    return _Near(n, a, b, w), np.bincount(a, w, n) + np.bincount(b, w, n)


def _local(n, a, b, w, total, start, rng) -> tuple[bool, np.ndarray]:
    near, degree = _adjacent(n, a, b, w)
    label = start.copy()
    mass = np.zeros(max(n, int(label.max()) + 1))
    np.add.at(mass, label, degree)
    queue, waiting, any_moved = list(rng.permutation(n)), [True] * n, False
    at = 0
    while at < len(queue):
        v = int(queue[at])
        at += 1
        waiting[v] = False
        links: dict[int, float] = {}
        for u, x in near[v]:
            links[int(label[u])] = links.get(int(label[u]), 0.0) + x
        old = int(label[v])
        mass[old] -= degree[v]
        best, gain = old, links.get(old, 0.0) - degree[v] * mass[old] / (2 * total)
        for c, x in sorted(links.items()):
            g = x - degree[v] * mass[c] / (2 * total)
            if g > gain + 1e-12:
                best, gain = c, g
        mass[best] += degree[v]
        if best != old:
            label[v] = best
            any_moved = True
            for u, _ in near[v]:
                if label[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return any_moved, np.unique(label, return_inverse=True)[1]


def _refine(n, a, b, w, total, labels, rng) -> np.ndarray:
    """Merge single nodes within their community only, so each part is connected."""
    near, degree = _adjacent(n, a, b, w)
    fine = np.arange(n)
    mass, alone = degree.copy(), np.ones(n, bool)
    for v in rng.permutation(n).tolist():
        if not alone[v]:
            continue
        links: dict[int, float] = {}
        for u, x in near[v]:
            if labels[u] == labels[v]:
                links[int(fine[u])] = links.get(int(fine[u]), 0.0) + x
        best, gain = v, 0.0
        for c, x in sorted(links.items()):
            g = x - degree[v] * mass[c] / (2 * total)
            if c != v and g > gain + 1e-12:
                best, gain = c, g
        if best != v:
            fine[v] = best
            mass[best] += degree[v]
            mass[v] -= degree[v]
            alone[v] = alone[best] = False
    return fine


def expand(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, settings: Settings, level: int = 0, parent: int | None = None) -> list[tuple[int, np.ndarray, int | None]]:
    """[(level, members, parent)]: communities larger than the limit are split again, down to the last level."""
    out: list[tuple[int, np.ndarray, int | None]] = []
    place = np.zeros(n, np.int64)

    def split(members: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, level: int, parent: int | None) -> None:
        place[members] = np.arange(len(members))
        part = leiden(len(members), place[a], place[b], w, settings.leiden_seed)
        n = int(part.max()) + 1 if len(members) else 0
        if parent is not None and n <= 1:
            return
        # The members and inner edges of each community side by side, in their order.
        of_a = part[place[a]]
        inner = np.flatnonzero(of_a == part[place[b]])
        inner = inner[np.argsort(of_a[inner], kind="stable")]
        at = np.searchsorted(of_a[inner], np.arange(n + 1))
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n + 1))
        for c in np.argsort(order[cut[:-1]], kind="stable").tolist():
            own = members[order[cut[c] : cut[c + 1]]]
            out.append((level, own, parent))
            if len(own) > settings.community_max_size and level < settings.community_max_level:
                e = inner[at[c] : at[c + 1]]
                split(own, a[e], b[e], w[e], level + 1, len(out) - 1)

    split(np.arange(n), a, b, w, level, parent)
    return out


def detect(entities: DataFrame, relations: DataFrame, settings: Settings = DEFAULTS, gather_edges: int = GATHER_EDGES) -> DataFrame:
    """The communities of every collection, split level by level.  Bridges play no part.

    A graph (a collection, or a community to be split) of at most gather_edges distinct edges is gathered in
    one task, with all levels below it; larger ones are aggregated by distributed rounds until they can be."""
    ready(entities.sparkSession)
    names = entities.select("collection", "name").distinct()
    nodes = stage(numbered(names, "collection", "name").withColumn("parent", F.lit(None).cast("string")), "nodes")
    named = weighted_edges(entities, relations)
    for end in ("a", "b"):
        named = named.join(moved_by_key(nodes.select("collection", F.col("name").alias(end), F.col("id").alias(f"id_{end}"))), ["collection", end])
    edges = stage(named.select("collection", F.lit(None).cast("string").alias("parent"), F.col("id_a").alias("a"), F.col("id_b").alias("b"), "weight"), "edges")
    found, level = None, 0
    while True:
        sizes = edges.groupBy("collection", "parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > gather_edges)
        graphs = [(r.collection, r.parent, g) for g, r in enumerate(sizes.collect())]  # fewer than all edges by the bound
        told = entities.sparkSession.createDataFrame(graphs, "collection string, parent string, g int")
        large = lambda df, how, told=told: df.join(F.broadcast(told.withColumnsRenamed({"collection": "c", "parent": "p"})), F.col("collection").eqNullSafe(F.col("c")) & F.col("parent").eqNullSafe(F.col("p")), how)
        gathered = _gathered(*((large(nodes, "left_anti"), large(edges, "left_anti")) if graphs else (nodes, edges)), settings, level)
        found = gathered if found is None else found.unionByName(gathered)
        if not graphs:
            break
        rows, nodes, edges = _one_level(large(nodes, "inner").drop("c", "p"), large(edges, "inner").drop("c", "p"), settings, level, gather_edges)
        found, level = found.unionByName(rows), level + 1
    return found.join(graph_signatures(entities, relations), "collection", "left").select(*[x.split()[0] for x in COMMUNITIES.split(", ")])


FOUND = "collection string, community_id string, level int, parent_community_id string, entity_names array<string>, size int"


def _gathered(nodes: DataFrame, edges: DataFrame, settings: Settings, level: int) -> DataFrame:
    """All levels from this one on, for graphs that one task holds; it holds numbered edges, and each name once."""

    def own(have: pa.Table, link: pa.Table) -> pa.Table:
        have = have.sort_by("id")
        ids, names = have.column("id").to_numpy(), have.column("name").combine_chunks()
        collection, parent = have.column("collection")[0].as_py(), have.column("parent")[0].as_py()
        a, b, w = (link.column(c).to_numpy() for c in ("a", "b", "weight"))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        order = np.lexsort((b, a))
        rows = expand(len(names), a[order], b[order], w[order], settings, level, None if parent is None else OUTER)
        told = [names.take(pa.array(members)).to_pylist() for _, members, _ in rows]
        named = [community_id(collection, level, members) for (level, _, _), members in zip(rows, told, strict=True)]
        columns = {
            "collection": pa.array([collection] * len(rows), pa.string()),
            "community_id": pa.array(named, pa.string()),
            "level": pa.array([level for level, _, _ in rows], pa.int32()),
            "parent_community_id": pa.array([None if up is None else parent if up == OUTER else named[up] for _, _, up in rows], pa.string()),
            "entity_names": pa.array(told, pa.list_(pa.string())),
            "size": pa.array([len(x) for x in told], pa.int32()),
        }
        return pa.table(columns)

    # A group of edges alone has no nodes and can't be: every edge's ends are nodes.
    return nodes.groupBy("collection", "parent").cogroup(edges.groupBy("collection", "parent")).applyInArrow(own, FOUND)


def _one_level(nodes: DataFrame, edges: DataFrame, settings: Settings, level: int, gather_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(communities, nodes, edges) of graphs too large to gather: one level, and the graphs of the next, which are the communities to be split."""
    links = stage(edges.select("g", "a", "b", "weight"), "large-edges")
    ended, ends = met_by(links)
    labels = partition(links, gather_edges, settings.leiden_seed, leiden, known=(ended, ends))
    # Nodes without edges are communities of their own.
    placed = stage(nodes.join(moved_by_key(labels), "id", "left").withColumn("label", F.coalesce("label", "id")), "placed")
    drop_staged(labels)
    groups = placed.groupBy("collection", "parent", "g", "label").agg(F.array_sort(F.collect_list("name")).alias("entity_names"))
    # A part of a community that does not split again is no community of its own.
    several = groups.groupBy("g").agg(F.count(F.lit(1)).alias("several"))
    named = F.arrow_udf(lambda c, m: pa.array([community_id(x, level, y) for x, y in zip(c.to_pylist(), m.to_pylist(), strict=True)], pa.string()), "string")("collection", "entity_names")
    groups = groups.join(F.broadcast(several), "g").where("parent is null or several > 1").select("collection", named.alias("community_id"), F.lit(level).alias("level"), F.col("parent").alias("parent_community_id"), "entity_names", F.size("entity_names").alias("size"), "label")
    groups = stage(groups, "communities")
    again = groups.where((F.col("size") > settings.community_max_size) & F.lit(level < settings.community_max_level)).select("label", F.col("community_id").alias("parent"))
    split = stage(placed.select("collection", "name", "id", "label").join(moved_by_key(again), "label", "left").select("collection", "name", "id", "parent", "label"), "nodes")
    inside = split.where("parent is not null")
    inner = ends.met(split.withColumn("again", F.col("parent").isNotNull().cast("int")), "label", "again", by=kept, schema="x long, a long, b long, weight double")
    inner = inner.unionByName(links.where("a = b").select(F.col("a").alias("x"), "a", "b", "weight"))
    inner = inner.join(moved_by_key(inside.select(F.col("id").alias("x"), "collection", "parent")), "x").select("collection", "parent", "a", "b", "weight")
    inner = stage(inner, "edges")
    ends.drop()
    for x in (links, placed, ended):
        drop_staged(x)
    return groups.drop("label"), inside.drop("label"), inner


def in_order(state: DataFrame, scope: list[str] | None = None, level: int | None = None) -> DataFrame:
    """Communities or reports of a scope, of one level if given, in the order of their levels and ids."""
    own = in_scope(state, scope)
    return (own if level is None else own.where(F.col("level") == level)).orderBy("collection", "level", "community_id")


def replace_communities(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.join(new.select("collection").distinct(), "collection", "left_anti").select(*state.columns).unionByName(new.select(*state.columns))


def boundary_edges(communities: DataFrame, relations: DataFrame, external_max: int = 20) -> DataFrame:
    """(collection, community_id, side, source, predicate, target, valid_from): inner relations, and the first external ones, which have exactly one end inside."""
    from pyspark.sql import Window

    member = communities.select("collection", "community_id", F.explode("entity_names").alias("name"))
    ends = relations.select("collection", "source", "predicate", "target", "valid_from", "source_doc", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
    met = ends.join(member, ["collection", "name"])
    keys = ["collection", "community_id", "source", "predicate", "target", "valid_from", "source_doc"]
    grouped = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"))
    sided = grouped.withColumn("side", F.when((F.col("inside") == 2) | (F.col("source") == F.col("target")), "inner").otherwise("outer"))
    nth = F.row_number().over(Window.partitionBy("collection", "community_id", "side").orderBy("source", "predicate", "target", "valid_from"))
    return sided.withColumn("nth", nth).where((F.col("side") == "inner") | (F.col("nth") <= external_max)).select("side", *keys)


def dominant_sources(edges: DataFrame) -> DataFrame:
    """(collection, community_id, source_doc): the most frequent one of a community's inner relations, ties to the least."""
    n = edges.where("side = 'inner'").groupBy("collection", "community_id", "source_doc").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("collection", "community_id").agg(F.min_by("source_doc", F.struct((-F.col("n")).alias("n"), "source_doc")).alias("source_doc"))
