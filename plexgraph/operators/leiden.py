"""Leiden for graphs that no single task should hold: rounds of joins and aggregates over staged edges.

A graph is aggregated until its edges are few enough to gather, and then finished by the local
algorithm.  One level of aggregation is:

moves     nodes are dealt to blocks of about as many edges as one task gathers, communities as a whole;
          in each block nodes move in a row, as in the local algorithm, to the best of their neighbours'
          communities, while labels outside the block stay as they were.  Edges are not sent to
          the blocks: those inside one are, of others only what a node's weigh by community.  A half of the nodes rests
          in each round, by a coin (a hash of node and round), so that few neighbours move unseen.  A
          round is kept for the graphs whose modularity it raises; IDLE rounds in a row that raise none
          by TOLERANCE end the moves
refining  inside each community (and block) every node starts alone, and joins the best part that an
          edge leads to, so that parts are connected
folding   parts become nodes, edges between them add up, and the communities are the next start

Blocks follow from hashes and the number of edges, what a block does from the order of ids, and all sums
are of whole numbers, so the result does not depend on how rows are dealt to tasks.  A node or a community of very many edges is a hot key in a plain join, which
adaptive execution splits; aggregates combine inside each task before they are shuffled.  No table of a row for each
node, community or part is broadcast, however few bytes its files have; edges lie in buckets of one end, and stay there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop_dealt, drop_staged, moved_by_key, stage, stage_dealt
from ..workers import ready

#: Modularity that a round of moves has to gain; how many rounds in a row may miss that before they end.
TOLERANCE, IDLE = 1e-3, 2
#: Fewer nodes than this, those of the most edges, have their labels carried to every task.
HUBS = 10_000
#: Edges of a bucket of the lists of edges.
LIST_EDGES = 500_000
#: What a move has to gain, in edges.
LEAST_GAIN = 1e-9


def _nodes(edges: DataFrame) -> DataFrame:
    """(id, g, degree, ends, double): each node with its graph, its weighted degree, its number of edges, and twice the graph's weight."""
    ends = edges.select("g", F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id", "g").agg(F.sum("weight").alias("degree"), F.count(F.lit(1)).alias("ends"))
    totals = edges.groupBy("g").agg((2 * F.sum("weight")).alias("double"))  # a row for each graph that is too large to gather
    return ends.join(F.broadcast(totals), "g").select("id", "g", "degree", "ends", "double")


def _dealt(labels: DataFrame, blocks: int, most: int, *salt: int) -> DataFrame:
    """labels with mass and block: a community lies in one, unless its nodes have more than `most` edges; then they are dealt one by one."""
    mass = labels.groupBy("label").agg(F.sum("degree").alias("mass"), F.sum("ends").alias("all"))
    key = F.when(F.col("all") > most, F.col("id")).otherwise(F.col("label"))
    return labels.join(moved_by_key(mass), "label").withColumn("block", F.pmod(F.xxhash64(key, *[F.lit(x) for x in salt]), F.lit(blocks)).cast("int"))


#: What one task tells a block, in arrays: edges inside it, what its nodes' edges to others' communities weigh, and the masses of those.
TOLD = "block int, x array<long>, y array<long>, w array<double>, node array<long>, label array<long>, weight array<double>, other array<long>, mass array<double>"


class _Ends:
    """Edges between different nodes, staged once for a graph's rounds, refinement and folding, by what brings them their ends' labels.

    lists   (x, arrays y and weight): edges to a hub y, in buckets of x; labels of the hubs, fewer than `hubs`, travel to every task
    rest    (x, y, weight): edges without a hub, which meet the labels of both ends by joins
    loops   by graph, the weight of edges from a node to itself"""

    def __init__(self, edges: DataFrame, nodes: DataFrame, hubs: int):
        self.edges = edges.count()
        # All nodes have twice as many ends as there are edges, so fewer than `hubs` have more than their share.
        self.hubs = stage(nodes.where(F.col("ends") * hubs > 2 * self.edges).select(F.col("id").alias("hub")), "hubs")
        of = lambda c: F.broadcast(self.hubs.select(F.col("hub").alias(c), F.lit(True).alias(f"hub_{c}")))
        apart = edges.where("a <> b").select("a", "b", "weight")
        self.count = apart.count()
        sided = apart.join(of("a"), "a", "left").join(of("b"), "b", "left")
        x, y = (F.when(F.col("hub_b").isNotNull(), F.col(c)).otherwise(F.col(d)) for c, d in ("ab", "ba"))
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-self.count // LIST_EDGES))
        led = sided.where("hub_a is not null or hub_b is not null").select(x.alias("x"), y.alias("y"), "weight").repartition(tasks, "x")
        self.lists = stage_dealt(led.groupBy("x").agg(F.collect_list(F.struct("y", "weight")).alias("to")).select("x", "to.y", "to.weight"), "lists", "x", tasks)
        self.rest = stage(sided.where("hub_a is null and hub_b is null").select(F.col("a").alias("x"), F.col("b").alias("y"), "weight"), "rest")
        self.bare = self.rest.isEmpty()
        self.loops = {r.g: r.w for r in edges.where("a = b").groupBy("g").agg(F.sum("weight").alias("w")).collect()}

    def met(self, labels: DataFrame, *columns: str, by: Callable[[dict[str, np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
        """by's rows for runs of edges: their x, y and weight, and columns of labels (id, ...) as x_ and y_ columns."""
        told = labels.join(F.broadcast(self.hubs), F.col("id") == F.col("hub")).select("id", *columns).orderBy("id").toArrow()  # fewer than `hubs`
        ids, told = told.column("id").to_numpy(), {c: told.column(c).to_numpy() for c in columns}
        of = lambda end: moved_by_key(labels.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]))

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.repeat(np.arange(batch.num_rows), batch.column("y").value_lengths().to_numpy(zero_copy_only=False))
                y, weight = (batch.column(c).flatten().to_numpy() for c in ("y", "weight"))
                place = np.searchsorted(ids, y)
                own = {c: batch.column(c).to_numpy()[at] for c in batch.schema.names if c not in ("y", "weight")}
                yield by(own | {"y": y, "weight": weight} | {f"y_{c}": v[place] for c, v in told.items()})

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield by({c: batch.column(c).to_numpy() for c in batch.schema.names})

        out = self.lists.join(of("x"), "x").mapInArrow(lists, schema)
        return out if self.bare else out.unionByName(self.rest.join(of("y"), "y").join(of("x"), "x").mapInArrow(rows, schema))

    def drop(self) -> None:
        for x in (self.hubs, self.rest):
            drop_staged(x)
        drop_dealt(self.lists)


def met_by(edges: DataFrame, hubs: int = HUBS) -> tuple[DataFrame, _Ends]:
    """The nodes of staged edges, staged, and their ends."""
    nodes = stage(_nodes(edges), "nodes")
    return nodes, _Ends(edges, nodes, hubs)


def _told(edges: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Edges as rows of TOLD: those that leave a block are added up by node and community, at both ends."""
    x, y, w = edges["x"], edges["y"], edges["weight"]
    inner = np.flatnonzero(edges["x_block"] == edges["y_block"])
    inner = inner[np.lexsort((y[inner], x[inner], edges["x_block"][inner]))]
    outer = np.flatnonzero(edges["x_block"] != edges["y_block"])
    both = lambda c, d: np.concatenate([edges[c][outer], edges[d][outer]])
    block, node, label, mass, weight = both("x_block", "y_block"), both("x", "y"), both("y_label", "x_label"), both("y_mass", "x_mass"), np.tile(w[outer], 2)
    order = np.lexsort((label, node, block))
    block, node, label, mass, weight = (c[order] for c in (block, node, label, mass, weight))
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (label[1:] != label[:-1])][: len(node)])  # a node lies in one block
    weight = np.add.reduceat(weight, first) if len(first) else weight
    block, node, label, mass = (c[first] for c in (block, node, label, mass))
    once = np.lexsort((label, block))
    once = once[np.r_[True, (label[once][1:] != label[once][:-1]) | (block[once][1:] != block[once][:-1])][: len(once)]]
    parts = [(edges["x_block"][inner], (x[inner], y[inner], w[inner])), (block, (node, label, weight)), (block[once], (label[once], mass[once]))]
    blocks = np.unique(np.concatenate([k for k, _ in parts]))
    out = [pa.array(blocks.astype(np.int32))]
    for key, columns in parts:
        cut = pa.array(np.r_[np.searchsorted(key, blocks), len(key)].astype(np.int32))
        out += [pa.ListArray.from_arrays(cut, pa.array(c)) for c in columns]
    return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in TOLD.split(", ")])


def _moves(seed: int, number: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block's moves in a row: labels outside it stay as they were, those inside and the masses follow each move."""

    def own(have: pa.Table, told: pa.Table) -> pa.Table:
        have = have.sort_by("id")
        ids, degree, double, able = (have.column(c).to_numpy() for c in ("id", "degree", "double", "able"))
        label = have.column("label").to_numpy().tolist()
        mass = dict(zip(label, have.column("mass").to_pylist(), strict=True))
        x, y, w, node, there, out, other, masses = (told.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in told.schema.names if c != "block")
        mass |= dict(zip(other.tolist(), masses.tolist(), strict=True))
        ends = np.r_[ids, np.iinfo(np.int64).max]
        a, b = np.r_[x, y], np.r_[y, x]
        order = np.lexsort((b, a))
        near, weight = np.searchsorted(ids, b[order]).tolist(), np.r_[w, w][order].tolist()
        cut = np.searchsorted(a[order], ends).tolist()
        order = np.argsort(node, kind="stable")
        leave, there, out = np.searchsorted(node[order], ends).tolist(), there[order].tolist(), out[order].tolist()
        queue = [v for v in np.random.default_rng([seed, number]).permutation(len(ids)).tolist() if able[v]]
        waiting = [False] * len(ids)
        for v in queue:
            waiting[v] = True
        for v in queue:  # grows while nodes move
            waiting[v] = False
            home, links = label[v], {}
            for e in range(cut[v], cut[v + 1]):
                c = label[near[e]]
                links[c] = links.get(c, 0.0) + weight[e]
            for e in range(leave[v], leave[v + 1]):
                links[there[e]] = links.get(there[e], 0.0) + out[e]
            share = degree[v] / double[v]
            best, top = home, links.get(home, 0.0) - share * (mass[home] - degree[v]) + LEAST_GAIN
            for c, k in sorted(links.items()):
                if c != home and k - share * mass[c] > top:
                    best, top = c, k - share * mass[c]
            if best != home:
                mass[home] -= degree[v]
                mass[best] += degree[v]
                label[v] = best
                for e in range(cut[v], cut[v + 1]):
                    u = near[e]
                    if able[u] and not waiting[u] and label[u] != best:
                        waiting[u] = True
                        queue.append(u)
        return have.select(["id", "g", "degree", "ends", "double"]).append_column("label", pa.array(label, pa.int64()))

    return own


def _inner(edges: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(g, w): the weight of edges inside communities."""
    same = edges["x_label"] == edges["y_label"]
    g, at = np.unique(edges["x_g"][same], return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(np.bincount(at, edges["weight"][same], len(g)).astype(float))], ["g", "w"])


def _quality(ends: _Ends, labels: DataFrame) -> dict[int, float]:
    """The modularity of each graph's labels, from sums of whole numbers; a row for each graph reaches the driver."""
    inner = {r.g: r.w for r in ends.met(labels, "label", "g", by=_inner, schema="g int, w double").groupBy("g").agg(F.sum("w").alias("w")).collect()}
    mass = labels.groupBy("g", "label").agg(F.sum("degree").cast("decimal(18,0)").alias("m"), F.max("double").alias("double"))
    square = mass.groupBy("g").agg(F.sum(F.col("m") * F.col("m")).alias("s"), F.max("double").alias("double"))
    return {r.g: 2 * (inner.get(r.g, 0.0) + ends.loops.get(r.g, 0.0)) / r.double - float(r.s) / r.double**2 for r in square.collect()}


def moved(edges: DataFrame, nodes: DataFrame, start: DataFrame | None, most: int, seed: int, hubs: int = HUBS, known: _Ends | None = None) -> DataFrame:
    """(id, g, degree, ends, double, label) after rounds of moves; nodes is staged, start has (id, label), known are the edges' ends where the caller has them."""
    ends = known or _Ends(edges, nodes, hubs)
    own = nodes.withColumn("label", F.col("id")) if start is None else nodes.join(moved_by_key(start), "id")
    labels, number, best, idle = stage(own, "labels"), 0, None, 0
    while True:
        blocks = -(-2 * ends.count // most)
        placed = stage(_dealt(labels, blocks, most, seed, number), "placed")
        # Where there are many blocks, a half of the nodes rests in each round: what it can't see move doesn't.
        able = (F.xxhash64("id", F.lit(seed), F.lit(number)) % 2 == 0) | F.lit(blocks < 2)
        have = placed.select("block", "id", "g", "degree", "ends", "double", "label", "mass", able.alias("able"))
        told = ends.met(placed, "label", "mass", "block", by=_told, schema=TOLD)
        after = stage(have.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_moves(seed, number), "id long, g int, degree double, ends long, double double, label long"), "labels")
        drop_staged(placed)
        quality = _quality(ends, after)
        if best is None:
            good, gained = set(quality), True
        else:
            good = {g for g, q in quality.items() if q > best[g]}
            gained = any(quality[g] > best[g] + TOLERANCE for g in good)
        if len(good) < len(quality):  # a graph that did not gain keeps the labels that it had
            kept = stage(after.where(F.col("g").isin(list(good))).unionByName(labels.where(~F.col("g").isin(list(good)))), "labels")
            drop_staged(after)
            after = kept
        best = {g: q if best is None else max(q, best[g]) for g, q in quality.items()}
        drop_staged(labels)
        labels, number, idle = after, number + 1, 0 if gained else idle + 1
        if idle == IDLE:
            if known is None:
                ends.drop()
            return labels


def kept(edges: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(x, a, b, weight): edges inside the communities that are split again."""
    same = np.flatnonzero((edges["x_label"] == edges["y_label"]) & (edges["x_again"] == 1))
    x, y = edges["x"][same], edges["y"][same]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (x, np.minimum(x, y), np.maximum(x, y), edges["weight"][same])], ["x", "a", "b", "weight"])


def _within(edges: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(block, a, b, weight), both ways: edges inside a community and a block."""
    same = np.flatnonzero((edges["x_label"] == edges["y_label"]) & (edges["x_block"] == edges["y_block"]))
    x, y = edges["x"][same], edges["y"][same]
    columns = np.tile(edges["x_block"][same], 2), np.r_[x, y], np.r_[y, x], np.tile(edges["weight"][same], 2)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "a", "b", "weight"])


def _parts(seed: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block's refinement: single nodes join parts of their community, so every part is connected."""

    def own(have: pa.Table, link: pa.Table) -> pa.Table:
        have = have.sort_by("id")
        ids, degree, double = (have.column(c).to_numpy() for c in ("id", "degree", "double"))
        link = link.sort_by([("a", "ascending"), ("b", "ascending")])
        a, to = link.column("a").to_numpy(), np.searchsorted(ids, link.column("b").to_numpy()).tolist()
        weight, cut = link.column("weight").to_numpy().tolist(), np.searchsorted(a, np.r_[ids, np.iinfo(np.int64).max]).tolist()
        part, mass, alone = list(range(len(ids))), degree.tolist(), [True] * len(ids)
        for v in np.random.default_rng(seed).permutation(len(ids)).tolist():
            if alone[v]:
                links: dict[int, float] = {}
                for e in range(cut[v], cut[v + 1]):
                    links[part[to[e]]] = links.get(part[to[e]], 0.0) + weight[e]
                best, top = v, LEAST_GAIN
                for c, k in sorted(links.items()):
                    if c != v and k - degree[v] * mass[c] / double[v] > top:
                        best, top = c, k - degree[v] * mass[c] / double[v]
                if best != v:
                    part[v] = best
                    mass[best] += degree[v]
                    alone[v] = alone[best] = False
        return have.select(["id", "g", "label"]).append_column("part", pa.array(ids[part]))

    return own


def refined(ends: _Ends, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """(id, g, label, part): connected parts of the communities that labels (staged) tell; a part does not reach over a block's bounds."""
    blocks = -(-ends.edges // most)
    placed = stage(_dealt(labels, blocks, most, seed), "placed")
    link = ends.met(placed, "label", "block", by=_within, schema="block int, a long, b long, weight double")
    have = placed.select("block", "id", "g", "degree", "double", "label")
    found = have.groupBy("block").cogroup(link.groupBy("block")).applyInArrow(_parts(seed), "id long, g int, label long, part long")
    out = stage(found, "parts")
    drop_staged(placed)
    return out


def _folded(edges: dict[str, np.ndarray]) -> pa.RecordBatch:
    """(g, a, b, weight): edges between parts, those of a run added up."""
    a, b = np.minimum(edges["x_part"], edges["y_part"]), np.maximum(edges["x_part"], edges["y_part"])
    order = np.lexsort((b, a))
    a, b, weight = a[order], b[order], edges["weight"][order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    columns = edges["x_g"][order][first], a[first], b[first], np.add.reduceat(weight, first) if len(first) else weight
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "a", "b", "weight"])


def partition(edges: DataFrame, gather_edges: int, seed: int, local: Callable[[int, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray], np.ndarray], hubs: int = HUBS, known: tuple[DataFrame, _Ends] | None = None) -> DataFrame:
    """(id, label), staged, for the nodes of edges (g, a, b, weight; staged, a row for each pair of nodes of a graph).

    known are the nodes and ends of these edges where the caller has them.  local finishes a graph of at most gather_edges: (nodes, a, b, weight, seed, start) -> labels."""
    ready(edges.sparkSession)
    graph, place, start = edges, None, None
    while max(r.n for r in graph.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()) > gather_edges:  # a row for each graph
        own = graph is edges and known
        nodes, ends = known if own else met_by(graph, hubs)
        labels = moved(graph, nodes, start, gather_edges, seed, hubs, ends)
        parts = refined(ends, labels, gather_edges, seed)
        rows, left = parts.agg(F.count(F.lit(1)), F.count_distinct("part")).first()
        # A part's id is that of a node in it, so it lies in that node's community.
        start = stage(parts.groupBy(F.col("part").alias("id")).agg(F.min("label").alias("label")), "start")
        onward = moved_by_key(parts.select(F.col("id").alias("part"), F.col("part").alias("onward")))
        place, old = parts.select("id", "part") if place is None else stage(place.join(onward, "part").select("id", F.col("onward").alias("part")), "places"), place
        loops = graph.where("a = b").select(F.col("a").alias("id"), "weight").join(moved_by_key(parts), "id").select("g", F.col("part").alias("a"), F.col("part").alias("b"), "weight")
        folded = ends.met(parts, "part", "g", by=_folded, schema="g int, a long, b long, weight double").unionByName(loops)
        after = stage(folded.groupBy("g", "a", "b").agg(F.sum("weight").alias("weight")), "folded-edges")
        if not own:
            ends.drop()
        for x in (labels, *([] if own else [nodes]), *([graph] if graph is not edges else []), *([old, parts] if old is not None else [])):
            drop_staged(x)
        graph = after
        if left == rows:  # nothing folds any more: the communities are what they are
            return stage(place.join(moved_by_key(start).select(F.col("id").alias("part"), "label"), "part").select("id", "label"), "communities")

    def finish(have: pa.Table, link: pa.Table) -> pa.Table:
        have = have.sort_by("id")
        ids, label = have.column("id").to_numpy(), have.column("label").to_numpy()
        a, b, w = (link.column(c).to_numpy() for c in ("a", "b", "weight"))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        order = np.lexsort((b, a))
        found = local(len(ids), a[order], b[order], w[order], seed, np.unique(label, return_inverse=True)[1])
        least = np.full(int(found.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, found, ids)
        return pa.table({"part": pa.array(ids), "label": pa.array(least[found])})

    first = graph.select("g", F.explode(F.array("a", "b")).alias("id")).distinct()
    first = first.join(moved_by_key(start), "id") if start is not None else first.withColumn("label", F.col("id"))
    first = first.toDF(*first.columns)  # columns of its own, not those of graph
    ends = first.groupBy("g").cogroup(graph.groupBy("g")).applyInArrow(finish, "part long, label long")
    return stage(ends.withColumnRenamed("part", "id") if place is None else place.join(moved_by_key(ends), "part").select("id", "label"), "communities")
