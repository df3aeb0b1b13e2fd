"""Communities of graphs that are not gathered: against the local algorithm, at several partition counts, level by level."""

import numpy as np

from plexgraph.config import Settings
from plexgraph.operators import community as C
from plexgraph.operators.leiden import _nodes, moved, partition
from plexgraph.schema import ENTITIES, RELATIONS
from plexgraph.staging import stage


def graphs():
    """Five graphs of different shapes: (nodes, edges)."""
    r = np.random.default_rng(5)
    own = r.integers(0, 6, 300)
    planted = {(min(u, v), max(u, v)) for v in range(300) for u in [*r.choice(np.flatnonzero(own == own[v]), 5), r.integers(0, 300)] if u != v}
    ends, grown = [0, 1], {(0, 1)}
    for v in range(2, 250):
        for u in r.choice(ends, 2):
            if u != v:
                grown.add((min(u, v), max(u, v)))
                ends += [u, v]
    cliques = {(c * 6 + i, c * 6 + j) for c in range(25) for i in range(6) for j in range(i + 1, 6)} | {tuple(sorted((c * 6, (c + 1) % 25 * 6 + 1))) for c in range(25)}
    grid = {(i * 15 + j, i * 15 + j + 1) for i in range(15) for j in range(14)} | {(i * 15 + j, i * 15 + 15 + j) for i in range(14) for j in range(15)}
    stars = {(c * 12, c * 12 + i) for c in range(20) for i in range(1, 12)} | {(c * 12, c * 12 + 12) for c in range(19)}
    return [(n, sorted((int(a), int(b)) for a, b in e)) for n, e in ((300, planted), (250, grown), (150, cliques), (225, grid), (240, stars))]


def quality(part, a, b, w):
    degree = np.bincount(a, w, len(part)) + np.bincount(b, w, len(part))
    return w[part[a] == part[b]].sum() / w.sum() - ((np.bincount(part, degree) / (2 * w.sum())) ** 2).sum()


def test_distributed_rounds_come_near_the_local_algorithm(spark):
    """Within 1 % of its modularity on five graphs, and one result at every number of partitions."""
    every = graphs()
    rows = [(g, g * 1000 + a, g * 1000 + b, 1.0 + (a * b) % 2) for g, (_, edges) in enumerate(every) for a, b in edges]
    found = []
    for parts in (2, 5):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        links = stage(spark.createDataFrame(rows, "g int, a long, b long, weight double").repartition(parts), "test-edges")
        found.append({r.id: r.label for r in partition(links, 500, 42, C.leiden).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1]
    for g, (n, edges) in enumerate(every):
        a, b = np.array(edges).T
        w = 1.0 + (a * b) % 2
        got = np.array([found[0].get(g * 1000 + v, g * 1000 + v) - g * 1000 for v in range(n)])
        assert quality(got, a, b, w) >= 0.99 * quality(C.leiden(n, a, b, w, 42), a, b, w), g


def stages(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_rounds_do_not_shuffle_every_edge(spark):
    """400 nodes that all lead to 40: rounds move rows of nodes, and what they weigh in arrays; with or without hubs the labels are the same."""
    rows = [(0, a, 400 + b, 1.0 + 9.0 * (a % 5 == b % 5)) for a in range(400) for b in range(40)]
    links = stage(spark.createDataFrame(rows, "g int, a long, b long, weight double").repartition(3), "test-edges")
    nodes = stage(_nodes(links), "test-nodes")
    seen = {x.stageId() for x in stages(spark)}
    plain = {r.id: r.label for r in moved(links, nodes, None, 8000, 42, hubs=100).collect()}  # the 40
    assert sum(x.shuffleWriteRecords() for x in stages(spark) if x.stageId() not in seen) < 4 * len(rows)  # a round sent each edge from both ends, and there are three rounds at least
    assert len(plain) == 440 and len(set(plain.values())) < 40
    assert {r.id: r.label for r in moved(links, nodes, None, 8000, 42, hubs=0).collect()} == plain


def test_levels_of_a_graph_that_is_not_gathered(spark):
    """Splits below a distributed level are nested in it; small collections beside it are as ever; nodes without edges stay alone."""
    names = [f"n{g:02}{i:02}" for g in range(4) for i in range(16)]
    inside = [(f"n{g:02}{i:02}", f"n{g:02}{j:02}") for g in range(4) for i in range(16) for j in range(i) if (i < 8) == (j < 8) or (i + j) % 5 == 0]
    small = [(f"m{i}", f"m{j}") for i in range(4) for j in range(i)]
    e = spark.createDataFrame([("big", n, "", "d", []) for n in [*names, "alone"]] + [("small", f"m{i}", "", "", []) for i in range(4)], ENTITIES)
    r = spark.createDataFrame([("big", a, b, "P", "", "") for a, b in [*inside, *((f"n{g:02}00", f"n{g + 1:02}00") for g in range(3))]] + [("small", a, b, "P", "", "") for a, b in small], RELATIONS)
    settings = Settings(community_max_size=10)
    got = C.detect(e, r, settings, gather_edges=200).collect()
    by = {x.community_id: x for x in got}
    big = [x for x in got if x.collection == "big"]
    assert {x.level for x in big} >= {0, 1} and sorted(n for x in big if x.level == 0 for n in x.entity_names) == ["alone", *names]
    assert all(set(x.entity_names) < set(by[x.parent_community_id].entity_names) and by[x.parent_community_id].level == x.level - 1 for x in big if x.level)
    assert all(x.community_id == C.community_id(x.collection, x.level, x.entity_names) and x.size == len(x.entity_names) and x.graph_signature for x in got)
    plain = {str(x) for x in C.detect(e, r, settings).collect() if x.collection == "small"}
    assert {str(x) for x in got if x.collection == "small"} == plain and len(plain) == 1
    # The four groups that hold together are found by either way.
    assert {tuple(x.entity_names) for x in big if x.level == 0} == {tuple(x.entity_names) for x in C.detect(e, r, settings).collect() if x.collection == "big" and x.level == 0}


def broadcast_rows(spark, since=-1):
    """The rows of each table that a plan run after execution `since` broadcast, and the last execution."""
    store, found, last = spark._jsparkSession.sharedState().statusStore(), [], since
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        last = max(last, number)
        if number <= since:
            continue
        told, every = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (every.apply(n) for n in range(every.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(m) for m in range(metrics.size())):
                if node.name() == "BroadcastExchange" and metric.name() == "number of output rows" and told.contains(metric.accumulatorId()):
                    found.append(int(told.apply(metric.accumulatorId()).replace(",", "")))
    return found, last


def test_nothing_of_a_row_for_each_node_is_broadcast(spark, monkeypatch):
    """Names, labels, parts and communities go by key at every step, though their files are a few KB; only hubs and graphs go to every task."""
    names = [f"n{g:02}{i:02}" for g in range(12) for i in range(12)]
    inside = [(f"n{g:02}{i:02}", f"n{g:02}{j:02}") for g in range(12) for i in range(12) for j in range(i) if (i < 6) == (j < 6) or (i + j) % 5 == 0]
    bridges = [(f"n{g:02}00", f"n{g + 1:02}00") for g in range(11)]
    e = spark.createDataFrame([("big", n, "", "d", []) for n in names], ENTITIES)
    r = spark.createDataFrame([("big", a, b, "P", "", "") for a, b in [*inside, *bridges]], RELATIONS)
    e, r = stage(e, "test-entities"), stage(r, "test-relations")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    if hasattr(C, "met_by"):
        made = C.met_by
        monkeypatch.setattr(C, "met_by", lambda edges: made(edges, 0))  # a graph this small is all hubs
    plain = C.partition
    monkeypatch.setattr(C, "partition", lambda *a, **k: plain(*a, hubs=0, **k))
    _, before = broadcast_rows(spark)
    got = C.detect(e, r, Settings(community_max_size=8), gather_edges=300).collect()
    assert sorted(n for x in got if x.level == 0 for n in x.entity_names) == names and {x.level for x in got} >= {0, 1}
    found, _ = broadcast_rows(spark, before)
    assert found and max(found) <= 2  # 144 nodes, 24 communities
