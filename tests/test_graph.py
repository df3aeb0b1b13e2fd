"""Graph writes and reads, resolution, collections and lifecycle: literal cases."""

import pytest
from pyspark.sql import functions as F

from plexgraph.operators import graph as G
from plexgraph.operators import lifecycle as L
from plexgraph.operators import resolve as R
from plexgraph.operators import scope as S
from plexgraph.schema import BLACKLIST, BUILD_STATE, ENTITIES, RELATIONS, SAME_AS


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def graph(spark):
    e = spark.createDataFrame([("c", n, "PERSON", "", []) for n in ("A", "B", "C", "D", "외톨이")] + [("d", "A", "WORK", "other", ["a"])], ENTITIES)
    r = spark.createDataFrame([("c", "B", "C", "P", "", "1"), ("c", "D", "B", "P", "", "2"), ("c", "B", "C", "P", "2020", "1"), ("c", "A", "A", "SELF", "", "3")], RELATIONS)
    b = spark.createDataFrame([("c", "B", "d", "A")], SAME_AS)
    return e, r, b


def test_entity_upsert(spark):
    state = spark.createDataFrame([("c", "x", "PERSON", "old", ["a"])], ENTITIES)
    batch = spark.createDataFrame([("c", "x", "WORK", "", 2), ("c", "x", "EVENT", "first", 1), ("c", "y", "DATE", "d", 1)], "collection string, name string, type string, description string, seq int")
    got = {r.name: r for r in G.upsert_entities(state, batch).collect()}
    assert (got["x"].type, got["x"].description, got["x"].aliases) == ("WORK", "", ["a"]) and got["y"].aliases == []
    assert {r.name: r.description for r in G.upsert_entities(state, batch, keep_nonempty=True).collect()} == {"x": "first", "y": "d"}


def test_relation_upsert(spark, graph):
    e, r, _ = graph
    batch = spark.createDataFrame([("c", "A", "B", "P", "", "d1", 1), ("c", "A", "B", "P", "", "d2", 2), ("c", "A", "B", "P", "2020", "d1", 1), ("c", "A", "missing", "P", "", "d", 1), ("d", "A", "B", "P", "", "d", 1)], RELATIONS + ", seq int")
    got = G.upsert_relations(r.limit(0), batch, e)
    assert rows(got, "source", "target", "valid_from", "source_doc") == [("A", "B", "", "d2"), ("A", "B", "2020", "d1")]


def test_merge(spark, graph):
    e, r, b = graph
    pairs = spark.createDataFrame([("c", "A", "B"), ("c", "B", "D")], "collection string, keep string, drop string")
    plan = G.resolve_merges(pairs)
    assert rows(plan) == [("c", "B", "A"), ("c", "D", "A")]
    e2, r2, b2 = G.merge_entities(e, r, b, plan.where("drop = 'B'"))
    assert rows(r2, "source", "target", "valid_from") == [("A", "A", ""), ("A", "C", ""), ("A", "C", "2020"), ("D", "A", "")]
    assert "B" not in [x[0] for x in rows(e2, "name")] and b2.count() == 0
    e3, _, b3 = G.merge_entities(e, r, b, plan.where("drop = 'B'"), carry_over=True)
    assert rows(b3) == [("c", "A", "d", "A")] and ("A", ["B"]) in [(x.name, x.aliases) for x in e3.collect()]
    cycle = spark.createDataFrame([("c", "A", "B"), ("c", "B", "A")], "collection string, keep string, drop string")
    assert rows(G.resolve_merges(cycle)) == [("c", "B", "A")]


def test_merges_by_broadcast_and_by_dealt_numbers(spark, monkeypatch):
    # A chain of 40 that ends in "0", one of three into a cycle of four, a cycle of three, and two keeps for one drop.
    chain = [("c", f"{i:02}", f"{i + 1:02}") for i in range(40)]
    rest = [("d", "B", "A"), ("d", "C", "B"), ("d", "D", "C"), ("d", "A", "D"), ("d", "C", "x"), ("d", "x", "0y"), ("d", "0y", "z"), ("e", "q", "p"), ("e", "r", "q"), ("e", "p", "r"), ("f", "n", "k"), ("f", "m", "k"), ("f", "s", "s")]
    pairs = spark.createDataFrame(chain + rest, "collection string, keep string, drop string")
    want = {("c", f"{i + 1:02}"): "00" for i in range(40)} | {("d", k): "A" for k in ("B", "C", "D", "x", "0y", "z")} | {("e", k): "p" for k in ("q", "r")} | {("f", "k"): "m"}
    for most in (G.BROADCAST_DROPS, 3):
        monkeypatch.setattr(G, "BROADCAST_DROPS", most)
        got = G.resolve_merges(pairs)
        assert {(r.collection, r.drop): r.keep for r in got.collect()} == want and got.count() == len(want)
        assert got.columns == ["collection", "drop", "keep"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 4, plan
    assert G.resolve_merges(pairs.where("false")).count() == 0


def test_reads(spark, graph):
    e, r, b = graph
    assert rows(G.isolated(e, r, ["c"])) == [("c", "외톨이")]
    assert rows(G.drop_isolated(e, r, ["c"]), "name") == [("A",), ("A",), ("B",), ("C",), ("D",)]
    assert dict(rows(G.degrees(r), "name", "degree")) == {"A": 2, "B": 3, "C": 2, "D": 1}
    assert {x.name: x.n_relations for x in G.contexts(e, r).where("collection = 'c'").collect()} == {"A": 1, "B": 3, "C": 2, "D": 1, "외톨이": 0}
    assert rows(G.outgoing(r, e.where("name = 'D'")), "other") == [("B",)]
    assert rows(G.incoming(r, e.where("name = 'B'")), "other") == [("D",)]
    assert rows(G.bridge_neighbours(b, e.where("collection = 'd'")), "other_name") == [("B",)]
    assert G.bridge_neighbours(b, scope=[]).count() == 0
    assert rows(G.delete_relations_of(r, "1"), "source") == [("A",), ("D",)]
    gone = G.delete_entities(e, r, b, e.where("name = 'B'"))
    assert (gone[0].count(), gone[1].count(), gone[2].count()) == (5, 1, 0)
    wanted = spark.createDataFrame([("d", "a"), ("d", "A"), ("c", "a"), ("c", "외톨이가")], "collection string, candidate string")
    assert {(x.collection, x.candidate): x.name for x in G.canonical_names(e, wanted, stripped=True).collect()} == {("d", "a"): "A", ("d", "A"): "A", ("c", "a"): None, ("c", "외톨이가"): "외톨이"}


def test_bridges(spark, graph):
    e, _, b = graph
    batch = spark.createDataFrame([("d", "A", "c", "C"), ("c", "C", "d", "A"), ("c", "A", "c", "A"), ("c", "A", "x", "Y")], "collection_a string, name_a string, collection_b string, name_b string")
    both = G.add_bridges(b, batch, e)
    assert rows(both) == [("c", "B", "d", "A"), ("c", "C", "d", "A")]
    assert rows(G.remove_bridges(both, batch)) == [("c", "B", "d", "A")]


def test_hierarchy(spark):
    h = spark.createDataFrame([("사업A", "본부"), ("사업B", "본부"), ("팀A1", "사업A"), ("x", "y"), ("y", "x")], "collection string, parent string")
    assert S.descendants_of(h, "본부") == ["본부", "사업A", "사업B", "팀A1"] and S.descendants_of(h, "모름") == ["모름"]
    closure = {}
    for a, d in rows(S.descendants(h)):
        closure.setdefault(a, []).append(d)
    assert closure["본부"] == ["본부", "사업A", "사업B", "팀A1"] and closure["x"] == ["x", "y"]
    assert S.expand_scope(h, "사업A, 팀A1,사업B") == ["사업A", "팀A1", "사업B"] and S.expand_scope(h, " ") is None
    with pytest.raises(ValueError):
        S.set_parent(h, "본부", "팀A1")
    assert rows(S.set_parent(h, "팀A1", "사업B").where("collection = '팀A1'")) == [("팀A1", "사업B")]


def test_duplicates_and_similar_pairs(spark):
    e = spark.createDataFrame([("c", n, "CONCEPT", "", []) for n in ("연료전지시스템", "연료전지 시스템", "연료전지-시스템", "다른")], ENTITIES)
    r = spark.createDataFrame([("c", "연료전지시스템", "다른", "P", "", "")], RELATIONS)
    assert rows(R.normalized_duplicates(e, r)) == [("c", "연료전지시스템", "연료전지 시스템"), ("c", "연료전지시스템", "연료전지-시스템")]
    black = spark.createDataFrame([("c", "연료전지 시스템", "연료전지시스템", "")], BLACKLIST)
    assert rows(R.normalized_duplicates(e, r, black)) == [("c", "연료전지시스템", "연료전지-시스템")]
    assert R.add_blacklist(black, black.select("collection", F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), "reason")).count() == 1
    assert R.remove_blacklist(black, black).count() == 0
    v = spark.createDataFrame([("c", "a", [1.0, 0.0]), ("c", "b", [0.87, 0.493]), ("c", "z", [0.0, 0.0]), ("d", "a", [1.0, 0.0])], "collection string, name string, vector array<double>")
    got = R.review_candidates(v, e, r).collect()
    assert [(x.keep, x.drop, round(x.score, 3)) for x in got] == [("a", "b", 0.87)]
    assert rows(R.bridge_candidates(v, spark.createDataFrame([], SAME_AS)), "collection", "name", "other_collection", "other_name") == [("c", "a", "d", "a")]
    assert R.bridge_candidates(v, spark.createDataFrame([("c", "a", "d", "a")], SAME_AS)).count() == 0


def test_lifecycle(spark):
    docs = spark.createDataFrame([("i1", "c", "f", "A", "h", None)], "source_id string, collection string, file_name string, content string, content_hash string, last_modified timestamp")
    incoming = spark.createDataFrame([("c", "f", "A"), ("c", "g", "B")], "collection string, file_name string, content string")
    changed = L.new_source_ids(L.needs_processing(incoming, docs))
    assert rows(changed, "file_name") == [("f",), ("g",)]
    new = L.upsert_documents(docs, changed.withColumn("last_modified", F.lit(None).cast("timestamp")))
    assert new.count() == 2 and L.needs_processing(incoming, new).count() == 0 and L.superseded(docs, changed).collect()[0][0] == "i1"
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    assert rows(L.orphans(one("source_id", "i1", "i2"), one("source_doc", "i3", ""), one("source_doc", "i4"), docs, one("source_id", "i4"))) == [("i2",), ("i3",)]
    state = L.mark_dirty(spark.createDataFrame([("c", False, "s")], BUILD_STATE), one("collection", "c"))
    assert dict(rows(L.is_dirty(state, one("collection", "c", "d")))) == {"c": True, "d": True}
    progress = spark.createDataFrame([("c", "f", "i1", "h", 5, 2)], "collection string, file_name string, source_id string, content_hash string, total_chunks int, done_chunks int")
    ask = spark.createDataFrame([("c", "f", "h", 5), ("c", "f", "h2", 5), ("c", "f", "h", 6), ("c", "g", "h", 1)], "collection string, file_name string, content_hash string, total_chunks int")
    assert [(r.first_chunk, r.resumed_id) for r in L.resumable(progress, ask).orderBy("file_name", "content_hash", "total_chunks").collect()] == [(2, "i1"), (0, "i1"), (0, None), (0, None)]
    q = L.quota(incoming, 499).first()
    assert (q.requests, q.allowed, q.parts) == (2, False, 1)


def test_large_tables_are_shared_by_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    from plexgraph.sources import bindings as B

    t = B.Tables(spark, "/root/testdata/sf0.001")
    want = {tuple(r) for r in B.written_relations(t).collect()}
    names = {tuple(r)[:4] for r in B.upserted_entities(t).collect()}
    monkeypatch.setattr(B, "TASK_ROWS", 1000)
    monkeypatch.setattr(B, "BROADCAST_ROWS", 10)
    n = -(-(2 * t.lineitem.count() + t.customer.count() + t.supplier.count()) // 1000)
    assert n > 8 and B.relation_tasks(t) == n
    relations, entities = B.written_relations(t), B.upserted_entities(t)
    assert {tuple(r) for r in relations.collect()} == want and relations.count() == len(want)
    assert {tuple(r)[:4] for r in entities.collect()} == names
    # Each shuffle of the lines has the tasks that their number asks for, not a fixed number of them.
    assert relations.where("predicate <> 'LOCATED_IN'").rdd.getNumPartitions() == n
    upserted = G.upsert_relations(relations.limit(0), B.relation_events(t), entities, tasks=n)
    assert {tuple(r) for r in upserted.collect()} == want


def test_a_relation_of_the_state_stays_without_its_ends(spark):
    e = spark.createDataFrame([("c", "a"), ("c", "b")], "collection string, name string")
    old = spark.createDataFrame([("c", "a", "gone", "P", "", "d0"), ("c", "a", "b", "P", "", "d0")], "collection string, source string, target string, predicate string, valid_from string, source_doc string")
    new = spark.createDataFrame([("c", "a", "gone", "P", "", "d1", 1), ("c", "a", "b", "P", "", None, 2), ("c", "x", "b", "P", "", "d1", 1)], "collection string, source string, target string, predicate string, valid_from string, source_doc string, seq int")
    assert {(r.source, r.target, r.source_doc) for r in G.upsert_relations(old, new, e, tasks=3).collect()} == {("a", "gone", "d0"), ("a", "b", None)}
