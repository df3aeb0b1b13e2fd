"""Queries without SQL take whole tables: nothing is filtered out before the operator."""

import datetime as dt

import pytest

from plexgraph import queries
from plexgraph.config import Settings
from plexgraph.operators import community as C
from plexgraph.schema import ENTITIES, RELATIONS
from plexgraph.sources import bindings as B

DAY = dt.datetime(2020, 1, 2)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One region, two nations; customers 0-2 order part 0 only, 3-5 part 1 only, whatever their nation."""
    at = str(tmp_path_factory.mktemp("whole"))
    rows = {
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
        "nation": ([(0, "N0", 0), (1, "N1", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(i, f"C{i}", i % 2, "M", 1.0) for i in range(6)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string, c_acctbal double"),
        "supplier": ([(0, "S0", 0)], "s_suppkey long, s_name string, s_nationkey long"),
        "part": ([(i, f"P{i}", "T") for i in range(2)], "p_partkey long, p_name string, p_type string"),
        "orders": ([(10 * i + k, i, DAY + dt.timedelta(days=k), "1-URGENT") for i in range(6) for k in range(3)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(10 * i + k, i // 3, 0, 1) for i in range(6) for k in range(3)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long"),
    }
    for name, (have, schema) in rows.items():
        spark.createDataFrame(have, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def test_communities_are_of_all_relations(spark, folder):
    t = B.Tables(spark, folder)
    whole = C.detect(B.entities(t), B.relations(t)).collect()
    together = [set(x.entity_names) for x in whole if x.level == 0]
    assert any({"C0", "C1", "C2", "P0"} <= x for x in together) and any({"C3", "C4", "C5", "P1"} <= x for x in together)
    got = queries.QUERIES["communities_leiden"](spark, folder).collect()
    assert sorted((x.community_id, x.level, x.size) for x in got) == sorted((x.community_id, x.level, x.size) for x in whole)


def test_no_collection_is_too_large_for_levels(spark):
    """Splits below level 0 are nested and connected to it."""
    names = [f"n{g:02}{i:02}" for g in range(4) for i in range(20)]
    e = spark.createDataFrame([("c", n, "", "d", []) for n in names], ENTITIES)
    inside = [(f"n{g:02}{i:02}", f"n{g:02}{j:02}") for g in range(4) for i in range(20) for j in range(i) if (i < 10) == (j < 10) or (i + j) % 3 == 0]
    r = spark.createDataFrame([("c", a, b, "P", "", "") for a, b in [*inside, *((f"n{g:02}00", f"n{g + 1:02}00") for g in range(3))]], RELATIONS)
    got = C.detect(e, r, Settings(community_max_size=12)).collect()
    by = {x.community_id: x for x in got}
    assert {x.level for x in got} >= {0, 1} and sorted(n for x in got if x.level == 0 for n in x.entity_names) == names
    assert all(set(x.entity_names) < set(by[x.parent_community_id].entity_names) for x in got if x.level)


def test_reports_tell_all_relations(spark, folder):
    """N0: its members C0, C2, C4, S0 and itself, 4 inner relations, and what the customers ordered and S0 produces as outer ones."""
    got = {x.community_id: x for x in queries.QUERIES["reports_bottom_up"](spark, folder).collect()}
    lines = lambda members, inner, outer: 5 + members + inner + outer  # noqa: E731  the five are headings and the source
    assert set(got) == {"N0", "N1", "all R"}
    # Each customer orders one part on three days; S0 produces two parts.
    assert got["N0"].summary == f"{lines(5, 4, 3 * 3 + 2) - 1} lines"
    assert got["N1"].summary == f"{lines(4, 3, 3 * 3) - 1} lines"


def test_leiden_against_every_partition():
    """On small graphs, the modularity that is found is that of the best of all partitions, or nearly."""
    import numpy as np

    def quality(part, a, b, w):
        total, out = w.sum(), 0.0
        for c in set(part):
            own = [i for i, p in enumerate(part) if p == c]
            inner = sum(x for i, j, x in zip(a, b, w, strict=True) if i in own and j in own)
            degree = sum(x * ((i in own) + (j in own)) for i, j, x in zip(a, b, w, strict=True))
            out += inner / total - (degree / (2 * total)) ** 2
        return out

    def partitions(n):
        def grow(part, top):
            if len(part) == n:
                yield part
            else:
                for c in range(top + 2):
                    yield from grow([*part, c], max(top, c))
        yield from grow([0], 0)

    rng = np.random.default_rng(8)
    exact = 0
    for _ in range(12):
        n = 7
        edges = sorted({(min(x), max(x)) for x in rng.integers(0, n, (11, 2)).tolist() if x[0] != x[1]})
        a, b, w = np.array([e[0] for e in edges]), np.array([e[1] for e in edges]), rng.integers(1, 4, len(edges)).astype(float)
        best = max(quality(p, a, b, w) for p in partitions(n))
        got = quality(C.leiden(n, a, b, w, 42).tolist(), a, b, w)
        assert got >= 0.9 * best - 1e-9
        exact += got >= best - 1e-9
    assert exact >= 8


def test_nearest_documents_of_an_item(spark, tmp_path):
    """The context of an answer against a plain ranking by the same embeddings."""
    import numpy as np

    from plexgraph.providers import HashedNgrams

    docs = [(i, f"text {i % 7} of {'ab' * (i % 5)} and {i}") for i in range(40)]
    items = [(i, f"what of {'ab' * i} and {i}") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.query_id, r.rank, r.doc_id) for r in queries.QUERIES["local_answer_context"](spark, str(tmp_path)).collect())
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = HashedNgrams()
    score = unit(np.array(one.embed([t for _, t in items]))) @ unit(np.array(one.embed([t for _, t in docs]))).T
    want = [(q, n + 1, d) for q in range(4) for n, d in enumerate(sorted(range(40), key=lambda d: (-round(score[q, d], 12), d))[:12])]
    assert [x[:2] for x in got] == [x[:2] for x in want] and sum(a == b for a, b in zip(got, want, strict=True)) >= 44
