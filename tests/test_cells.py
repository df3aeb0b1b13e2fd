"""Pairs of blocks that are left out hold no pair, and of clustered vectors most are left out."""

import math

import duckdb
import numpy as np

from plexgraph.operators import cells, resolve


def clustered(n=600, groups=6, wide=0.15, seed=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, 12))
    x = centre[r.integers(0, groups, n)] + wide * r.normal(size=(n, 12))
    x[:3] = 0
    return x


def pairs(x, low, high=2.0):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(size == 0, 1, size)
    score = u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero((score > low) & (score <= high)), strict=True) if i < j}


def test_pairs_equal_brute_force_and_few_cells_meet(spark):
    x = clustered()
    df = spark.createDataFrame([("a" if i % 10 else "b", i, v.tolist()) for i, v in enumerate(x)], "collection string, name int, vector array<double>").repartition(4)
    got = {(r.a, r.b) for r in resolve.similar_pairs(df, 0.9, group=None, block_rows=40).collect()}
    assert got == {(int(i), int(j)) for i, j in pairs(x, 0.9)}
    own = {(r.a, r.b) for r in resolve.similar_pairs(df, 0.3, 0.95, block_rows=100).collect()}
    assert own == {(int(i), int(j)) for i, j in pairs(x, 0.3, 0.95) if (i % 10 == 0) == (j % 10 == 0)}
    # Two groups whose pivots are partly equal, and many rows of one vector.
    y = np.concatenate([np.repeat(x[5:6], 150, 0), x[10:160]])
    many = spark.createDataFrame([(g, g * 1000 + i, v.tolist()) for g in (0, 1) for i, v in enumerate(y * (1 if g else -1))], "collection int, name int, vector array<double>").repartition(3)
    told = {(r.a, r.b) for r in resolve.similar_pairs(many, 0.9, block_rows=30).collect()}
    assert told == {(g * 1000 + int(i), g * 1000 + int(j)) for g in (0, 1) for i, j in pairs(y, 0.9)}
    rows = df.selectExpr("'' as g", "name as k", "vector as u")
    blocks = cells.celled(rows, rows.groupBy("g").count().withColumnRenamed("count", "n"), 40)
    size = {r.block: r["count"] for r in blocks.groupBy("block").count().collect()}
    assert max(size.values()) <= 40 and sum(size.values()) == 600
    met = sum(size[r.p] * size[r.q] * (1 if r.p == r.q else 2) for r in cells.meeting(blocks, 0.9).collect())
    assert met < 0.4 * 600**2, met / 600**2


def test_bounds_hold_for_the_rounded_cosine(spark):
    # Against (1, 0): just above 0.3, just below 0.3, just above 0.35, and clearly between and beyond.
    cosines = {1: 0.3000002, 2: 0.2999998, 3: 0.3500002, 4: 0.32, 5: 0.3000008, 6: 0.36}
    df = spark.createDataFrame([("c", 0, [1.0, *[0.0] * 6])] + [("c", i, [x, *[(1 - x * x) ** 0.5 if i == j else 0.0 for j in cosines]]) for i, x in cosines.items()], "collection string, name int, vector array<double>")
    told = {block: {r.b: r.score for r in resolve.similar_pairs(df, 0.3, 0.35, digits=6, block_rows=block).where("a = 0").collect()} for block in (2048, 2)}
    assert told[2048] == told[2] == {3: 0.35, 4: 0.32, 5: 0.300001}
    assert {r.b for r in resolve.similar_pairs(df, 0.3, 0.35).where("a = 0").collect()} == {1, 4, 5}
    assert {r.b for r in resolve.similar_pairs(df, 0.3, digits=6).where("a = 0").collect()} == {3, 4, 5, 6}


def test_candidate_queries_keep_pairs_whose_shown_cosine_is_within(spark, tmp_path):
    # Against vector 0, just beside the bounds: the SQL compares what it shows.
    import __spark_entry__ as contract

    cosines = {1: 0.3000002, 2: 0.2999998, 3: 0.2500002, 4: 0.2500008, 5: 0.3500002, 6: 0.3000008}
    rows = [(0, 0, [1.0, *[0.0] * 6])] + [(i, 0, [x, *[(1 - x * x) ** 0.5 if i == j else 0.0 for j in cosines]]) for i, x in cosines.items()]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    told = {q: contract.queries()[q](spark, str(tmp_path)) for q in ("merge_candidates", "review_candidates", "similarity_pairs_band")}
    own = {q: {int(r[2]): r.score for r in df.collect() if int(r[1]) == 0} for q, df in told.items()}
    assert own["merge_candidates"] == {5: 0.35, 6: 0.300001}
    assert own["review_candidates"] == {1: 0.3, 2: 0.3, 4: 0.250001}
    assert own["similarity_pairs_band"] == {5: 0.35, 6: 0.300001}


def test_candidate_queries_round_halves_as_their_sql(spark, tmp_path):
    # Each label has a vector a of whole numbers and others whose cosine to it is t / 2,000,000 for an odd t: the seventh digit is
    # a 5, at the bounds and beside them, and what is shown hangs on the last bit.  Every sum of the SQL is exact.
    import __spark_entry__ as contract

    r = np.random.default_rng(7)
    rows = []
    for label in range(30):
        a = [int(x) for x in r.integers(1, 10, 8)]
        rows.append((len(rows), label, [*a, *[0] * 16]))
        for t in (c + 2 * k + 1 for c in (500_000, 600_000, 700_000) for k in (0, 1, 2)):
            rest, others = sum(x * x for x in a) * (2_000_000**2 - t * t), []
            while rest:
                others.append(math.isqrt(rest))
                rest -= others[-1] ** 2
            rows.append((len(rows), label, [*[t * x for x in a], *others, *[0] * (16 - len(others))]))
    spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    differ = {}
    for name in ("merge_candidates", "review_candidates", "similarity_pairs_band", "similarity_pairs_in_collection", "bridge_candidates"):
        got, want = set(map(tuple, contract.queries()[name](spark, str(tmp_path)).collect())), set(own.sql(contract.oracle_sql()[name]).fetchall())
        differ[name] = len(got ^ want)
    assert not any(differ.values()), differ
