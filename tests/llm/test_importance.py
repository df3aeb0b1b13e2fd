"""Importance resampling against brute force, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

ROWS = "doc_id long, text string, gram_1 string, nth int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def corpus(n=70):
    r = random.Random(3)
    vocabulary = ["Sun", "moon", "ÉTÉ", "straße", "a1", "x", "Z", "日本語", "naïve", *[f"w{i}" for i in range(30)]]
    say = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\x00", "@["]) for _ in range(k))
    rows = [(i, say(r.choice([1, 5, 19, 20, 21, 60]))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " .,;"), (n + 3, say(9000)), (3, rows[3][1]), (None, say(30)), (n + 4, "İI ₂"), (None, None)]


def grams(text, orders):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def slow(rows, target, orders, buckets, percent, least, seed="2024"):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    own = Counter(place(g) for _, t in rows for g in grams(t, orders)[1])
    aim = Counter(place(g) for t in target for g in grams(t, orders)[1])
    s, t = own.total(), aim.total()
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in own}
    out = []
    for doc, text in rows:
        words, found = grams(text, orders)
        weight = sum(gain[place(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-x[4], -1 if x[0] is None else x[0]) for x in out if x[1] >= least)
    return out, len(able) * percent // 100, able


@pytest.mark.parametrize(("orders", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 10_000, 100)])
def test_weights_and_ranks_equal_brute_force(spark, orders, buckets, percent):
    from plexgraph.llm.importance import importance

    rows = corpus()
    target = ["Sun moon sun", "été w1 w2", None, ""]
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], ROWS).repartition(5)
    got = importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), orders, buckets, percent).collect()
    want, k, able = slow(rows, target, orders, buckets, percent, 20)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score) for r in got], key=key) == sorted([(d, n, w, s) for d, _, n, w, s in want], key=key)
    drawn = sorted((r.rank, -r.score, -1 if r.doc_id is None else r.doc_id) for r in got if r.rank is not None)
    assert [x[0] for x in drawn] == list(range(1, k + 1)) and [x[1:] for x in drawn] == able[:k]


def test_positions_never_cross_documents(spark):
    from plexgraph.llm.importance import positions

    docs = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, None), (4, "-e f-")], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.gram_1, r.gram_2 or "", r.gram_3 or "") for r in positions(docs, ["doc_id"], 3).where("gram_1 is not null").collect())
    assert got == [(1, "a", "a b", "a b c"), (1, "b", "b c", ""), (1, "c", "", ""), (2, "d", "", ""), (4, "e", "e f", ""), (4, "f", "", "")]


def test_resampled_rows_keep_their_columns(spark):
    from plexgraph.llm.importance import importance, resampled

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(25)), f"g{i}", i) for i in range(40)], ROWS).withColumnRenamed("nth", "drawn_id")
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    drawn = {r.doc_id for r in importance(docs, target).where("rank is not null").collect()}
    out = resampled(docs, target)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == drawn and len(drawn) == 4


def test_empty_tables(spark):
    from plexgraph.llm.importance import importance

    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert importance(none, some.select("text")).collect() == []
    got = importance(some, none.select("text"), percent=100).collect()
    assert sorted(r.rank for r in got) == [1, 2] and {r.n_features for r in got} == {30}
