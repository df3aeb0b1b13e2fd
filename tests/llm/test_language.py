"""Language identification: code lengths by a plain model, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

ROWS = "doc_id long, text string, lang string, language int, bits string"
STEMS = {"aa": ["ka", "lo", "mi", "ka "], "bb": ["stra", "ße", "und ", "ung"], "日本": ["です", "ます", "。", "語"]}


def corpus(n=240, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(STEMS))
        rows.append((i, "".join(r.choice(STEMS[lang]) for _ in range(r.choice([3, 10, 80]))), lang, 0, ""))
    return rows


def slow_trees(rows, order, least):
    """{lang: {context: Counter}} of the rows that are not held out."""
    out = defaultdict(lambda: defaultdict(Counter))
    for doc, text, lang, *_ in rows:
        if doc is not None and text is not None and lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            data = text.lower().encode()
            for i, b in enumerate(data):
                for n in range(min(order, i) + 1):
                    out[lang][data[i - n : i]][b] += 1
    return {lang: {c: x for c, x in own.items() if not c or x.total() >= least} for lang, own in out.items()}


def chances(tree, context):
    """All 256 probabilities after a context, by recursion."""
    if context is None:
        return [1 / 256] * 256
    below = chances(tree, context[1:] if context else None)
    seen = tree.get(context)
    if not seen:
        return below
    rest = sum(p for b, p in enumerate(below) if b not in seen)
    total = seen.total() + (len(seen) if rest > 1e-12 else 0)
    return [seen[b] / total if b in seen else len(seen) / total * p / rest for b, p in enumerate(below)]


def slow_bits(tree, text, order, known):
    data, out = text.lower().encode(), 0.0
    for i, b in enumerate(data):
        context = data[max(0, i - order) : i]
        if context not in known:
            known[context] = chances(tree, context)
        out -= math.log2(known[context][b])
    return out


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_equal_a_plain_model(spark, monkeypatch, order):
    from plexgraph.llm import language as m

    rows = corpus()
    docs = spark.createDataFrame(rows, ROWS).repartition(5)
    trees, want = m.learn(docs.select("doc_id", "text", "lang"), order, least=4), slow_trees(rows, order, 4)
    assert trees.languages == sorted(want)
    # Every context's bytes share out exactly one.
    alike = np.bincount(trees.classes, minlength=trees.width)
    assert np.allclose((np.exp2(-trees.bits.astype(float)) * alike[None, :, None]).sum(1), 1, atol=1e-4)
    monkeypatch.setattr(m, "LANE", 7)
    texts = [r[1] for r in rows[:40]] + ["", None, "Zebra ÿ\x00!", "ka" * 60, "K"]
    got = trees.lengths(*m.lowered(pa.array(texts, pa.string())))
    for k, lang in enumerate(trees.languages):
        known = {}
        for i, text in enumerate(texts):
            assert abs(got[i, k] - slow_bits(want[lang], text or "", order, known)) < 1e-3


def test_predictions_and_edges(spark):
    from plexgraph.llm import language as m

    rows = corpus()
    more = [(1000, None, "aa", 0, ""), (1001, "", "aa", 0, ""), (1002, "12 ,;", "bb", 0, ""), (1003, "kalo " * 30_000, None, 0, ""), (None, "straße", "aa", 0, ""), (3, rows[3][1], rows[3][2], 0, ""), (1004, "ÿ" * 40, None, 0, "")]
    docs = spark.createDataFrame(rows + more, ROWS).repartition(4)
    out = m.identified(docs, m.learn(docs.select("doc_id", "text", "lang")))
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == len(rows) + len(more)
    got = {r.doc_id: r.language for r in out.collect()}
    assert [(got[i].lang, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang == "aa" and got[None].lang == "bb" and got[1004].lang in STEMS
    right = sum(got[r[0]].lang == r[2] for r in rows)
    assert right == len(rows) and all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(spark):
    from plexgraph.llm import language as m

    rows = corpus()
    lied = [(*r[:2], "aa" if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], *r[3:]) for r in rows]
    a, b = (m.learn(spark.createDataFrame(x, ROWS).select("doc_id", "text", "lang")) for x in (rows, lied))
    assert a.languages == b.languages and np.array_equal(a.bits, b.bits) and np.array_equal(a.goto, b.goto)


def test_without_labels_and_rows(spark):
    from plexgraph.llm import language as m

    docs = spark.createDataFrame([(1, "ka lo", None, 0, "")], ROWS)
    out = m.identified(docs, m.learn(docs.select("doc_id", "text", "lang"))).collect()
    assert [(r.language.lang, r.language.score) for r in out] == [("und", 0.0)]
    assert m.identified(docs.limit(0), m.learn(docs.limit(0).select("doc_id", "text", "lang"))).collect() == []


def test_held_out_accuracy_of_the_query(spark):
    from plexgraph.llm.language import op13_language

    folder = "/root/testdata/sf0.01"
    got = op13_language(spark, folder)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    both = got.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = both.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
