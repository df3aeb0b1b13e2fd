"""The registered queries on a small folder, against brute force of what they return."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, corpus, library_ids, slow_hits, slow_print, slow_rest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in corpus(seed=5) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    items = [(1, " ".join(rows[0][1].split()[:20])), (2, "zz zz"), (10, " ".join(rows[5][1].split()[3:19]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, r[0] % 4 == 0 and 1 or 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    x = np.random.default_rng(2).normal(size=(90, 8)).astype("f4")
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    pages = [(i, f"http://h{i % 3}.net/es/{i}", f"<nav>m</nav><article><h1>t{i}</h1><p>x{i} &amp; y</article>") for i in range(12)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at, rows, items, x, pages


def ran(spark, folder, name):
    from plexgraph.llm.registry import QUERIES

    return QUERIES[name](spark, folder[0])


def test_op1(spark, folder):
    df = ran(spark, folder, "op1_sharding")
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    want = {r[0]: (len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in folder[1]}
    rows = df.collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want
    # Every cut lies between two rows, as near to its even place as rows allow: brute force over the order that the shards give.
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ends = np.cumsum([r["size"] for r in order])
    largest = max(r["size"] for r in order)
    for i in range(1, 40):
        cut = sum(r["size"] for r in order if r.shard < i)
        assert cut in {0, *ends.tolist()} and abs(cut - i * ends[-1] / 40) <= largest / 2 + 0.002 * ends[-1] / 40
    for s in range(40):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in order)))


def test_op2(spark, folder):
    """Scores, ranks and ties are exact among what is found, which is at least nine in ten of the true neighbours."""
    x = folder[3].astype(float)
    got = ran(spark, folder, "op2_permutation_index").collect()
    hits = 0
    for q in range(0, 90, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {i for _, i, _ in own} and len({i for _, i, _ in own}) == 20
        assert all(abs(s - float(np.sum(x[i] * x[q]))) < 1e-12 for _, i, s in own)
        assert own == [(n, i, s) for n, (s, i) in enumerate(sorted(((s, i) for _, i, s in own), key=lambda p: (-p[0], p[1])), 1)]
        true = sorted((-float(np.sum(x[i] * x[q])), i) for i in range(90) if i != q)[:20]
        hits += len({i for _, i in true} & {i for _, i, _ in own})
    assert {r.query_id for r in got} == set(range(0, 90, 20)) and hits >= 90


def test_op3_and_op10(spark, folder):
    rows = sorted(folder[1])
    at, want = 0, {}
    for r in rows:
        ids = library_ids(r[1])
        want[r[0]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ran(spark, folder, "op3_token_output").collect()} == want
    seen = dict.fromkeys(want, 0)
    for r in ran(spark, folder, "op10_packing").collect():
        ids = library_ids(next(x[1] for x in rows if x[0] == r.doc_id))
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {k: v[1] for k, v in want.items()}


def test_op4_and_op6(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in ran(spark, folder, "op4_wrapper").collect()}
    assert got == {i: (u, f"t{i}\n\nx{i} & y", len(f"t{i}\n\nx{i} & y")) for i, u, _ in folder[4]}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ran(spark, folder, "op6_url_filter").collect()}
    assert got == {i: (f"h{i % 3}.net", f"/es/{i}", "net/es/", "block") for i, _, _ in folder[4]}


def test_op5(spark, folder):
    """Every score is recomputed from the model's token scores and calibration, with segments by brute force."""
    import math

    from plexgraph.llm.toxicity import features, learn, tokens

    got = {r.doc_id: r for r in ran(spark, folder, "op5_toxicity").collect()}
    assert set(got) == {r[0] for r in folder[1]}
    model = learn(spark.read.parquet(f"{folder[0]}/documents.parquet"), spark.read.parquet(f"{folder[0]}/labels.parquet"))

    def best(scores, lo, hi):
        total, top, low, at = 0.0, (0.0, 0, 0), lo, lo
        for i in range(lo, hi):
            if total <= 0:
                total, at = 0.0, i
            total += scores[i]
            if total > top[0] + 1e-12:
                top = (total, at, i + 1)
        s, low, high = top
        return [] if s <= 0 else [*best(scores, lo, low), s, *best(scores, high, hi)]

    for doc, text, *_ in folder[1]:
        words = tokens(text)
        each = [next((model.scores[f] for f in features(w) if f in model.scores), 0.0) or -model.drift for w in words]
        bar = math.log(max(model.scale * max(len(words), 1) / 0.05, 1e-9))
        evidence = sum(max(0.0, model.decay * s - bar) for s in best(each, 0, len(each)))
        want = 1 / (1 + math.exp(-max(-50.0, min(50.0, model.slope * math.log1p(evidence) + model.level)))) if model.fitted else 0.0
        r = got[doc]
        assert abs(r.score - want) < 1e-9 and r.held_out == (zlib.crc32(str(doc).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)


def test_op7(spark, folder):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in ran(spark, folder, "op7_simhash").collect()}
    prints = {r[0]: slow_print(r[1]) for r in folder[1]}
    group = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    assert got == {i: (f"{p:016x}", group[i]) for i, p in prints.items()}


def test_op8(spark, folder):
    for r in ran(spark, folder, "op8_decontaminate").collect():
        n, hit, items = slow_hits(next(x[1] for x in folder[1] if x[0] == r.doc_id), folder[2])
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0)


def test_op9(spark, folder):
    want = {r[0]: (n, gone, runs, hashlib.sha256(rest).hexdigest()) for r, (n, gone, runs, rest) in zip(folder[1], slow_rest([r[1] for r in folder[1]]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ran(spark, folder, "op9_substrings").collect()} == want
