"""Each operator against brute force or a round trip, and on nulls, empties, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(r):
    return "".join(r.choice(["th", "er", "on", "an", "ß", "é", "ing", "ed", "Ou"]) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 150)) for _ in range(n)]
    passage = prose(r, 70)
    for i in range(0, n, 5):
        texts[i] = texts[i] + " " + passage + " " + texts[-1 - i]
    texts += [texts[3], texts[3], texts[4] + "x", "", "   ", "a  b \n\n c   ", "<|endoftext|> 日本語 x", "a" * 700, None, "ab" * 400]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[5], None, None, None), (10**12, texts[7], "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# 1 sharding


def test_shards_are_even_gapless_and_complete(spark, docs):
    from plexgraph.llm.sharding import shard_documents

    out = shard_documents(docs.withColumn("shard", docs.doc_id), 5)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in corpus())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len((r.text or "").encode()) + 16
    top = max(len((r[1] or "").encode()) + 16 for r in corpus())
    assert set(sizes) == set(range(5))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * top
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_one_text_on_a_third_of_all_rows_is_still_split(spark):
    from plexgraph.llm.sharding import shard_documents

    df = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 5)) for i in range(3000)], "doc_id long, text string")
    got = shard_documents(df, 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text) + 16
    assert max(sizes.values()) - min(sizes.values()) <= 200
    assert len({(r.shard, r.slot) for r in got}) == 3000


def test_sharding_small_tables(spark, empty):
    from plexgraph.llm.sharding import shard_documents

    assert shard_documents(empty, 4).collect() == []
    assert len(shard_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), 4).collect()) == 1


# 2 nearest neighbours


def test_nearest_matches_brute_force_and_its_exclusions(spark):
    from plexgraph.llm.permutation_index import nearest

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(601, None), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] + [1.0] * 15), (605, [1.0]), (None, [1.0] * 16), (606, []), (607, [float("inf")] * 16), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, lambda i: i % 20 == 0, k=10, share=1.0).collect()
    want = []
    for q in range(0, 600, 20):
        s = [(-float(np.sum(x[i] * x[q])), i) for i in range(600) if i != q]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(sorted(s)[:10])]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(want)


def recall(spark, x, k=20, every=50, **options):
    """The part of the true k nearest that the search finds."""
    from plexgraph.llm.permutation_index import nearest

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, lambda i: i % every == 0, k=k, **options).collect()
    hits = total = 0
    for q in range(0, len(x), every):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:k].tolist()) & {r.vec_id for r in got if r.query_id == q})
        total += k
    return hits / total


def test_nearest_recall_with_a_tenth_as_candidates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert recall(spark, x) >= 0.9
    assert recall(spark, x, block_rows=1000, query_rows=20) >= 0.9  # three blocks, three groups of queries


def test_nearest_recall_on_fifty_thousand_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert recall(spark, x, every=1000) >= 0.9


def test_nearest_of_nothing_and_of_few(spark):
    from plexgraph.llm.permutation_index import nearest

    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 2 == 0).collect() == []
    got = nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>"), lambda i: i == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 2.0), (2, 2, 2.0)]


# 3 and 10 token ids


def library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_the_library():
    from plexgraph.llm import encoding
    from plexgraph.llm._shared import tokenizer_file
    from plexgraph.llm.encoding import Encoder

    enc = Encoder(tokenizer_file(None))
    r = random.Random(3)
    signs = ["a", "B", "é", "ß", "Œ", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "1", "²", "½", "'s", "'", "!", "_", "日", "😀", " ", "can't", "<|endoftext|>", ".", "\x00"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert enc.encode(text) == library_ids(text).astype(enc.dtype).tobytes(), repr(text)
    # Many texts in one block, and blocks of several texts.
    texts = [None, *("".join(r.choice(signs) for _ in range(r.randint(0, 14))) for _ in range(3000)), *(prose(r, 300) for _ in range(40)), "zz " * 3000]
    block, encoding.BLOCK = encoding.BLOCK, 20_000
    try:
        got = [x.as_py() for low, ids in enc.encode_all(pa.array(["cut off", *texts], pa.string()).slice(1)) for x in ids]
    finally:
        encoding.BLOCK = block
    assert got == [library_ids(x).astype(enc.dtype).tobytes() for x in texts]


def test_repair_round_trip():
    from plexgraph.llm.token_output import Shard, pack_shard

    r = np.random.default_rng(5)
    for n, top in ((0, 5), (1, 5), (4000, 6), (4000, 3000), (3000, 1)):
        ids = r.integers(0, top, n).astype(np.uint32)
        cuts = np.sort(r.integers(0, n + 1, 9))
        lengths = np.diff(np.r_[0, cuts, n])
        shard = Shard(pack_shard([None, *range(1, 10)], ids, lengths, 65_000, min_count=3))
        assert np.array_equal(shard.all(), ids) and np.array_equal(shard.sizes(), lengths)
        ends = np.cumsum(lengths)
        for i in range(10):
            assert np.array_equal(shard.document(i), ids[ends[i] - lengths[i] : ends[i]])
        if n == 4000 and top == 6:
            assert len(shard.rules) and len(shard.symbols) < n * 0.7
        if top == 1:  # runs of one id compress as well
            assert len(shard.symbols) < n / 50  # ten documents, each a sum of powers of two
        # To the end: no pair inside a document is left min_count times.
        bounds = np.r_[0, shard.ends]
        left = Counter()
        for a, b in zip(bounds, bounds[1:], strict=False):
            own, i = shard.symbols[a:b].tolist(), 0
            left.update(p for p in zip(own, own[1:], strict=False) if p[0] != p[1])
            while i + 1 < len(own):
                if own[i] == own[i + 1]:
                    left[own[i], own[i]] += 1
                    i += 1
                i += 1
        assert max(left.values(), default=0) < 3


def test_token_files_hold_every_document_in_order(spark, docs, empty):
    from plexgraph.llm._shared import staged_path
    from plexgraph.llm.token_output import read_ids, write_ids

    path = staged_path(spark, "test")
    write_ids(docs, path, shard_ids=500, min_count=4)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
    at = 0
    key = lambda r: (r is not None, r or 0)
    assert [key(r.doc_id) for r in got] == sorted(key(r.doc_id) for r in got)
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((r[0], library_ids(r[1]).tobytes()) for r in corpus())
    assert sorted((r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got) == sorted((r.start, r.n_tokens, r.ids_crc32) for r in read_ids(spark, path, digest=True).collect())
    path = staged_path(spark, "test")
    write_ids(empty, path)
    assert read_ids(spark, path).collect() == read_ids(spark, path, digest=True).collect() == []


def test_packing_cuts_the_concatenation(spark, docs, empty):
    from plexgraph.llm.packing import pack

    got = pack(docs, window=64).collect()
    whole = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in whole:
        assert r.sequence_id * 64 + r.offset == at and 0 < r.length <= 64 and len(r.ids) == 4 * r.length
        assert r.continues == (r.start > 0) and r.continued == (r.start + r.length < r.doc_tokens)
        at += r.length
    texts, run = Counter(), []
    for r in whole:
        run.append(bytes(r.ids))
        if not r.continued:
            texts[(r.doc_id, b"".join(run))] += 1
            run = []
    assert texts == Counter((r[0], library_ids(r[1]).tobytes()) for r in corpus())
    assert pack(empty).collect() == []


# 4 pages


def test_main_text_of_a_page():
    from plexgraph.llm.wrapper import extract, parse

    page = (
        "<!DOCTYPE html><title>t</title><style>p{}</style><body><header><h1>Site</h1></header><nav><ul><li><a href=/>x</a></ul></nav><div class='ad-box ad'>Buy</div><!-- <p>no</p> -->"
        '<main><article><header><h1>T &amp; U</h1><p>by me</p></header><p>One <b>two<br>three<p>Four&nbsp; &lt;five<div id="comments">no</div><form><p>no</form><script>var a = "<p>no</p>";</script>'
        "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><aside>no</aside><p>end</article></main><footer>&copy; no"
    )
    assert extract(parse(page), None) == "T & U\n\nOne two three\n\nFour <five\n\na\n\nb\n\n1 2\n\n3\n\nend"
    assert extract(parse(None), None) == "" and extract(parse("<p"), None) == ""
    assert extract(parse("a < b <p>c"), None) == "a < b\n\nc"


def test_wrappers_separate_template_from_content(spark):
    from plexgraph.llm.wrapper import main_text

    r = random.Random(7)
    bodies = [[prose(r, 30).replace("\n", " ") for _ in range(3)] for _ in range(12)]
    rows = []
    for i, b in enumerate(bodies):
        text = "".join(f"<p>{x}</p>" for x in b)
        rows.append((i, f"http://a.com/{i}", f"<body><div class=top>Welcome to our site</div><div class=wrap><div class=x>Read this first</div><div class=y>{text}</div></div><div class=z>Bye</div>"))
    rows += [(20, None, None), (21, "x", ""), (22, "http://b.com/", "<article><p>only page</article>"), rows[0]]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, b in enumerate(bodies):
        assert got[i] == "\n\n".join(" ".join(x.split()) for x in b)
    assert (got[20], got[21], got[22]) == ("", "", "only page")
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string, text int")).collect() == []


def test_copies_of_one_article_are_kept(spark):
    from plexgraph.llm.wrapper import main_text

    rows = [(i, "http://a.com/", "<article><h1>H</h1><p>The very same article text.</article>") for i in range(9)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {x.text for x in got} == {"H\n\nThe very same article text."}


# 5 toxicity


def test_segments_are_all_maximal_ones():
    from plexgraph.llm.toxicity import maximal_segments

    def slow(scores):
        """Ruzzo and Tompa's recursion: the best, then both sides."""
        def best(lo, hi):
            top = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if top[0] <= 0:
                return []
            a, b = -top[2], top[3]
            return [*best(lo, a), (a, b), *best(b, hi)]
        return best(0, len(scores))

    r = random.Random(2)
    for _ in range(150):
        scores = [r.choice([-1.5, -1.5, 2.1, 5.3, 1.2]) for _ in range(r.randint(0, 14))]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = maximal_segments(places, [s if s > 0 else 0 for s in scores], 1.5)
        assert [round(s, 6) for s, _, _ in got] == [round(sum(scores[a:b]), 6) for a, b in slow(scores)]


def test_toxicity_on_held_out_rows(spark):
    from plexgraph.llm.toxicity import held_out, learn, scored, without_toxic
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        words = prose(r, 60).split()
        for _ in range(6 * toxic):
            words.insert(r.randint(0, 50), r.choice(["idiot", "moron", "zorkly", "zorken", "zorkash"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "you idiot"), rows[0]]
    labels += [(None, 1), (1000, None), labels[1]]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = scored(df, learn(df, lab)).withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [x for x in got if x.held and x.doc_id is not None and x.doc_id < 900]
    assert len(held) > 120
    assert all((x.toxicity.score >= 0.7) == (x.doc_id % 5 == 0) for x in held)
    assert all(0 <= x.toxicity.score <= 1 for x in got)
    kept = {x.doc_id for x in without_toxic(df, lab).collect()}
    assert {900, 901} <= kept and all(i % 5 for i in kept if i is not None and i < 900)


def test_toxicity_without_labels(spark, empty):
    from plexgraph.llm.toxicity import learn, scored

    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert [x.toxicity.score for x in scored(df, learn(df, none)).collect()] == [0.0]
    assert scored(empty, learn(empty, none)).collect() == []


# 6 URLs


def test_url_rules(spark):
    from plexgraph.llm.url_filter import RULES, filter_urls

    urls = ["http://WWW.Example.com/en/x?q", "https://a.www.example.com/en/", "http://example.com/enx", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/ES/", "ftp://net/fr/#", "net/fr/", "http://com", "http://com?/", "http://a.org/en/", "://", "http://a.com://b.net/fr/", None, "", "http://..com/", "http://example.com/en/a\nb"]
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")
    for bound in (10, 0):
        got = filter_urls(df.withColumn("rule", df.url), rules, broadcast_rules=bound).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            url = urls[r.page_id]
            rest = url.split("://", 1)[1] if url and "://" in url else ""
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            fit = [x for x in RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
            best = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), url
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), rules).collect() == []
    assert {r.verdict for r in filter_urls(df, rules.limit(0)).collect()} == {"allow"}


# 7 SimHash


def slow_print(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    said = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_fingerprints(spark, docs, empty):
    from plexgraph.llm.simhash import keep_one, near_duplicates

    got = near_duplicates(docs.withColumn("fp", docs.doc_id)).collect()
    rows = corpus()
    prints = [slow_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    name = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None) for g in set(group)}
    want = Counter((r[0], r[1], p, name[g]) for r, p, g in zip(rows, prints, group, strict=True))
    assert Counter((r.doc_id, r.text, r.fp % 2**64, r.component_id) for r in got) == want
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(name.values())
    assert near_duplicates(empty).collect() == []
    none = spark.createDataFrame([(None, "a b c d e"), (None, "f g h i j k"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted(r.text for r in keep_one(none).collect()) == ["a b c d e", "f g h i j k"]


def test_ball_links_find_all_pairs_within_the_radius(spark):
    from plexgraph.llm.simhash import ball_links, components

    r = random.Random(9)
    prints = []
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(12):
            prints.append(base)
            for _ in range(r.randint(1, 3)):
                base ^= 1 << r.randrange(64)
    prints = list(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {x.node: x.root for x in components(ball_links(df)).collect()}
    group = dict(zip(signed, signed, strict=True))
    for a, x in zip(signed, prints, strict=True):
        for b, y in zip(signed, prints, strict=True):
            if (x ^ y).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {k: new if g == old else g for k, g in group.items()}
    same = lambda f: {frozenset(k for k in signed if f(k) == f(q)) for q in signed}
    assert same(lambda k: found.get(k, k)) == same(group.get)


# 8 decontamination


def slow_hits(text, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = norm(text), set(), set()
    for name, item in items:
        w = norm(item)
        n = min(window, len(w))
        if not n:
            continue
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(name)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def test_decontamination_equals_brute_force(spark, docs, empty):
    from plexgraph.llm.decontaminate import decontaminate, matched

    rows = corpus()
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 60]
    items = [(1, " ".join(long[0].split()[5:25])), (2, long[1].split()[3] + " " + long[1].split()[4]), (10, " ".join(long[2].split()[:11]) + " zz"), (3, ""), (4, None), (5, " ".join(long[0].split()[10:40])), (None, " ".join(long[3].split()[2:16])), (6, "a a a"), (7, "a b c d e f g h i j k l")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 20):
        for r in matched(docs, bench, most=most).collect():
            c = r.contamination
            assert (c.n_words, c.n_hit, c["items"]) == slow_hits(r.text, items), r.text
    assert matched(empty, bench).collect() == []
    assert all(r.contamination.n_hit == 0 for r in matched(docs, bench.limit(0)).collect())
    clean = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    for r in rows:
        n, hit, _ = slow_hits(r[1], items)
        if hit > n / 2:
            assert r[0] not in clean
        elif not hit and r[0] is not None:
            assert clean[r[0]].text == r[1] and clean[r[0]].n_chars == r[4]
        elif r[0] is not None:
            assert slow_hits(clean[r[0]].text, items)[0] == n - hit


def test_automaton_on_random_sequences():
    from plexgraph.llm.decontaminate import Automaton, union

    r = random.Random(11)
    for _ in range(300):
        items = [(i, [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 9))]) for i in range(r.randint(0, 5))]
        words = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randint(0, 30))]
        hits, found = Automaton(items, 4).scan(words) if items else ([], set())
        want, names = set(), set()
        for name, w in items:
            n = min(4, len(w))
            for i in range(len(words) - n + 1 if n else 0):
                if any(w[j : j + n] == words[i : i + n] for j in range(len(w) - n + 1)):
                    want.update(range(i, i + n))
                    names.add(name)
        machine = Automaton(items, 4)
        assert {x for a, b in union(hits) for x in range(a, b)} == want
        assert {machine.names[i] for i in found} == names


# 9 substrings


def slow_rest(texts, width=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("group_classes", [5000, 0])
def test_substrings_equal_brute_force(spark, docs, empty, group_classes):
    from plexgraph.llm.substrings import deduplicated, without_repeats

    rows = corpus()
    want = Counter((r[0], *x) for r, x in zip(rows, slow_rest([r[1] for r in rows]), strict=True))
    got = Counter((r.doc_id, r.dedup.n_bytes, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in deduplicated(docs, group_classes=group_classes).collect())
    assert got == want
    assert sum(n for (_, _, n, _, _) in want) > 0
    assert deduplicated(empty).collect() == []
    text = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    for r, x in zip(rows, slow_rest([r[1] for r in rows]), strict=True):
        assert text[r[0]] == (x[3].decode("utf-8", "ignore") if x[1] else r[1])


def test_substrings_of_long_and_periodic_bytes(spark):
    from plexgraph.llm import substrings

    r = random.Random(13)
    base = "".join(r.choice("abcdefgh \0é") for _ in range(3000))
    texts = [base, "x" + base[500:900] + "y" + base[1200:1399], base[:200], base[300:499] + "!", "ab\0" * 90 + base[100:320], "\0" * 240, "q" + "\0" * 210, base[2900:] + base[:350]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    block, substrings.BLOCK = substrings.BLOCK, 700
    try:
        got = {r.doc_id: (r.dedup.n_bytes, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in substrings.deduplicated(df).collect()}
    finally:
        substrings.BLOCK = block
    assert [got[i] for i in range(len(texts))] == slow_rest(texts)


# the pipeline


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    import corpus_pipeline
    from plexgraph.llm._shared import stage

    r = random.Random(17)
    texts = [prose(r, 90) for _ in range(300)]
    toxic = set(range(0, 300, 6))
    for i in toxic:
        texts[i] += " " + " ".join(r.choice(["idiot", "moron", "scum"]) for _ in range(5)) + " " + prose(r, 20)
    texts[11] = texts[7]
    shared = prose(r, 80)
    texts[13] += shared + prose(r, 60)
    texts[14] += prose(r, 40) + shared
    item = prose(r, 30)
    texts[17] += " . " + item + " . " + prose(r, 30)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    assert not toxic & set(seen["toxicity"]) and len(seen["toxicity"]) == 250
    assert set(seen["toxicity"]) - set(seen["simhash"]) == {11}
    assert shared not in seen["substrings"][13] and shared not in seen["substrings"][14]
    changed = {i for i, t in seen["substrings"].items() if t != texts[i]}
    assert changed == {13, 14}
    assert slow_hits(seen["decontaminate"][17], [(1, item)])[1] == 0
    assert {i for i, t in seen["decontaminate"].items() if t != texts[i]} == {13, 14, 17}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(seen["decontaminate"])
    for i, t in seen["decontaminate"].items():
        assert b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)) == library_ids(t).tobytes()


def test_digests(spark):
    assert zlib.crc32(b"") == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
