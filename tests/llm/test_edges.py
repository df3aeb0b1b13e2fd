"""Columns of clashing names, very long texts, deep pages, long hosts, equal rows, and time that grows with the input."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, corpus, library_ids, prose, slow_hits, slow_print, slow_rest

EXTRA = ("best", "root", "toxicity", "contamination", "__clean", "__text", "clean", "fp", "component_id", "shard", "slot", "dedup", "row", "__row", "key", "nth", "salt", "rank", "host", "rule", "__spans", "a.b", "ids", "start", "__nth", "__hash", "part")


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)])


def kept(df, out, *replaced):
    """out's columns are df's with those of replaced at the end, and every other extra value is as it was."""
    want = [c for c in df.columns if c not in replaced]
    assert out.columns == [*want, *replaced]
    rows = out.collect()
    for r in rows:
        assert all(r[c] == f"x{i}" for i, c in enumerate(EXTRA) if c not in replaced)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(corpus(), DOCS).repartition(3))


@pytest.fixture(scope="module")
def bench(spark):
    rows = corpus()
    return spark.createDataFrame([(1, " ".join(rows[0][1].split()[:20])), (2, " ".join(rows[3][1].split()[:12]))], "item_id long, text string")


def test_clashing_columns_of_document_operators(spark, docs, bench):
    from plexgraph.llm import decontaminate, packing, sharding, simhash, substrings, token_output, toxicity
    from plexgraph.llm._shared import staged_path

    n = len(corpus())
    texts = Counter((r[0], r[1]) for r in corpus())
    lab = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, "y") for i in range(60)], "doc_id long, toxic int, toxicity string")
    whole = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    assert whole(kept(docs, sharding.shard_documents(docs, 3), "shard", "slot")) == texts
    assert whole(kept(docs, toxicity.scored(docs, toxicity.learn(docs, lab)), "toxicity")) == texts
    kept(docs, toxicity.without_toxic(docs, lab))
    assert whole(kept(docs, simhash.near_duplicates(docs), "fp", "component_id")) == texts
    kept(docs, simhash.keep_one(docs))
    for most in (10**6, 20):  # one automaton, and several
        assert whole(kept(docs, decontaminate.matched(docs, bench, most=most), "contamination")) == texts
        kept(docs, decontaminate.decontaminate(docs, bench, most=most))
    assert whole(kept(docs, substrings.deduplicated(docs), "dedup")) == texts
    kept(docs, substrings.without_repeats(docs))
    path = staged_path(spark, "test")
    token_output.write_ids(docs, path)
    assert token_output.read_ids(spark, path).count() == n
    assert packing.pack(docs).where("start = 0").count() == n


def test_clashing_columns_of_pages_and_vectors(spark):
    from plexgraph.llm.permutation_index import nearest
    from plexgraph.llm.url_filter import RULES, filter_urls
    from plexgraph.llm.wrapper import main_text

    pages = clashing(spark.createDataFrame([(i, f"http://h{i % 2}.net/es/{i}", f"<article>t{i}</article>") for i in range(12)], "page_id long, url string, html string"))
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    for bound in (10, 0):
        rows = kept(pages, filter_urls(pages, rules, broadcast_rules=bound).select(*[f"`{c}`" for c in pages.columns if c not in ("host", "rule")], "host", "rule"), "host", "rule")
        assert {(r.host, r.rule) for r in rows} == {("h0.net", "net/es/"), ("h1.net", "net/es/")}
    assert Counter(r.text for r in kept(pages, main_text(pages), "text")) == Counter(f"t{i}" for i in range(12))
    vectors = clashing(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>"))
    assert [(r.rank, r.vec_id) for r in sorted(nearest(vectors, lambda i: i == 0, k=2).collect())] == [(1, 1), (2, 2)]


def test_pipeline_keeps_columns_of_any_name(spark, docs, bench, tmp_path):
    import corpus_pipeline
    from plexgraph.llm._shared import stage

    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        now = stage(step(spark, now, str(tmp_path)), "test")
        kept(docs, now)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).where("start = 0").count() == now.count()


def test_pipeline_on_an_empty_table(spark, docs, bench, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_very_long_texts(spark):
    """Texts of about 5 MB, one of them without a space."""
    from plexgraph.llm import decontaminate, packing, sharding, simhash, substrings, token_output, toxicity
    from plexgraph.llm._shared import staged_path

    r = random.Random(23)
    base = prose(r, 400)
    long = " ".join(prose(r, 1000) + f" {i}" for i in range(900))
    assert len(long) > 5_000_000
    rows = [(1, long), (2, "x" * 300_000), (3, base), (4, "zz " + base + " yy"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    text = dict(rows)
    assert {x.doc_id for x in sharding.shard_documents(df, 2).collect()} == set(text)
    lab = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.scored(df, toxicity.learn(df, lab)).count() == 5
    assert {x.doc_id: x.fp % 2**64 for x in simhash.near_duplicates(df).collect()} == {i: slow_print(t) for i, t in rows}
    bench = spark.createDataFrame([(1, " ".join(long.split()[-300:-280])), (2, " ".join(base.split()[:12]))], "item_id long, text string")
    for x in decontaminate.matched(df, bench).collect():
        items = [(1, " ".join(long.split()[-300:-280])), (2, " ".join(base.split()[:12]))]
        assert (x.contamination.n_words, x.contamination.n_hit, x.contamination["items"]) == slow_hits(text[x.doc_id], items)
    short = [(i, t) for i, t in rows if i != 1]
    got = {x.doc_id: (x.dedup.n_bytes, x.dedup.n_removed, x.dedup.n_spans, bytes(x.dedup.kept)) for x in substrings.deduplicated(df.where("doc_id <> 1")).collect()}
    assert got == {i: w for (i, _), w in zip(short, slow_rest([t for _, t in short]), strict=True)}
    assert substrings.deduplicated(df).where("doc_id = 1").select("dedup.n_removed").first()[0] == 0
    path = staged_path(spark, "test")
    token_output.write_ids(df, path)
    assert {x.doc_id: zlib.crc32(bytes(x.ids)) for x in token_output.read_ids(spark, path).collect()} == {i: zlib.crc32(library_ids(t).tobytes()) for i, t in rows}
    pieces = packing.pack(df).where("doc_id = 1").orderBy("start").collect()
    assert b"".join(bytes(p.ids) for p in pieces) == library_ids(long).tobytes()


def test_deep_wide_and_long_pages(spark):
    from plexgraph.llm.wrapper import extract, main_text, parse

    deep = "<div>" * 5000 + "<p>deep text" + "</div>" * 5000
    steps = "".join(f"<div><p>s{i}</p>" for i in range(1500))
    wide = "<article>" + "".join(f"<h2>h{i}</h2><p>p{i}</p>" for i in range(2000)) + "</article>"
    long = "<article><p>" + "long words here " * 350_000 + "</article>"
    assert extract(parse(deep), None) == "deep text"
    pages = [deep, steps, wide, long, deep.replace("deep", "other"), wide.replace("p7<", "q7<"), "<article><p>plain</article>"]
    for same_host in (True, False):
        rows = [(i, f"http://h{0 if same_host else i}.com/{i}", p) for i, p in enumerate(pages)]
        got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got[0] == "deep text" and got[3] == ("long words here " * 350_000).strip() and got[6] == "plain"
        assert got[1] == "\n\n".join(f"s{i}" for i in range(1500))
        assert got[2] == "\n\n".join(f"h{i}\n\np{i}" for i in range(2000))


def test_the_template_decides_what_no_markup_tells():
    """Without articles, roles or telling classes: constant blocks, a varying list of links and a varying side column go."""
    from plexgraph.llm.wrapper import _mark, _numbered, _runs, extract, merge, of_page, parse

    r = random.Random(31)
    pages, want = [], []
    for i in range(12):
        body = [f"{prose(r, 40)} {i}".replace("\n", " ") for _ in range(4)]
        pages.append(f"<body><div class=a>Site name</div><div class=b><a href=/>{prose(r, 3)}</a> <a href=/>{prose(r, 3)}</a></div><div class=c><div class=d><h1>Title {i}</h1></div><div class=e>" + "".join(f"<p>{x}</p>" for x in body) + f"<p>Read more here</p></div></div><div class=f>{prose(r, 5)}</div></body>")
        want.append("\n\n".join([f"Title {i}", *[" ".join(x.split()) for x in body]]))
    trees = [parse(p) for p in pages]
    template = of_page(trees[0])
    for t in trees[1:]:
        merge(template, of_page(t))
    nth = {id(n): i for i, n in enumerate(_numbered(template))}
    seen = Counter(x for t in trees for x in {(nth[id(n)], _mark(b.text)) for b, n in _runs(t, template) if n and b.text})
    for (i, mark), n in seen.items():
        if 2 * n >= len(pages):
            _numbered(template)[i][4][str(mark)] = n
    assert [extract(t, template) for t in trees] == want


def test_parts_of_compound_classes_tell_on_pages_without_an_article():
    from plexgraph.llm.wrapper import extract, parse

    text = lambda page: extract(parse(page), None)
    sides = "<div class=site-header>Site menu</div><div class=cookie-banner>We use cookies</div>{}<div class='x ad_slot'>Buy now</div><div class=comments-area><p>nice</div><div id=site-footer>(c) 2020</div>"
    body = "<div class=story><h1>Title</h1><p>The whole text of this page.</p><p>And more of it.</p></div>"
    assert text(sides.format(body)) == "Title\n\nThe whole text of this page.\n\nAnd more of it."
    # What holds most of the text stays, however it is called, and nothing is told by has-sidebar or an article's own header.
    for name in ("layout-sidebar", "has-sidebar", "menu-page"):
        assert text(f"<div class={name}>{sides.format(body)}</div>") == text(body)
    assert text(f"<div class=no-comments><p>short</div><div class=post-header>head</div>{body}") == "short\n\nhead\n\n" + text(body)
    # An id that comes from a heading's words, in an article or at a heading.
    kept = "<article><h2 id=related-work>Related work</h2><div id=social-security><p>On it.</div><p>End.</article>"
    assert text(kept) == "Related work\n\nOn it.\n\nEnd."
    deep = "<div class=x-sidebar>" * 3000 + "<p>held by all" + "</div>" * 3000
    assert text(deep) == "held by all"


def test_the_longest_runs_are_the_region_where_nothing_holds_most(spark):
    """Eight pages whose text, side rail and comments vary alike, without names that tell."""
    from plexgraph.llm.wrapper import main_text

    r = random.Random(5)
    words = lambda n: " ".join(prose(r, n).split())
    rows, want, plain, whole = [], [], [], []
    for i in range(8):
        body = [words(40) + f" {i}" for _ in range(3)]
        rail = "".join(f"<p>{words(8)} {i}</p>" for _ in range(8))
        said = "".join(f"<div><p>{words(7)} {i}</p></div>" for _ in range(8))
        rows.append((i, f"http://a.com/{i}", f"<div class=r>{rail}</div><div class=b><h1>{words(5)} t{i}</h1>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><div class=c>{said}</div>"))
        want.append(body)
        # An article in sections of like runs is never cut.
        parts = [words(40) + f" {i}" for _ in range(5)]
        plain.append((100 + i, f"http://b.com/{i}", "".join(f"<div class=s{j}><p>{x}</p></div>" for j, x in enumerate(parts))))
        whole.append("\n\n".join(parts))
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows + plain, "page_id long, url string, html string")).collect()}
    assert [got[i].split("\n\n")[1:] for i in range(8)] == want and all(got[i].split("\n\n")[0].endswith(f"t{i}") for i in range(8))
    assert [got[100 + i] for i in range(8)] == whole


def test_pages_in_spark_are_what_extract_makes_of_them(spark):
    """Random pages of three hosts, against templates, counts and extraction one page at a time."""
    from plexgraph.llm.wrapper import CONSTANT, MIN_PAGES, _mark, _numbered, _runs, extract, main_text, merge, of_page, parse

    r = random.Random(41)
    parts = ["<p>{}</p>", "<div class=ad>{}</div>", "<h2>{}</h2>", "<ul><li>{}<li>more</ul>", "<nav>{}</nav>", "<div class=box><p>{}</p></div>", "<aside>{}</aside>", "<p>Follow us</p>", "<header><h1>{}</h1><p>by us</p></header>"]
    rows = []
    for i in range(90):
        body = "".join(r.choice(parts).format(f"{r.choice(['same words', 'é ' + str(i)])} {r.randint(0, 3)}") for _ in range(r.randint(0, 14)))
        holder = r.choice(["<article>{}</article>", "<div class=main><h1>t</h1>{}</div>", "<article>{}</article><article>second</article>", "{}", "<main>{}</main>"])
        rows.append((i, f"http://{'abc'[min(2, i % 17 // 7)]}.com/{i}", f"<body><div class=top>Site</div>{holder.format(body)}<div class=end>Bye {i % 2}</div>"))
    rows += [(200, "http://few.com/", "<article>one page</article>"), (201, None, None)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1).sortWithinPartitions("page_id")).collect()}
    host = lambda url: url.split("/")[2] if url else ""
    trees, templates, seen = {i: parse(h) for i, _, h in rows}, {}, Counter()
    for i, u, _ in rows:
        page = of_page(trees[i])
        templates[host(u)] = merge(templates[host(u)], page) if host(u) in templates else page
    for i, u, _ in rows:
        nth = {id(n): k for k, n in enumerate(_numbered(templates[host(u)]))}
        seen.update({(host(u), nth[id(n)], _mark(b.text)) for b, n in _runs(trees[i], templates[host(u)]) if n and b.text})
    for (h, k, mark), n in seen.items():
        if templates[h][1] >= MIN_PAGES and n >= CONSTANT * templates[h][1]:
            _numbered(templates[h])[k][4][str(mark)] = n
    assert got == {i: extract(trees[i], templates[host(u)]) for i, u, _ in rows}


def test_templates_are_packed_and_matched_at_any_depth():
    from plexgraph.llm.wrapper import _pack, _unpack, match, merge, of_page, parse, repeats

    page = of_page(parse("<div>" * 3000 + "x"))
    assert _unpack(_pack(page)) is not page and _pack(_unpack(_pack(page))) == _pack(page)
    assert match(page, _unpack(_pack(page))) == 3002
    merge(page, of_page(parse("<div>" * 2000 + "<p>y")))
    assert page[1] == 2
    assert repeats(list("abababc")) == [[0, 2, 4], [1, 3, 5], [6]] and repeats(list("aab")) == [[0, 1], [2]]


def test_hosts_of_very_many_labels(spark):
    from plexgraph.llm.url_filter import RULES, filter_urls

    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    host = "a." * 10_000 + "net"
    df = spark.createDataFrame([(1, f"http://{host}/es/" + "p" * 100_000), (2, f"http://{host}.org/es/"), *((i, None) for i in range(3, 40))], "page_id long, url string")
    for bound in (10, 0):
        began = time.time()
        got = {r.page_id: (r.host, r.rule, r.verdict) for r in filter_urls(df, rules, broadcast_rules=bound).collect()}
        assert got[1] == (host, "net/es/", "block") and got[2] == (host + ".org", None, "allow") and got[3] == ("", None, "allow")
        assert time.time() - began < 30


def test_rules_of_many_shapes_and_of_equal_length(spark):
    from plexgraph.llm.url_filter import filter_urls

    r = random.Random(3)
    rules = list({(".".join(r.choice("ab") for _ in range(r.randint(1, 6))), "/" + "x" * r.randint(0, 7), r.choice(["allow", "block"])) for _ in range(200)})
    rules += [("b.a", "/xx", "allow"), ("b.a", "/xx", "block")]
    hosts = [".".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(80)]
    urls = [f"http://{h}/{'x' * r.randint(0, 8)}{r.choice(['', '?q', 'y'])}" for h in hosts]
    known = {}
    for h, p, v in rules:
        known[h, p] = max(v, known.get((h, p), ""))
    df, table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    for bound in (1000, 0):
        for x in filter_urls(df, table, broadcast_rules=bound).collect():
            fit = [(len(h + p), len(h), h + p, v) for (h, p), v in known.items() if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
            best = max(fit, default=(0, 0, None, "allow"))
            assert (x.rule, x.verdict) == best[2:], x


def test_equal_rows_are_split_and_equal_texts_stay_together(spark):
    from plexgraph.llm.sharding import shard_documents

    got = shard_documents(spark.createDataFrame([(1, "the same row")] * 4000, "doc_id long, text string"), 8).collect()
    sizes = Counter(x.shard for x in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 8
    assert len({(x.shard, x.slot) for x in got}) == 4000 and all({x.slot for x in got if x.shard == s} == set(range(sizes[s])) for s in sizes)
    rows = [(i, f"text {i // 4} of a group") for i in range(4000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, tolerance=0.05).collect()
    assert all(len({x.shard for x in got if x.text == t}) == 1 for t in {r[1] for r in rows[::50]})


def test_copies_of_one_text_are_dealt_to_several_tasks(spark):
    """The ways for hot keys give what the plain ones give."""
    from plexgraph.llm import _shared, simhash, substrings

    rows = corpus()
    df = spark.createDataFrame([*[r[:2] for r in rows], *[(1000 + i, rows[3][1]) for i in range(40)]], "doc_id long, text string")
    want = Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())
    one = sorted(str(r.doc_id) for r in simhash.keep_one(df).collect())
    gone = Counter((r.doc_id, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in substrings.deduplicated(df).collect())
    found = []
    plain = _shared.hot_keys

    def hot(counts, key, total, least=4, parts=512):
        found.append(plain(counts, key, total, 4, 10**9))
        return found[-1]

    simhash.hot_keys = substrings.hot_keys = hot
    try:
        assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()) == want
        assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == one
        assert Counter((r.doc_id, r.dedup.n_removed, r.dedup.n_spans, bytes(r.dedup.kept)) for r in substrings.deduplicated(df).collect()) == gone
    finally:
        simhash.hot_keys = substrings.hot_keys = plain
    assert sum(map(bool, found)) >= 4


def spent(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


def test_segments_take_linear_time():
    from plexgraph.llm.toxicity import maximal_segments

    r = np.random.default_rng(1)
    small, large = ([min(spent(maximal_segments, list(range(n)), x, 3.0) for _ in range(3)) for x in (r.uniform(0.1, 2.9, n).tolist(), [2.9 - i / n for i in range(n)])] for n in (20_000, 160_000))
    assert all(b < 25 * a + 0.2 for a, b in zip(small, large, strict=True))


def test_automata_of_equal_words_take_linear_time():
    from plexgraph.llm.decontaminate import Automaton

    def both(n):
        Automaton([(1, [b"a"] * n), (2, [b"b", b"a"] * (n // 2))], 10).scan([b"a"] * n)

    small, large = min(spent(both, 10_000) for _ in range(2)), spent(both, 80_000)
    assert large < 25 * small + 0.3


def test_an_automaton_is_flat_and_its_size_is_checked(spark, monkeypatch):
    from plexgraph.llm import decontaminate

    r = random.Random(5)
    words = [f"w{r.randint(0, 400)}".encode() for _ in range(20_000)]
    machine = decontaminate.Automaton([(1, words)], 10)
    assert machine.nbytes() < 220 * len(words)  # of these, 160 a window for the windows' table
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 1000)
    with pytest.raises(ValueError):
        decontaminate.sent(spark, machine)


# Rows of one key


def test_rows_of_one_id_are_dealt_to_several_tasks(spark, tmp_path):
    """Null ids, one id many times and equal rows: no task writes most of them."""
    from plexgraph.llm.token_output import read_ids, write_ids

    rows = [(None, f"null {i}") for i in range(600)] + [(7, f"seven {i}") for i in range(600)] + [(9, "nine")] * 600
    write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), f"{tmp_path}/ids", shard_ids=64)
    parts = spark.read.parquet(f"{tmp_path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(parts) == 4 and max(r.n for r in parts) < 0.5 * sum(r.n for r in parts)
    got = sorted(read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 600 + [7] * 600 + [9] * 600


def test_one_row_repeated_many_times_is_folded(spark, monkeypatch):
    """Copies of a row beside another row with a shared gram: as many suffixes as for two copies, and the right rest."""
    from plexgraph.llm import substrings as m
    from tests.llm.test_operators import slow_rest

    r = random.Random(8)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = say(60)
    text = say(300) + shared + say(300)
    others = [(2, say(200) + shared + say(300)), (3, say(900)), (3, None)]
    made = []
    inner = m._surroundings
    monkeypatch.setattr(m, "_surroundings", lambda joined: made.append(inner(joined)) or made[-1])
    sizes = {}
    for copies in (2, 300):
        rows = [(1, text)] * copies + others
        got = m.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        want = slow_rest([text, text, *[t for _, t in others]])
        told = {(x.doc_id, x.text): (x.dedup.n_removed, x.dedup.n_spans, bytes(x.dedup.kept)) for x in got}
        assert len(got) == copies + 3
        for (doc, own), (_, gone, runs, rest) in zip([(1, text), *others], want[1:], strict=True):
            assert told[(doc, own)] == (gone, runs, rest)
        sizes[copies] = made[-1].count()
    assert sizes[300] == sizes[2]


def test_long_items_are_cut_into_overlapping_parts(spark):
    """An item of more words than an automaton holds: each of its windows is found, and it counts once."""
    from plexgraph.llm.decontaminate import matched

    words = [f"w{i}" for i in range(400)]
    items = [(1, " ".join(words)), (2, "zz yy")]
    docs = [(i, " ".join(words[i : i + 10])) for i in range(0, 391, 3)] + [(1000, " ".join(words)), (1001, " ".join(words[:9])), (1002, "zz yy x")]
    got = matched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=50)
    for r in got.collect():
        n, hit, found = slow_hits(r.text, items)
        assert (r.contamination.n_words, r.contamination.n_hit, sorted(r.contamination["items"])) == (n, hit, sorted(found))


def test_templates_that_travel_with_pages_and_hosts_that_are_handed_on(spark, monkeypatch):
    """Both ways to a page's template, and tasks that flush their hosts, give equal texts."""
    from plexgraph.llm import wrapper as m

    rows = [(i, f"http://h{i % 40}.net/{i}", f"<div class=z><p>menu of {i % 40}</p></div><div class=q><p>own text {i} says {i * 7}</p><p>more of {i}</p></div>") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    plain = {r.page_id: r.text for r in m.main_text(pages).collect()}
    assert all("own text" in t and "menu" not in t for t in plain.values())
    monkeypatch.setattr(m, "TOGETHER", 10)
    monkeypatch.setattr(m, "FEW_HOSTS", 4)
    monkeypatch.setattr(m, "BROADCAST_CHARS", 0)
    assert {r.page_id: r.text for r in m.main_text(pages).collect()} == plain
