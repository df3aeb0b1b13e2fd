"""Ingest as a user meets it: further turns, waves, breaking off and going on, usage, quota, moved files, copies, reviews, providers."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plexgraph.cli import run
from plexgraph.config import Settings
from plexgraph.operators import extract as X
from plexgraph.operators import graph as G
from plexgraph.operators import lifecycle as L
from plexgraph.operators import resolve
from plexgraph.plans import ingest as I
from plexgraph.operators.mentions import mentions
from plexgraph.plans import resolution
from plexgraph.providers import CommandLine, HashedNgrams, LocalHttp, ProviderError, Scripted
from plexgraph.schema import ENTITIES, RELATIONS
from plexgraph.sources.files import file_names, route
from plexgraph.sources.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNKS = "collection string, source_id string, chunk_idx int, text string"
DOCS = "collection string, file_name string, content string"


def said(*names, links=()):
    return json.dumps({"entities": [{"name": n, "type": "PERSON", "description": f"d {n}"} for n in names], "relations": [{"source": a, "predicate": "p", "target": b} for a, b in links]})


def none(spark):
    return spark.createDataFrame([], ENTITIES), spark.createDataFrame([], RELATIONS)


def test_gleaning_tells_what_is_found_and_stops(spark):
    """Chunk a gains once, b never, c's turn fails, d's first call fails: 4 + 3 + 1 calls of the 4 * 4 that are possible."""

    def answer(prompt):
        text = prompt.split("Text:\n")[1][0]
        found = prompt.split("Already found: ")[1].split("\n")[0].split(", ") if "Already found: " in prompt else []
        if text == "d" or (text == "c" and found):
            return "broken"
        if text == "a" and found:
            assert "a1" in found
            return said("a1", "a2")
        return said(f"{text}1")

    chunks = spark.createDataFrame([("k", "s", i, t) for i, t in enumerate("abcd")], CHUNKS)
    e, _, calls = X.extract(chunks, *none(spark), Scripted(answer), Settings(glean_rounds=3))
    assert sorted(r.name for r in e.collect()) == ["a1", "a2", "b1", "c1"]
    assert sorted((r.chunk_idx, r.turn) for r in calls.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]


def word_model(prompt):
    """Every word of the text is a person; a name that the prompt hints at is told in the description."""
    hint = [x for x in prompt.split("\n") if x.startswith("Known names: ")]
    words = prompt.split("Text:\n")[1].split("\nAlready found")[0].split()
    return json.dumps({"entities": [{"name": w, "type": "PERSON", "description": (hint or [""])[0]} for w in dict.fromkeys(words)], "relations": []})


TWO = Settings(chunk_size=8, chunk_overlap=0)


def test_later_waves_see_what_earlier_ones_found(spark, tmp_path):
    docs = spark.createDataFrame([("c", "f", "anna ben anna cem")], DOCS)
    for wave, told in ((None, ""), (1, "Known names: anna")):
        store = Store(spark, str(tmp_path / f"s{wave}"))
        I.ingest(store, docs, Scripted(word_model), HashedNgrams(), TWO, wave=wave)
        assert {r.name: r.description for r in store.table("entities").collect()}["cem"].startswith(told) if told else True
        assert sorted(r.name for r in store.table("entities").collect()) == ["anna", "ben", "cem"]
        assert store.table("ingest_progress").count() == 0 and store.table("documents").count() == 1 and store.table("chunks").count() == 3


def test_a_broken_ingest_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("c", "f", "anna1234ben12345cem12345"), ("c", "g", "dora")], DOCS)
    asked = []
    real = I._absorb

    def breaks(store, changed, part, *rest):
        asked.append(sorted((r.file_name, r.chunk_idx) for r in part.collect()))
        if len(asked) == 2:
            raise RuntimeError("power cut")
        return real(store, changed, part, *rest)

    monkeypatch.setattr(I, "_absorb", breaks)
    with pytest.raises(RuntimeError):
        I.ingest(store, docs, Scripted(word_model), HashedNgrams(), TWO, wave=1)
    progress = {r.file_name: r for r in store.table("ingest_progress").collect()}
    assert {k: (r.done_chunks, r.total_chunks) for k, r in progress.items()} == {"f": (1, 3), "g": (1, 1)}
    assert store.table("documents").count() == 0
    assert L.orphans(store.table("chunks"), store.table("relations"), store.table("entity_desc_candidates"), store.table("documents"), store.table("ingest_progress")).count() == 0
    I.ingest(store, docs, Scripted(word_model), HashedNgrams(), TWO, wave=1)
    assert asked == [[("f", 0), ("g", 0)], [("f", 1)], [("f", 1)], [("f", 2)]]
    assert {r.file_name: r.source_id for r in store.table("documents").collect()} == {k: r.source_id for k, r in progress.items()}
    assert store.table("ingest_progress").count() == 0
    # Another size of chunks starts the file anew, and so does another content.
    monkeypatch.setattr(I, "_absorb", real)
    other = spark.createDataFrame([("f", "h1", 3, "c"), ("f", "h2", 4, "c"), ("f", "h1", 4, "c")], "file_name string, content_hash string, total_chunks int, collection string")
    at = spark.createDataFrame([("c", "f", "s1", "h1", 3, 2)], store.table("ingest_progress").schema)
    assert sorted((r.content_hash, r.total_chunks, r.first_chunk, r.resumed_id) for r in L.resumable(at, other).collect()) == [("h1", 3, 2, "s1"), ("h1", 4, 0, "s1"), ("h2", 4, 0, None)]


def test_usage_is_recorded_only_where_it_is_metered(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for name, metered, want in (("f", False, 0), ("g", True, 4)):
        # Two chunks, each with a first turn and one further turn that brings nothing new.
        I.ingest(store, spark.createDataFrame([("c", name, "anna1234ben12345")], DOCS), Scripted(word_model), HashedNgrams(), Settings(chunk_size=8, chunk_overlap=0, glean_rounds=2), metered=metered)
        assert L.usage_on(store.table("api_usage")) == want
    assert L.usage_on(store.table("api_usage"), "2001-01-01") == 0


def test_a_deleted_collection_keeps_its_blacklist_and_progress(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    I.ingest(store, spark.createDataFrame([("c", "f", "anna")], DOCS), Scripted(word_model), HashedNgrams())
    store.commit(
        merge_blacklist=spark.createDataFrame([("c", "a", "b", "r")], store.table("merge_blacklist").schema), ingest_progress=spark.createDataFrame([("c", "z", "s", "h", 2, 1)], store.table("ingest_progress").schema),
        collection_meta=spark.createDataFrame([("c", "top")], store.table("collection_meta").schema),
    )
    I.delete_collection(store, "c")
    assert {n: store.table(n).count() for n in ("documents", "chunks", "entities", "merge_blacklist", "ingest_progress", "collection_meta")} == {"documents": 0, "chunks": 0, "entities": 0, "merge_blacklist": 1, "ingest_progress": 1, "collection_meta": 1}


def test_files_are_moved_and_not_overwritten(spark, tmp_path):
    a, b = tmp_path / "in", tmp_path / "out"
    a.mkdir()
    for text in "xy":
        (a / "f.md").write_text(text)
        (a / ".hidden").write_text("")
        assert file_names(spark, str(a)) == ["f.md"]
        route(spark, str(a), ["f.md"], str(b), clock=lambda: 12.5)
    assert (b / "f.md").read_text() == "x" and (b / "12500_f.md").read_text() == "y" and file_names(spark, str(a)) == []


def test_an_inbox_files_what_it_handled(spark, tmp_path):
    from plexgraph.streaming.inbox import drain, filed

    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a.md", "bad.md", "c.txt"):
        (inbox / name).write_text(name)
    seen = []

    def handle(documents, batch):
        rows = [r.file_name for r in documents.collect()]
        if "bad.md" in rows:
            raise ValueError("bad")
        seen.extend(rows)

    drain(spark, str(inbox), "c", filed(spark, str(inbox), handle, str(tmp_path / "done"), str(tmp_path / "failed")), str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    assert sorted(seen) == ["a.md", "c.txt"] and file_names(spark, str(inbox)) == []
    assert sorted(x.name for x in (tmp_path / "done").iterdir() if not x.name.startswith(".")) == ["a.md", "c.txt"] and (tmp_path / "failed" / "bad.md").exists()


def test_a_failure_is_its_files_own(spark, tmp_path):
    """One batch of three files, one of which fails: the others are done."""
    from plexgraph.streaming.inbox import drain, filed

    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a.md", "bad.md", "c.txt"):
        (inbox / name).write_text(name)
    seen = []

    def handle(documents, batch):
        rows = [r.file_name for r in documents.collect()]
        if "bad.md" in rows:
            raise ValueError("bad")
        seen.extend(rows)

    drain(spark, str(inbox), "c", filed(spark, str(inbox), handle, str(tmp_path / "done"), str(tmp_path / "failed")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a.md", "c.txt"] and file_names(spark, str(inbox)) == [] and (tmp_path / "failed" / "bad.md").exists()


def test_command_line_of_ingest(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setitem(sys.modules, "own_models", type(sys)("own_models"))
    sys.modules["own_models"].both = lambda: (Scripted(word_model), HashedNgrams())
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "f.md").write_text("anna ben")
    base = ["--store", str(tmp_path / "s"), "--provider", "own_models:both"]
    tail = [str(inbox), "--processed", str(tmp_path / "done"), "--failed", str(tmp_path / "failed")]
    run(spark, [*base, "ingest", "c", *tail, "--dry-run", "--glean", "2"])
    assert json.loads(capsys.readouterr().out) == {"used": 0, "limit": 500, "requests": 3, "allowed": True, "parts": 1}
    used = [(F.current_timestamp(), 499)]
    store = Store(spark, str(tmp_path / "s"))
    store.commit(api_usage=L.record_usage(store.table("api_usage"), spark.range(1).select(used[0][0].alias("ts"), F.lit(500).alias("n"))))
    run(spark, [*base, "ingest", "c", *tail, "--metered"])
    assert store.table("documents").count() == 0 and file_names(spark, str(inbox)) == ["f.md"]
    run(spark, [*base, "ingest", "c", *tail, "--metered", "--force"])
    assert store.table("documents").count() == 1 and file_names(spark, str(inbox)) == [] and (tmp_path / "done" / "c" / "f.md").exists()
    capsys.readouterr()
    run(spark, [*base, "status"])
    told = {x["what"]: x["n"] for x in map(json.loads, capsys.readouterr().out.splitlines())}
    assert told["isolated"] == 2 and told["entities"] == 2 and told["bytes"] > 0
    (inbox / "g.md").write_text("cem")
    monkeypatch.setattr(I, "ingest", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, [*base, "ingest", "c", *tail])
    assert (tmp_path / "failed" / "c" / "g.md").exists()
    # Of two files, the one that fails goes to failed, the other is done.
    (inbox / "h.md").write_text("dora emil")
    (inbox / "i.md").write_text("fritz")
    monkeypatch.undo()
    monkeypatch.setitem(sys.modules, "own_models", type(sys)("own_models"))
    sys.modules["own_models"].both = lambda: (Scripted(word_model), HashedNgrams())
    inner = I.ingest
    monkeypatch.setattr(I, "ingest", lambda store, docs, *a, **k: 1 / 0 if docs.where("file_name = 'i.md'").count() else inner(store, docs, *a, **k))
    with pytest.raises(ZeroDivisionError):
        run(spark, [*base, "ingest", "c", *tail])
    assert (tmp_path / "failed" / "c" / "i.md").exists() and (tmp_path / "done" / "c" / "h.md").exists() and store.table("documents").count() == 2
    capsys.readouterr()
    run(spark, [*base, "delete-collection", "c"])
    assert capsys.readouterr().out.strip() == "2" and store.table("documents").count() == 0


def test_copies_outlive_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    copies = []
    for n in range(3):
        store.commit(entities=spark.createDataFrame([("c", f"e{n}", "", "", [])], ENTITIES))
        copies.append(store.backup(str(tmp_path / "b"), keep=2, clock=lambda n=n: n + 1))
    assert sorted(x.name for x in (tmp_path / "b").iterdir()) == ["000000000002000", "000000000003000"]
    fresh = Store(spark, str(tmp_path / "t"))
    fresh.restore_copy(copies[1])
    assert [r.name for r in fresh.table("entities").collect()] == ["e1"]


def test_merging_equal_then_similar_and_a_review(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    names = ["Ann Lee", "ann-lee", "annleee", "Bob", "Cleo"]
    store.commit(entities=spark.createDataFrame([("c", n, "", f"d {n}", []) for n in names], ENTITIES), relations=spark.createDataFrame([("c", "Ann Lee", "Bob", "KNOWS", "", "s")], RELATIONS))
    assert resolution.merge(store, HashedNgrams(), 0.9, backups=str(tmp_path / "b")) >= 1
    assert len(list((tmp_path / "b").iterdir())) == 1
    left = {r.name: r.aliases for r in store.table("entities").collect()}
    assert "ann-lee" in left["Ann Lee"] and {"Bob", "Cleo"} <= set(left)
    assert store.table("community_build_state").where("dirty").count() == 1
    rows = spark.createDataFrame([("c", "Bob", "Cleo", True, ""), ("c", "Ann Lee", "Bob", False, "two people")], "collection string, keep string, drop string, approved boolean, reason string")
    resolution.decide(store, rows)
    assert "Cleo" not in {r.name for r in store.table("entities").collect()} and [(r.node_a, r.node_b, r.reason) for r in store.table("merge_blacklist").collect()] == [("Ann Lee", "Bob", "two people")]
    seen = resolution.review(store, HashedNgrams(), -1.0, 1.0).collect()
    assert not any({r.keep, r["drop"]} == {"Ann Lee", "Bob"} for r in seen)


def test_similar_pairs_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(4).normal(size=(60, 5))
    rows = [(f"g{i % 3 if i < 50 else 0}", f"n{i:02}", "ab"[i % 2], v.tolist()) for i, v in enumerate(x)] + [("g0", "zero", "a", [0.0] * 5), ("alone", "one", "a", [1.0] * 5)]
    df = spark.createDataFrame(rows, "collection string, name string, kind string, vector array<float>")
    u = {n: np.array(v, "f4").astype(float) / (np.linalg.norm(np.array(v, "f4").astype(float)) or 1) for _, n, _, v in rows}
    for apart in (None, "kind"):
        want = {(g, *sorted((a, b))) for i, (g, a, k, _) in enumerate(rows) for h, b, m, _ in rows[:i] if g == h and 0.2 < u[a] @ u[b] <= 0.9 and (not apart or k != m)}
        for size in (7, 1000):
            assert {(r.collection, r.a, r.b) for r in resolve.similar_pairs(df, 0.2, 0.9, apart=apart, block_rows=size).collect()} == want
    assert resolve.similar_pairs(df.limit(0), 0.2).collect() == []


def test_mentions_by_automaton_and_by_join(spark):
    names = spark.createDataFrame([("c", 1, "ab"), ("c", 2, "b"), ("c", 3, "ab"), ("c", 4, ""), ("x", 5, "a"), ("c", 6, "é日本語 and far more than sixteen")], "collection string, id long, name string")
    texts = spark.createDataFrame([("c", "t1", "xabx"), ("c", "t2", None), ("c", "t3", "é日本語 and far more than sixteen!"), ("x", "t4", "ab"), ("c", "t5", "")], "collection string, key string, text string")
    want = {("c", "t1", 1), ("c", "t1", 2), ("c", "t1", 3), ("x", "t4", 5), }
    want |= {("c", "t3", 6)}
    for most in (10**6, 0):
        got = [tuple(r) for r in mentions(texts, names, "key", "id", ["collection"], most).collect()]
        assert sorted(got) == sorted(want)


def test_bridged_pairs(spark):
    b = spark.createDataFrame([("a", "1", "b", "2")], "collection_lo string, name_lo string, collection_hi string, name_hi string")
    p = spark.createDataFrame([("a", "1", "b", "2"), ("b", "2", "a", "1"), ("a", "2", "b", "1")], "collection_a string, name_a string, collection_b string, name_b string")
    assert sorted(tuple(r) for r in G.bridged(b, p).collect()) == [("a", "1", "b", "2"), ("b", "2", "a", "1")]


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        body = {"fail": b"{}", "bad": b"no json"}.get(asked["prompt"], json.dumps({"response": f"{asked['model']} {asked['prompt']} {asked.get('format')}"}).encode())
        self.send_response(503 if asked["prompt"] == "busy" else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_http_provider_fails_closed():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = LocalHttp(f"http://127.0.0.1:{server.server_port}/api/generate", "m")
    assert model.generate("hi", json=True) == "m hi json" and model.generate("hi") == "m hi None"
    for prompt, retry in (("fail", False), ("bad", False), ("busy", True)):
        with pytest.raises(ProviderError) as e:
            model.generate(prompt)
        assert e.value.retryable is retry
    server.shutdown()
    with pytest.raises(ProviderError):
        LocalHttp("http://127.0.0.1:1/x", "m", timeout=2).generate("hi")


def test_command_line_provider_fails_closed(tmp_path):
    program = "import sys; p = sys.stdin.read(); open(p.rsplit(' ', 1)[1].strip(), 'w').write(' said ' + p.split()[0] + chr(10))"
    assert CommandLine([sys.executable, "-c", program]).generate("hi there") == "said hi"
    for command in ([sys.executable, "-c", "pass"], [sys.executable, "-c", "raise SystemExit(3)"], [str(tmp_path / "missing")]):
        with pytest.raises(ProviderError):
            CommandLine(command).generate("hi")
    with pytest.raises(ProviderError):
        CommandLine([sys.executable, "-c", "import time; time.sleep(9)"], timeout=0.5).generate("hi")


def _files(store, name):
    """The data files that a table's newest version consists of, by collection."""
    out = {}
    for r in store.table(name).select(F.input_file_name().alias("f")).distinct().collect():
        out.setdefault(r.f.split("collection=")[1].split("/")[0], set()).add(r.f)
    return out


def test_an_ingest_into_one_of_fifty_collections_writes_that_one_s_files_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    names = [f"k {i}/%[{i}]" for i in range(49)] + ["one"]
    for table, row in {
        "entities": lambda c: (c, "anna", "PERSON", "", []), "relations": lambda c: (c, "anna", "ben", "P", "", "s0"), "chunks": lambda c: (c, "s0", 0, "t", [1.0]),
        "documents": lambda c: (f"s{c}", c, "old.md", "t", "h", None), "community_build_state": lambda c: (c, False, "x"), "entity_desc_candidates": lambda c: (c, "anna", "s0", "d"),
    }.items():
        store.commit(**{table: spark.createDataFrame([row(c) for c in names], store.table(table).schema)})
    wide = ("entities", "relations", "chunks", "documents", "entity_desc_candidates", "community_build_state")
    before, counts = {n: _files(store, n) for n in wide}, {n: store.table(n).count() for n in wide}
    written = set(p for p in (tmp_path / "s" / "data").rglob("*.parquet"))
    I.ingest(store, spark.createDataFrame([("one", "new.md", "cem dora")], DOCS), Scripted(word_model), HashedNgrams())
    after = {n: _files(store, n) for n in wide}
    for n in wide:
        assert len(before[n]) == 50 and {c: f for c, f in after[n].items() if c != "one"} == {c: f for c, f in before[n].items() if c != "one"}
    fresh = {p for p in (tmp_path / "s" / "data").rglob("*.parquet")} - written
    assert fresh and all("collection=one" in str(p) or "/same_as/" in str(p) for p in fresh)
    assert store.table("documents").count() == counts["documents"] + 1 and store.table("documents", ["one"]).count() == 2
    assert sorted(r.name for r in store.table("entities", ["one"]).collect()) == ["anna", "cem", "dora"]
    assert store.table("entities", [names[3]]).collect()[0].collection == names[3] and store.table("entities", ["none"]).count() == 0 and store.table("entities", []).count() == 0
    # A collection that goes writes nothing, and pruning forgets what no kept version names.
    I.delete_collection(store, names[7])
    assert store.table("documents").count() == counts["documents"] and store.table("documents", [names[7]]).count() == 0
    store.prune(keep=1)
    assert store.table("entities").count() == 51 and len(_files(store, "entities")) == 49
    assert {p.parent.name for p in (tmp_path / "s" / "data" / "entities").rglob("*.parquet")} == {f"collection={unquote(c)}" for c in _files(store, "entities")}


def test_only_collections_that_changed_are_detected_and_reported(spark, tmp_path, monkeypatch):
    from plexgraph.operators import community
    from plexgraph.plans import communities

    store, asked, detected = Store(spark, str(tmp_path / "s")), [], []
    ring = ["a", "b", "c", "d"]
    entities = [(k, n, "", f"about {n}", []) for k in "xyz" for n in ring]
    links = [(k, n, m, "P", "", "s") for k in "xyz" for n, m in zip(ring, ring[1:] + ring[:1], strict=True)]
    store.commit(entities=spark.createDataFrame(entities, ENTITIES), relations=spark.createDataFrame(links, RELATIONS))
    model = Scripted(lambda prompt: json.dumps({"title": "t", "summary": "s", "rating": 1}))
    plain, said = community.detect, communities.reports.generate_reports
    monkeypatch.setattr(community, "detect", lambda e, r, *more: detected.append(sorted({x.collection for x in e.collect()})) or plain(e, r, *more))
    monkeypatch.setattr(communities.reports, "generate_reports", lambda c, *more: asked.append(sorted({x.collection for x in c.collect()})) or said(c, *more))
    every = list("xyz")
    assert communities.build(store) == (every, []) and store.table("community_build_state").where("dirty").count() == 3
    assert communities.build(store, model) == ([], every) and store.table("community_reports").select("collection").distinct().count() == 3
    seen, version = store.table("community_reports").count(), len(store._versions())
    assert communities.build(store, model) == ([], []) and (detected, asked) == ([every], [every]) and len(store._versions()) == version
    assert store.table("community_build_state").where("dirty").count() == 0
    # One graph changes, one collection is only marked, one goes.
    store.commit(["x"], relations=store.table("relations", ["x"]).unionByName(spark.createDataFrame([("x", "a", "c", "P", "", "s")], RELATIONS)))
    store.commit(["y"], community_build_state=L.mark_dirty(store.table("community_build_state", ["y"]), spark.createDataFrame([("y",)], "collection string")))
    store.commit(["z"], entities=store.table("entities", []), relations=store.table("relations", []))
    assert communities.build(store, model) == (["x"], ["x", "y"]) and (detected[1:], asked[1:]) == ([["x"]], [["x", "y"]])
    assert {r.collection for r in store.table("communities").collect()} == {r.collection for r in store.table("community_reports").collect()} == {"x", "y"} and seen
    assert {(r.collection, r.dirty) for r in store.table("community_build_state").collect()} == {("x", False), ("y", False)}
    assert communities.build(store, model) == ([], []) and communities.build(store, model, ["y"], force=True) == (["y"], ["y"])
