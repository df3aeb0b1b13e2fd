"""Extraction, communities, reports, search, evaluation, ingest, inbox and exports with scripted providers."""

import json
import sys
from xml.etree import ElementTree

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plexgraph.config import Settings
from plexgraph.operators import community as C
from plexgraph.operators import export
from plexgraph.operators import extract as X
from plexgraph.plans import evaluate, reports, search
from plexgraph.plans import ingest as I
from plexgraph.providers import HashedNgrams, Patient, ProviderError, Router, Scripted
from plexgraph.schema import ENTITIES, RELATIONS, REPORTS, SAME_AS, TYPE_PRIORITY
from plexgraph.sources.store import Store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # scripted models are defined here


def responses(spark, *texts):
    return spark.createDataFrame([("c", "d", i, t) for i, t in enumerate(texts)], "collection string, source_id string, chunk_idx int, response string")


def said(entities=(), relations=()):
    return json.dumps({"entities": list(entities), "relations": list(relations)}, ensure_ascii=False)


def test_items_are_repaired_and_checked(spark):
    good = said([{"id": "카카오", "type": "organization", "aliases": ["k", "카카오", " k "]}], [{"subject": "카카오", "to": "제주", "predicate": "located in"}])
    bad = said([{"name": "x"}, {"name": " "}], [{"source": "a", "predicate": "p"}])
    r = responses(spark, f"```json\n{good}\n```", bad, "not json", None)
    assert [(e.name, e.type, e.aliases) for e in X.entity_items(r).collect()] == [("카카오", "ORGANIZATION", ["k"])]
    assert [(x.source, x.predicate, x.target) for x in X.relation_items(r).collect()] == [("카카오", "LOCATED_IN", "제주")]
    assert sorted(e.name for e in X.entity_items(r, strict=False).collect()) == ["x", "카카오"]


def test_reconcile(spark):
    r = responses(
        spark,
        said(
            [{"name": "제주", "type": "EVENT", "aliases": ["섬"]}, {"name": "제주", "type": "LOCATION", "description": "d", "aliases": ["섬", "탐라"]}, {"name": "2025년", "type": "DATE"}, {"name": "A", "type": "PERSON"}, {"name": "A", "type": "ORGANIZATION"}],
            [{"source": "A", "target": "제주", "predicate": "p"}, {"source": "A", "target": "제주", "predicate": "q"}, {"source": "제주", "target": "A", "predicate": "r"}, {"source": "A", "target": "30%", "predicate": "p"}, {"source": "A", "target": "새", "predicate": "p"}],
        ),
    )
    e, links = X.reconcile(X.entity_items(r), X.relation_items(r))
    got = {x.name: (x.type, x.description, x.aliases) for x in e.collect()}
    assert got == {"제주": ("LOCATION", "d", ["섬", "탐라"]), "A": ("PERSON", "", []), "새": ("OTHER", "", [])}
    assert sorted((x.source, x.predicate, x.target) for x in links.collect()) == [("A", "P", "새"), ("A", "P", "제주"), ("제주", "R", "A")]


def test_prompts_hint_at_names_in_the_chunk(spark):
    chunks = spark.createDataFrame([("c", "d", 0, "카카오가 제주에 왔다"), ("c", "d", 1, "")], "collection string, source_id string, chunk_idx int, text string")
    e = spark.createDataFrame([("c", n, "", "", []) for n in ("카카오", "제주", "서울", "왔")] + [("x", "카카오가", "", "", [])], ENTITIES)
    r = spark.createDataFrame([("c", "a", "b", "OWNS", "", "")], RELATIONS)
    got = {x.chunk_idx: x.prompt for x in X.prompts(chunks, e, r).collect()}
    assert "Known names: 왔, 제주, 카카오\n" in got[0] and "OWNS" in got[0] and "Known names" not in got[1]


def test_modes():
    assert X.extraction_mode("auto", "ollama") == "decomposed" and X.extraction_mode("auto", "x") == "single" and X.extraction_mode("single", "ollama") == "single"


def test_decomposed_extraction(spark):
    chunks = spark.createDataFrame([("c", "d", 0, "t")], "collection string, source_id string, chunk_idx int, text string")
    calls = lambda p: said([], [{"source": "김", "target": "집", "predicate": "p"}]) if p.startswith("Relations among") else said([{"name": "김", "type": "PERSON"}]) if "people" in p else said([{"name": "집", "type": "OBJECT"}]) if "objects" in p else "broken"
    e, r, _ = X.extract(chunks, spark.createDataFrame([], ENTITIES), spark.createDataFrame([], RELATIONS), Scripted(calls), mode="decomposed")
    assert sorted(x.name for x in e.collect()) == ["김", "집"] and r.count() == 1


@pytest.fixture(scope="module")
def clusters(spark):
    names, edges = [], []
    for m in range(4):
        tri = [[f"n{m}{t}{i}" for i in range(3)] for t in range(2)]
        names += tri[0] + tri[1]
        edges += [(a[i], a[(i + 1) % 3]) for a in tri for i in range(3)] * 2 + [(tri[0][0], tri[1][0]), (tri[0][1], tri[1][1])]
    e = spark.createDataFrame([("c", n, "", "d", []) for n in names] + [("o", "alone", "", "", [])], ENTITIES)
    r = spark.createDataFrame([("c", a, b, f"P{i}", "", f"doc{i % 2}.md") for i, (a, b) in enumerate(edges)], RELATIONS)
    return e, r


def test_communities_are_nested_and_deterministic(spark, clusters):
    e, r = clusters
    settings = Settings(community_max_size=4)
    got = C.detect(e, r, settings).collect()
    own = [x for x in got if x.collection == "c"]
    assert {x.level for x in own} == {0, 1} and len([x for x in own if x.level == 0]) == 4
    assert sorted(n for x in own if x.level == 0 for n in x.entity_names) == sorted(x.name for x in e.where("collection = 'c'").collect())
    by = {x.community_id: x for x in own}
    assert all(set(x.entity_names) <= set(by[x.parent_community_id].entity_names) for x in own if x.level == 1)
    assert [tuple(x) for x in sorted(got)] == [tuple(x) for x in sorted(C.detect(e.repartition(3), r.repartition(2), settings).collect())]
    assert C.detect(e.limit(0), r).collect() == []


def test_reports_reuse_and_isolate_failures(spark, clusters):
    e, r = clusters
    c = C.detect(e.where("collection = 'c'"), r, Settings(community_max_size=4)).persist()
    ok = Scripted(lambda p: json.dumps({"title": "t" + str(len(p)), "summary": "s", "rating": "x"}))
    first = reports.generate_reports(c, e, r, spark.createDataFrame([], REPORTS), ok).persist()
    assert first.count() == c.count() and first.where("rating is not null").count() == 0
    fail = Scripted(lambda p: "no json")
    again = reports.generate_reports(c, e, r, first, fail)
    assert sorted(x.title for x in again.collect()) == sorted(x.title for x in first.collect())
    changed = e.withColumn("description", F.when(F.col("name") == "n000", "new").otherwise(F.col("description")))
    assert reports.generate_reports(c, changed, r, first, fail).count() == c.count() - 2  # the leaf, and no call renews its parent's other child
    assert reports.generate_reports(c, e, r, spark.createDataFrame([], REPORTS), fail).count() == 0


def test_subquestions():
    assert search.subquestions("A는 무엇인가? 그리고 B는 무엇인가?") == ["A는 무엇인가? 그리고 B는 무엇인가?", "A는 무엇인가?", "B는 무엇인가?"]
    assert search.subquestions("철수 및 영희의 관계는?") == ["철수 및 영희의 관계는?"]
    assert search.subquestions("") == [""]


@pytest.mark.parametrize(
    ("scores", "ratio", "least", "most", "want"),
    [([8, 7, 3, 2], 0.8, 1, 20, 2), ([9, 8, 7], 0.6, 1, 20, 3), ([10, 1, 1, 1, 1], 0.7, 4, 20, 4), ([6], 0.7, 2, 20, 1), ([], 0.7, 2, 20, 0), ([2] * 9, 0.3, 1, 5, 5), ([-1, -2, -3, -4], 0.5, 2, 20, 2)],
)
def test_admission(spark, scores, ratio, least, most, want):
    df = spark.createDataFrame([("q", "c", str(i), float(s)) for i, s in enumerate(scores)], "subquery string, collection string, community_id string, score double")
    assert search.admitted(df, ratio, least, most).count() == want


def test_global_answers(spark):
    embedding = HashedNgrams()
    rep = spark.createDataFrame([("c", "1", 0, "가", "나", None, None, None), ("c", "2", 0, "다", "라", None, None, None)], REPORTS)

    def answer(p):
        if p.startswith("List as JSON"):
            return '{"evidence_points": ["점"]}' if "가" in p else "broken"
        return p

    got = search.answer_global("질문?", rep, embedding, Scripted(answer))
    assert "[c/가]\n- 점" in got and got.endswith("※ MAP 호출 1/2건이 실패했습니다 — 로그를 확인하세요.")
    assert search.answer_global("질문?", rep.limit(0), embedding, Scripted(answer)) == search.NO_REPORTS
    none = search.answer_global("질문?", rep, embedding, Scripted(lambda p: '{"evidence_points": []}' if p.startswith("List") else p))
    assert "- 나" in none and "※" not in none


def test_local_answers(spark):
    e = spark.createDataFrame([("c", "홍길동", "PERSON", "도적", []), ("c", "율도국", "LOCATION", "", []), ("d", "길동", "PERSON", "다른 이", [])], ENTITIES)
    r = spark.createDataFrame([("c", "홍길동", "율도국", "RULES", "", "")], RELATIONS)
    b = spark.createDataFrame([("c", "홍길동", "d", "길동")], SAME_AS)
    told = search.graph_context(e, r, b, "홍길동은 누구?", scope=["c"])
    assert told.splitlines()[0] == "[c] 홍길동 (PERSON) 도적" and "  = [d] 길동" in told and "  -[RULES]-> 율도국" in told and "다른 이" not in told
    assert search.text_context(["a", " a ", "", "b"]) == "[본문 1]\na\n---\n[본문 2]\nb"
    chunks = spark.createDataFrame([("c", "s", 0, "율도국 이야기", HashedNgrams().embed(["율도국 이야기"])[0])], "collection string, source_id string, chunk_idx int, text string, embedding array<double>")
    assert "<-[RULES]- 홍길동" in search.answer("어디인가?", e, r, b, chunks, HashedNgrams(), Scripted(lambda p: p), ["c"])


def test_judging(spark):
    df = spark.createDataFrame([("q1", "long", "s"), ("q2", "x", "y"), ("q3", "x", "y")], "question string, answer_a string, answer_b string")
    judge = Scripted(lambda p: json.dumps({"winner": "1" if "1: long" in p else "2" if "2: long" in p else "1"}) if "q3" not in p else "?")
    won = evaluate.verdicts(evaluate.judged(df, judge))
    assert {r.question: r.winner for r in won.collect()} == {"q1": "A", "q2": "tie", "q3": "tie"}
    assert tuple(evaluate.tally(won).first()) == (1, 0, 2)
    assert evaluate.questions('```json\n["a?", "b?"]\n```', 1) == ["a?"] and evaluate.questions("1. x?\nnone\n- y?", 5) == ["x?", "y?"]


def test_providers():
    pauses, tries = [], []

    def shaky(p):
        tries.append(p)
        raise ProviderError("busy", retryable=len(tries) < 3)

    with pytest.raises(ProviderError):
        Patient(Scripted(shaky), sleep=pauses.append).generate("x")
    assert len(tries) == 3 and pauses == [5.0, 10.0]
    with pytest.raises(ValueError):
        Router({"a": Scripted(str)}, "a").get("b")


def test_ingest_store_and_inbox(spark, tmp_path):
    from plexgraph.sources.files import whole_files
    from plexgraph.streaming.inbox import drain

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "01_봄봄.md").write_text("장인은 나를 부린다.\n빙장이라고도 한다.")
    (inbox / "skip.bin").write_text("x")
    store = Store(spark, str(tmp_path / "store"))
    model = Scripted(lambda p: said([{"name": "나", "type": "PERSON"}, {"name": "장인", "type": "PERSON", "description": "d", "aliases": ["빙장"]}, {"name": "빙장", "type": "PERSON"}], [{"source": "장인", "target": "나", "predicate": "manages"}, {"source": "빙장", "target": "나", "predicate": "likes"}]))
    docs = whole_files(spark, str(inbox), "c", "*.{md,txt}")
    v1 = I.ingest(store, docs, model, HashedNgrams())
    assert sorted(r.name for r in store.table("entities").collect()) == ["장인", "화자(봄봄)"]
    assert store.table("chunks").count() == 1 and store.table("documents").count() == 1
    source = store.table("documents").first().source_id
    assert all(r.source == "장인" and r.source_doc == source for r in store.table("relations").collect())
    I.ingest(store, docs, model, HashedNgrams())
    assert store.table("documents").first().source_id == source
    (inbox / "01_봄봄.md").write_text("바뀐 글.")
    drain(spark, str(inbox), "c", lambda df, n: I.ingest(store, df, model, HashedNgrams()), str(tmp_path / "cp"), "*.{md,txt}").awaitTermination()
    assert store.table("chunks").collect()[0].text == "바뀐 글." and store.table("documents").count() == 1
    assert {r.source_doc for r in store.table("relations").collect()} == {store.table("documents").first().source_id}
    I.delete_document(store, "c", "01_봄봄.md")
    assert store.table("relations").count() == 0 and store.table("entities").count() == 2
    store.restore(v1)
    assert store.table("documents").first().source_id == source
    assert store.prune(keep=2) > 0 and store.table("documents").count() == 1
    I.delete_collection(store, "c")
    assert store.table("entities").count() == 0


def test_exports(spark):
    e = spark.createDataFrame([("c", 'A "x" & <y>', "PERSON", "", []), ("c", "B", "WORK", "d", []), ("d", "B", "WORK", "", [])], ENTITIES)
    r = spark.createDataFrame([("c", 'A "x" & <y>', "B", "P", "2020", "doc"), ("c", "B", "missing", "P", "", "")], RELATIONS)
    root = ElementTree.fromstring(export.gexf(e, r).encode())
    tags = [x.tag.rpartition("}")[2] for x in root.iter()]
    assert tags.count("node") == 3 and tags.count("edge") == 1
    assert 'A \\"x\\"' in export.html(e, r, ["c"])
    with pytest.raises(ValueError):
        export.gexf(e, r, max_nodes=1)


def make_providers():
    return Scripted(lambda p: said([{"name": "가", "type": "PERSON"}, {"name": "가 나", "type": "WORK"}, {"name": "가나", "type": "WORK"}], [{"source": "가", "target": "가나", "predicate": "p"}]) if p.startswith("Extract") else json.dumps({"title": "t", "summary": p[:20], "evidence_points": ["e"]})), HashedNgrams()


def test_command_line(spark, tmp_path, capsys):
    from plexgraph import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("가 이야기")
    go = lambda *a: cli.run(spark, ["--store", str(tmp_path / "s"), "--provider", f"{__name__}:make_providers", *a])
    go("init")
    go("ingest", "c", str(tmp_path / "in"))
    go("set-parent", "c", "root")
    go("merge")
    go("communities")
    capsys.readouterr()
    go("status")
    assert '{"what": "entities", "n": 2}' in capsys.readouterr().out.splitlines()
    go("query", "가?", "--mode", "global", "--collections", "root")
    assert '"title"' in capsys.readouterr().out
    go("query", "가?")
    go("collections")
    go("graph", "--out", str(tmp_path / "g.gexf"))
    assert (tmp_path / "g.gexf").read_text().count("<node ") == 2
    go("delete", "c", "a.txt")
    go("clean")
    go("backup", "--keep", "3")
    with pytest.raises(SystemExit):
        cli.run(spark, ["--store", str(tmp_path / "s"), "summarize-descriptions"])


def test_items_parse_a_response_once_and_are_dealt_by_chunk(spark):
    r = responses(spark, said([{"name": "A"}], [{"source": "A", "target": "B", "predicate": "p"}])).coalesce(1)
    for items in (X.entity_items(r), X.relation_items(r), X.entity_items(r, strict=False), X.relation_items(r, strict=False)):
        plan = items._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and "RepartitionByExpression [collection" in plan, plan


def test_chunks_of_one_file_are_dealt_before_a_model_is_asked(spark):
    import os

    chunks = spark.range(0, 200, 1, 1).selectExpr("'c' as collection", "string(id) as source_id", "0 as chunk_idx", "'t' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for settings, mode in ((Settings(glean_rounds=1), "single"), (Settings(), "decomposed")):
            model = Scripted(lambda p: said([{"name": f"p{os.getpid()}" + " more" * ("Already" in p), "type": "PERSON"}]))
            e, _, calls = X.extract(chunks, spark.createDataFrame([], ENTITIES), spark.createDataFrame([], RELATIONS), model, settings, mode)
            assert all(n > 1 for n in [x.n for x in calls.groupBy("turn").agg(F.count_distinct("response").alias("n")).collect()])
            assert {x.source_id for x in e.collect()} == {str(i) for i in range(200)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reconcile_equals_its_rules_by_hand_without_joins(spark):
    import random

    r = random.Random(7)
    names, kinds = ["A", "B", "새", "30%", "2025년", " ", "만"], ["PERSON", "EVENT", "DATE"]
    noise = {"30%", "2025년", " "}
    own = [("c", "d", r.randrange(4), (0, i), r.choice(names), r.choice(kinds), r.choice(["", f"d{i}"]), [f"a{i % 3}"]) for i in range(40)]
    links = [("c", "d", r.randrange(6), (1, i), r.choice(names), f"P{i}", r.choice(names), "") for i in range(40)]
    key = "collection string, source_id string, chunk_idx int, seq struct<turn:int,at:int>"
    e, good = X.reconcile(spark.createDataFrame(own, f"{key}, name string, type string, description string, aliases array<string>"), spark.createDataFrame(links, f"{key}, source string, predicate string, target string, valid_from string"))
    want, pairs = {}, {}
    for _, _, c, (_, at), name, kind, told, aliases in own:
        if name not in noise:
            want.setdefault((c, name), []).append((kind, at, told, aliases))
    want = {k: (min(v, key=lambda x: (TYPE_PRIORITY[x[0]], x[1]))[0], next((x[2] for x in v if x[2]), ""), list(dict.fromkeys(a for x in v for a in x[3]))) for k, v in want.items()}
    for _, _, c, _, a, p, b, _ in links:
        if not {a, b} & noise:
            pairs.setdefault((c, a, b), p)
            for end in (a, b):
                want.setdefault((c, end), ("OTHER", "", []))
    assert {(x.chunk_idx, x.name): (x.type, x.description, x.aliases) for x in e.collect()} == want and e.count() == len(want)
    assert {(x.chunk_idx, x.source, x.target): x.predicate for x in good.collect()} == pairs
    assert "Join" not in e._jdf.queryExecution().optimizedPlan().toString()
