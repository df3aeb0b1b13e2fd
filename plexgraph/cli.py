"""A command line over a store: ingest, query, graph, communities, merges, bridges and maintenance.

Providers are given as module:function, which returns (language model, embedding); without one only
the commands that call no model work."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULTS
from .operators import export, extract, lifecycle, resolve, scope
from .operators import graph as G
from .plans import communities, evaluate, ingest, resolution, search
from .providers import HashedNgrams
from .schema import TABLES
from .sources.files import file_names, route, whole_files
from .sources.store import Store
from .streaming.inbox import one_by_one
from .workers import ready


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def _providers(args):
    if not args.provider:
        raise SystemExit("this command needs --provider module:function")
    module, _, name = args.provider.partition(":")
    return getattr(importlib.import_module(module), name)()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plexgraph")
    p.add_argument("--store", required=True)
    p.add_argument("--provider")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple) -> None:
        s = sub.add_parser(name)
        for flags, options in arguments:
            s.add_argument(*flags, **options)

    some = (("--collections",), {})
    one = (("collection",), {})
    add("init")
    flag = {"action": "store_true"}
    add(
        "ingest", one, (("folder",), {}), (("--mode",), {"default": "single"}), (("--glean",), {"type": int, "default": 0}), (("--wave",), {"type": int}), (("--metered",), flag), (("--force",), flag), (("--dry-run",), flag),
        (("--processed",), {"help": "folder that takes the files after success"}), (("--failed",), {"help": "folder that takes them after a failure"}),
    )
    add("usage", (("--day",), {"help": "yyyy-mm-dd, a Pacific date"}))
    add("delete", one, (("file_name",), {}))
    add("delete-collection", one)
    add("query", (("question",), {}), some, (("--mode",), {"default": "local", "choices": ["local", "global"]}), (("--level",), {"type": int}))
    add("graph", some, (("--out",), {"required": True}))
    add("status", some)
    add("collections")
    copies = (("--backups",), {"help": "folder for copies of the store"})
    add("merge", some, copies, (("--threshold",), {"type": float, "default": DEFAULTS.merge_threshold}))
    add("review", some, (("--low",), {"type": float, "default": DEFAULTS.review_threshold}), (("--high",), {"type": float, "default": DEFAULTS.merge_threshold}))
    add("decide", (("decisions",), {"help": "JSON lines: collection, keep, drop, approved, reason"}), copies)
    add("blacklist", some)
    pair = ((("collection",), {}), (("node_a",), {}), (("node_b",), {}))
    add("blacklist-add", *pair, (("--reason",), {"default": ""}))
    add("blacklist-remove", *pair)
    add("alias", one, (("name",), {}), (("alias",), {}))
    add("summarize-descriptions")
    add("communities", some, (("--no-reports",), flag), (("--force",), {"action": "store_true", "help": "detect unchanged collections too"}))
    add("bridge", some, (("--threshold",), {"type": float, "default": DEFAULTS.bridge_threshold}), (("--apply",), {"action": "store_true"}))
    add("set-parent", one, (("parent",), {}))
    add("unset-parent", one)
    add("eval", some, (("--count",), {"type": int, "default": 5}))
    add("backup", (("--to",), {"help": "folder for copies; without it, old versions are forgotten"}), (("--keep",), {"type": int, "default": DEFAULTS.backup_keep}))
    add("restore", (("version",), {"type": int, "nargs": "?"}), (("--copy",), {"help": "path of a copy"}))
    add("clean")
    return p


def _ingest(spark: SparkSession, store: Store, args) -> None:
    """Estimate the calls, refuse what exceeds the day's limit, process, and move the files."""
    settings = replace(DEFAULTS, glean_rounds=max(0, args.glean))
    incoming = whole_files(spark, args.folder, args.collection)
    used = lifecycle.usage_on(store.table("api_usage"))
    wanted = lifecycle.quota(incoming, used, settings).first()
    print(json.dumps({"used": used, "limit": settings.daily_limit, "requests": wanted.requests, "allowed": wanted.allowed, "parts": wanted.parts}))
    if args.dry_run or (args.metered and not wanted.allowed and not args.force):
        return
    model, embedding = _providers(args)
    # With a folder for failures a file's failure is its own.
    own = lambda docs: print(ingest.ingest(store, docs, model, embedding, settings, args.mode, wave=args.wave, metered=args.metered))
    done, bad = one_by_one(incoming, file_names(spark, args.folder), own, bool(args.failed))
    if args.processed:
        route(spark, args.folder, done, f"{args.processed.rstrip('/')}/{args.collection}")
    if bad:
        route(spark, args.folder, [name for name, _ in bad], f"{args.failed.rstrip('/')}/{args.collection}")
        raise bad[0][1]
    ingest.collect_orphans(store)


def run(spark: SparkSession, argv: list[str]) -> None:
    ready(spark)
    args = parser().parse_args(argv)
    store = Store(spark, args.store)
    t = store.table
    names = scope.expand_scope(t("collection_meta"), getattr(args, "collections", None))
    match args.command:
        case "init":
            store.commit(**{n: t(n) for n in TABLES})
        case "ingest":
            _ingest(spark, store, args)
        case "usage":
            if args.day:
                print(lifecycle.usage_on(t("api_usage"), args.day))
            else:
                _show(t("api_usage").orderBy("usage_date"))
        case "delete":
            ingest.delete_document(store, args.collection, args.file_name)
            own = [args.collection]
            store.commit(own, entities=G.drop_isolated(t("entities", own), t("relations", own), own))
        case "delete-collection":
            print(ingest.delete_collection(store, args.collection))
        case "query":
            model, embedding = _providers(args)
            state = {n: t(n) for n in ("entities", "relations", "same_as", "chunks", "community_reports", "community_build_state")}
            if args.mode == "global":
                said, whole = search.answer_either(args.question, scope.resolve_scope(names, t("entities"), t("documents")), state, embedding, model, args.level, names)
                if not whole:
                    print("The communities are older than the graph; answering from the graph.", file=sys.stderr)
                print(said)
            else:
                print(search.answer(args.question, t("entities"), t("relations"), t("same_as"), t("chunks"), embedding, model, names))
        case "graph":
            write = export.html if args.out.endswith(".html") else export.gexf
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(write(t("entities"), t("relations"), names))
        case "status":
            _show(lifecycle.status(*[scope.in_scope(t(n), names) for n in ("entities", "relations", "documents", "chunks")]))
            print(json.dumps({"what": "bytes", "n": store.size()}))
        case "collections":
            _show(scope.tree(t("collection_meta"), t("entities"), t("documents")).orderBy("collection"))
        case "merge":
            print(resolution.merge(store, _providers(args)[1] if args.provider else None, args.threshold, names, args.backups))
        case "review":
            _show(resolution.review(store, _providers(args)[1], args.low, args.high, names))
        case "decide":
            resolution.decide(store, spark.read.schema("collection string, keep string, drop string, approved boolean, reason string").json(args.decisions), args.backups)
        case "blacklist":
            _show(scope.in_scope(t("merge_blacklist"), names).orderBy("collection", "node_a", "node_b"))
        case "blacklist-add" | "blacklist-remove":
            row = spark.createDataFrame([(args.collection, args.node_a, args.node_b, getattr(args, "reason", ""))], "collection string, node_a string, node_b string, reason string")
            change = resolve.add_blacklist if args.command == "blacklist-add" else resolve.remove_blacklist
            store.commit([args.collection], merge_blacklist=change(t("merge_blacklist", [args.collection]), row))
        case "alias":
            row = spark.createDataFrame([(args.collection, args.name, args.alias)], "collection string, name string, alias string")
            store.commit([args.collection], entities=G.add_aliases(t("entities", [args.collection]), row))
        case "summarize-descriptions":
            store.commit(entities=extract.summarised(t("entities"), t("entity_desc_candidates"), _providers(args)[0], DEFAULTS.min_candidates))
        case "communities":
            anew, told = communities.build(store, None if args.no_reports else _providers(args)[0], names, force=args.force)
            print(json.dumps({"detected": anew, "reported": told}, ensure_ascii=False))
        case "bridge":
            embedding = _providers(args)[1] if args.provider else HashedNgrams()
            found = resolve.bridge_candidates(resolution.named_vectors(scope.in_scope(t("entities"), names), embedding, described=True), t("same_as"), args.threshold).persist()
            _show(found)
            if args.apply:
                batch = found.select(F.col("collection").alias("collection_a"), F.col("name").alias("name_a"), F.col("other_collection").alias("collection_b"), F.col("other_name").alias("name_b"))
                store.commit(same_as=G.add_bridges(t("same_as"), batch, t("entities")))
        case "set-parent":
            store.commit(collection_meta=scope.set_parent(t("collection_meta"), args.collection, args.parent))
        case "unset-parent":
            store.commit(collection_meta=scope.unset_parent(t("collection_meta"), args.collection))
        case "eval":
            model, embedding = _providers(args)
            told = "\n".join(r.title for r in scope.in_scope(t("community_reports"), names).orderBy("collection", "community_id").select("title").limit(50).collect())
            asked = evaluate.questions(model.generate(f"{args.count} questions as a JSON list on:\n{told}"), args.count)
            rows = [(q, search.answer(q, t("entities"), t("relations"), t("same_as"), t("chunks"), embedding, model, names), search.answer_global(q, t("community_reports"), embedding, model, scope=names)) for q in asked]
            pairs = spark.createDataFrame(rows, "question string, answer_a string, answer_b string")
            _show(evaluate.tally(evaluate.verdicts(evaluate.judged(pairs, model))))
        case "backup":
            print(store.backup(args.to, args.keep) if args.to else json.dumps({"pruned": store.prune(args.keep)}))
        case "restore":
            print(store.restore_copy(args.copy) if args.copy else store.restore(args.version))
        case "clean":
            ingest.collect_orphans(store)


def main() -> None:
    spark = SparkSession.builder.appName("plexgraph").getOrCreate()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
