"""Ingest: documents to chunks, entities and relations, committed as one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.chunking import chunks
from ..functions.text import clean_markdown, content_hash, document_label
from ..operators import extract as X
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import vectors as V
from ..providers import Embedding, LanguageModel, embedded
from ..sources.store import Store
from ..staging import stage


def chunked(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """documents (collection, source_id, file_name, content) as chunks (chunk_idx, text)."""
    cut = chunks(clean_markdown(F.col("content")), settings.chunk_size, settings.chunk_overlap)
    return documents.select("collection", "source_id", "file_name", F.posexplode(cut).alias("chunk_idx", "text"))


GRAPH = ("entities", "relations", "same_as", "entity_desc_candidates")


def ingest(store: Store, incoming: DataFrame, model: LanguageModel, embedding: Embedding, settings: Settings = DEFAULTS, mode: str = "single", parallel: int | None = None, wave: int | None = None, metered: bool = False) -> int:
    """Process what changed of incoming (collection, file_name, content); returns the new version.

    Chunks go in waves of `wave` places (all at once by default): a wave's prompts see what the waves
    before it found, and its commit holds its part of the graph with every file's progress.  An ingest
    that broke off goes on after its last wave, under the same source ids, if a file's content and
    number of chunks are as they were; else the file starts anew.  The last commit stores the documents,
    retires what they replace and ends the progress.  Only the collections of changed files are read
    and written; chunks are committed first and documents last, so between the two a reader sees new
    chunks of an old document.  metered records the calls as today's usage."""
    progress = store.table("ingest_progress")
    hashed = incoming.withColumn("content_hash", content_hash(F.col("content")))
    pending = hashed.join(progress.select("collection", "file_name", "content_hash"), ["collection", "file_name", "content_hash"], "left_semi").select(*incoming.columns)
    changed = L.needs_processing(incoming, store.table("documents")).select(*incoming.columns).unionByName(pending).distinct()
    named = L.new_source_ids(changed.withColumn("content_hash", content_hash(F.col("content"))))
    counted = L.request_counts(named, settings).withColumnRenamed("n_requests", "total_chunks")
    resumed = L.resumable(progress, counted).withColumn("source_id", F.coalesce("resumed_id", "source_id")).drop("resumed_id")
    changed = stage(resumed, "changed")
    some = touched(changed)
    cut = stage(chunked(changed, settings).join(changed.select("source_id", "first_chunk"), "source_id"), "chunks")
    vectors = cut.select("collection", "source_id", "chunk_idx", "text", embedded(F.col("text"), embedding).alias("embedding"))
    store.commit(some, chunks=V.upsert_chunks(store.table("chunks", some), vectors), ingest_progress=L.start_progress(progress, changed.withColumn("done_chunks", F.col("first_chunk"))))
    last = changed.agg(F.max("total_chunks")).first()[0] or 0
    for low in range(0, last, wave or max(1, last)):
        high = low + (wave or last)
        part = cut.where((F.col("chunk_idx") >= F.greatest(F.lit(low), "first_chunk")) & (F.col("chunk_idx") < high))
        if part.limit(1).count():
            _absorb(store, changed, part.drop("first_chunk"), some, model, settings, mode, parallel, high, metered)
    state = {n: store.table(n, some) for n in ("documents", "chunks", *GRAPH)}
    retired = L.superseded(state["documents"], changed)
    old_chunks, relations, candidates = L.without_sources(retired, state["chunks"], state["relations"], state["entity_desc_candidates"])
    return store.commit(
        some,
        documents=L.upsert_documents(state["documents"], changed.withColumn("last_modified", F.current_timestamp())), chunks=old_chunks, relations=relations, entity_desc_candidates=candidates,
        ingest_progress=L.end_progress(store.table("ingest_progress"), changed), community_build_state=L.mark_dirty(store.table("community_build_state"), changed),
    )


def touched(rows: DataFrame) -> list[str]:
    """The names of the collections of some rows; names alone, as many as a batch has collections."""
    return [r[0] for r in rows.select("collection").distinct().collect()]


def _absorb(store: Store, changed: DataFrame, cut: DataFrame, some: list[str], model: LanguageModel, settings: Settings, mode: str, parallel: int | None, done: int, metered: bool) -> None:
    """Commit what the model finds in some chunks, with the progress of their files."""
    state = {n: store.table(n, some) for n in (*GRAPH, "merge_blacklist", "ingest_progress", "api_usage")}
    found, links, calls = X.extract(cut.select("collection", "source_id", "chunk_idx", "text"), state["entities"], state["relations"], model, settings, mode, parallel)
    label = changed.select("collection", "source_id", document_label(F.col("file_name")).alias("label"))
    found, links = X.promote_first_person(found.join(label, ["collection", "source_id"]), links.join(label, ["collection", "source_id"]), F.col("label"), settings.first_person_scope)
    names = found.select("collection", F.col("name").alias("candidate")).unionByName(links.select("collection", F.explode(F.array("source", "target")).alias("candidate")))
    known = G.canonical_names(state["entities"], names, stripped=True).where("name is not null")

    def resolved(df: DataFrame, column: str) -> DataFrame:
        to = known.select("collection", F.col("candidate").alias(column), F.col("name").alias("__to"))
        return df.join(to, ["collection", column], "left").withColumn(column, F.coalesce("__to", column)).drop("__to")

    order = F.struct("source_id", "chunk_idx", "seq")
    nodes = resolved(found, "name").withColumn("seq", order)
    edges = resolved(resolved(links, "source"), "target").withColumn("seq", order).withColumn("source_doc", F.col("source_id"))
    surface = known.where("candidate <> name").select("collection", "name", F.col("candidate").alias("alias"))
    entities = G.upsert_entities(state["entities"], nodes)
    merges, aliases = X.coref_fold(entities, state["relations"], nodes, state["merge_blacklist"])
    if not settings.coref_merge:
        merges = merges.limit(0)
    relations = G.upsert_relations(state["relations"], edges, entities)
    pairs = G.resolve_merges(merges)
    entities, relations, bridges = G.merge_entities(G.add_aliases(entities, surface.unionByName(aliases)), relations, state["same_as"], pairs)
    candidates = nodes.where("description <> ''").select("collection", F.col("name").alias("entity_name"), F.col("source_id").alias("source_doc"), "description", "seq").groupBy("collection", "entity_name", "source_doc").agg(F.max_by("description", "seq").alias("description"))
    reached = changed.select("collection", "file_name", F.least(F.lit(done), "total_chunks").alias("done_chunks"))
    out = {
        "entities": entities,
        "relations": relations,
        "entity_desc_candidates": state["entity_desc_candidates"].join(candidates, ["collection", "entity_name", "source_doc"], "left_anti").unionByName(candidates),
        "ingest_progress": L.mark_done(state["ingest_progress"], reached),
    }
    if pairs.limit(1).count():  # bridges lie between collections: they are written only if a name went
        out["same_as"] = bridges
    if metered:
        events = calls.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("ts", F.current_timestamp())
        out["api_usage"] = L.record_usage(state["api_usage"], events)
    store.commit(some, **out)


def delete_document(store: Store, collection: str, file_name: str) -> int:
    """Without one document and what came from it; its entities stay."""
    own = lambda name: store.table(name, [collection])
    docs = own("documents")
    gone = docs.where(F.col("file_name") == file_name)
    kept_chunks, relations, candidates = L.without_sources(gone, own("chunks"), own("relations"), own("entity_desc_candidates"))
    return store.commit([collection], documents=docs.join(gone, ["collection", "file_name"], "left_anti").select(*docs.columns), chunks=kept_chunks, relations=relations, entity_desc_candidates=candidates, community_build_state=L.mark_dirty(own("community_build_state"), gone))


def delete_collection(store: Store, collection: str) -> int:
    """Without a collection: documents, chunks, graph, candidates, communities and reports; its progress, blacklist and place in the hierarchy stay.  Returns the number of documents that went.

    No other collection's files are written; the bridges are, if it has any."""
    gone = store.table("documents", [collection]).count()
    old = store.table("same_as")
    *_, bridges = G.delete_collection(store.table("entities", [collection]), store.table("relations", [collection]), old, collection)
    rest = {n: store.table(n, []) for n in ("entities", "relations", "documents", "chunks", "entity_desc_candidates", "communities", "community_build_state", "community_reports")}
    if old.where((F.col("collection_lo") == collection) | (F.col("collection_hi") == collection)).limit(1).count():
        rest["same_as"] = bridges
    store.commit([collection], **rest)
    return gone


def collect_orphans(store: Store) -> int | None:
    """Drop what refers to documents that are gone, and mark the collections dirty; None if there is nothing to drop."""
    c, r, d = store.table("chunks"), store.table("relations"), store.table("entity_desc_candidates")
    gone = stage(L.orphans(c, r, d, store.table("documents"), store.table("ingest_progress")), "orphans")
    docs = gone.withColumnRenamed("source_id", "source_doc")
    hit = c.join(gone, "source_id", "left_semi").select("collection").unionByName(r.join(docs, "source_doc", "left_semi").select("collection"))
    some = touched(hit.unionByName(d.join(docs, "source_doc", "left_semi").select("collection")))
    if not some:
        return None
    kept = L.without_sources(gone, *[store.table(n, some) for n in ("chunks", "relations", "entity_desc_candidates")])
    return store.commit(some, chunks=kept[0], relations=kept[1], entity_desc_candidates=kept[2], community_build_state=L.mark_dirty(store.table("community_build_state", some), hit))
