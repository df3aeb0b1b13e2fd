"""Documents and what follows from them: change detection, cascades, orphans, progress, usage and quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.chunking import chunk_count
from ..functions.text import clean_markdown, content_hash
from .scope import in_scope

FILE = ["collection", "file_name"]


def needs_processing(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """incoming (collection, file_name, content) with content_hash, where it differs from what is stored."""
    stored = documents.select(*FILE, F.col("content_hash").alias("stored"))
    own = incoming.withColumn("content_hash", content_hash(F.col("content")))
    return own.join(stored, FILE, "left").where(~F.col("content_hash").eqNullSafe(F.col("stored"))).drop("stored")


def new_source_ids(changed: DataFrame) -> DataFrame:
    """A source_id that depends on collection, file and content: a retry makes the same one."""
    return changed.withColumn("source_id", F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\x1f", *FILE, "content_hash"), 256), 1, 16)))


def upsert_documents(state: DataFrame, batch: DataFrame) -> DataFrame:
    """A row replaces those with its source_id or its (collection, file_name); of several new ones of a file the greatest source_id stays."""
    kept = state.join(batch.select("source_id").distinct(), "source_id", "left_anti").join(batch.select(*FILE).distinct(), FILE, "left_anti")
    return kept.select(*state.columns).unionByName(batch.groupBy(*FILE).agg(F.max_by(F.struct(*state.columns), "source_id").alias("row")).select("row.*"))


def superseded(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Source ids that a batch of documents retires."""
    return state.join(batch.select(*FILE, F.col("source_id").alias("new")), FILE).where("source_id <> new").select("source_id")


def without_sources(gone: DataFrame, chunk_rows: DataFrame, relations: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, relations and candidates without those of gone (source_id); entities stay."""
    ids = gone.select(F.col("source_id")).distinct()
    docs = ids.withColumnRenamed("source_id", "source_doc")
    return chunk_rows.join(ids, "source_id", "left_anti").select(*chunk_rows.columns), relations.join(docs, "source_doc", "left_anti").select(*relations.columns), candidates.join(docs, "source_doc", "left_anti").select(*candidates.columns)


def orphans(chunk_rows: DataFrame, relations: DataFrame, candidates: DataFrame, documents: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Source ids that something refers to and that neither a document nor a running ingest has."""
    used = chunk_rows.select("source_id").unionByName(relations.select(F.col("source_doc").alias("source_id"))).unionByName(candidates.select(F.col("source_doc").alias("source_id"))).where("source_id is not null and source_id <> ''").distinct()
    return used.join(documents.select("source_id").unionByName(in_flight.select("source_id")), "source_id", "left_anti")


def document_counts(documents: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return in_scope(documents, scope).groupBy("collection").agg(F.count(F.lit(1)).alias("n_documents"))


def request_counts(documents: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """documents with n_requests: the chunks of their cleaned text."""
    return documents.withColumn("n_requests", chunk_count(clean_markdown(F.col("content")), settings.chunk_size, settings.chunk_overlap))


def quota(documents: DataFrame, used: int, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: requests asked for, whether they fit today's limit, and in how many parts they would."""
    n = F.sum(F.col("n_requests") * (1 + settings.glean_rounds))
    return request_counts(documents, settings).agg(F.coalesce(n, F.lit(0)).alias("requests")).select("requests", (F.col("requests") + used <= settings.daily_limit).alias("allowed"), F.ceil(F.col("requests") / settings.daily_limit).alias("parts"))


def record_usage(state: DataFrame, events: DataFrame) -> DataFrame:
    """state plus events (ts, n), by Pacific date; n of zero or less is ignored."""
    day = F.to_date(F.from_utc_timestamp("ts", "America/Los_Angeles"))
    new = events.where("n > 0").select(day.alias("usage_date"), F.col("n").cast("long").alias("request_count"))
    return state.unionByName(new).groupBy("usage_date").agg(F.sum("request_count").alias("request_count"))


def resumable(progress: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (collection, file_name, content_hash, total_chunks) with first_chunk: where an interrupted ingest of the same content goes on, else 0, and the source_id to go on with."""
    old = progress.select(*FILE, F.col("source_id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("total_chunks").alias("old_total"), "done_chunks")
    met = incoming.join(old, FILE, "left")
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    go_on = same & (F.col("old_total") == F.col("total_chunks"))
    return met.select(*incoming.columns, F.when(go_on, F.col("done_chunks")).otherwise(0).alias("first_chunk"), F.when(same, F.col("old_id")).alias("resumed_id"))


def mark_done(progress: DataFrame, done: DataFrame) -> DataFrame:
    """done: collection, file_name, done_chunks."""
    new = done.select(*FILE, F.col("done_chunks").alias("new"))
    return progress.join(new, FILE, "left").withColumn("done_chunks", F.greatest("done_chunks", F.coalesce("new", "done_chunks"))).drop("new").select(*progress.columns)


def mark_dirty(state: DataFrame, collections: DataFrame, dirty: bool = True) -> DataFrame:
    names = collections.select("collection").distinct()
    new = names.join(state.select("collection", "graph_signature"), "collection", "left").select("collection", F.lit(dirty).alias("dirty"), "graph_signature")
    return state.join(names, "collection", "left_anti").select("collection", "dirty", "graph_signature").unionByName(new)


def drop_build_state(state: DataFrame, collections: DataFrame) -> DataFrame:
    return state.join(collections.select("collection").distinct(), "collection", "left_anti").select(*state.columns)


def content_hash_of(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (collection, file_name) with source_id and content_hash, null for a file that isn't stored."""
    return keys.select(*FILE).join(documents.select(*FILE, "source_id", "content_hash"), FILE, "left")


def source_names(documents: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """source_id and file_name of every document."""
    return in_scope(documents, scope).select("source_id", "file_name")


def start_progress(progress: DataFrame, batch: DataFrame) -> DataFrame:
    """progress with batch's rows (its columns), which replace those of the same files."""
    return progress.join(batch.select(*FILE).distinct(), FILE, "left_anti").select(*progress.columns).unionByName(batch.select(*progress.columns))


def end_progress(progress: DataFrame, files: DataFrame) -> DataFrame:
    return progress.join(files.select(*FILE).distinct(), FILE, "left_anti").select(*progress.columns)


def usage_on(usage: DataFrame, day: str | None = None) -> int:
    """Requests of a Pacific day (yyyy-mm-dd), today's by default."""
    date = F.lit(day).cast("date") if day else F.to_date(F.from_utc_timestamp(F.current_timestamp(), "America/Los_Angeles"))
    return usage.where(F.col("usage_date") == date).agg(F.coalesce(F.sum("request_count"), F.lit(0))).first()[0]


def is_dirty(state: DataFrame, collections: DataFrame) -> DataFrame:
    """A collection without a build is dirty."""
    return collections.select("collection").distinct().join(state, "collection", "left").select("collection", F.coalesce("dirty", F.lit(True)).alias("dirty"))


def status(entities: DataFrame, relations: DataFrame, documents: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """(what, n): one small row for each figure."""
    from .graph import isolated

    figures = {"isolated": isolated(entities, relations), "entities": entities, "relations": relations, "documents": documents, "chunks": chunk_rows, "types": entities.select("type").distinct(), "predicates": relations.select("predicate").distinct(), "collections": entities.select("collection").distinct()}
    out = None
    for name, df in figures.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out
