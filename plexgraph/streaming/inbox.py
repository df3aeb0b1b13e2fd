"""The inbox as a stream: every new file is one document, handled at least once with idempotent writes."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import route

log = logging.getLogger(__name__)


def drain(spark: SparkSession, folder: str, collection: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", files_per_batch: int = 1000) -> StreamingQuery:
    """Hand all files that are not yet done to handle(documents, batch), in batches, then stop.

    The checkpoint remembers what is done; a batch that failed comes again with the same number, and
    handle keeps it idempotent by writing under its keys."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    docs = files.select(F.lit(collection).alias("collection"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))
    return docs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def filed(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], processed: str | None = None, failed: str | None = None) -> Callable[[DataFrame, int], None]:
    """handle, and then the batch's files moved to processed.

    Where failed is given, a batch that raises is handled again file by file, so that each file's success
    or failure is its own: those that raise go to failed, the others to processed, and the next batch goes
    on.  handle may meet a file twice and is idempotent by writing under its keys."""

    def own(documents: DataFrame, batch: int) -> None:
        names = [r[0] for r in documents.select("file_name").distinct().orderBy("file_name").collect()]  # at most files_per_batch
        done, bad = one_by_one(documents, names, lambda docs: handle(docs, batch), bool(failed))
        # Only now, as a batch reads its files where they lay.
        if processed:
            route(spark, folder, done, processed)
        if bad:
            log.error("%s of batch %s of %s failed", [name for name, _ in bad], batch, folder)
            route(spark, folder, [name for name, _ in bad], failed)

    return own


def one_by_one(documents: DataFrame, names: list[str], handle: Callable[[DataFrame], None], apart: bool) -> tuple[list[str], list[tuple[str, Exception]]]:
    """(names that were handled, names that failed with their errors): all at once, or if that raises and apart is set, each file by itself."""
    try:
        handle(documents)
        return names, []
    except Exception as e:
        if not apart:
            raise
        if len(names) <= 1:
            return [], [(name, e) for name in names]
    found = [one_by_one(documents.where(F.col("file_name") == name), [name], handle, True) for name in names]
    return [x for done, _ in found for x in done], [x for _, bad in found for x in bad]


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events (ts, event_type) in tumbling windows with a watermark; works on streams and tables alike."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
