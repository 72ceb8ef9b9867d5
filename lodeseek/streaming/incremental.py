"""Incremental indexing of a stream of files into a store.

The batch diff is the faithful form, as a file stream reports neither deletions nor edits in place.
Where a change feed is at hand (rows path, content, deleted), each micro-batch is applied as one
committed version of all tables, points, graph, postings and snapshot (where a file's sequence number
stands for its time): the last row of each path counts, and a batch that is replayed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.plans.engine import Engine


def apply_batch(engine: Engine, collection: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts and deletions of one micro-batch."""

    def apply(batch: DataFrame, number: int) -> None:
        if number <= engine.store.facts(collection).get("batch", -1):
            return
        with engine.store.staging(collection) as stage:
            last = stage.written(batch.groupBy("path").agg(F.max_by(F.struct("content", "deleted", "sequence"), "sequence").alias("r")).select("path", "r.*"))
            held = last.where("NOT deleted AND content IS NOT NULL")
            new = held.select("path", F.octet_length("content").cast("long").alias("size"), F.col("sequence").cast("double").alias("mtime"), F.lit(None).cast("long").alias("inode"), F.md5("content").alias("hash"))
            engine.apply(collection, stage, held.select("path", "content"), last.select("path"), new, last.select("path"), {"batch": number})

    return apply


def start(engine: Engine, collection: str, feed: DataFrame, checkpoint: str) -> StreamingQuery:
    """Apply feed (path, content, deleted, sequence) until it is stopped."""
    engine.store.create(collection, {"docs": engine.settings.doc_index, "english": engine.settings.english})
    return feed.writeStream.foreachBatch(apply_batch(engine, collection)).option("checkpointLocation", checkpoint).start()


def counts(events: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Rows by window and keys, with a watermark so that state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
