"""Streams into tables: each micro-batch is written once, and replays change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.catalog import first_per
from tessella.operators.versions import VersionedTable
from tessella.operators.writes import with_new_ids
from tessella.shared import discard

KEYS = ["video_id", "timestamp_seconds"]
STORED = "id long, video_id long, timestamp_seconds double, creator_id long, embedding array<double>, model_name string, batch long"
#: A cell of the store holds this many seconds of the videos of one of so many groups.
CELL_SECONDS, CELL_GROUPS = 3600, 64


def _started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    """Start a stream whose shuffles, and so its states, have a partition a core: a micro-batch opens each of them, however few rows it has.

    A stream that was started before keeps the number of its checkpoint.
    """
    spark, name = stream.sparkSession, "spark.sql.shuffle.partitions"
    writer, before = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), spark.conf.get(name)
    spark.conf.set(name, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 seconds")).start()
    finally:
        spark.conf.set(name, before)


def into_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream's rows to a Parquet folder, one sub-folder a micro-batch, overwritten by a replay."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _started(stream, write, checkpoint, available_now)


def vector_store(spark: SparkSession, path: str) -> VersionedTable:
    """Vectors by video and second, in cells of an hour: what a batch looks up does not grow with the length of what is stored."""
    cell = F.concat_ws("-", F.pmod(F.xxhash64("video_id"), F.lit(CELL_GROUPS)).cast("string"), F.floor(F.col("timestamp_seconds") / CELL_SECONDS).cast("string"))
    return VersionedTable(spark, path, T._parse_datatype_string(STORED), KEYS, cell)


def stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows that ``ingest_into`` committed, with the number of their micro-batch, replaced ones too (until compaction)."""
    store = vector_store(spark, path)
    return store._stored(store.snapshot().folders, None)


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One row a key: of rows that were sent more than once, the latest."""
    return vector_store(spark, path).read()


def ingest_into(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, model_name: str, last_id: int = 0, available_now: bool = True, compact_at: int = 32) -> StreamingQuery:
    """Embed and store a stream of chunks by (video_id, timestamp_seconds).

    ``embed`` makes (video_id, creator_id, timestamp_seconds, embedding) of a micro-batch; empty and null embeddings
    are left out. A second that is known keeps its id, a new one gets the next after ``last_id`` and those given so
    far. A micro-batch reads the keys of the cells that it touches and no others, adds a folder and commits it with
    its number, so a replay of what was committed changes nothing, compacted or not. Every ``compact_at`` batches the
    store is compacted. Rows without a video or a time are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        session, staged = batch.sparkSession, f"{path}-embedded/{number}"
        store = vector_store(session, path)
        base = store.snapshot()
        if base.batches.get(checkpoint, -1) >= number:
            return
        rows = embed(batch).where(F.size("embedding") > 0).dropna(subset=KEYS)
        first_per(rows, KEYS, "creator_id").select(*KEYS, "creator_id", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(staged)
        rows = session.read.parquet(staged)
        known = store.read(base, store.cells_of(rows), ["id", *KEYS])
        last = base.facts.get("last_id", last_id)
        fresh = with_new_ids(rows.select(*KEYS).join(known, KEYS, "left_anti"), KEYS, session.createDataFrame([(last,)], "last_id long")).select("id", *KEYS)
        ids = rows.select(*KEYS).join(known, KEYS).select("id", *KEYS).unionByName(fresh)
        # ids have no gaps, so the last one follows from their number
        given = fresh.count()
        added = rows.join(ids, KEYS).select("id", *KEYS, "creator_id", "embedding", F.lit(model_name).alias("model_name"), F.lit(number).cast("long").alias("batch"))
        done = store.add(added, base, checkpoint, number, {"last_id": last + given})
        discard(rows)
        if len(done.folders) >= compact_at:
            store.compact(done)

    return _started(chunks, write, checkpoint, available_now)
