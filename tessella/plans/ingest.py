"""What to ingest next: backlog decisions, chunk plans, run counters, batch ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalars import blank_to_null
from tessella.operators.catalog import first_per
from tessella.operators.writes import delete_keys, patch_videos, upsert_embeddings, upsert_fingerprints
from tessella.shared import written

CHUNK_SECONDS, LAG_SECONDS = 60, 120


def vod_problem(streamer: Column, vod_id: Column, url: Column, duration: Column) -> Column:
    """The first missing field of a vod, or null."""
    return F.when(blank_to_null(streamer).isNull(), "streamer").when(blank_to_null(vod_id).isNull(), "vod_id").when(blank_to_null(url).isNull(), "url").when(F.coalesce(duration, F.lit(0)) <= 0, "duration")


def backlog(vods: DataFrame, videos: DataFrame, state: DataFrame) -> DataFrame:
    """``vods(vod_id, streamer, url, created_at, duration_seconds)`` with a decision each.

    decision is ``eligible`` or ``skip``; reason names the status that a skip follows; cursor is where an
    eligible vod begins, and resumed says whether that is past its start.
    """
    known = first_per(videos, ["url"], "id").select("url", F.col("id").alias("video_id"), "status", "processed", F.lit(True).alias("has_video"))
    saved = state.select(F.col("vod_platform_id").alias("vod_id"), F.col("last_ingested_seconds").alias("saved"), F.lit(True).alias("has_state"))
    rows = vods.join(known, "url", "left").join(saved, "vod_id", "left")
    reason = (
        F.when(F.col("has_video").isNull() | (F.col("status") == "reindex_requested"), F.lit(None).cast("string"))
        .when(F.col("status") == "indexing", F.when(F.col("has_state").isNull(), "indexing"))
        .when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("processed"), "processed")
    )
    decided = rows.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "eligible").otherwise("skip"))
    cursor = F.when(F.col("status").eqNullSafe("reindex_requested"), 0).otherwise(F.coalesce("saved", F.lit(0)))
    placed = decided.withColumn("cursor", F.when(F.col("decision") == "eligible", cursor))
    return placed.select("vod_id", "streamer", "url", "created_at", "duration_seconds", "video_id", "decision", "reason", "cursor", F.coalesce(F.col("cursor") > 0, F.lit(False)).alias("resumed"))


def next_of_backlog(decided: DataFrame) -> DataFrame:
    """The newest eligible vod of each streamer."""
    return first_per(decided.where("decision = 'eligible'"), ["streamer"], F.desc("created_at"), "vod_id")


def run_positions(decided: DataFrame) -> DataFrame:
    """Each eligible vod's place in its streamer's run, newest first, and the run's length."""
    w = W.partitionBy("streamer")
    rows = decided.where("decision = 'eligible'")
    return rows.select("streamer", "vod_id", F.row_number().over(w.orderBy(F.desc("created_at"), "vod_id")).alias("position"), F.count(F.lit(1)).over(w).alias("total"))


def skip_log(decided: DataFrame) -> DataFrame:
    """One line a skipped vod, however often it is listed."""
    return decided.where("decision = 'skip'").dropDuplicates(["vod_id"]).select("vod_id", "reason")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts a streamer over ``outcomes(streamer, decision, resumed, ok)``; a failed vod that was resumed is both."""
    eligible = F.col("decision") == "eligible"
    return outcomes.groupBy("streamer").agg(
        F.count_if(eligible & F.col("ok")).alias("ingested"), F.count_if(eligible & F.col("resumed")).alias("resumed"), F.count_if(~eligible).alias("skipped"), F.count_if(eligible & ~F.col("ok")).alias("failed")
    )


def watch_summary(steps: DataFrame) -> DataFrame:
    """Counts a streamer over the ``steps(streamer, mode, outcome)`` of runs that turn between ``live``, ``backlog`` and ``watch``.

    A live session that is ``done`` hands over to the backlog; one that is ``interrupted`` does not. A backlog vod is ``done``, or
    ``preempted`` by a live session.
    """
    is_a = lambda mode, outcome: F.count_if((F.col("mode") == mode) & (F.col("outcome") == outcome))
    return steps.groupBy("streamer").agg(
        F.count_if(F.col("mode") == "live").alias("live_sessions_started"), is_a("live", "done").alias("handoffs_to_backlog"), is_a("backlog", "preempted").alias("handoffs_to_live"),
        is_a("backlog", "done").alias("backlog_ingested"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("mode") == "watch").alias("watch_cycles"),
    )


def chunk_name(vod_id: Column, start: Column, length: Column) -> Column:
    return F.format_string("vod_%s_%08d_%04d.wav", vod_id, start.cast("long"), length.cast("long"))


def _chunks(rows: DataFrame, end: Column, seconds: int) -> DataFrame:
    starts = F.when(end > F.col("cursor"), F.sequence(F.col("cursor").cast("long"), (end - 1).cast("long"), F.lit(seconds).cast("long")))
    cut = rows.withColumn("start", F.explode(starts)).withColumn("length", F.least(F.lit(seconds).cast("long"), end.cast("long") - F.col("start")))
    return cut.withColumn("name", chunk_name(F.col("vod_id"), F.col("start"), F.col("length")))


def chunk_plan(decided: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """(vod_id, start, length, name, progress): the chunks of eligible vods from their cursors; the last is shorter."""
    rows = decided.where("decision = 'eligible' and duration_seconds > 0")
    cut = _chunks(rows, F.col("duration_seconds"), seconds)
    return cut.select("vod_id", "start", "length", "name", ((F.col("start") + F.col("length")) / F.col("duration_seconds") * 100).alias("progress"))


def live_chunk_plan(snapshots: DataFrame, seconds: int = CHUNK_SECONDS, lag: int = LAG_SECONDS) -> DataFrame:
    """The chunks that ``snapshots(vod_id, is_live, duration_seconds, cursor)`` allow: up to ``lag`` before a live end."""
    end = F.col("duration_seconds") - F.when(F.col("is_live"), F.lit(lag)).otherwise(0)
    return _chunks(snapshots, end, seconds).select("vod_id", "start", "length", "name")


def archive_session(events: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """(vod_id, ts, event_id, start, length, status): what each poll of ``events`` brings.

    ``events(vod_id, ts, event_id, kind, saved, duration_seconds)``, ``kind`` being ``poll`` or ``stop``; ``saved`` is where
    the vod was left. A poll commits the chunk of the poll right before it and brings the next ``chunk``; after a stop
    the chunk under way is not committed and comes again. The first poll with all committed is ``searchable``; polls
    after it, and stops, bring nothing.
    """
    w = W.partitionBy("vod_id").orderBy("ts", "event_id")
    polled = F.col("kind") == "poll"
    rows = events.withColumn("commits", (polled & (F.lag("kind").over(w) == "poll")).cast("int"))
    rows = rows.withColumn("commits", F.sum(F.coalesce("commits", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    saved = F.coalesce(F.col("saved"), F.lit(0)).cast("long")
    rows = rows.where(polled).withColumn("start", F.greatest(saved, F.least(saved + F.col("commits") * seconds, F.col("duration_seconds").cast("long"))))
    over = F.col("start") >= F.col("duration_seconds")
    rows = rows.withColumn("over", over).withColumn("times", F.sum(over.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).where("times < 2")
    length = F.when(F.col("over"), 0).otherwise(F.least(F.lit(seconds), F.col("duration_seconds") - F.col("start"))).cast("long")
    return rows.select("vod_id", "ts", "event_id", "start", length.alias("length"), F.when(F.col("over"), "searchable").otherwise("chunk").alias("status"))


def growth_streak(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the longest duration so far and how many offline checks saw no growth since the last growth.

    ``snapshots(vod_id, ts, is_live, duration_seconds)``.
    """
    w = W.partitionBy("vod_id").orderBy("ts")
    before = F.coalesce(F.max("duration_seconds").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = snapshots.withColumn("max_duration", F.max("duration_seconds").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("still", (~F.col("is_live") & (F.col("duration_seconds") <= before)).cast("int")).withColumn("group", F.sum((F.col("duration_seconds") > before).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    streak = F.sum("still").over(W.partitionBy("vod_id", "group").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("vod_id", "ts", "max_duration", streak.alias("stable_checks"))


def run_ingest(embedded: DataFrame, fingerprints: DataFrame, vectors: DataFrame, videos: DataFrame, state: DataFrame, model_name: str) -> dict[str, DataFrame]:
    """The tables after ``embedded(video_id, creator_id, timestamp_seconds, embedding)`` is stored; its videos are then searchable."""
    kept = written(embedded.where(F.size("embedding") > 0), "embedded")  # embedded once, though read for ids, rows and videos
    batch = kept.groupBy("video_id").agg(F.array_sort(F.collect_set("timestamp_seconds")).alias("timestamps"))
    table, ids = upsert_fingerprints(fingerprints, batch)
    rows = first_per(kept, ["video_id", "timestamp_seconds"], "creator_id").join(ids.select("video_id", "timestamp_seconds", F.col("id").alias("fingerprint_id")), ["video_id", "timestamp_seconds"])
    done = kept.select(F.col("video_id").alias("id")).distinct()
    return {
        "fingerprints": table, "vectors": upsert_embeddings(vectors, rows.select("fingerprint_id", "embedding", "creator_id"), model_name),
        "videos": patch_videos(videos, done.withColumn("status", F.lit("searchable"))), "state": delete_keys(state, done.withColumnRenamed("id", "video_id")),
    }


def embed_chunks(chunks: DataFrame, embed: Callable, width: int) -> DataFrame:
    """(video_id, timestamp_seconds, embedding) of ``chunks(video_id, offset_seconds, samples, rate)``; see ``sources.audio``."""
    from tessella.sources.audio import embed_segments

    return embed_segments(chunks, embed, width)


def observed(chunks: DataFrame, name: str = "ingest") -> tuple[DataFrame, Observation]:
    """``chunks`` and an observation of what passes by: how many chunks, of how many seconds. Known after an action."""
    seen = Observation(name)
    return chunks.observe(seen, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("seconds")), seen
