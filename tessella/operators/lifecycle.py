"""Guarded changes of videos and of search jobs. Commands come as a table and get an outcome each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalars import status_of
from tessella.operators.catalog import first_per
from tessella.operators.writes import patch_videos

#: Outcome, error code and HTTP status.
ERRORS = {"invalid_actor": (None, 422), "not_found": ("VIDEO_NOT_FOUND", 404), "owner_mismatch": ("VIDEO_OWNER_MISMATCH", 403), "invalid_transition": ("INVALID_VIDEO_STATE_TRANSITION", 409)}


def command_outcomes(commands: DataFrame, videos: DataFrame) -> DataFrame:
    """``commands(cmd_id, op, video_id, actor_creator_id)`` with outcome, error_code and http_status.

    ``delete`` needs a searchable video, ``reindex`` a deleted one; what is already so is left as it is. Commands
    take effect in the order of cmd_id: the owner's first delete of a searchable video, and the first reindex after
    the video is deleted. ``was`` is the status that a command meets. An actor must be a positive number.
    """
    known = videos.select(F.col("id").alias("video_id"), F.col("creator_id").alias("owner"), F.col("status").alias("at_first"))
    before = W.partitionBy("video_id").orderBy("cmd_id").rowsBetween(W.unboundedPreceding, -1)
    own = F.col("owner").eqNullSafe(F.col("actor_creator_id"))
    rows = commands.join(known, "video_id", "left")
    deleted = (F.col("at_first") == "deleted") | ((F.col("at_first") == "searchable") & F.coalesce(F.max(own & (F.col("op") == "delete")).over(before), F.lit(False)))
    rows = rows.withColumn("deleted", deleted)
    asked = F.coalesce(F.max(own & (F.col("op") == "reindex") & F.col("deleted")).over(before), F.lit(False))
    rows = rows.withColumn("status", F.when(asked, "reindex_requested").when(F.col("deleted"), "deleted").otherwise(F.col("at_first")))
    done, needed = F.when(F.col("op") == "delete", "deleted").otherwise("reindex_requested"), F.when(F.col("op") == "delete", "searchable").otherwise("deleted")
    outcome = (
        F.when(~F.coalesce(F.col("actor_creator_id") > 0, F.lit(False)), "invalid_actor").when(F.col("owner").isNull() & F.col("status").isNull(), "not_found")
        .when(~F.col("owner").eqNullSafe(F.col("actor_creator_id")), "owner_mismatch")
        .when(F.col("status") == done, "unchanged")
        .when(~F.col("status").eqNullSafe(needed), "invalid_transition")
        .otherwise("accepted")
    )
    judged = rows.withColumn("outcome", outcome)
    code, status = F.lit(None).cast("string"), F.lit(200)
    for name, (c, s) in ERRORS.items():
        code, status = F.when(F.col("outcome") == name, c).otherwise(code), F.when(F.col("outcome") == name, F.lit(s)).otherwise(status)
    return judged.select("cmd_id", "op", "video_id", "actor_creator_id", F.col("status").alias("was"), "outcome", code.alias("error_code"), status.alias("http_status"))


def apply_video_commands(commands: DataFrame, videos: DataFrame, fingerprints: DataFrame, vectors: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
    """The outcomes, and the tables after the accepted commands."""
    outcomes = command_outcomes(commands, videos)
    all_accepted = outcomes.where("outcome = 'accepted'")
    accepted = first_per(all_accepted, ["video_id"], F.desc("cmd_id"))
    gone = all_accepted.where("op = 'delete'").select("video_id").distinct()
    patches = accepted.select(F.col("video_id").alias("id"), F.when(F.col("op") == "delete", "deleted").otherwise("reindex_requested").alias("status"))
    doomed = fingerprints.join(gone, "video_id", "left_semi").select("fingerprint_id")
    return {
        "outcomes": outcomes, "videos": patch_videos(videos, patches), "fingerprints": fingerprints.join(gone, "video_id", "left_anti"),
        "vectors": vectors.join(doomed, "fingerprint_id", "left_anti"), "state": state.join(accepted.select("video_id"), "video_id", "left_anti"),
    }


def fold_job_events(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after all their events ``(id, ts, status, stage, started, error_code, error_message, http_status)``.

    Status and stage are the last given; ``started_at`` is the first start; a finished job has no stage.
    """
    done = F.col("status").isin("completed", "failed")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    folded = events.groupBy("id").agg(
        last("status").alias("e_status"), last("stage").alias("e_stage"), F.min(F.when(F.col("started"), F.col("ts"))).alias("e_started"), F.max(F.when(done, F.col("ts"))).alias("e_finished"),
        last("error_code").alias("e_code"), last("error_message").alias("e_message"), last("http_status").alias("e_http"),
    )
    rows = requests.join(folded, "id", "left")
    status = F.coalesce("e_status", "job_status")
    ended = status.isin("completed", "failed")
    return rows.select(
        "id", status.alias("job_status"), F.when(~ended, F.coalesce("e_stage", "job_stage")).alias("job_stage"), F.coalesce("started_at", "e_started").alias("started_at"),
        F.when(ended, F.coalesce("e_finished", "finished_at")).alias("finished_at"), F.coalesce("e_code", "error_code").alias("error_code"),
        F.coalesce("e_message", "error_message").alias("error_message"), F.coalesce("e_http", "http_status").alias("http_status"),
    )


#: What a finished search leaves in its job.
RESULTS = (
    "result_reason", "found_match", "matched_video_id", "matched_timestamp_seconds", "score", "clip_filename", "download_source", "download_host", "input_duration_seconds",
    "total_duration_ms", "preprocess_duration_ms", "embed_duration_ms", "vector_query_duration_ms", "alignment_duration_ms",
)


def _finish(requests: DataFrame, rows: DataFrame, now: Column, changes: dict[str, Column]) -> DataFrame:
    """``requests`` with ``changes`` where ``rows`` has the id; ``__c`` is the column c of ``rows``."""
    given = rows.select("id", *[F.col(c).alias(f"__{c}") for c in rows.columns if c != "id"], F.lit(True).alias("__hit"))
    changes = {**changes, "job_stage": F.lit(None).cast("string"), "finished_at": now}
    return requests.join(given, "id", "left").select(*[F.when(F.col("__hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in requests.columns])


def complete_jobs(requests: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Jobs with the results of ``outcomes(id, ...)``, one row an id: no error is left, results that are not given are null."""
    none = F.lit(None).cast("string")
    results = {c: F.col(f"__{c}") if c in outcomes.columns else F.lit(None) for c in RESULTS}
    fixed = {"success": F.lit(True), "http_status": F.lit(200), "error_code": none, "error_message": none, "job_status": F.lit("completed")}
    return _finish(requests, outcomes.select("id", *[c for c in outcomes.columns if c in RESULTS]), now, {**results, **fixed})


def fail_jobs(requests: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Jobs with the error of ``failures(id, error_code, error_message, http_status, input_duration_seconds)``; a null duration leaves the job's own."""
    changes = {c: F.col(f"__{c}") for c in ("error_code", "error_message", "http_status")}
    kept = {"input_duration_seconds": F.coalesce("__input_duration_seconds", "input_duration_seconds")} if "input_duration_seconds" in requests.columns else {}
    return _finish(requests, failures, now, {**changes, **kept, "success": F.lit(False), "job_status": F.lit("failed")})


def fail_open_jobs(requests: DataFrame, code: str, message: str, now: Column) -> DataFrame:
    """Public jobs that are queued or running fail, as after a restart."""
    hit = (F.col("source_app") == "public") & F.col("job_status").isin("queued", "running")
    changes = {"job_status": F.lit("failed"), "job_stage": F.lit(None).cast("string"), "error_code": F.lit(code), "error_message": F.lit(message), "finished_at": F.coalesce("finished_at", now), "success": F.lit(False)}
    return requests.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in requests.columns])


def create_jobs(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """The log with the asked jobs added: queued, at validation."""
    rows = asked.withColumns({"source_app": F.lit("public"), "job_status": F.lit("queued"), "job_stage": F.lit("validating")})
    return requests.unionByName(rows, allowMissingColumns=True)


def backfill_job_status(requests: DataFrame) -> DataFrame:
    """Log rows from before there were jobs: finished when they were made, by their success."""
    return requests.withColumn("job_status", F.when(F.col("success"), "completed").otherwise("failed")).withColumn("finished_at", F.coalesce("finished_at", "created_at"))


def backfill_video_status(videos: DataFrame) -> DataFrame:
    return videos.withColumn("status", F.coalesce("status", status_of(F.coalesce("processed", F.lit(False)))))


def backfill_request_creator(requests: DataFrame, creators: DataFrame) -> DataFrame:
    """The creator by name where none is set."""
    known = creators.groupBy(F.lower("name").alias("__key")).agg(F.min("id").alias("__id"))
    rows = requests.withColumn("__key", F.lower("streamer")).join(known, "__key", "left")
    return rows.withColumn("creator_id", F.coalesce("creator_id", "__id")).drop("__key", "__id")
