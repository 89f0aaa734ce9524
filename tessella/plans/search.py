"""Clip search, many clips at once: creator, neighbours, votes, recording, url."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import name_key, timestamp_url
from tessella.operators.align import MIN_RATIO, MIN_VOTES, align
from tessella.operators.catalog import videos_with_owner
from tessella.operators.knn import knn_join


def search_clips(clips: DataFrame, segments: DataFrame, creators: DataFrame, vectors: DataFrame, fingerprints: DataFrame, videos: DataFrame, k: int = 10, min_votes: int = MIN_VOTES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row a clip of ``clips(clip_id, streamer)``, whatever happens to it."""
    owners = creators.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("creator_id"))
    named = clips.select("clip_id", "streamer", name_key(F.col("streamer")).alias("key")).join(owners, "key", "left").drop("key")
    scoped = segments.join(named.select("clip_id", "creator_id"), "clip_id").where(F.col("creator_id").isNotNull())
    neighbours = knn_join(scoped, vectors, k)
    aligned = align(neighbours, scoped, fingerprints, min_votes, min_ratio)
    has = segments.select("clip_id").distinct().withColumn("embedded", F.lit(True))
    detail = videos_with_owner(videos, creators).select(F.col("id").alias("video_id"), F.col("url").alias("video_url"), "title", "creator_name")
    rows = named.join(has, "clip_id", "left").join(aligned, "clip_id", "left").join(detail, "video_id", "left")
    reason = (
        F.when(F.col("embedded").isNull(), "No embeddings generated for query clip")
        .when(F.col("creator_id").isNull() | (F.col("reason") == "No neighbors returned"), F.concat(F.lit("No indexed clips found for streamer: "), name_key(F.col("streamer"))))
        .when(~F.col("found"), F.col("reason"))
        .when(F.col("video_url").isNull(), "Aligned video metadata not found")
    )
    judged = rows.withColumn("why", reason).withColumn("ok", F.col("why").isNull())
    only = lambda c, name=None: F.when(F.col("ok"), F.col(c)).alias(name or c)
    return judged.select(
        "clip_id", F.when(F.col("embedded"), name_key(F.col("streamer"))).alias("streamer"), F.col("ok").alias("found"), only("video_id"), only("title"), only("creator_name"), only("offset", "timestamp_seconds"),
        only("ratio", "score"), F.when(F.col("ok"), timestamp_url(F.col("video_url"), F.col("offset"))).alias("url"), F.col("why").alias("reason"),
    )
