"""Offset voting: which recording, and where in it, a clip was cut from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import ratio_text, rounded_offset

MIN_VOTES, MIN_RATIO = 3, 0.08


def resolve(neighbours: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Neighbour rows with the recording and time of their fingerprint; unknown ids vanish."""
    return neighbours.join(fingerprints.select("fingerprint_id", "video_id", "timestamp_seconds"), "fingerprint_id")


def vote_histogram(neighbours: DataFrame, segments: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(clip_id, video_id, offset, votes, first_seen): each neighbour votes for one offset of its recording."""
    timed = resolve(neighbours, fingerprints).join(segments.select("clip_id", "seg_ord", "q_time"), ["clip_id", "seg_ord"])
    offset = rounded_offset(F.col("timestamp_seconds") - F.col("q_time"))
    return timed.groupBy("clip_id", "video_id", offset.alias("offset")).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("seg_ord", "rank")).alias("first_seen"))


def align(neighbours: DataFrame, segments: DataFrame, fingerprints: DataFrame, min_votes: int = MIN_VOTES, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row a clip: (clip_id, found, video_id, offset, votes, ratio, reason).

    The most voted candidate wins, the first seen on ties; it must reach both thresholds, votes checked first.
    The ratio counts all segments of the clip and may pass 1.
    """
    known = fingerprints.select("fingerprint_id", "video_id", "timestamp_seconds")
    timed = neighbours.join(known, "fingerprint_id", "left").join(segments.select("clip_id", "seg_ord", "q_time"), ["clip_id", "seg_ord"])
    offset = rounded_offset(F.col("timestamp_seconds") - F.col("q_time"))
    # one pass over the neighbours: each segment that has any has one of rank 1, so those count the segments heard
    groups = timed.groupBy("clip_id", "video_id", offset.alias("offset")).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("seg_ord", "rank")).alias("first_seen"), F.count_if(F.col("rank") == 1).alias("firsts"))
    first = F.struct((-F.col("votes")).alias("order"), "first_seen", "video_id", "offset", "votes")
    best = groups.groupBy("clip_id").agg(F.sum("firsts").alias("heard"), F.min(F.when(F.col("video_id").isNotNull(), first)).alias("best"))
    best = best.select("clip_id", "heard", "best.video_id", "best.offset", "best.votes")
    sizes = segments.groupBy("clip_id").agg(F.count("q_time").alias("n_times"), F.count(F.lit(1)).alias("n_segments"))
    rows = sizes.join(best, "clip_id", "left").withColumn("ratio", F.col("votes") / F.col("n_segments"))
    # fixed values: the texts that callers see
    problem = (
        F.when(F.col("heard").isNull(), "No neighbors returned")
        .when(F.col("n_times") == 0, "Query had no timestamps")
        .when((F.col("n_times") != F.col("n_segments")) | (F.col("heard") != F.col("n_segments")), "Neighbor/timestamp length mismatch")
        .when(F.col("votes").isNull(), "No fingerprint rows resolved")
        .when(F.col("votes") < min_votes, F.format_string(f"Best candidate vote count %d is below min_vote_count {min_votes}", "votes"))
        .when(F.col("ratio") < min_ratio, F.concat(F.lit("Best candidate vote ratio "), ratio_text(F.col("ratio")), F.lit(f" is below min_vote_ratio {min_ratio:.3f}")))
    )
    accepted = F.concat(F.format_string("Accepted with %d votes (", "votes"), ratio_text(F.col("ratio")), F.lit(" ratio)"))
    judged = rows.withColumn("found", problem.isNull()).withColumn("reason", F.coalesce(problem, accepted))
    only = lambda c: F.when(F.col("found"), F.col(c)).alias(c)
    return judged.select("clip_id", "found", only("video_id"), only("offset"), "votes", "ratio", "reason")
