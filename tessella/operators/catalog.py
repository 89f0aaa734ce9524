"""Lookups and lists over the catalog tables. Keys come as a DataFrame, so many are looked up at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalars import iso_text, name_key, normal_status, timestamp_url


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def videos_by_url(videos: DataFrame, urls: DataFrame) -> DataFrame:
    """The video with the lowest id of each url of ``urls(url)``."""
    return first_per(videos.join(urls.select("url").distinct(), "url"), ["url"], "id").select("url", "id", "creator_id", "title", "processed", "status")


def creators_by_name(creators: DataFrame, names: DataFrame) -> DataFrame:
    """(name, creator_id) for each asked name; only the asked name is trimmed, case does not count."""
    known = creators.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("creator_id"))
    asked = names.select("name", name_key(F.col("name")).alias("key"), name_key(F.col("name")).isNull().alias("blank"))
    return asked.join(known, "key", "left").select("name", "creator_id", "blank")


def video_statuses(videos: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status, valid): the status of each asked video, null where it is none of the four."""
    return ids.select("id").distinct().join(videos.select("id", F.col("status").alias("raw")), "id", "left").select("id", normal_status(F.col("raw")).alias("status"), (F.col("raw").isNull() | normal_status(F.col("raw")).isNotNull()).alias("valid"))


def states_by_vod(state: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("vod_platform_id").distinct().join(state, "vod_platform_id", "left")


def videos_with_owner(videos: DataFrame, creators: DataFrame) -> DataFrame:
    owner = creators.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"), F.col("url").alias("creator_url"), F.col("profile_image_url"))
    return videos.join(owner, "creator_id").select("id", "creator_id", "url", "title", "thumbnail_url", "processed", "status", "creator_name", "creator_url", "profile_image_url")


def live_sessions(videos: DataFrame, creators: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of live sessions, newest id first: videos whose url is a channel's, not a recording's."""
    if not 0 < limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset 0 or more")
    live = videos.where(F.col("url").startswith("https://twitch.tv/") | F.col("url").startswith("https://www.twitch.tv/"))
    return videos_with_owner(live, creators).select("id", "creator_name", "url", "title", "status", "processed").orderBy(F.desc("id")).offset(offset).limit(limit)


def searchable_creators(creators: DataFrame, videos: DataFrame, fingerprints: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, profile_image_url) of creators with any vector, whatever the videos' status; semi-joins, so no fan-out."""
    held = fingerprints.join(vectors.select("fingerprint_id"), "fingerprint_id", "left_semi").select("video_id").distinct()
    owners = videos.join(held, videos["id"] == held["video_id"], "left_semi").select("creator_id").distinct()
    known = creators.where(F.trim("name") != "").join(owners, creators["id"] == owners["creator_id"], "left_semi")
    return known.select("name", "profile_image_url").distinct().orderBy(F.lower("name"), "name")


def job_records(requests: DataFrame, videos: DataFrame, creators: DataFrame) -> DataFrame:
    """Public jobs as their clients see them: the result once completed, the error where code and message are there."""
    jobs = requests.where("source_app = 'public'")
    detail = videos_with_owner(videos, creators).select(F.col("id").alias("matched_video_id"), F.col("url").alias("video_url"), F.col("title").alias("video_title"), F.col("creator_name").alias("owner"), F.col("profile_image_url").alias("owner_image"))
    images = creators.groupBy(F.lower("name").alias("key")).agg(F.min_by("profile_image_url", "id").alias("named_image"))
    rows = jobs.join(detail, "matched_video_id", "left").withColumn("key", name_key(F.col("streamer"))).join(images, "key", "left")
    done, failed = F.col("job_status") == "completed", F.col("error_code").isNotNull() & F.col("error_message").isNotNull()
    return rows.select(
        "id", F.col("job_status").alias("status"), F.col("job_stage").alias("stage"), iso_text(F.col("created_at")).alias("created_at"), iso_text(F.col("started_at")).alias("started_at"), iso_text(F.col("finished_at")).alias("finished_at"),
        F.when(done, F.col("found_match")).alias("found"), F.when(done, F.col("video_title")).alias("title"), F.when(done, F.coalesce("owner", "streamer")).alias("streamer"),
        F.when(done, F.when(F.col("matched_video_id").isNotNull(), F.col("owner_image")).otherwise(F.col("named_image"))).alias("image"),
        F.when(done, timestamp_url(F.col("video_url"), F.col("matched_timestamp_seconds"))).alias("url"), F.when(failed, F.col("error_code")).alias("error_code"), F.when(failed, F.col("error_message")).alias("error_message"),
    )
