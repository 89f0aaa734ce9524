"""Keyed writes as pure functions from a table and its updates to a new table, and snapshot swaps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.functions.scalars import processed_of, status_of
from tessella.operators.catalog import first_per
from tessella.operators.versions import Conflict, Snapshot, VersionedTable

#: Parts in which new ids are counted, so that no task numbers all new rows.
ID_PARTS = 256


def last_per(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key, in the order of the rows."""
    numbered = updates.withColumn("__n", F.monotonically_increasing_id())
    return first_per(numbered, keys, F.desc("__n")).drop("__n")


def latest_per(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per(updates, keys, F.desc(order))


def with_new_ids(rows: DataFrame, key: list[str], first: DataFrame, parts: int = ID_PARTS) -> DataFrame:
    """Gapless ids after the one in ``first(last_id)``: by hash part, then key. The offsets are ``parts`` rows."""
    parted = rows.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(parts)))
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__off"))
    ranked = parted.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy(*key)))
    placed = ranked.join(F.broadcast(offsets), "__part").crossJoin(F.broadcast(first.select(F.coalesce("last_id", F.lit(0)).alias("__last"))))  # one row
    return placed.withColumn("id", F.col("__last") + F.col("__off") + F.col("__rank")).drop("__part", "__rank", "__off", "__last")


def upsert_creators(creators: DataFrame, updates: DataFrame) -> DataFrame:
    """By url: the name is overwritten, the image only by one that is not null; new urls get new ids.

    Of a url that comes twice in ``updates(url, name, profile_image_url)`` the last name counts, and the last image
    that is not null.
    """
    numbered = updates.withColumn("__n", F.monotonically_increasing_id())
    image = F.max_by("profile_image_url", F.when(F.col("profile_image_url").isNotNull(), F.col("__n")))
    updates = numbered.groupBy("url").agg(F.max_by("name", "__n").alias("name"), image.alias("profile_image_url"))
    new = updates.select("url", F.col("name").alias("n"), F.col("profile_image_url").alias("i"), F.lit(True).alias("hit"))
    kept = creators.join(new, "url", "left").select("id", F.when(F.col("hit"), F.col("n")).otherwise(F.col("name")).alias("name"), "url", F.coalesce("i", "profile_image_url").alias("profile_image_url"))
    fresh = updates.join(creators.select("url"), "url", "left_anti")
    numbered = with_new_ids(fresh, ["url"], creators.agg(F.max("id").alias("last_id")))
    return kept.unionByName(numbered.select("id", "name", "url", "profile_image_url"))


def upsert_fingerprints(fingerprints: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new table, and (video_id, pos, timestamp_seconds, id) for each row of ``batch(video_id, timestamps)`` in order."""
    rows = batch.select("video_id", F.posexplode("timestamps").alias("pos", "timestamp_seconds"))
    fresh = rows.select("video_id", "timestamp_seconds").distinct().join(fingerprints, ["video_id", "timestamp_seconds"], "left_anti")
    numbered = with_new_ids(fresh, ["video_id", "timestamp_seconds"], fingerprints.agg(F.max("id").alias("last_id"))).select("id", "video_id", "timestamp_seconds")
    table = fingerprints.select("id", "video_id", "timestamp_seconds").unionByName(numbered)
    return table, rows.join(table, ["video_id", "timestamp_seconds"]).select("video_id", "pos", "timestamp_seconds", "id")


def upsert_rows(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updates replace the rows with their keys; keys are unique in ``updates``."""
    return table.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def upsert_embeddings(vectors: DataFrame, batch: DataFrame, model_name: str, now: Column | None = None) -> DataFrame:
    """Vectors of a batch replace those of their fingerprints; of an id that comes twice the last counts."""
    stamped = last_per(batch, ["fingerprint_id"]).withColumn("model_name", F.lit(model_name)).withColumn("created_at", now if now is not None else F.current_timestamp())
    return upsert_rows(vectors, stamped, ["fingerprint_id"])


def embedding_problems(batch: DataFrame, width: int | None = None) -> DataFrame:
    """(fingerprint_id, problem) of rows that may not be stored: without an id or a vector, without a creator, or of another width.

    A batch with any such row is not to be stored; ``checked`` raises for it.
    """
    wide = F.lit(False) if width is None else F.size("embedding") != width
    problem = F.when(F.col("fingerprint_id").isNull() | F.col("embedding").isNull(), "length mismatch").when(~F.coalesce(F.col("creator_id") > 0, F.lit(False)), "creator_id is required").when(wide, "width")
    return batch.select("fingerprint_id", problem.alias("problem")).where("problem is not null")


def checked(batch: DataFrame, width: int | None = None) -> DataFrame:
    """The batch, if all its rows may be stored."""
    worst = embedding_problems(batch, width).groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a kind of problem
    if worst:
        raise ValueError("; ".join(f"{r['problem']}: {r['n']} rows" for r in worst))
    return batch


def upsert_ingest_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """The latest update of each vod, by ``updated_at``."""
    return upsert_rows(state, latest_per(updates, ["vod_platform_id"], "updated_at"), ["vod_platform_id"])


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def insert_videos(videos: DataFrame, rows: DataFrame) -> DataFrame:
    """New videos with ids; a status given wins over ``processed``, which then follows it."""
    status = F.coalesce("status", status_of(F.col("processed")))
    numbered = with_new_ids(rows, ["url", "title"], videos.agg(F.max("id").alias("last_id")))
    return videos.unionByName(numbered.withColumn("status", status).withColumn("processed", processed_of(F.col("status"))), allowMissingColumns=True)


def patch(table: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Columns that are not null in ``patches`` replace the table's."""
    names = [c for c in patches.columns if c != key]
    joined = table.join(patches.select(key, *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def patch_videos(videos: DataFrame, patches: DataFrame) -> DataFrame:
    """As ``patch``; a status wins over ``processed``, and each sets the other."""
    p = patches
    for c, kind in (("status", "string"), ("processed", "boolean")):
        p = p if c in p.columns else p.withColumn(c, F.lit(None).cast(kind))
    status = F.coalesce("status", F.when(F.col("processed").isNotNull(), status_of(F.col("processed"))))
    return patch(videos, p.withColumn("status", status).withColumn("processed", processed_of(F.col("status"))))


def changed_metadata(current: DataFrame, incoming: DataFrame, image: str = "thumbnail_url") -> DataFrame:
    """(id, title, image) of what differs: the title, or an image that is not null."""
    new = incoming.select("id", F.col("title").alias("t"), F.col(image).alias("i"))
    differs = ~F.col("t").eqNullSafe(F.col("title")) | (F.col("i").isNotNull() & ~F.col("i").eqNullSafe(F.col(image)))
    return current.join(new, "id").where(differs).select("id", F.col("t").alias("title"), F.col("i").alias(image))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def request_log(spark: SparkSession, path: str, schema: T.StructType) -> VersionedTable:
    """The request log as a table that is only added to, a folder a day."""
    return VersionedTable(spark, path, schema, cell=F.to_date("created_at"))


def append_request_log(rows: DataFrame, path: str, app: str | None = None, batch: int | None = None) -> Snapshot:
    """Append log rows in one commit; a batch that ``app`` has committed before is not added again.

    A writer that meets another's commit looks again and tries anew: appends do not exclude each other.
    """
    log = request_log(rows.sparkSession, path, rows.schema)
    while True:
        try:
            return log.add(rows, log.snapshot(), app, batch)
        except Conflict:
            continue


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a new version of a table beside the old ones and point at it; readers of an old one are not disturbed."""
    version = f"{path}/{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(version)
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/_current.txt")
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.text(f"{path}/_current.txt").first()[0])
