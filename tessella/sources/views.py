"""The media index as views over the test tables. The same SQL runs on Spark and, for the oracles, elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (source tables, SQL). Later views may use earlier ones.
VIEWS = {
    "vectors": "SELECT vec_id AS fingerprint_id, embedding, CAST(label + 1 AS BIGINT) AS creator_id FROM embeddings",
    "fingerprints": "SELECT vec_id AS fingerprint_id, CAST((label + 1) * 1000 + vec_id % 3 AS BIGINT) AS video_id, CAST(vec_id AS DOUBLE) AS timestamp_seconds FROM embeddings",
    "creators": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, concat('https://twitch.tv/', lower(n_name)) AS url, CASE WHEN n_nationkey % 3 <> 0 THEN concat('https://img.example/', lower(n_name), '.png') END AS profile_image_url FROM nation",
    "videos": """SELECT id, creator_id, url, title, thumbnail_url, status <> 'indexing' AS processed, status FROM (
        SELECT DISTINCT video_id AS id, CAST(floor(video_id / 1000) AS BIGINT) AS creator_id, concat('https://www.twitch.tv/videos/', CAST(video_id AS VARCHAR(20))) AS url, concat('Recording ', CAST(video_id AS VARCHAR(20))) AS title,
          CASE WHEN video_id % 2 = 0 THEN 'https://img.example/t.jpg' END AS thumbnail_url,
          CASE video_id % 4 WHEN 0 THEN 'indexing' WHEN 1 THEN 'searchable' WHEN 2 THEN 'deleted' ELSE 'reindex_requested' END AS status FROM fingerprints) v""",
    "all_segments": """SELECT video_id AS clip_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds) - 1 AS INT) AS seg_ord, timestamp_seconds - min(timestamp_seconds) OVER (PARTITION BY video_id) AS q_time,
          embedding, creator_id FROM fingerprints JOIN vectors USING (fingerprint_id)""",
    "segments": """SELECT video_id AS clip_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds) - 1 AS INT) AS seg_ord, timestamp_seconds - min(timestamp_seconds) OVER (PARTITION BY video_id) AS q_time,
          embedding, creator_id FROM fingerprints JOIN vectors USING (fingerprint_id) WHERE fingerprint_id % 100 = 0""",
    "clips": "SELECT v.id AS clip_id, CASE WHEN v.id % 7 = 0 THEN 'nobody' ELSE concat(' ', lower(c.name), ' ') END AS streamer FROM videos v JOIN creators c ON v.creator_id = c.id",
    "seconds": "SELECT o_orderkey AS k, CAST(floor(o_totalprice / 10) AS BIGINT) % 20000 AS s, o_custkey, o_orderdate, o_orderstatus, o_orderpriority FROM orders",
    "vods": """SELECT CAST(k AS VARCHAR(20)) AS vod_id, CAST(o_custkey AS VARCHAR(20)) AS streamer, concat('https://www.twitch.tv/videos/', CAST(k AS VARCHAR(20))) AS url, o_orderdate AS created_at, CAST(s AS INT) AS duration_seconds, k FROM seconds""",
    "vod_videos": """SELECT k AS id, CAST(o_custkey AS BIGINT) AS creator_id, concat('https://www.twitch.tv/videos/', CAST(k AS VARCHAR(20))) AS url, concat('Vod ', CAST(k AS VARCHAR(20))) AS title, CAST(NULL AS VARCHAR(20)) AS thumbnail_url,
          CASE k % 6 WHEN 0 THEN FALSE WHEN 5 THEN k % 4 = 1 ELSE TRUE END AS processed,
          CASE k % 6 WHEN 0 THEN 'indexing' WHEN 1 THEN 'searchable' WHEN 2 THEN 'deleted' WHEN 3 THEN 'reindex_requested' ELSE NULL END AS status FROM seconds WHERE k % 5 <> 0""",
    "vod_state": """SELECT CAST(k AS VARCHAR(20)) AS vod_platform_id, k AS video_id, CAST(o_custkey AS VARCHAR(20)) AS streamer, CAST(s - s % 60 AS INT) AS last_ingested_seconds, CAST(s AS INT) AS last_seen_duration_seconds, o_orderdate AS updated_at FROM seconds WHERE k % 7 < 3""",
    "requests": """SELECT event_id AS id, ts AS created_at, CASE WHEN user_id % 2 = 0 THEN 'public' ELSE 'admin' END AS source_app, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN concat('https://', CASE WHEN event_id % 9 = 0 THEN 'evil.example' ELSE 'vm.tiktok.com' END, '/v/', CAST(event_id AS VARCHAR(20))) WHEN event_id % 6 = 1 THEN 'ftp://tiktok.com/x' ELSE 'https://www.TikTok.com/@a/video/1' END END AS tiktok_url,
          CASE WHEN event_id % 4 = 0 OR event_id % 10 = 3 THEN concat('clip', CAST(event_id AS VARCHAR(20)), '.mp4') END AS filename, CAST(event_id % 50 AS BIGINT) * 5000000 AS file_size, value AS duration_seconds,
          CASE WHEN event_id % 11 = 0 THEN '  ' ELSE concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END, (CASE user_id % 13 WHEN 0 THEN 'nobody' WHEN 1 THEN 'FRANCE' WHEN 2 THEN 'china' WHEN 3 THEN 'Algeria' WHEN 4 THEN 'BRAZIL' ELSE 'canada' END)) END AS streamer,
          event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 400 ELSE 200 END AS http_status, CASE WHEN event_type = 'error' THEN 'DOWNLOAD_ERROR' END AS error_code, CASE WHEN event_type = 'error' THEN 'no file' END AS error_message,
          event_type = 'click' AS found_match, CASE WHEN event_type = 'click' THEN (user_id % 10 + 1) * 1000 + event_id % 4 END AS matched_video_id, CAST(CASE WHEN event_type = 'click' THEN event_id % 5000 END AS INT) AS matched_timestamp_seconds,
          CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'completed' END AS job_status, CASE event_id % 5 WHEN 0 THEN 'validating' WHEN 1 THEN 'embedding' END AS job_stage,
          CASE WHEN event_id % 5 > 0 THEN ts END AS started_at, CASE WHEN event_id % 5 > 1 THEN ts END AS finished_at, CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 25 + 1 AS BIGINT) END AS creator_id, event_type, user_id, value FROM events""",
    "snapshots": "SELECT CAST(user_id AS VARCHAR(20)) AS vod_id, ts, event_id, event_type <> 'error' AS is_live, CAST(floor(value) AS INT) * 10 AS duration_seconds, CAST(60 AS INT) AS cursor FROM events",
}
#: The source tables with their declared columns: no file is opened to find them.
SOURCES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def needed(name: str) -> list[str]:
    """A view and all it uses, in an order that works."""
    out: list[str] = []
    for other in VIEWS:
        if other == name:
            break
        if any(word == other for word in VIEWS[name].replace("(", " ").replace(")", " ").replace("\n", " ").split()):
            out += [x for x in needed(other) if x not in out]
    return [*out, name]


def with_views(*names: str) -> str:
    """The common table expressions of some views, for an SQL text."""
    order: list[str] = []
    for n in names:
        order += [x for x in needed(n) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame, read from the Parquet tables of a folder."""
    for table in SOURCES:
        if any(table in VIEWS[n].replace("\n", " ").split() for n in needed(name)):
            spark.read.schema(SOURCES[table]).parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    order = needed(name)
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    df = spark.sql(f"WITH {text} SELECT * FROM {name}")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})  # times are UTC
