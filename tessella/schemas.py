"""The tables of the media index, and a report of what a set of tables lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _S, _I, _D, _B, _TS = T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


CREATORS = _table(id=_L, name=_S, url=_S, profile_image_url=_S)
VIDEOS = _table(id=_L, creator_id=_L, url=_S, title=_S, thumbnail_url=_S, processed=_B, streamed_at=_TS, status=_S)
FINGERPRINTS = _table(id=_L, video_id=_L, timestamp_seconds=_D)
EMBEDDINGS = _table(fingerprint_id=_L, embedding=T.ArrayType(T.FloatType()), creator_id=_L, model_name=_S, created_at=_TS)
INGEST_STATE = _table(vod_platform_id=_S, video_id=_L, streamer=_S, last_ingested_seconds=_I, last_seen_duration_seconds=_I, updated_at=_TS)
SEARCH_REQUESTS = _table(
    id=_L, created_at=_TS, source_app=_S, route=_S, input_type=_S, streamer=_S, creator_id=_L, success=_B, http_status=_I, error_code=_S, error_message=_S, result_reason=_S,
    found_match=_B, matched_video_id=_L, matched_timestamp_seconds=_I, score=_D, clip_filename=_S, download_source=_S, download_host=_S, input_duration_seconds=_D,
    preprocess_duration_ms=_I, embed_duration_ms=_I, vector_duration_ms=_I, alignment_duration_ms=_I, total_duration_ms=_I, job_status=_S, job_stage=_S, started_at=_TS, finished_at=_TS, tiktok_url=_S,
)
TABLES = {"creators": CREATORS, "videos": VIDEOS, "fingerprints": FINGERPRINTS, "fingerprint_embeddings": EMBEDDINGS, "vod_ingest_state": INGEST_STATE, "search_requests": SEARCH_REQUESTS}

VOD_PAGE = T.StructType([
    T.StructField("user_id", _S), T.StructField("page", _I),
    T.StructField("data", T.ArrayType(_table(id=_S, title=_S, duration=_S, created_at=_S, thumbnail_url=_S, viewable=_S))),
    T.StructField("pagination", _table(cursor=_S)),
])


def schema_report(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, T.StructType] = TABLES) -> DataFrame:
    """(kind, name) of all missing tables, then all missing columns of the tables that are there."""
    rows = [("table", t) for t in expected if t not in tables]
    rows += [("column", f"{t}.{c}") for t, s in expected.items() if t in tables for c in s.names if c not in tables[t].columns]
    return spark.createDataFrame(rows, "kind string, name string")
