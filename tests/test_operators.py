"""Small tables with known answers."""

import datetime as dt
import io
import os
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import schemas
from tessella.functions import scalars as X
from tessella.operators import align, catalog, knn, lifecycle, requests, writes
from tessella.plans import ingest
from tessella.sources import audio, vods
from tessella.streaming.ingest import into_table
from tessella.streaming import monitor, webhook


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return df.select(column).first()[0]


FPS = [(31, 5, 62.0), (32, 5, 64.0), (33, 9, 7.0)]


@pytest.mark.parametrize("votes,ratio,found", [(2, 0.5, True), (5, 0.9, False)])
def test_align(spark, votes, ratio, found):
    fps = spark.createDataFrame(FPS, "fingerprint_id long, video_id long, timestamp_seconds double")
    lists, times = [[33, 31], [31, 33], [32], [33, 32]], [0.0, 0.0, 2.0, 2.0]
    neighbours = spark.createDataFrame([(1, s, r + 1, f) for s, row in enumerate(lists) for r, f in enumerate(row)], "clip_id long, seg_ord int, rank int, fingerprint_id long")
    segments = spark.createDataFrame([(1, s, t) for s, t in enumerate(times)], "clip_id long, seg_ord int, q_time double")
    got = align.align(neighbours, segments, fps, votes, ratio).first()
    assert got["found"] is found and got["votes"] == 4 and got["ratio"] == 1.0
    if found:
        assert (got["video_id"], got["offset"], got["reason"]) == (5, 62, "Accepted with 4 votes (1.000 ratio)")
    else:
        assert got["reason"] == "Best candidate vote count 4 is below min_vote_count 5"


def test_align_unknown_ids_and_ties(spark):
    fps = spark.createDataFrame(FPS, "fingerprint_id long, video_id long, timestamp_seconds double")
    neighbours = spark.createDataFrame([(1, 0, 1, 99), (2, 0, 1, 33), (2, 0, 2, 31)], "clip_id long, seg_ord int, rank int, fingerprint_id long")
    segments = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)], "clip_id long, seg_ord int, q_time double")
    got = {r["clip_id"]: r for r in align.align(neighbours, segments, fps, 1, 0.01).collect()}
    assert got[1]["reason"] == "No fingerprint rows resolved" and got[3]["reason"] == "No neighbors returned"
    assert got[2]["video_id"] == 9  # the first seen wins a tie


@pytest.mark.parametrize("method", ["block", "expr"])
def test_knn(spark, method):
    vectors = spark.createDataFrame([(10, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (30, [-1.0, 0.0], 1), (40, [0.0, 0.0], 1), (50, [1.0, 0.0], 2)], "fingerprint_id long, embedding array<float>, creator_id long")
    segments = spark.createDataFrame([(1, 0, [0.9, 0.1], 1), (1, 1, [-0.8, 0.2], 1), (2, 0, [1.0, 0.0], 9)], "clip_id long, seg_ord int, embedding array<float>, creator_id long")
    rows = knn.knn_join(segments, vectors, 2, method=method).orderBy("seg_ord", "rank").collect()
    assert [r["fingerprint_id"] for r in rows] == [10, 20, 30, 20]
    assert rows[0]["score"] > rows[1]["score"]
    assert knn.knn_join(segments, vectors, 9, method=method).where("seg_ord = 0").count() == 4  # more than there are; zero vectors count
    assert knn.knn_join(segments.limit(0), vectors, 2, method=method).count() == 0


@pytest.mark.parametrize("s,text", [(0, "0s"), (7, "7s"), (61, "1m1s"), (754, "12m34s"), (7200, "2h0m0s"), (40271, "11h11m11s"), (-1, None)])
def test_offset_text(spark, s, text):
    assert one(spark, X.offset_text(F.col("s")), s=s) == text


@pytest.mark.parametrize("url,s,out", [
    ("https://x.tv/v/8?t=9h&lang=en", 90, "https://x.tv/v/8?lang=en&t=1m30s"), ("https://x.tv/a#top", 5, "https://x.tv/a?t=5s#top"), ("https://x.tv/a?a", 5, "https://x.tv/a?a=&t=5s"),
    ("https://x.tv/a?k=~*", 5, "https://x.tv/a?k=~%2A&t=5s"), ("/no/scheme", 5, None), ("https://x.tv", -1, None),
])
def test_timestamp_url(spark, url, s, out):
    assert one(spark, X.timestamp_url(F.col("u"), F.col("s")), u=url, s=s) == out


@pytest.mark.parametrize("text,s", [("2h0m7s", 7207), ("8m", 480), ("31s", 31), ("", 0), ("1x2m", 720), ("h5m", 300), ("1h1h", 7200), ("90", 0), (None, 0)])
def test_duration(spark, text, s):
    assert one(spark, X.duration_seconds(F.col("t")), t=text) == s


def test_rounding(spark):
    assert [one(spark, X.rounded_offset(F.col("x")), x=v) for v in (0.5, 1.5, 2.5, -0.5)] == [0, 2, 2, 0]
    assert one(spark, X.ratio_text(F.col("x")), x=0.0625) == "0.062"
    assert one(spark, X.clock_text(F.col("x")), x=3661.9) == "01:01:01" and one(spark, X.clock_text(F.col("x")), x=float("nan")) is None


def test_iso(spark):
    assert one(spark, X.iso_text(X.iso_time(F.col("t"))), t="2026-03-05T01:02:03.5Z") == "2026-03-05T01:02:03.500000Z"
    assert one(spark, X.iso_text(X.iso_time(F.col("t"))), t="2026-03-05T01:02:03") == "2026-03-05T01:02:03Z"
    assert one(spark, X.iso_time(F.col("t")), t="bad") is None


def test_vod_pages(spark):
    item = lambda i, t, d="1h0m0s": (i, "x", d, t, "a%{width}x%{height}.jpg", "public")
    pages = spark.createDataFrame([("u", 1, [item("300", "2026-03-09T00:00:00Z"), item("200", "2026-03-08T00:00:00Z")], ("c",)), ("u", 2, [item("100", "2026-03-01T00:00:00Z"), item(" ", "2026-03-10T00:00:00Z")], None), ("w", 1, [item("111", "2026-03-01T10:00:00Z"), item("222", "2026-03-01T12:00:00Z", "2h3m4s")], None)], schemas.VOD_PAGE)
    since = vods.vods_since(pages.where("user_id = 'u'"), F.lit("2026-03-05").cast("timestamp")).collect()
    assert [r["vod_id"] for r in since] == ["300", "200"]
    latest = vods.latest_vod(pages).collect()
    assert [(r["vod_id"], r["duration_seconds"], r["thumbnail_url"]) for r in latest] == [("222", 7384, "a320x180.jpg")]  # u's newest has no id


STATE = [("reindex", "reindex_requested", True, 90), ("deleted", "deleted", True, None), ("searchable", "searchable", True, None), ("indexing", "indexing", False, None), ("legacy-processed", None, True, 5), ("legacy", None, False, None), ("resume", "indexing", False, 60)]


def test_backlog(spark):
    now = dt.datetime(2026, 1, 1)
    vods_ = spark.createDataFrame([(n, "s", f"u/{n}", now, 180) for n in ["missing", *[s[0] for s in STATE]]], "vod_id string, streamer string, url string, created_at timestamp, duration_seconds int")
    videos = spark.createDataFrame([(i, 1, f"u/{n}", p, s) for i, (n, s, p, _) in enumerate(STATE)], "id long, creator_id long, url string, processed boolean, status string")
    state = spark.createDataFrame([(n, c) for n, _, _, c in STATE if c is not None], "vod_platform_id string, last_ingested_seconds int")
    got = {r["vod_id"]: (r["decision"], r["reason"], r["cursor"]) for r in ingest.backlog(vods_, videos, state).collect()}
    assert got == {
        "missing": ("eligible", None, 0), "reindex": ("eligible", None, 0), "deleted": ("skip", "deleted", None), "searchable": ("skip", "searchable", None), "indexing": ("skip", "indexing", None),
        "legacy-processed": ("skip", "processed", None), "legacy": ("eligible", None, 0), "resume": ("eligible", None, 60),
    }
    plan = ingest.chunk_plan(ingest.backlog(vods_, videos, state).where("vod_id = 'resume'")).collect()
    assert [(r["start"], r["length"], r["name"]) for r in plan] == [(60, 60, "vod_resume_00000060_0060.wav"), (120, 60, "vod_resume_00000120_0060.wav")]


def test_commands(spark):
    videos = spark.createDataFrame([(1, 99, "searchable", True), (2, 99, "deleted", True), (3, 42, "searchable", True)], "id long, creator_id long, status string, processed boolean")
    fps = spark.createDataFrame([(10, 1, 0.0), (11, 3, 0.0)], "fingerprint_id long, video_id long, timestamp_seconds double")
    vectors = spark.createDataFrame([(10,), (11,)], "fingerprint_id long")
    state = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "vod_platform_id string, video_id long")
    commands = spark.createDataFrame([(1, "delete", 1, 99), (2, "delete", 2, 99), (3, "delete", 3, 99), (4, "reindex", 2, 99), (5, "reindex", 3, 42), (6, "delete", 7, 99)], "cmd_id long, op string, video_id long, actor_creator_id long")
    out = lifecycle.apply_video_commands(commands, videos, fps, vectors, state)
    assert {r["cmd_id"]: r["outcome"] for r in out["outcomes"].collect()} == {1: "accepted", 2: "unchanged", 3: "owner_mismatch", 4: "accepted", 5: "invalid_transition", 6: "not_found"}
    assert {r["id"]: (r["status"], r["processed"]) for r in out["videos"].collect()} == {1: ("deleted", True), 2: ("reindex_requested", True), 3: ("searchable", True)}
    assert [r[0] for r in out["vectors"].collect()] == [11] and [r["vod_platform_id"] for r in out["state"].collect()] == ["c"]


def test_upserts(spark):
    fps = spark.createDataFrame([(1, 5, 0.0), (2, 5, 1.0)], "id long, video_id long, timestamp_seconds double")
    batch = spark.createDataFrame([(5, [1.0, 2.0, 2.0]), (6, [0.0])], "video_id long, timestamps array<double>")
    table, ids = writes.upsert_fingerprints(fps, batch)
    rows = {(r["video_id"], r["pos"]): r["id"] for r in ids.collect()}
    assert rows[5, 0] == 2 and rows[5, 1] == rows[5, 2] and table.count() == 4 and sorted(r["id"] for r in table.collect()) == [1, 2, 3, 4]
    creators = spark.createDataFrame([(7, "xQc", "u", "i")], "id long, name string, url string, profile_image_url string")
    new = spark.createDataFrame([("u", "xqc", None), ("v", "new", None)], "url string, name string, profile_image_url string")
    assert sorted(map(tuple, writes.upsert_creators(creators, new).select("id", "name", "profile_image_url").collect())) == [(7, "xqc", "i"), (8, "new", None)]
    videos = spark.createDataFrame([(55, "old", None, True, "searchable")], "id long, title string, thumbnail_url string, processed boolean, status string")
    got = writes.patch_videos(videos, spark.createDataFrame([(55, "t", "th", False)], "id long, title string, thumbnail_url string, processed boolean")).first()
    assert tuple(got) == (55, "t", "th", False, "indexing")


def test_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writes.write_snapshot(spark.range(3), path)
    first = writes.read_snapshot(spark, path)
    writes.write_snapshot(first.where("id > 0"), path)
    assert first.count() == 3 and writes.read_snapshot(spark, path).count() == 2


def test_names_and_statuses(spark):
    creators = spark.createDataFrame([(7, "xQc")], "id long, name string")
    names = spark.createDataFrame([(" XqC ",), ("nobody",), (" ",)], "name string")
    assert {r["name"]: (r["creator_id"], r["blank"]) for r in catalog.creators_by_name(creators, names).collect()} == {" XqC ": (7, False), "nobody": (None, False), " ": (None, True)}


def _ttl(spark, times):
    base = dt.datetime(2026, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=t), i) for i, (k, t) in enumerate(times)]
    return {r["n"] for r in webhook.ttl_dedup(spark.createDataFrame(rows, "id string, ts timestamp, n int"), "id", "ts").collect()}


def test_ttl_dedup(spark):
    assert _ttl(spark, [("a", 0), ("a", 400), ("a", 700)]) == {0, 2}
    assert _ttl(spark, [("a", 0), ("a", 600)]) == {0, 1}
    assert _ttl(spark, [("", 0), ("", 1), (None, 1)]) == {0, 1, 2}


def test_webhook(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [("1", "notification", "2026-01-01T00:00:00Z", '{"subscription":{"type":"stream.online"},"event":{"broadcaster_user_login":" XqC "}}', base), ("2", "revocation", "2026-01-01T00:00:00Z", "{}", base + dt.timedelta(seconds=601)), ("", "notification", "2026-01-01T00:00:00Z", "{}", base)]
    df = spark.createDataFrame(rows, "message_id string, message_type string, message_ts string, body string, arrival_ts timestamp")
    signed = df.withColumn("signature", webhook.signature("s", F.col("message_id"), F.col("message_ts"), F.col("body")))
    assert [r["problem"] for r in webhook.verified(signed, "s").orderBy("message_id").collect()] == ["missing header", None, "outside the allowed skew"]
    assert {r["problem"] for r in webhook.verified(signed, "other").where("message_id = '1'").collect()} == {"bad signature"}
    got = {r["message_id"]: (r["kind"], r["streamer"], r["detail"]) for r in webhook.routed(df).collect()}
    assert got["1"] == ("online", "xqc", None) and got["2"] == ("degraded", None, "revoked")


@pytest.mark.parametrize("rows,expected", [
    ([("v1", True, 240)], [(0, 60, "chunk"), (60, 60, "chunk")]),
    ([("v1", True, 240), ("v1", False, 240), ("v1", False, 240), ("v1", False, 240)], [(0, 60, "chunk"), (60, 60, "chunk"), (120, 60, "chunk"), (180, 60, "chunk"), (240, 0, "searchable")]),
    ([("v1", True, 300), ("v2", True, 180)], [(0, 60, "chunk"), (60, 60, "chunk"), (120, 60, "chunk"), (0, 60, "chunk")]),
])
def test_live_chunks(spark, rows, expected):
    base = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("s", base + dt.timedelta(seconds=i), i, v, live, d) for i, (v, live, d) in enumerate(rows)], "streamer string, ts timestamp, event_id long, vod_id string, is_live boolean, duration_seconds long")
    assert [(r["start"], r["length"], r["status"]) for r in monitor.live_chunks(df).collect()] == expected


def polls(spark, rows):
    base = dt.datetime(2026, 3, 1)
    schema = "streamer string, ts timestamp, event_id long, vod_id string, is_live boolean, duration_seconds long, video_status string, saved_seconds long, saved_longest long"
    df = spark.createDataFrame([("s", base + dt.timedelta(seconds=i), i, *r) for i, r in enumerate(rows)], schema).repartition(3)
    return [(r["event_id"], r["start"], r["length"], r["still"], r["afresh"], r["status"]) for r in monitor.live_polls(df).orderBy("event_id").collect()]


def test_still_checks_outlast_live_polls(spark):
    """Checks while live neither count nor reset: only growth does. The fifth poll is the third still one."""
    rows = [("v", live, 100, None, 100, 100) for live in (True, False, False, True, False, False)]
    assert polls(spark, rows) == [(0, 100, 0, 0, False, "waiting"), (1, 100, 0, 1, False, "waiting"), (2, 100, 0, 2, False, "waiting"), (3, 100, 0, 2, False, "waiting"), (4, 100, 0, 3, False, "searchable")]


def test_polls_commit_the_chunk_before(spark):
    rows = [("v", True, 400, None, None, None), ("v", True, 400, None, None, None), ("v", False, 130, None, None, None), ("v", False, 400, "reindex_requested", None, None), ("v", False, 400, "reindex_requested", None, None),
            ("v", False, 400, "deleted", None, None), ("v", False, 500, None, None, None), ("w", False, 90, None, 60, None), ("w", False, 90, None, 60, None)]
    assert polls(spark, rows) == [
        (0, 0, 60, 0, False, "chunk"), (1, 60, 60, 0, False, "chunk"), (2, 120, 60, 1, False, "chunk"), (3, 0, 60, 0, True, "chunk"), (4, 60, 60, 1, False, "chunk"), (7, 60, 30, 0, False, "chunk"), (8, 90, 0, 1, False, "waiting"),
    ]


def test_feed_health(spark):
    from tessella.streaming import feed

    base = dt.datetime(2026, 3, 1)
    body = '{"subscription": {"type": "%s", "status": "%s"}, "event": {"broadcaster_user_login": " Ann "}}'
    rows = [("a", "notification", body % ("stream.online", "")), ("b", "revocation", body % ("", "gone")), ("b", "revocation", body % ("", "gone")), ("c", "notification", body % ("stream.offline", "")), ("d", "revocation", body % ("", ""))]
    sent = spark.createDataFrame([(m, t, "2026-03-01T00:00:00Z", b, base + dt.timedelta(seconds=i)) for i, (m, t, b) in enumerate(rows)], "message_id string, message_type string, message_ts string, body string, arrival_ts timestamp")
    signed = sent.withColumn("signature", webhook.signature("k", F.col("message_id"), F.col("message_ts"), F.col("body")))
    got = [tuple(r)[2:] for r in feed.feed_status(signed, "k").orderBy("arrival_ts").collect()]
    assert got == [("a", "online", "ingesting", True, True, "healthy", None), ("b", "degraded", "ingesting", True, True, "degraded", "gone"), ("c", "offline", "ingesting", False, True, "healthy", None), ("d", "degraded", "ingesting", False, True, "degraded", "revoked")]
    assert feed.feed_status(signed, "other").count() == 0


def test_batches_that_may_not_be_stored(spark):
    schema = "fingerprint_id long, embedding array<float>, creator_id long"
    good = spark.createDataFrame([(1, [1.0, 2.0], 5)], schema)
    assert writes.checked(good, 2).count() == 1
    for row, text in (((None, [1.0, 2.0], 5), "length mismatch"), ((1, [1.0, 2.0], None), "creator_id is required"), ((1, [1.0], 5), "width")):
        with pytest.raises(ValueError, match=text):
            writes.checked(good.unionByName(spark.createDataFrame([row], schema)), 2)


def test_requests(spark):
    names = spark.createDataFrame([("Jason",)], "name string")
    rows = [(1, "admin", "a.mp4", 10, None, "jason ", 10.0), (2, "admin", "a.mp4", 10, "https://tiktok.com/x", "jason", 10.0), (3, "public", None, None, "https://evil.com/x", "jason", 1.0), (4, "admin", "a.mp4", 0, None, "jason", 1.0),
            (5, "admin", "a.mp4", 5, None, "jason", 180.5), (6, "public", None, None, "https://vm.tiktok.com/x", "who", 1.0), (7, "public", None, None, None, "jason", 1.0)]
    df = spark.createDataFrame(rows, "request_id long, source_app string, filename string, file_size long, tiktok_url string, streamer string, duration_seconds double")
    got = {r["request_id"]: (r["error_code"], r["error_message"]) for r in requests.validate_requests(df, names).collect()}
    assert got[1] == (None, None) and got[2][1] == "Provide exactly one of file or tiktok_url" and got[3] == ("INVALID_TIKTOK_URL", "Only TikTok URLs are supported") and got[4] == ("INVALID_UPLOAD", "Uploaded file is empty")
    assert got[5] == ("INPUT_DURATION_EXCEEDED", "Input video is 181s; maximum allowed is 180s") and got[6] == ("INVALID_STREAMER", "Streamer is not searchable: who") and got[7] == ("INVALID_SEARCH_INPUT", "tiktok_url is required")


def test_audio(spark):
    rows, times = audio.cut_segments(np.zeros(32_000, np.float32), 16_000, 1.5)
    assert times.tolist() == [1.5, 2.5] and audio.cut_segments(np.ones(16_001, np.float32), 16_000, 0)[0].shape == (2, 16_000) and not len(audio.cut_segments(np.zeros(0, np.float32), 16_000, 0)[0])
    with pytest.raises(ValueError):
        audio.cut_segments(np.zeros(5, np.float32), 8_000, 0)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16_000)
        w.writeframes(np.zeros(16_000 * 3 + 1, "<i2").tobytes())
    files = spark.createDataFrame([("a.wav", bytearray(out.getvalue()))], "path string, content binary")
    found = audio.embed_segments(audio.audio_chunks(files, 2)).collect()
    assert sorted(r["timestamp_seconds"] for r in found) == [0.0, 1.0, 2.0, 3.0] and {len(r["embedding"]) for r in found} == {64}


def test_recordings_in_blocks(spark):
    """Blocks of a recording are bounded and give the chunks of one long WAV."""
    values = [(k, i, None if i % 50 == 7 else float((i * 37 + k) % 5000)) for k, n in ((1, 1000), (2, 80), (3, 81), (4, 1)) for i in range(n)]
    rows = spark.createDataFrame(values, "k long, i long, v double").repartition(7)
    files = audio.wavs_from_values(rows, "k", "i", "v", block_seconds=2)
    assert files.groupBy("path").count().where("path = '1.wav'").first()["count"] == 13
    assert max(len(r["content"]) for r in files.collect()) <= 2 * 16_000 * 2 + 100
    got = {(r["path"], r["offset_seconds"]): np.frombuffer(r["samples"], np.float32) for r in audio.audio_chunks(files, 1).collect()}
    for k in (1, 2, 3, 4):
        pitch = np.repeat([200 + (v or 0) % 3000 for a, _, v in values if a == k], 400)
        x = (np.sin(2 * np.pi * np.cumsum(pitch) / 16_000) * 20000).astype("<i2") / 32768
        seconds = -(-len(x) // 16_000)
        whole = np.zeros(seconds * 16_000)
        whole[: len(x)] = x
        assert sorted(t for p, t in got if p == f"{k}.wav") == list(range(seconds))
        assert np.abs(np.concatenate([got[f"{k}.wav", float(t)] for t in range(seconds)]) - whole).max() < 1e-3
    with pytest.raises(ValueError):
        audio.wavs_from_values(rows, "k", "i", "v", samples_per_value=7)


def test_job_events(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    kinds = "id long, ts timestamp, status string, stage string, started boolean, error_code string, error_message string, http_status int"
    jobs = spark.createDataFrame([(7, "queued", "validating", None, None, None, None, None), (8, "queued", "validating", None, None, None, None, None)], "id long, job_status string, job_stage string, started_at timestamp, finished_at timestamp, error_code string, error_message string, http_status int")
    events = spark.createDataFrame([(7, at(1), "running", "downloading", True, None, None, None), (7, at(2), None, "embedding", False, None, None, None), (7, at(3), "failed", None, False, "DOWNLOAD_ERROR", "no", 400)], kinds)
    got = {r["id"]: r for r in lifecycle.fold_job_events(jobs, events).collect()}
    assert (got[7]["job_status"], got[7]["job_stage"], got[7]["error_code"]) == ("failed", None, "DOWNLOAD_ERROR") and got[7]["started_at"] == at(1) and got[7]["finished_at"] == at(3)
    assert (got[8]["job_status"], got[8]["job_stage"]) == ("queued", "validating")


def test_schema_report(spark):
    rows = schemas.schema_report(spark, {"creators": spark.range(1)}).collect()
    assert ("table", "videos") in map(tuple, rows) and ("column", "creators.name") in map(tuple, rows)


def test_observed_plan_and_log(spark, tmp_path):
    plan, seen = ingest.observed(spark.createDataFrame([("v", 0, 60), ("v", 60, 5)], "vod_id string, start long, length long"))
    plan.collect()
    assert seen.get == {"chunks": 2, "seconds": 65}
    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 5)), (2, dt.datetime(2026, 1, 2, 5))], "id long, created_at timestamp")
    for _ in range(2):
        writes.append_request_log(rows, f"{tmp_path}/log")
    for n in (0, 0, 1, 0):  # a batch that is sent again is not added again
        writes.append_request_log(rows, f"{tmp_path}/log", "api", n)
    log = writes.request_log(spark, f"{tmp_path}/log", rows.schema)
    assert log.read().count() == 8 and log.read(cells=["2026-01-02"]).count() == 4


def test_commands_see_those_before_them(spark):
    videos = spark.createDataFrame([(1, 5, "searchable", True), (2, 5, "deleted", True)], "id long, creator_id long, status string, processed boolean")
    ops = [("reindex", 1, 5), ("delete", 1, 6), ("delete", 1, 5), ("delete", 1, 5), ("reindex", 1, 5), ("reindex", 1, 5), ("delete", 1, 5), ("delete", 2, 5), ("reindex", 2, 5)]
    commands = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "cmd_id long, op string, video_id long, actor_creator_id long").repartition(3)
    got = {r["cmd_id"]: (r["was"], r["outcome"]) for r in lifecycle.command_outcomes(commands, videos).collect()}
    assert got == {
        0: ("searchable", "invalid_transition"), 1: ("searchable", "owner_mismatch"), 2: ("searchable", "accepted"), 3: ("deleted", "unchanged"), 4: ("deleted", "accepted"),
        5: ("reindex_requested", "unchanged"), 6: ("reindex_requested", "invalid_transition"), 7: ("deleted", "unchanged"), 8: ("deleted", "accepted"),
    }
    empty = spark.createDataFrame([], "fingerprint_id long, video_id long, vod_platform_id string")
    out = lifecycle.apply_video_commands(commands, videos, empty, empty, empty)
    assert {r["id"]: r["status"] for r in out["videos"].collect()} == {1: "reindex_requested", 2: "reindex_requested"}


def test_keys_that_come_twice(spark):
    vectors = spark.createDataFrame([(1, [0.0])], "fingerprint_id long, embedding array<float>")
    batch = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (1, [3.0])], "fingerprint_id long, embedding array<float>").coalesce(1)
    assert sorted((r["fingerprint_id"], r["embedding"]) for r in writes.upsert_embeddings(vectors.withColumns({"model_name": F.lit(""), "created_at": F.current_timestamp()}), batch, "m").collect()) == [(1, [3.0]), (2, [2.0])]
    creators = spark.createDataFrame([(4, "old", "u", "i")], "id long, name string, url string, profile_image_url string")
    new = spark.createDataFrame([("u", "a", "j"), ("w", "x", None), ("u", "b", None), ("w", "y", "k")], "url string, name string, profile_image_url string").coalesce(1)
    assert sorted(map(tuple, writes.upsert_creators(creators, new).collect())) == [(4, "b", "u", "j"), (5, "y", "w", "k")]


def test_polls_wait_from_the_last_one(spark):
    base = dt.datetime(2026, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    polls = spark.createDataFrame([("a", at(s)) for s in (119, 121, 238, 239, 300, 360)], "streamer string, ts timestamp")
    health = spark.createDataFrame([("a", at(350), True)], "streamer string, ts timestamp, healthy boolean")
    assert sorted((r["ts"] - base).seconds for r in monitor.fallback_polls(polls, health).collect()) == [119, 239]


def test_blank_ids_in_a_stream(spark, tmp_path):
    rows = [("", dt.datetime(2026, 1, 1, 0, 0, i), i) for i in range(3)] + [(None, dt.datetime(2026, 1, 1), 5), ("k", dt.datetime(2026, 1, 1), 6), ("k", dt.datetime(2026, 1, 1, 0, 0, 9), 7)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, n int")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
    into_table(webhook.stream_ttl_dedup(stream, "key", "ts", 600), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r["n"] for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 5, 6]


def test_live_switch(spark):
    """A saved place is taken up, a finished video stops its recording, and one to be reindexed starts again."""
    base = dt.datetime(2026, 1, 1)
    rows = [("v1", False, 150, "indexing", 60, 90), ("v1", False, 150, "reindex_requested", None, None), ("v1", False, 200, "deleted", None, None), ("v2", True, 500, "searchable", None, None), ("v3", True, 200, None, None, None)]
    schema = "streamer string, ts timestamp, event_id long, vod_id string, is_live boolean, duration_seconds long, video_status string, saved_seconds long, saved_longest long"
    df = spark.createDataFrame([("s", base + dt.timedelta(seconds=i), i, *r) for i, r in enumerate(rows)], schema)
    got = [(r["vod_id"], r["start"], r["length"], r["status"]) for r in monitor.live_chunks(df).collect()]
    assert got == [("v1", 60, 60, "chunk"), ("v1", 120, 30, "chunk"), ("v1", 0, 0, "indexing"), ("v1", 0, 60, "chunk"), ("v1", 60, 60, "chunk"), ("v1", 120, 30, "chunk"), ("v3", 0, 60, "chunk"), ("v3", 60, 20, "chunk")]


def test_archive_session(spark):
    """Polls and stops one by one: a poll commits what the poll before it brought."""
    rng, rows, expected = random.Random(3), [], {}
    for vod in range(30):
        cursor, pending, over, duration = rng.choice([0, 60, 400]), None, False, rng.choice([0, 59, 60, 61, 250])
        saved = cursor
        for event in range(15):
            kind = "stop" if rng.random() < 0.3 else "poll"
            rows.append((vod, dt.datetime(2026, 1, 1, 0, 0, event // 2), event, kind, saved if saved or vod % 2 else None, duration))
            if kind == "stop":
                pending = None
            elif not over:
                cursor, pending = (cursor if pending is None else pending), None
                if cursor >= duration:
                    over = True
                    expected[vod, event] = (cursor, 0, "searchable")
                else:
                    pending = cursor + min(60, duration - cursor)
                    expected[vod, event] = (cursor, pending - cursor, "chunk")
    df = spark.createDataFrame(rows, "vod_id long, ts timestamp, event_id long, kind string, saved long, duration_seconds long").repartition(4)
    assert {(r["vod_id"], r["event_id"]): (r["start"], r["length"], r["status"]) for r in ingest.archive_session(df).collect()} == expected
    assert ingest.archive_session(df.limit(0)).count() == 0


def test_ingest_into(spark, tmp_path):
    """Chunks in three micro-batches: ids stay, later vectors win, empty ones go, and a replay changes nothing."""
    from tessella.streaming import ingest

    schema, base = "video_id long, creator_id long, timestamp_seconds double, embedding array<double>", f"file://{tmp_path}"
    batches = [[(1, 7, 0.0, [1.0]), (1, 7, 1.0, [2.0]), (1, 7, 2.0, [])], [(1, 7, 1.0, [3.0]), (2, 8, 0.0, [4.0]), (2, 8, 0.0, [4.0]), (None, 8, 0.0, [5.0])], [(2, 8, 1.0, [6.0]), (2, 8, 2.0, None)]]
    for at, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{at}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
        ingest.ingest_into(stream, lambda b: b, f"{base}/out", f"{base}/checkpoint", "m", last_id=10).awaitTermination()
    got = {(r["video_id"], r["timestamp_seconds"]): r for r in ingest.stored_vectors(spark, f"{base}/out").collect()}
    assert {k: r["embedding"] for k, r in got.items()} == {(1, 0.0): [1.0], (1, 1.0): [3.0], (2, 0.0): [4.0], (2, 1.0): [6.0]}
    assert sorted(r["id"] for r in got.values()) == [11, 12, 13, 14] and {r["creator_id"] for k, r in got.items() if k[0] == 2} == {8}
    first = {(r["video_id"], r["timestamp_seconds"]): r["id"] for r in ingest.stored_batches(spark, f"{base}/out").where("batch = 0").collect()}
    assert all(got[k]["id"] == i for k, i in first.items())
    os.remove(tmp_path / "checkpoint" / "commits" / "2")  # as if the last micro-batch had failed after its rows were written
    (tmp_path / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
    ingest.ingest_into(stream, lambda b: b, f"{base}/out", f"{base}/checkpoint", "m", last_id=10).awaitTermination()
    again = {(r["video_id"], r["timestamp_seconds"]): r for r in ingest.stored_vectors(spark, f"{base}/out").collect()}
    assert again == got


def test_parts_of_a_stream(spark, tmp_path):
    """A part is one micro-batch of several files, parts come in order, their number follows the rows, and states have no more partitions than there are cores."""
    from tessella import queries

    rows = spark.range(0, 1000, 1, 3).select((F.col("id") % 7).cast("string").alias("streamer"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("event_id"), F.lit("online").alias("kind"))
    late = rows.union(spark.sql("select 'x', cast(null as timestamp), -1L, 'online'"))
    parts = queries._ranged(late, "ts", 200)
    assert [r["__part"] for r in parts.where("ts is null").collect()] == [0]
    sizes = parts.groupBy("__part").count().orderBy("__part").collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) <= 200
    assert queries._ranged(rows, "ts", 10**6).select("__part").distinct().count() == 4
    stream, base, arrivals = queries._source(queries._ranged(rows, "ts", 200))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        for _ in arrivals:
            into_table(monitor.stream_status(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = spark.read.parquet(f"{base}/out").groupBy("batch").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("batch").collect()
    assert len(found) == 5 and sum(r["n"] for r in found) == 1000
    assert all(x["b"] + 1 == y["a"] for x, y in zip(found, found[1:]))
    states = [d for d in os.listdir(f"{base}/checkpoint/state/0".removeprefix("file://")) if d.isdigit()]
    assert len(states) <= spark.sparkContext.defaultParallelism


def test_log_rows_of_one_time(spark, tmp_path):
    from tessella import queries

    spark.range(5).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' as ts", "id as user_id", "'click' as event_type", "1.5D as value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["id"] for r in queries.queries()["request_log_rows"](spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4]


def test_audio_of_a_stream_is_small(spark, monkeypatch):
    """What a stream of recordings stores: WAVs of five seconds in parts of an hour at most."""
    from tessella import queries

    seen = []
    monkeypatch.setattr(queries, "_source", lambda parted, *order: seen.append(parted) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.queries()["stream_ingest"](spark, "/root/testdata/sf0.01")
    sizes = seen[0].groupBy("__part").agg(F.max(F.length("content")).alias("bytes"), (F.max("offset_seconds") - F.min("offset_seconds")).alias("width")).collect()
    assert len(sizes) > 1 and all(r["bytes"] <= 44 + 2 * 5 * audio.RATE and r["width"] < 3600 for r in sizes)


def test_progress_in_few_batches(spark, monkeypatch):
    from tessella import queries

    seen = []
    monkeypatch.setattr(queries, "_ranged", lambda df, order, rows: seen.append(rows) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.queries()["ingest_progress"](spark, "/root/testdata/sf0.001")
    assert seen == [queries.PLAIN_BATCH_ROWS]


def test_ingest_embeds_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embedded(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    batch = spark.createDataFrame([(1, 1, float(i), [1.0, 2.0]) for i in range(6)], "video_id long, creator_id long, timestamp_seconds double, embedding array<float>")
    known = spark.createDataFrame([(5, 1, 0.0)], "id long, video_id long, timestamp_seconds double")
    vectors = spark.createDataFrame([(5, [0.5, 0.5], 1)], "fingerprint_id long, embedding array<float>, creator_id long")
    videos = spark.createDataFrame([(1, "indexing", False)], "id long, status string, processed boolean")
    state = spark.createDataFrame([(1,)], "video_id long")
    out = ingest.run_ingest(batch.mapInArrow(embedded, batch.schema), known, vectors, videos, state, "m")
    assert out["vectors"].count() == 6 and out["fingerprints"].count() == 6 and [r["status"] for r in out["videos"].collect()] == ["searchable"]
    assert calls.value == 6


def test_records_ask_for_columns_once():
    """The names of a frame's columns are not looked up for each of its rows."""
    import pandas as pd

    class Frame:
        def __init__(self, frame):
            self.frame, self.asked = frame, 0

        @property
        def columns(self):
            self.asked += 1
            return self.frame.columns

        def __getitem__(self, name):
            return self.frame[name]

    rows = Frame(pd.DataFrame({"a": range(100), "b": [True] * 100}))
    assert list(monitor._records(rows)) == [{"a": i, "b": True} for i in range(100)] and rows.asked <= 2


def test_duplicates_of_one_time(spark, tmp_path):
    """Of messages of one key and time the first by ``then`` is accepted, in the batch and in the stream."""
    base = dt.datetime(2026, 1, 1)
    rows = [(f"k{k}", base + dt.timedelta(seconds=700 * step), 100 * step + (i * 37 + k) % 100) for step in range(3) for k in range(5) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, n int").repartition(4, "n")
    expected = sorted((f"k{k}", 100 * step) for step in range(3) for k in range(5))
    assert sorted((r["key"], r["n"]) for r in webhook.ttl_dedup(df, "key", "ts", 600, "n").collect()) == expected
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
    into_table(webhook.stream_ttl_dedup(stream, "key", "ts", 600, "n"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted((r["key"], r["n"]) for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()) == expected


def test_fresh_times_one_by_one():
    import pandas as pd

    rng, base = random.Random(5), pd.Timestamp("2026-01-01")
    for _ in range(300):
        times = pd.Series(pd.to_datetime([None if rng.random() < 0.1 else base + pd.Timedelta(seconds=rng.randrange(60)) for _ in range(rng.randrange(1, 20))])).sort_values(kind="stable")
        ttl, deadline = rng.choice([0, 5, 20]) * 1_000_000, rng.choice([None, base.value // 1000 + rng.randrange(60) * 1_000_000])
        keep, last = [], deadline
        for t in times.astype("datetime64[us]").astype("int64"):
            keep.append(last is None or t >= last)
            last = int(t) + ttl if keep[-1] else last
        got = webhook._fresh(times, deadline, ttl)
        assert (got[0].tolist(), got[1]) == (keep, last)
