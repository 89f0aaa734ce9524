"""The registered queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella import schemas
from tessella.functions import scalars as X
from tessella.operators import align as A
from tessella.operators import catalog as C
from tessella.operators import knn as K
from tessella.operators import lifecycle as M
from tessella.operators import requests as R
from tessella.operators import writes as U
from tessella.plans import ingest as P
from tessella.plans.search import search_clips
from tessella.shared import new_path
from tessella.sources import audio, vods
from tessella.sources.views import view, with_views
from tessella.streaming import feed, monitor, webhook

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
SECRET = "test-secret"


class Views:
    """The views of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = (spark, sf_dir)
        self.spark = spark

    def __getattr__(self, name: str) -> DataFrame:
        return view(*self._at, name)


def query(sql: str | None = None, *views: str):
    """Register a function of ``Views`` under its name; ``sql`` may use ``views``."""

    def keep(f: Callable[[Views], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = f"{with_views(*views)} {sql}" if views else sql
        return f

    return keep


_NEIGHBOURS = """, scored AS (SELECT s.clip_id, s.seg_ord, v.fingerprint_id,
    list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM segments s JOIN vectors v ON s.creator_id = v.creator_id),
  neighbours AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id, seg_ord ORDER BY score DESC, fingerprint_id) AS INT) AS rank FROM scored) t WHERE rank <= 10)"""
_VOTES = _NEIGHBOURS + """, votes AS (SELECT n.clip_id, f.video_id, CAST(round_even(f.timestamp_seconds - s.q_time, 0) AS BIGINT) AS "offset", count(*) AS votes, min(n.seg_ord * 1000 + n.rank) AS first_seen
    FROM neighbours n JOIN fingerprints f USING (fingerprint_id) JOIN segments s ON s.clip_id = n.clip_id AND s.seg_ord = n.seg_ord GROUP BY 1, 2, 3)"""
_BEST = _VOTES + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY votes DESC, first_seen) AS r FROM votes) t WHERE r = 1),
  sizes AS (SELECT clip_id, count(*) AS n FROM segments GROUP BY 1)"""


@query(f"{_NEIGHBOURS} SELECT clip_id, seg_ord, rank, fingerprint_id, round(score, 6) AS score FROM neighbours", "segments", "vectors")
def knn_exact_topk(v: Views) -> DataFrame:
    return K.knn_join(v.segments, v.vectors).withColumn("score", F.round("score", 6))


@query(f"{_NEIGHBOURS} SELECT clip_id, seg_ord, rank, fingerprint_id, round(score, 6) AS score FROM neighbours WHERE rank <= 3", "segments", "vectors")
def knn_exact_expr(v: Views) -> DataFrame:
    return K.knn_join(v.segments, v.vectors, 3, method="expr").withColumn("score", F.round("score", 6))


@query(f"{_NEIGHBOURS} SELECT n.fingerprint_id, f.video_id, f.timestamp_seconds, n.clip_id, n.seg_ord, n.rank FROM neighbours n JOIN fingerprints f USING (fingerprint_id)", "segments", "vectors")
def resolved_neighbours(v: Views) -> DataFrame:
    return A.resolve(K.knn_join(v.segments, v.vectors), v.fingerprints).drop("score")


@query(f"{_NEIGHBOURS}, cut AS (SELECT * FROM neighbours WHERE rank <= 2 + seg_ord % 4), k AS (SELECT clip_id, min(n) AS k FROM (SELECT clip_id, seg_ord, count(*) AS n FROM cut GROUP BY 1, 2) t GROUP BY 1) SELECT clip_id, seg_ord, rank, fingerprint_id FROM cut JOIN k USING (clip_id) WHERE rank <= k", "segments", "vectors")
def neighbour_truncation(v: Views) -> DataFrame:
    some = K.knn_join(v.segments, v.vectors).where(F.col("rank") <= 2 + F.col("seg_ord") % 4)
    return K.truncated(some, v.segments).drop("score")


@query(f'{_VOTES} SELECT clip_id, video_id, "offset", votes, first_seen FROM votes', "segments", "vectors", "fingerprints")
def vote_histogram(v: Views) -> DataFrame:
    found = A.vote_histogram(K.knn_join(v.segments, v.vectors), v.segments, v.fingerprints)
    return found.withColumn("first_seen", F.col("first_seen.seg_ord") * 1000 + F.col("first_seen.rank"))


@query(f"""{_BEST} SELECT s.clip_id, coalesce(votes >= 3 AND votes / n >= 0.08, FALSE) AS found, CASE WHEN votes >= 3 AND votes / n >= 0.08 THEN video_id END AS video_id, CASE WHEN votes >= 3 AND votes / n >= 0.08 THEN "offset" END AS "offset",
  votes, votes / n AS ratio, CASE WHEN votes < 3 THEN concat('Best candidate vote count ', votes, ' is below min_vote_count 3') WHEN votes / n < 0.08 THEN concat('Best candidate vote ratio ', printf('%.3f', round_even(votes / n, 3)), ' is below min_vote_ratio 0.080') ELSE concat('Accepted with ', votes, ' votes (', printf('%.3f', round_even(votes / n, 3)), ' ratio)') END AS reason FROM sizes s LEFT JOIN best b ON s.clip_id = b.clip_id""", "segments", "vectors", "fingerprints")
def best_alignment(v: Views) -> DataFrame:
    return A.align(K.knn_join(v.segments, v.vectors), v.segments, v.fingerprints)


@query(f"""{_BEST}, named AS (SELECT k.clip_id, lower(trim(k.streamer)) AS streamer, c.id AS creator_id FROM clips k LEFT JOIN creators c ON lower(c.name) = lower(trim(k.streamer))),
  judged AS (SELECT m.clip_id, m.streamer, m.creator_id, b.video_id, b."offset", b.votes, b.votes / z.n AS ratio, d.title, d.url, o.name AS creator_name,
    CASE WHEN z.n IS NULL THEN 'No embeddings generated for query clip' WHEN m.creator_id IS NULL OR b.votes IS NULL THEN concat('No indexed clips found for streamer: ', m.streamer)
      WHEN b.votes < 3 THEN concat('Best candidate vote count ', b.votes, ' is below min_vote_count 3') WHEN b.votes / z.n < 0.08 THEN concat('Best candidate vote ratio ', printf('%.3f', round_even(b.votes / z.n, 3)), ' is below min_vote_ratio 0.080') WHEN d.url IS NULL THEN 'Aligned video metadata not found' END AS reason, z.n
    FROM named m LEFT JOIN sizes z ON m.clip_id = z.clip_id LEFT JOIN best b ON m.clip_id = b.clip_id LEFT JOIN videos d ON b.video_id = d.id LEFT JOIN creators o ON d.creator_id = o.id)
  SELECT clip_id, CASE WHEN n IS NOT NULL THEN streamer END AS streamer, reason IS NULL AS found, CASE WHEN reason IS NULL THEN video_id END AS video_id, CASE WHEN reason IS NULL THEN title END AS title, CASE WHEN reason IS NULL THEN creator_name END AS creator_name,
    CASE WHEN reason IS NULL THEN "offset" END AS timestamp_seconds, CASE WHEN reason IS NULL THEN ratio END AS score, CASE WHEN reason IS NULL AND "offset" >= 0 THEN concat(url, '?t=', CASE WHEN "offset" >= 3600 THEN concat("offset" // 3600, 'h') ELSE '' END, CASE WHEN "offset" >= 60 THEN concat("offset" % 3600 // 60, 'm') ELSE '' END, "offset" % 60, 's') END AS url, reason FROM judged""",
       "segments", "vectors", "fingerprints", "clips")
def clip_search(v: Views) -> DataFrame:
    return search_clips(v.clips, v.segments.drop("creator_id"), v.creators, v.vectors, v.fingerprints, v.videos)


@query()
def knn_ivf(v: Views) -> DataFrame:
    index, centres = K.build_ivf(v.vectors, 8)
    return K.knn_ivf(v.segments, index, centres, 10, 7)


@query()
def knn_lsh(v: Views) -> DataFrame:
    return K.knn_lsh(v.segments, v.vectors)


@query("SELECT DISTINCT c.name, c.profile_image_url FROM creators c JOIN videos v ON v.creator_id = c.id JOIN fingerprints f ON f.video_id = v.id JOIN vectors e USING (fingerprint_id) WHERE trim(c.name) <> ''", "creators", "videos", "fingerprints", "vectors")
def searchable_creators(v: Views) -> DataFrame:
    return C.searchable_creators(v.creators, v.videos, v.fingerprints, v.vectors)


@query("SELECT v.id, c.name AS creator_name, v.url, v.title, v.status, v.processed FROM videos v JOIN creators c ON v.creator_id = c.id WHERE v.url LIKE 'https://twitch.tv/%' OR v.url LIKE 'https://www.twitch.tv/%' ORDER BY v.id DESC LIMIT 10 OFFSET 5", "videos", "creators")
def live_sessions_page(v: Views) -> DataFrame:
    return C.live_sessions(v.videos, v.creators, 10, 5)


@query("SELECT v.id, v.creator_id, v.url, v.title, v.thumbnail_url, v.processed, v.status, c.name AS creator_name, c.url AS creator_url, c.profile_image_url FROM videos v JOIN creators c ON v.creator_id = c.id", "videos", "creators")
def video_with_owner(v: Views) -> DataFrame:
    return C.videos_with_owner(v.videos, v.creators)


@query("SELECT url, id, creator_id, title, processed, status FROM (SELECT d.*, row_number() OVER (PARTITION BY url ORDER BY id) AS r FROM vod_videos d WHERE url IN (SELECT url FROM vods WHERE k % 3 = 0)) t WHERE r = 1", "vod_videos", "vods")
def lookup_videos_by_url(v: Views) -> DataFrame:
    return C.videos_by_url(v.vod_videos, v.vods.where("k % 3 = 0"))


@query("SELECT DISTINCT r.streamer AS name, c.id AS creator_id, trim(r.streamer) = '' AS blank FROM requests r LEFT JOIN creators c ON lower(c.name) = nullif(lower(trim(r.streamer)), '')", "requests", "creators")
def lookup_creators_by_name(v: Views) -> DataFrame:
    return C.creators_by_name(v.creators, v.requests.select(F.col("streamer").alias("name")).distinct())


@query("SELECT k AS id, v.status, TRUE AS valid FROM vods LEFT JOIN vod_videos v ON v.id = vods.k", "vods", "vod_videos")
def lookup_status(v: Views) -> DataFrame:
    return C.video_statuses(v.vod_videos, v.vods.select(F.col("k").alias("id")))


@query("SELECT vod_id AS vod_platform_id, s.video_id, s.streamer, s.last_ingested_seconds, s.last_seen_duration_seconds, s.updated_at FROM vods LEFT JOIN vod_state s ON s.vod_platform_id = vods.vod_id", "vods", "vod_state")
def lookup_state(v: Views) -> DataFrame:
    return C.states_by_vod(v.vod_state, v.vods.select(F.col("vod_id").alias("vod_platform_id")))


def _pages(v: Views) -> DataFrame:
    """The recordings as landed pages of the platform: an array of structs a user and page."""
    text = F.concat(F.floor(F.col("duration_seconds") / 3600).cast("string"), F.lit("h"), F.floor(F.col("duration_seconds") % 3600 / 60).cast("string"), F.lit("m"), (F.col("duration_seconds") % 60).cast("string"), F.lit("s"))
    item = F.struct(
        F.when(F.col("k") % 17 == 0, " ").otherwise(F.col("vod_id")).alias("id"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("Vod "), F.col("vod_id"))).otherwise(F.lit(" ")).alias("title"), text.alias("duration"),
        F.when(F.col("k") % 13 > 0, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("").alias("created_at"),
        F.when(F.col("k") % 2 > 0, F.lit("https://img/%{width}x%{height}.jpg")).otherwise("").alias("thumbnail_url"), F.lit(None).cast("string").alias("viewable"),
    )
    return v.vods.groupBy(F.col("streamer").alias("user_id"), (F.col("k") % 2).cast("int").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("data"))


_LISTED = """, listed AS (SELECT streamer AS user_id, k % 2 AS page, CASE WHEN k % 17 = 0 THEN ' ' ELSE vod_id END AS id, CASE WHEN k % 3 > 0 THEN concat('Vod ', vod_id) ELSE 'Untitled stream' END AS title, duration_seconds,
    CASE WHEN k % 13 > 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS created_at, CASE WHEN k % 13 > 0 THEN date_trunc('second', created_at) ELSE TIMESTAMP '0001-01-01' END AS made, CASE WHEN k % 2 > 0 THEN 'https://img/320x180.jpg' END AS thumbnail_url, k FROM vods)"""
_NORMAL = "user_id, trim(id) AS vod_id, concat('https://www.twitch.tv/videos/', trim(id)) AS url, title, CAST(duration_seconds AS BIGINT) AS duration_seconds, created_at, thumbnail_url, 'public' AS viewable"


@query(f"{_LISTED} SELECT {_NORMAL} FROM listed", "vods")
def vod_normalised(v: Views) -> DataFrame:
    return vods.normalised(vods.page_rows(_pages(v)))


@query(f"{_LISTED} SELECT {_NORMAL} FROM listed WHERE made >= TIMESTAMP '1996-01-01' AND trim(id) <> ''", "vods")
def vods_since(v: Views) -> DataFrame:
    return vods.vods_since(_pages(v), F.lit("1996-01-01").cast("timestamp"))


@query(f"{_LISTED}, newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY made DESC, page, id, title, duration_seconds) AS r FROM listed) SELECT {_NORMAL} FROM newest WHERE r = 1 AND trim(id) <> ''", "vods")
def latest_vod(v: Views) -> DataFrame:
    return vods.latest_vod(_pages(v))


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, CAST(sum(duration_seconds) AS BIGINT) AS seconds FROM (SELECT streamer AS user_id, duration_seconds FROM vods) t", "vods")
def concat_pages(v: Views) -> DataFrame:
    pages = _pages(v)
    both = pages.where("page = 0").unionByName(pages.where("page = 1"))
    return vods.normalised(vods.page_rows(both)).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.sum("duration_seconds").alias("seconds"))


@query("SELECT CASE WHEN id % 5 > 0 THEN CAST(id AS VARCHAR) END AS id, lower(trim(concat(' ', name))) AS login, CASE WHEN id % 2 = 0 THEN name ELSE lower(trim(concat(' ', name))) END AS display_name, profile_image_url, CASE WHEN id % 5 = 0 THEN 'missing id' END AS problem FROM creators", "creators")
def user_profiles(v: Views) -> DataFrame:
    raw = v.creators.select(F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).otherwise(" ").alias("id"), F.concat(F.lit(" "), F.col("name")).alias("login"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("").alias("display_name"), "profile_image_url")
    return vods.user_profiles(raw)


_DECIDED = """, decided AS (SELECT o.vod_id, o.streamer, o.url, o.created_at, o.duration_seconds, d.id AS video_id, s.last_ingested_seconds AS saved, d.status, s.vod_platform_id,
    CASE WHEN d.id IS NULL OR d.status = 'reindex_requested' THEN NULL WHEN d.status = 'indexing' THEN CASE WHEN s.vod_platform_id IS NULL THEN 'indexing' END WHEN d.status IS NOT NULL THEN d.status WHEN d.processed THEN 'processed' END AS reason
    FROM vods o LEFT JOIN vod_videos d ON d.url = o.url LEFT JOIN vod_state s ON s.vod_platform_id = o.vod_id),
  backlog AS (SELECT vod_id, streamer, url, created_at, duration_seconds, video_id, CASE WHEN reason IS NULL THEN 'eligible' ELSE 'skip' END AS decision, reason,
    CASE WHEN reason IS NULL THEN CASE WHEN status = 'reindex_requested' THEN 0 ELSE coalesce(saved, 0) END END AS cursor FROM decided),
  full_backlog AS (SELECT *, coalesce(cursor > 0, FALSE) AS resumed FROM backlog)"""
_BACKLOG_VIEWS = ("vods", "vod_videos", "vod_state")


def _backlog(v: Views) -> DataFrame:
    return P.backlog(v.vods, v.vod_videos, v.vod_state)


@query(f"{_DECIDED} SELECT * FROM full_backlog", *_BACKLOG_VIEWS)
def backlog_decisions(v: Views) -> DataFrame:
    return _backlog(v)


@query(f"{_DECIDED} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY streamer ORDER BY created_at DESC, vod_id) AS r FROM full_backlog WHERE decision = 'eligible') t WHERE r = 1", *_BACKLOG_VIEWS)
def backlog_next(v: Views) -> DataFrame:
    return P.next_of_backlog(_backlog(v))


@query(f"{_DECIDED} SELECT streamer, count(*) FILTER (decision = 'eligible' AND duration_seconds % 7 > 0) AS ingested, count(*) FILTER (decision = 'eligible' AND resumed) AS resumed, count(*) FILTER (decision = 'skip') AS skipped, count(*) FILTER (decision = 'eligible' AND duration_seconds % 7 = 0) AS failed FROM full_backlog GROUP BY 1", *_BACKLOG_VIEWS)
def backlog_summary(v: Views) -> DataFrame:
    return P.run_summary(_backlog(v).withColumn("ok", F.col("duration_seconds") % 7 > 0))


@query("""SELECT user_id AS streamer, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS live_sessions_started, sum(CASE WHEN event_type IN ('click', 'view') AND id % 3 = 0 THEN 1 ELSE 0 END) AS handoffs_to_backlog,
    sum(CASE WHEN event_type = 'purchase' AND id % 3 = 2 THEN 1 ELSE 0 END) AS handoffs_to_live, sum(CASE WHEN event_type = 'purchase' AND id % 3 = 0 THEN 1 ELSE 0 END) AS backlog_ingested,
    sum(CASE WHEN event_type IN ('click', 'view', 'purchase') AND id % 3 = 1 THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END) AS watch_cycles FROM requests GROUP BY 1""", "requests")
def watch_summary(v: Views) -> DataFrame:
    kinds, i = F.col("event_type"), F.col("id")
    mode = F.when(kinds.isin("click", "view"), "live").when(kinds == "purchase", "backlog").when(kinds.isin("error", "signup"), "watch")
    outcome = F.when(mode != "watch", F.when(i % 3 == 0, "done").when(i % 3 == 1, "failed").when(mode == "live", "interrupted").otherwise("preempted"))
    return P.watch_summary(v.requests.select(F.col("user_id").alias("streamer"), mode.alias("mode"), outcome.alias("outcome")))


@query(f"{_DECIDED} SELECT streamer, vod_id, row_number() OVER (PARTITION BY streamer ORDER BY created_at DESC, vod_id) AS position, count(*) OVER (PARTITION BY streamer) AS total FROM full_backlog WHERE decision = 'eligible'", *_BACKLOG_VIEWS)
def run_positions(v: Views) -> DataFrame:
    return P.run_positions(_backlog(v))


@query(f"{_DECIDED} SELECT DISTINCT vod_id, reason FROM full_backlog WHERE decision = 'skip'", *_BACKLOG_VIEWS)
def skip_log_once(v: Views) -> DataFrame:
    decided = _backlog(v)
    return P.skip_log(decided.unionByName(decided))


@query(f"""{_DECIDED}, plan AS (SELECT vod_id, duration_seconds, unnest(range(cursor, duration_seconds, 600)) AS start FROM full_backlog WHERE decision = 'eligible' AND duration_seconds > 0 AND cursor < duration_seconds)
  SELECT vod_id, start, CAST(least(600, duration_seconds - start) AS BIGINT) AS length, printf('vod_%s_%08d_%04d.wav', vod_id, start, CAST(least(600, duration_seconds - start) AS BIGINT)) AS name, (start + least(600, duration_seconds - start)) / duration_seconds * 100 AS progress FROM plan""", *_BACKLOG_VIEWS)
def ingest_chunk_plan(v: Views) -> DataFrame:
    return P.chunk_plan(_backlog(v), 600)


@query("""SELECT vod_id, start, CAST(least(60, e - start) AS BIGINT) AS length, printf('vod_%s_%08d_%04d.wav', vod_id, start, CAST(least(60, e - start) AS BIGINT)) AS name
  FROM (SELECT vod_id, e, unnest(range(cursor, e, 60)) AS start FROM (SELECT vod_id, cursor, CAST(duration_seconds - CASE WHEN is_live THEN 120 ELSE 0 END AS BIGINT) AS e FROM snapshots) t WHERE e > cursor) u""", "snapshots")
def live_chunk_plan(v: Views) -> DataFrame:
    return P.live_chunk_plan(v.snapshots)


@query("""SELECT vod_id, ts, max_duration, CAST(sum(still) OVER (PARTITION BY vod_id, g ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stable_checks FROM (
    SELECT *, sum(grown) OVER (PARTITION BY vod_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT vod_id, ts, max(duration_seconds) OVER w AS max_duration, CASE WHEN duration_seconds > coalesce(max(duration_seconds) OVER (PARTITION BY vod_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS grown, CASE WHEN NOT is_live AND duration_seconds <= coalesce(max(duration_seconds) OVER (PARTITION BY vod_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS still
      FROM snapshots WINDOW w AS (PARTITION BY vod_id ORDER BY ts ROWS UNBOUNDED PRECEDING)) a) b""", "snapshots")
def growth_streak(v: Views) -> DataFrame:
    return P.growth_streak(v.snapshots)


@query("""SELECT c.id, coalesce(u.name, c.name) AS name, c.url, coalesce(u.profile_image_url, c.profile_image_url) AS profile_image_url FROM creators c LEFT JOIN (SELECT url, upper(concat(name, '!')) AS name, CASE WHEN id % 2 = 0 THEN 'new.png' END AS profile_image_url FROM creators WHERE id % 3 = 0) u ON u.url = c.url
  UNION ALL SELECT 26, 'fresh', 'https://twitch.tv/fresh', NULL""", "creators")
def upsert_creators(v: Views) -> DataFrame:
    old = v.creators.where("id % 3 = 0").select("url", F.upper(F.concat("name", F.lit("!"))).alias("name"), F.when(F.col("id") % 2 == 0, "new.png").alias("profile_image_url"))
    new = v.creators.where("id = 1").select(F.lit("https://twitch.tv/fresh").alias("url"), F.lit("fresh").alias("name"), F.lit(None).cast("string").alias("profile_image_url"))
    return U.upsert_creators(v.creators, old.unionByName(new))


@query("""SELECT video_id, pos, timestamp_seconds, pos % 2 = 0 AS known FROM (SELECT video_id, CAST(pos AS INT) AS pos, timestamp_seconds + CASE WHEN pos % 2 = 1 THEN 0.5 ELSE 0 END AS timestamp_seconds FROM (SELECT video_id, timestamp_seconds, row_number() OVER (PARTITION BY video_id ORDER BY timestamp_seconds) - 1 AS pos FROM fingerprints) t) u""", "fingerprints")
def upsert_fingerprints(v: Views) -> DataFrame:
    table = v.fingerprints.withColumnRenamed("fingerprint_id", "id")
    batch = table.groupBy("video_id").agg(F.array_sort(F.collect_list("timestamp_seconds")).alias("t")).select("video_id", F.transform("t", lambda x, i: x + F.when(i % 2 == 1, 0.5).otherwise(0.0)).alias("timestamps"))
    new, ids = U.upsert_fingerprints(table, batch)
    return ids.join(table.select("id", F.lit(True).alias("known")), "id", "left").select("video_id", "pos", "timestamp_seconds", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT fingerprint_id, CASE WHEN fingerprint_id % 4 = 0 THEN creator_id + 1 ELSE creator_id END AS creator_id, CASE WHEN fingerprint_id % 4 = 0 THEN 'm2' END AS model_name, len(embedding) AS width FROM vectors UNION ALL SELECT 1000000 + fingerprint_id, creator_id, 'm2', len(embedding) FROM vectors WHERE fingerprint_id % 9 = 0", "vectors")
def upsert_embeddings(v: Views) -> DataFrame:
    old = v.vectors.where("fingerprint_id % 4 = 0").withColumn("creator_id", F.col("creator_id") + 1)
    new = v.vectors.where("fingerprint_id % 9 = 0").withColumn("fingerprint_id", F.col("fingerprint_id") + 1000000)
    table = v.vectors.withColumn("model_name", F.lit(None).cast("string"))
    return U.upsert_embeddings(table, old.unionByName(new), "m2").select("fingerprint_id", "creator_id", "model_name", F.size("embedding").cast("long").alias("width"))


@query("""SELECT * FROM vod_state WHERE vod_platform_id NOT IN (SELECT streamer FROM vods) UNION ALL SELECT vod_platform_id, video_id, streamer, last_ingested_seconds, last_seen_duration_seconds, updated_at FROM (SELECT streamer AS vod_platform_id, k AS video_id, streamer, duration_seconds AS last_ingested_seconds, duration_seconds AS last_seen_duration_seconds, created_at AS updated_at, row_number() OVER (PARTITION BY streamer ORDER BY created_at DESC, k) AS r FROM vods) t WHERE r = 1""", "vod_state", "vods")
def upsert_ingest_state(v: Views) -> DataFrame:
    newest = C.first_per(v.vods, ["streamer", "created_at"], "k")
    updates = newest.select(F.col("streamer").alias("vod_platform_id"), F.col("k").alias("video_id"), "streamer", F.col("duration_seconds").alias("last_ingested_seconds"), F.col("duration_seconds").alias("last_seen_duration_seconds"), F.col("created_at").alias("updated_at"))
    return U.upsert_ingest_state(v.vod_state, updates)


@query("SELECT * FROM vod_state WHERE vod_platform_id NOT IN (SELECT vod_id FROM vods WHERE k % 2 = 0)", "vod_state", "vods")
def delete_state_keys(v: Views) -> DataFrame:
    return U.delete_keys(v.vod_state, v.vods.where("k % 2 = 0").select(F.col("vod_id").alias("vod_platform_id")))


@query("SELECT url, title, status, processed FROM vod_videos UNION ALL SELECT concat(url, '#new'), 'New', coalesce(st, CASE WHEN k % 4 = 1 THEN 'searchable' ELSE 'indexing' END), coalesce(st, CASE WHEN k % 4 = 1 THEN 'searchable' ELSE 'indexing' END) <> 'indexing' FROM (SELECT url, k, CASE WHEN k % 3 = 0 THEN 'indexing' WHEN k % 3 = 1 THEN 'deleted' END AS st FROM vods WHERE k % 5 = 0) t", "vod_videos", "vods")
def insert_videos(v: Views) -> DataFrame:
    rows = v.vods.where("k % 5 = 0").select(F.concat("url", F.lit("#new")).alias("url"), F.lit("New").alias("title"), F.when(F.col("k") % 3 == 0, "indexing").when(F.col("k") % 3 == 1, "deleted").alias("status"), (F.col("k") % 4 == 1).alias("processed"))
    return U.insert_videos(v.vod_videos, rows).select("url", "title", "status", "processed")


_PATCHES = "SELECT id, CASE WHEN id % 2 = 0 THEN 'Patched' END AS t, CASE WHEN id % 4 = 0 THEN 'p.jpg' END AS th, CASE WHEN id % 5 = 1 THEN TRUE WHEN id % 5 = 2 THEN FALSE END AS p, CASE WHEN id % 6 = 1 THEN 'deleted' END AS st FROM vod_videos WHERE id % 3 = 0"


@query(f"""SELECT v.id, v.creator_id, v.url, coalesce(t, v.title) AS title, coalesce(th, v.thumbnail_url) AS thumbnail_url, coalesce(s <> 'indexing', v.processed) AS processed, coalesce(s, v.status) AS status FROM vod_videos v LEFT JOIN (SELECT *, coalesce(st, CASE WHEN p THEN 'searchable' WHEN NOT p THEN 'indexing' END) AS s FROM ({_PATCHES}) a) b ON v.id = b.id""", "vod_videos")
def patch_videos(v: Views) -> DataFrame:
    i = F.col("id")
    patches = v.vod_videos.where("id % 3 = 0").select("id", F.when(i % 2 == 0, "Patched").alias("title"), F.when(i % 4 == 0, "p.jpg").alias("thumbnail_url"), F.when(i % 5 == 1, True).when(i % 5 == 2, False).alias("processed"), F.when(i % 6 == 1, "deleted").alias("status"))
    return U.patch_videos(v.vod_videos, patches)


@query("SELECT id, creator_id, url, title, thumbnail_url, TRUE AS processed, 'searchable' AS status FROM vod_videos", "vod_videos")
def set_status(v: Views) -> DataFrame:
    return U.patch_videos(v.vod_videos, v.vod_videos.select("id", F.lit("searchable").alias("status")))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN concat(title, '*') ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 'https://img.example/u.jpg' END AS thumbnail_url FROM videos WHERE id % 4 = 0 OR id % 3 = 0", "videos")
def changed_metadata(v: Views) -> DataFrame:
    incoming = v.videos.select("id", F.when(F.col("id") % 4 == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title")).alias("title"), F.when(F.col("id") % 3 == 0, "https://img.example/u.jpg").alias("thumbnail_url"))
    return U.changed_metadata(v.videos, incoming)


@query("SELECT vod_platform_id, streamer FROM vod_state UNION ALL SELECT vod_id, 'legacy' FROM vods WHERE vod_id NOT IN (SELECT vod_platform_id FROM vod_state)", "vod_state", "vods")
def merge_legacy_state(v: Views) -> DataFrame:
    legacy = v.vods.select(F.col("vod_id").alias("vod_platform_id"), F.lit("legacy").alias("streamer"))
    return U.insert_absent(v.vod_state.select("vod_platform_id", "streamer"), legacy, ["vod_platform_id"])


_COMMANDS = """, commands AS (SELECT k AS cmd_id, CASE WHEN k % 2 = 0 THEN 'delete' ELSE 'reindex' END AS op, CASE WHEN k % 7 = 0 THEN -k ELSE k END AS video_id, CASE WHEN k % 5 = 1 THEN -1 WHEN k % 5 = 2 THEN 900000 ELSE CAST(o_custkey AS BIGINT) END AS actor_creator_id FROM seconds),
  judged AS (SELECT c.*, d.status AS was, CASE WHEN c.actor_creator_id <= 0 THEN 'invalid_actor' WHEN d.id IS NULL THEN 'not_found' WHEN d.creator_id <> c.actor_creator_id THEN 'owner_mismatch' WHEN d.status = CASE WHEN op = 'delete' THEN 'deleted' ELSE 'reindex_requested' END THEN 'unchanged'
      WHEN d.status IS NULL OR d.status <> CASE WHEN op = 'delete' THEN 'searchable' ELSE 'deleted' END THEN 'invalid_transition' ELSE 'accepted' END AS outcome FROM commands c LEFT JOIN (SELECT id, creator_id, CASE WHEN id % 9 < 5 THEN status ELSE 'searchable' END AS status FROM vod_videos WHERE status IS NOT NULL) d ON d.id = c.video_id)"""
_OUTCOMES = """SELECT cmd_id, op, video_id, actor_creator_id, was, outcome, CASE outcome WHEN 'not_found' THEN 'VIDEO_NOT_FOUND' WHEN 'owner_mismatch' THEN 'VIDEO_OWNER_MISMATCH' WHEN 'invalid_transition' THEN 'INVALID_VIDEO_STATE_TRANSITION' END AS error_code,
  CASE outcome WHEN 'invalid_actor' THEN 422 WHEN 'not_found' THEN 404 WHEN 'owner_mismatch' THEN 403 WHEN 'invalid_transition' THEN 409 ELSE 200 END AS http_status FROM judged"""


def _commands(v: Views) -> tuple[DataFrame, DataFrame]:
    k = F.col("k")
    commands = v.seconds.select(k.alias("cmd_id"), F.when(k % 2 == 0, "delete").otherwise("reindex").alias("op"), F.when(k % 7 == 0, -k).otherwise(k).alias("video_id"), F.when(k % 5 == 1, F.lit(-1).cast("long")).when(k % 5 == 2, F.lit(900_000).cast("long")).otherwise(F.col("o_custkey").cast("long")).alias("actor_creator_id"))
    table = v.vod_videos.where("status is not null").withColumn("status", F.when(F.col("id") % 9 < 5, F.col("status")).otherwise("searchable"))
    return commands, table


@query(f"{_COMMANDS} {_OUTCOMES} WHERE op = 'delete'", "seconds", "vod_videos")
def delete_index_outcomes(v: Views) -> DataFrame:
    commands, table = _commands(v)
    return M.command_outcomes(commands.where("op = 'delete'"), table)


@query(f"{_COMMANDS} {_OUTCOMES} WHERE op = 'reindex'", "seconds", "vod_videos")
def reindex_outcomes(v: Views) -> DataFrame:
    commands, table = _commands(v)
    return M.command_outcomes(commands.where("op = 'reindex'"), table)


@query("SELECT fingerprint_id, creator_id FROM vectors WHERE fingerprint_id NOT IN (SELECT fingerprint_id FROM fingerprints WHERE video_id IN (SELECT id FROM videos WHERE status = 'searchable' AND id % 3 = 0))", "vectors", "fingerprints", "videos")
def after_delete_embeddings(v: Views) -> DataFrame:
    commands = v.videos.where("id % 3 = 0").select(F.col("id").alias("cmd_id"), F.lit("delete").alias("op"), F.col("id").alias("video_id"), F.col("creator_id").alias("actor_creator_id"))
    return M.apply_video_commands(commands, v.videos, v.fingerprints, v.vectors, v.vod_state)["vectors"].select("fingerprint_id", "creator_id")


def _job_events(v: Views) -> DataFrame:
    kinds = F.col("event_type")
    done = kinds.isin("purchase", "error")
    return v.requests.select(
        (F.col("user_id") * 10).alias("id"), F.col("created_at").alias("ts"), F.when(kinds == "purchase", "completed").when(kinds == "error", "failed").when(kinds == "click", "running").alias("status"),
        F.when(~done, kinds).alias("stage"), (kinds == "click").alias("started"), "error_code", "error_message", F.when(kinds == "error", 400).alias("http_status"),
    )


@query("""SELECT r.id, coalesce(e.status, r.job_status) AS job_status, CASE WHEN coalesce(e.status, r.job_status) NOT IN ('completed', 'failed') THEN coalesce(e.stage, r.job_stage) END AS job_stage, coalesce(r.started_at, e.started) AS started_at,
    CASE WHEN coalesce(e.status, r.job_status) IN ('completed', 'failed') THEN coalesce(e.finished, r.finished_at) END AS finished_at, coalesce(e.code, r.error_code) AS error_code, coalesce(e.message, r.error_message) AS error_message, coalesce(e.http, r.http_status) AS http_status
  FROM requests r LEFT JOIN (SELECT user_id * 10 AS id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' END, created_at) FILTER (event_type IN ('purchase', 'error', 'click')) AS status, arg_max(event_type, created_at) FILTER (event_type NOT IN ('purchase', 'error')) AS stage,
      min(created_at) FILTER (event_type = 'click') AS started, max(created_at) FILTER (event_type IN ('purchase', 'error')) AS finished, arg_max(error_code, created_at) FILTER (error_code IS NOT NULL) AS code, arg_max(error_message, created_at) FILTER (error_message IS NOT NULL) AS message, max(CASE WHEN event_type = 'error' THEN 400 END) AS http
    FROM requests GROUP BY 1) e ON e.id = r.id""", "requests")
def job_events_folded(v: Views) -> DataFrame:
    return M.fold_job_events(v.requests, _job_events(v))


_OPEN = "source_app = 'public' AND job_status IN ('queued', 'running')"


@query(f"SELECT id, CASE WHEN {_OPEN} THEN 'failed' ELSE job_status END AS job_status, CASE WHEN NOT ({_OPEN}) THEN job_stage END AS job_stage, CASE WHEN {_OPEN} THEN 'WORKER_RESTARTED' ELSE error_code END AS error_code, CASE WHEN {_OPEN} THEN coalesce(finished_at, TIMESTAMP '2030-01-01') ELSE finished_at END AS finished_at, CASE WHEN {_OPEN} THEN FALSE ELSE success END AS success FROM requests", "requests")
def fail_open_jobs(v: Views) -> DataFrame:
    now = F.lit("2030-01-01").cast("timestamp")
    return M.fail_open_jobs(v.requests, "WORKER_RESTARTED", "The worker was restarted", now).select("id", "job_status", "job_stage", "error_code", "finished_at", "success")


@query("SELECT source_app, job_status, job_stage, count(*) AS n FROM (SELECT source_app, job_status, job_stage FROM requests UNION ALL SELECT 'public', 'queued', 'validating' FROM requests WHERE tiktok_url IS NOT NULL) t GROUP BY 1, 2, 3", "requests")
def create_jobs(v: Views) -> DataFrame:
    asked = v.requests.where("tiktok_url is not null").select((F.col("id") + 10_000_000).alias("id"), "tiktok_url", "streamer")
    return M.create_jobs(v.requests, asked).groupBy("source_app", "job_status", "job_stage").agg(F.count(F.lit(1)).alias("n"))


_ISO = "CASE WHEN {0} IS NULL THEN NULL WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
_HMS = """concat(CASE WHEN s >= 3600 THEN concat(s // 3600, 'h') ELSE '' END, CASE WHEN s >= 60 THEN concat(s % 3600 // 60, 'm') ELSE '' END, s % 60, 's')"""


@query(f"""SELECT id, status, stage, created_at, started_at, finished_at, CASE WHEN done THEN found_match END AS found, CASE WHEN done THEN title END AS title, CASE WHEN done THEN coalesce(owner, streamer) END AS streamer, CASE WHEN done THEN CASE WHEN matched_video_id IS NOT NULL THEN owner_image ELSE named_image END END AS image,
    CASE WHEN done AND url IS NOT NULL THEN concat(url, '?t=', {_HMS}) END AS url, CASE WHEN error_code IS NOT NULL AND error_message IS NOT NULL THEN error_code END AS error_code, CASE WHEN error_code IS NOT NULL AND error_message IS NOT NULL THEN error_message END AS error_message
  FROM (SELECT r.id, job_status AS status, job_stage AS stage, {_ISO.format('created_at')} AS created_at, {_ISO.format('started_at')} AS started_at, {_ISO.format('finished_at')} AS finished_at, job_status = 'completed' AS done, found_match, d.title, d.url, o.name AS owner, o.profile_image_url AS owner_image, n.profile_image_url AS named_image, r.streamer, matched_video_id, matched_timestamp_seconds AS s, error_code, error_message
    FROM requests r LEFT JOIN videos d ON d.id = r.matched_video_id LEFT JOIN creators o ON o.id = d.creator_id LEFT JOIN creators n ON lower(n.name) = nullif(lower(trim(r.streamer)), '') WHERE r.source_app = 'public') t""", "requests", "videos", "creators")
def job_records(v: Views) -> DataFrame:
    return C.job_records(v.requests, v.videos, v.creators)


@query("SELECT r.id, coalesce(r.creator_id, c.id) AS creator_id FROM requests r LEFT JOIN creators c ON lower(c.name) = lower(r.streamer)", "requests", "creators")
def backfill_request_creator(v: Views) -> DataFrame:
    return M.backfill_request_creator(v.requests, v.creators).select("id", "creator_id")


@query("SELECT id, CASE WHEN success THEN 'completed' ELSE 'failed' END AS job_status, coalesce(finished_at, created_at) AS finished_at FROM requests", "requests")
def backfill_job_status(v: Views) -> DataFrame:
    return M.backfill_job_status(v.requests).select("id", "job_status", "finished_at")


@query("SELECT id, coalesce(status, CASE WHEN processed THEN 'searchable' ELSE 'indexing' END) AS status FROM vod_videos", "vod_videos")
def backfill_video_status(v: Views) -> DataFrame:
    return M.backfill_video_status(v.vod_videos).select("id", "status")


@query("SELECT id, lower(trim(status)) AS normal, status <> 'indexing' AS as_processed, CASE WHEN processed THEN 'searchable' ELSE 'indexing' END AS as_status FROM vod_videos", "vod_videos")
def status_sync(v: Views) -> DataFrame:
    return v.vod_videos.select("id", X.normal_status(F.concat(F.lit(" "), F.upper("status"))).alias("normal"), X.processed_of(F.col("status")).alias("as_processed"), X.status_of(F.col("processed")).alias("as_status"))


@query("SELECT k, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, " + _HMS + " AS offset_text FROM seconds", "seconds")
def display_durations(v: Views) -> DataFrame:
    return v.seconds.select("k", X.clock_text(F.col("s").cast("double")).alias("clock"), X.offset_text(F.col("s")).alias("offset_text"))


_URL_SQL = r"""WITH p AS (SELECT page_id, page_id % 4000 - 3 AS s, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'frag']) AS m FROM pages),
 q AS (SELECT *, list_filter(string_split(m.query, '&'), lambda x: x <> '' AND split_part(x, '=', 1) <> 't') AS kept FROM p)
 SELECT page_id, CASE WHEN m.scheme <> '' AND m.host <> '' AND s >= 0 THEN concat(lower(m.scheme), '://', m.host, m.path, '?', array_to_string(list_append(list_transform(kept, lambda x: CASE WHEN contains(x, '=') THEN x ELSE concat(x, '=') END), concat('t=', """ + _HMS + r""")), '&'), CASE WHEN m.frag <> '' THEN concat('#', m.frag) ELSE '' END) END AS url FROM q"""


@query(_URL_SQL)
def timestamp_urls(v: Views) -> DataFrame:
    pages = v.spark.read.parquet(f"{v._at[1]}/pages.parquet")
    return pages.select("page_id", X.timestamp_url(F.col("url"), F.col("page_id") % 4000 - 3).alias("url"))


@query(r"SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def download_hosts(v: Views) -> DataFrame:
    pages = v.spark.read.parquet(f"{v._at[1]}/pages.parquet")
    return pages.groupBy(X.host_name(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_HOST = r"nullif(lower(regexp_extract(trim(tiktok_url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_URL_BAD = f"CASE WHEN trim(coalesce(tiktok_url, '')) = '' THEN 'TikTok URL is required' WHEN lower(regexp_extract(trim(tiktok_url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'TikTok URL must use http or https' WHEN coalesce({_HOST}, '') NOT IN ('tiktok.com', 'www.tiktok.com', 'm.tiktok.com', 'vm.tiktok.com', 'vt.tiktok.com') THEN 'Only TikTok URLs are supported' END"


@query(f"SELECT id, {_URL_BAD} AS problem FROM requests", "requests")
def url_validation(v: Views) -> DataFrame:
    return v.requests.select("id", R.url_problem(F.col("tiktok_url")).alias("problem"))


@query("SELECT id, CASE WHEN duration_seconds > 180 THEN concat('Input video is ', CAST(ceil(duration_seconds) AS BIGINT), 's; maximum allowed is 180s') END AS problem FROM requests", "requests")
def duration_limit(v: Views) -> DataFrame:
    return v.requests.select("id", R.duration_problem(F.col("duration_seconds")).alias("problem"))


_FILE_BAD = "CASE WHEN coalesce(trim(filename), '') = '' THEN 'Uploaded file must have a filename' WHEN coalesce(file_size, 0) <= 0 THEN 'Uploaded file is empty' END"


@query(f"SELECT id, {_FILE_BAD} AS problem FROM requests", "requests")
def file_checks(v: Views) -> DataFrame:
    return v.requests.select("id", R.file_problem(F.col("filename"), F.col("file_size")).alias("problem"))


@query("SELECT source_app, filename AS path, file_size AS length FROM (SELECT *, row_number() OVER (PARTITION BY source_app ORDER BY file_size DESC, filename) AS r FROM requests WHERE filename IS NOT NULL) t WHERE r = 1", "requests")
def largest_files(v: Views) -> DataFrame:
    files = v.requests.where("filename is not null").select("source_app", F.col("filename").alias("path"), F.col("file_size").alias("length"))
    return R.largest_file(files, "source_app")


@query("SELECT id, CASE WHEN size IS NULL THEN 'Downloaded file was not created' WHEN size <= 0 THEN 'Downloaded file is empty' WHEN size > 209715200 THEN 'Downloaded file exceeds 200MB limit' END AS problem FROM (SELECT id, CASE WHEN id % 7 > 0 THEN file_size END AS size FROM requests) t", "requests")
def download_checks(v: Views) -> DataFrame:
    return v.requests.select("id", R.download_problem(F.when(F.col("id") % 7 > 0, F.col("file_size"))).alias("problem"))


@query(f"""SELECT request_id, source_app, c IS NULL AS valid, CASE WHEN c IN (1, 2) THEN 'INVALID_SEARCH_INPUT' WHEN c IN (3, 4) THEN 'INVALID_STREAMER' WHEN c = 5 THEN 'INVALID_TIKTOK_URL' WHEN c = 6 THEN 'INVALID_UPLOAD' WHEN c = 7 THEN 'DOWNLOAD_ERROR' WHEN c = 8 THEN 'INPUT_DURATION_EXCEEDED' END AS error_code, CASE WHEN c IS NOT NULL THEN 400 END AS http_status,
   CASE c WHEN 1 THEN 'tiktok_url is required' WHEN 2 THEN 'Provide exactly one of file or tiktok_url' WHEN 3 THEN 'streamer is required' WHEN 4 THEN concat('Streamer is not searchable: ', lower(trim(streamer))) WHEN 5 THEN ub WHEN 6 THEN fb
     WHEN 7 THEN CASE WHEN file_size = 0 THEN 'Downloaded file is empty' ELSE 'Downloaded file exceeds 200MB limit' END WHEN 8 THEN concat('Input video is ', CAST(ceil(duration_seconds) AS BIGINT), 's; maximum allowed is 180s') END AS error_message
  FROM (SELECT *, CASE WHEN source_app = 'public' AND NOT hu THEN 1 WHEN source_app <> 'public' AND hf = hu THEN 2 WHEN coalesce(trim(streamer), '') = '' THEN 3 WHEN lower(trim(streamer)) NOT IN (SELECT lower(name) FROM creators c JOIN vectors e ON e.creator_id = c.id) THEN 4
      WHEN hu AND ub IS NOT NULL THEN 5 WHEN source_app <> 'public' AND hf AND fb IS NOT NULL THEN 6 WHEN hu AND (file_size <= 0 OR file_size > 209715200) THEN 7 WHEN duration_seconds > 180 THEN 8 END AS c
    FROM (SELECT id AS request_id, *, filename IS NOT NULL AS hf, coalesce(trim(tiktok_url), '') <> '' AS hu, {_URL_BAD} AS ub, {_FILE_BAD} AS fb FROM requests) a) b""", "requests", "creators", "vectors")
def request_validation(v: Views) -> DataFrame:
    names = C.searchable_creators(v.creators, v.videos, v.fingerprints, v.vectors)
    return R.validate_requests(v.requests.withColumnRenamed("id", "request_id").withColumn("downloaded_bytes", F.col("file_size")), names)


@query(f"""SELECT id, CASE WHEN filename IS NOT NULL AND tiktok_url IS NOT NULL THEN 'both' WHEN filename IS NOT NULL THEN 'file' WHEN tiktok_url IS NOT NULL THEN 'tiktok_url' END AS input_type, nullif(lower(trim(streamer)), '') AS streamer, {_HOST} AS download_host, CAST(greatest(round_even(value / 100 * 1000, 0), 0) AS INT) AS embed_duration_ms, coalesce(CASE WHEN id % 2 = 0 THEN value END, duration_seconds) AS score FROM requests""", "requests")
def request_log_rows(v: Views) -> DataFrame:
    rows = v.requests.withColumns({"embed_seconds": F.col("value") / 100, "total_seconds": F.col("value"), "meta_score": F.when(F.col("id") % 2 == 0, F.col("value")), "result_score": F.col("duration_seconds")})
    log = R.request_log_rows(rows.withColumn("filename", F.concat_ws("|", "filename")).withColumn("created_at", F.struct("id", "created_at")))
    return log.select(F.col("created_at.id").alias("id"), "input_type", "streamer", "download_host", "embed_duration_ms", "score")


@query("""SELECT id, created_at, source_app, '/api/search/clip' AS route, CASE WHEN filename IS NOT NULL AND tiktok_url IS NOT NULL THEN 'both' WHEN filename IS NOT NULL THEN 'file' WHEN tiktok_url IS NOT NULL THEN 'tiktok_url' END AS input_type,
    nullif(lower(trim(streamer)), '') AS streamer, creator_id, success, http_status, error_code, error_message, CASE WHEN id % 3 = 0 THEN 'measured' WHEN id % 3 = 1 THEN 'answered' ELSE event_type END AS result_reason,
    found_match, coalesce(CASE WHEN id % 2 = 0 THEN matched_video_id END, user_id) AS matched_video_id, matched_timestamp_seconds, CASE WHEN id % 4 > 0 THEN value ELSE value / 2 END AS score, filename AS clip_filename,
    CASE WHEN tiktok_url IS NOT NULL THEN 'tiktok' END AS download_source, regexp_extract(lower(tiktok_url), '//([^/]*)', 1) AS download_host, duration_seconds AS input_duration_seconds,
    CAST(4000 + id % 1000 AS INT) AS total_duration_ms, CAST(NULL AS INT) AS preprocess_duration_ms, CAST(250 AS INT) AS embed_duration_ms, CAST(0 AS INT) AS vector_query_duration_ms, CAST(id % 100 AS INT) AS alignment_duration_ms FROM requests""", "requests")
def request_log_full(v: Views) -> DataFrame:
    i = F.col("id")
    rows = v.requests.drop("score").withColumns({
        "meta_reason": F.when(i % 3 == 0, "measured").when(i % 3 == 1, ""), "result_reason": F.when(i % 3 == 1, "answered").otherwise(F.col("event_type")), "meta_found_match": F.col("found_match"),
        "meta_matched_video_id": F.when(i % 2 == 0, F.col("matched_video_id")), "result_matched_video_id": F.col("user_id"), "result_matched_timestamp_seconds": F.col("matched_timestamp_seconds"),
        "meta_score": F.when(i % 4 > 0, F.col("value")), "result_score": F.col("value") / 2, "input_duration_seconds": F.col("duration_seconds"),
        "total_seconds": F.lit(4.0) + (i % 1000) / 1000, "embed_seconds": F.lit(0.25), "vector_query_seconds": F.lit(-1.0), "alignment_seconds": (i % 100) / 1000,
    })
    return rows.select("id", "created_at").join(R.request_log_rows(rows.withColumn("created_at", F.struct("id", "created_at"))).withColumn("id", F.col("created_at.id")).drop("created_at"), "id")


_FINISHED = "CASE WHEN id % 5 = 3 THEN {done} WHEN id % 5 = 2 THEN {failed} ELSE {other} END"


@query("SELECT id, " + ", ".join(_FINISHED.format(done=d, failed=f, other=o) + f" AS {n}" for n, d, f, o in [
    ("job_status", "'completed'", "'failed'", "job_status"), ("job_stage", "NULL", "NULL", "job_stage"), ("success", "TRUE", "FALSE", "success"), ("http_status", "200", "504", "http_status"),
    ("error_code", "NULL", "'SEARCH_FAILED'", "error_code"), ("error_message", "NULL", "'timed out'", "error_message"), ("finished_at", "TIMESTAMP '2030-01-01'", "TIMESTAMP '2030-01-01'", "finished_at"),
    ("found_match", "TRUE", "found_match", "found_match"), ("matched_video_id", "user_id", "matched_video_id", "matched_video_id"), ("matched_timestamp_seconds", "NULL", "matched_timestamp_seconds", "matched_timestamp_seconds"),
    ("input_duration_seconds", "value", "CASE WHEN id % 2 = 0 THEN 99.5 ELSE duration_seconds END", "duration_seconds")]) + " FROM requests", "requests")
def finished_jobs(v: Views) -> DataFrame:
    now, i = F.lit("2030-01-01").cast("timestamp"), F.col("id")
    jobs = v.requests.withColumn("input_duration_seconds", F.col("duration_seconds"))
    outcomes = v.requests.where(i % 5 == 3).select("id", F.lit(True).alias("found_match"), F.col("user_id").alias("matched_video_id"), F.col("value").alias("input_duration_seconds"))
    failures = v.requests.where(i % 5 == 2).select("id", F.lit("SEARCH_FAILED").alias("error_code"), F.lit("timed out").alias("error_message"), F.lit(504).alias("http_status"), F.when(i % 2 == 0, 99.5).alias("input_duration_seconds"))
    done = M.fail_jobs(M.complete_jobs(jobs, outcomes, now), failures, now)
    return done.select("id", "job_status", "job_stage", "success", "http_status", "error_code", "error_message", "finished_at", "found_match", "matched_video_id", "matched_timestamp_seconds", "input_duration_seconds")


@query("""SELECT request_id, seconds, CASE WHEN seconds IS NULL THEN 'Could not determine input video duration' WHEN seconds > 180 THEN concat('Input video is ', CAST(ceil(seconds) AS BIGINT), 's; maximum allowed is 180s') END AS problem
  FROM (SELECT id AS request_id, CASE WHEN TRY_CAST(trim(raw) AS DOUBLE) > 0 THEN TRY_CAST(trim(raw) AS DOUBLE) END AS seconds FROM (SELECT id, CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '-3.5' WHEN 3 THEN '0' ELSE concat(' ', CAST(id % 400 AS VARCHAR), '.25 ') END AS raw FROM requests) a) b""", "requests")
def duration_probe(v: Views) -> DataFrame:
    i = F.col("id")
    raw = F.when(i % 7 == 0, "").when(i % 7 == 1, "N/A").when(i % 7 == 2, "-3.5").when(i % 7 == 3, "0").otherwise(F.concat(F.lit(" "), (i % 400).cast("string"), F.lit(".25 ")))
    seconds = R.probed_seconds(raw)
    return v.requests.select(i.alias("request_id"), seconds.alias("seconds"), F.coalesce(R.probe_problem(raw), R.duration_problem(seconds)).alias("problem"))


@query("SELECT vod_id, CASE WHEN trim(st) = '' THEN 'streamer' WHEN d <= 0 THEN 'duration' END AS problem FROM (SELECT vod_id, CASE WHEN k % 7 = 0 THEN ' ' ELSE streamer END AS st, CASE WHEN k % 5 = 0 THEN 0 ELSE duration_seconds END AS d FROM vods) t", "vods")
def vod_field_checks(v: Views) -> DataFrame:
    k = F.col("k")
    return v.vods.select("vod_id", P.vod_problem(F.when(k % 7 == 0, " ").otherwise(F.col("streamer")), F.col("vod_id"), F.col("url"), F.when(k % 5 == 0, 0).otherwise(F.col("duration_seconds"))).alias("problem"))


@query("SELECT clip_id, seg_ord, 'time' AS problem FROM (SELECT clip_id, seg_ord, t, lag(t) OVER (PARTITION BY clip_id ORDER BY seg_ord) AS b FROM (SELECT clip_id, seg_ord, CASE WHEN seg_ord % 5 = 0 THEN q_time - 50 ELSE q_time END AS t FROM all_segments) a) c WHERE t < b", "all_segments")
def monotonic_violations(v: Views) -> DataFrame:
    return R.monotonic_violations(v.all_segments.withColumn("q_time", F.when(F.col("seg_ord") % 5 == 0, F.col("q_time") - 50).otherwise(F.col("q_time"))), 64)


@query("SELECT clip_id, count(*) AS n_segments, CAST(max(len(embedding)) AS INT) AS dim, max(q_time) - min(q_time) + 1 AS duration_seconds FROM all_segments GROUP BY 1", "all_segments")
def clip_summary(v: Views) -> DataFrame:
    return R.clip_summary(v.all_segments)


@query()
def schema_report(v: Views) -> DataFrame:
    return schemas.schema_report(v.spark, {"creators": v.creators, "videos": v.videos, "fingerprints": v.fingerprints, "search_requests": v.requests})


_TTL = """, m AS (SELECT concat(CAST(user_id % 40 AS VARCHAR), '-', event_type) AS key, ts, event_id FROM events), o AS (SELECT key, ts, event_id, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS r FROM m),
  f AS (SELECT key, r, event_id, ts, ts + INTERVAL 36000 SECOND AS deadline, TRUE AS fresh FROM o WHERE r = 1 UNION ALL SELECT o.key, o.r, o.event_id, o.ts, CASE WHEN o.ts >= f.deadline THEN o.ts + INTERVAL 36000 SECOND ELSE f.deadline END, o.ts >= f.deadline FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1)
  SELECT key, ts, event_id FROM f WHERE fresh"""


def _messages(v: Views) -> DataFrame:
    events = v.spark.read.parquet(f"{v._at[1]}/events.parquet")
    return events.select(F.concat((F.col("user_id") % 40).cast("string"), F.lit("-"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query("WITH RECURSIVE x AS (SELECT 1)" + _TTL)
def ttl_dedup(v: Views) -> DataFrame:
    return webhook.ttl_dedup(_messages(v), "key", "ts", 36_000, "event_id")


#: Rows of a micro-batch of the streamed tables, about: where the rows of a key are sorted in memory, and elsewhere.
BATCH_ROWS, PLAIN_BATCH_ROWS = 1_000_000, 10_000_000


def _ranged(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Add ``__part``: the number of the range of ``order`` that a row lies in, of about ``rows`` rows; four ranges at least, rows without ``order`` in the first."""
    grid = 1000
    seen = df.select(F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("at", [i / grid for i in range(1, grid)]).alias("q")).first()
    n = min(grid, max(4, -(-seen["n"] // rows)))
    edges = sorted({seen["q"][i * grid // n - 1] for i in range(1, n)} - {float("-inf")}) if seen["q"] else []
    if not edges:
        return df.withColumn("__part", F.lit(0))
    ends = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="__at", outputCol="__part")
    placed = ends.transform(df.withColumn("__at", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))))
    return placed.withColumn("__part", F.col("__part").cast("int")).drop("__at")


def _source(parted: DataFrame) -> tuple[DataFrame, str, Iterator[None]]:
    """A table as a stream, its folder, and its arrivals: each step of these moves the files of the next ``__part`` into the folder that is streamed.

    A query that is run after each step takes a part as one micro-batch, and its checkpoint carries it to the next.
    """
    spark, schema = parted.sparkSession, parted.drop("__part").schema
    base = new_path(spark, "stream")
    parted.write.partitionBy("__part").parquet(f"{base}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/in"))

    def arrivals() -> Iterator[None]:
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{base}/parts")) if s.isDirectory()]
        for name in sorted(names, key=lambda n: int(n.partition("=")[2])):
            if not fs.rename(path(f"{base}/parts/{name}"), path(f"{base}/in/{name}")):
                raise OSError(f"{base}/parts/{name} was not moved")
            yield
        if not names:  # an empty table: the query runs once
            yield

    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in"), base, arrivals()


def _streamed(df: DataFrame, build: Callable[[DataFrame], DataFrame], order: str) -> DataFrame:
    """What ``build`` makes of a table that comes as a stream."""
    from tessella.streaming.ingest import into_table

    stream, base, arrivals = _source(_ranged(df, order, BATCH_ROWS))
    out = build(stream)
    for _ in arrivals:
        into_table(out, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return df.sparkSession.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


@query("WITH RECURSIVE x AS (SELECT 1)" + _TTL)
def stream_ttl_dedup(v: Views) -> DataFrame:
    return _streamed(_messages(v), lambda s: webhook.stream_ttl_dedup(s.withWatermark("ts", "10 minutes"), "key", "ts", 36_000, "event_id"), "ts")


def _signed(v: Views, name: Column | None = None) -> DataFrame:
    events = v.spark.read.parquet(f"{v._at[1]}/events.parquet")
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    login = F.concat(F.lit(" User"), (F.col("user_id") % 50).cast("string"))
    body = F.to_json(F.struct(
        F.when(kind == "signup", "hello").alias("challenge"), F.struct(F.when(kind == "click", "stream.online").when(kind == "view", "stream.offline").alias("type"), F.when(kind == "error", "user_removed").alias("status")).alias("subscription"),
        F.struct(login.alias("broadcaster_user_login")).alias("event"),
    ))
    rows = events.select(
        F.when(F.col("event_id") % 31 > 0, F.col("event_id").cast("string") if name is None else name).otherwise("").alias("message_id"), F.when(kind == "signup", "webhook_callback_verification").when(kind == "error", "revocation").when(kind == "purchase", "other").otherwise("notification").alias("message_type"),
        X.iso_text(ts).alias("message_ts"), body.alias("body"), F.timestamp_micros(F.unix_micros(ts) + (F.col("event_id") % 13) * 60_000_000).alias("arrival_ts"), "event_id",
    )
    good = webhook.signature(SECRET, F.col("message_id"), F.col("message_ts"), F.col("body"))
    return rows.withColumn("signature", F.when(F.col("event_id") % 17 > 0, good).otherwise("sha256=00"))


@query("SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'missing header' WHEN event_id % 13 * 60 > 600 THEN 'outside the allowed skew' WHEN event_id % 17 = 0 THEN 'bad signature' END AS problem FROM events")
def webhook_verified(v: Views) -> DataFrame:
    return webhook.verified(_signed(v), SECRET).select("event_id", "problem")


@query("SELECT CASE WHEN event_id % 31 > 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS message_id, CASE event_type WHEN 'signup' THEN 'challenge' WHEN 'click' THEN 'online' WHEN 'view' THEN 'offline' WHEN 'error' THEN 'degraded' ELSE 'ignored' END AS kind, concat('user', user_id % 50) AS streamer, CASE event_type WHEN 'signup' THEN 'hello' WHEN 'error' THEN 'user_removed' END AS detail FROM events")
def webhook_routed(v: Views) -> DataFrame:
    return webhook.routed(_signed(v)).select("message_id", "kind", "streamer", "detail")


_FEED = """WITH RECURSIVE m AS (SELECT concat(user_id % 40, '-', event_type) AS key, concat('user', user_id % 50) AS streamer, ts + to_minutes(event_id % 13) AS arrival, event_id, CASE event_type WHEN 'signup' THEN 'challenge' WHEN 'click' THEN 'online' WHEN 'view' THEN 'offline' WHEN 'error' THEN 'degraded' ELSE 'ignored' END AS kind FROM events WHERE event_id % 31 > 0 AND event_id % 13 <= 10 AND event_id % 17 > 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY arrival, event_id) AS r FROM m),
  f AS (SELECT key, r, arrival + INTERVAL 36000 SECOND AS deadline, TRUE AS fresh FROM o WHERE r = 1 UNION ALL SELECT o.key, o.r, CASE WHEN o.arrival >= f.deadline THEN o.arrival + INTERVAL 36000 SECOND ELSE f.deadline END, o.arrival >= f.deadline FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1),
  e AS (SELECT o.streamer, o.arrival, o.key, o.kind FROM f JOIN o ON o.key = f.key AND o.r = f.r WHERE fresh),
  a AS (SELECT *, coalesce(max(CASE kind WHEN 'online' THEN TRUE END) OVER w, FALSE) AS active, coalesce(last_value(CASE kind WHEN 'online' THEN TRUE WHEN 'offline' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS is_live FROM e WINDOW w AS (PARTITION BY streamer ORDER BY arrival, key ROWS UNBOUNDED PRECEDING))
  SELECT streamer, arrival AS arrival_ts, key AS message_id, kind, CASE WHEN active THEN 'ingesting' ELSE 'polling' END AS state, is_live, active, CASE kind WHEN 'degraded' THEN 'degraded' ELSE 'healthy' END AS health, CASE kind WHEN 'degraded' THEN 'user_removed' END AS error FROM a"""


def _feed(v: Views) -> DataFrame:
    return _signed(v, F.concat((F.col("user_id") % 40).cast("string"), F.lit("-"), F.col("event_type")))


@query(_FEED)
def feed_status(v: Views) -> DataFrame:
    return feed.feed_status(_feed(v), SECRET, 36_000)


@query(_FEED)
def stream_feed(v: Views) -> DataFrame:
    return _streamed(_feed(v).drop("event_id"), lambda s: feed.stream_feed(s, SECRET, 36_000), "arrival_ts")


def _status_events(v: Views) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "online").when(F.col("event_type") == "view", "offline").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("degraded")
    return v.requests.select(F.concat(F.lit("s"), (F.col("user_id") % 200).cast("string")).alias("streamer"), F.col("created_at").alias("ts"), F.col("id").alias("event_id"), kind.alias("kind"))


_STATUS = """, e AS (SELECT concat('s', user_id % 200) AS streamer, created_at AS ts, id AS event_id, CASE event_type WHEN 'click' THEN 'online' WHEN 'view' THEN 'offline' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'degraded' END AS kind FROM requests),
  a AS (SELECT *, coalesce(last_value(CASE kind WHEN 'online' THEN TRUE WHEN 'failed' THEN FALSE WHEN 'done' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS active, coalesce(last_value(CASE kind WHEN 'online' THEN TRUE WHEN 'offline' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS is_live FROM e WINDOW w AS (PARTITION BY streamer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, CASE kind WHEN 'online' THEN 'ingesting' WHEN 'offline' THEN CASE WHEN active THEN 'ingesting' ELSE 'polling' END WHEN 'failed' THEN 'error' WHEN 'done' THEN 'polling' END AS s FROM a)
  SELECT streamer, ts, event_id, kind, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY streamer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'polling') AS state, is_live, active FROM b"""


@query(_STATUS, "requests")
def status_fold(v: Views) -> DataFrame:
    return monitor.status_fold(_status_events(v))


@query(_STATUS, "requests")
def stream_status_fold(v: Views) -> DataFrame:
    return _streamed(_status_events(v), monitor.stream_status, "ts")


def _live(v: Views) -> DataFrame:
    """Snapshots of recordings that change, some saved half-way, some deleted, searchable or to be reindexed for a while."""
    user, event = F.col("vod_id").cast("long") % 100, F.col("event_id")
    status = F.when(event % 97 == 0, "deleted").when(event % 89 == 0, "searchable").when(event % 40 < 3, "reindex_requested").otherwise("indexing")
    return v.snapshots.select(
        F.concat(F.lit("s"), user.cast("string")).alias("streamer"), "ts", "event_id", F.concat(F.lit("v"), user.cast("string"), F.lit("-"), F.date_format("ts", "yyyyMM")).alias("vod_id"), "is_live", F.col("duration_seconds").cast("long").alias("duration_seconds"),
        status.alias("video_status"), F.when(user % 3 == 0, user * 7).alias("saved_seconds"), F.when(user % 6 == 0, user * 9).alias("saved_longest"),
    )


#: One recording after the other: ``f`` holds what a streamer's snapshots have led to, a row a snapshot. {cursor} is where the one before left off.
_LIVE = """, o AS (SELECT concat('s', u) AS streamer, ts, event_id, concat('v', u, '-', strftime(ts, '%Y%m')) AS vod_id, is_live, d, CASE WHEN event_id % 97 = 0 THEN 'deleted' WHEN event_id % 89 = 0 THEN 'searchable' WHEN event_id % 40 < 3 THEN 'reindex_requested' ELSE 'indexing' END AS st,
    CASE WHEN u % 3 = 0 THEN u * 7 ELSE 0 END AS sv, CASE WHEN u % 6 = 0 THEN u * 9 ELSE 0 END AS sl, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS r FROM (SELECT CAST(vod_id AS BIGINT) % 100 AS u, ts, event_id, is_live, CAST(duration_seconds AS BIGINT) AS d FROM snapshots) t),
  f AS (SELECT DISTINCT streamer, CAST(0 AS BIGINT) AS r, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, NULL::VARCHAR AS vod_id, 0::BIGINT AS cur, NULL::BIGINT AS under_way, 0::BIGINT AS longest, 0::BIGINT AS still, FALSE AS over, FALSE AS asked, FALSE AS afresh, 0::BIGINT AS began, 0::BIGINT AS safe, FALSE AS closed, FALSE AS done FROM o
    UNION ALL SELECT streamer, r, ts, event_id, vod_id, CASE WHEN closed THEN c1 ELSE {after} END, CASE WHEN NOT closed AND safe > c1 THEN c1 + least(60, safe - c1) END, CASE WHEN closed THEN l1 ELSE l2 END, CASE WHEN closed THEN s1 ELSE s2 END, closed OR {done}, st = 'reindex_requested', afresh, c1, safe, closed, NOT closed AND {done} FROM (
      SELECT *, l2 - CASE WHEN is_live THEN 120 ELSE 0 END AS safe FROM (
        SELECT *, greatest(l1, d) AS l2, CASE WHEN d > l1 THEN 0 WHEN is_live THEN s1 ELSE s1 + 1 END AS s2 FROM (
          SELECT *, st IN ('deleted', 'searchable') OR (was_over AND NOT afresh) AS closed, CASE WHEN afresh THEN 0 WHEN new THEN sv ELSE c0 END AS c1, CASE WHEN afresh THEN 0 WHEN new THEN sl ELSE longest END AS l1, CASE WHEN new THEN 0 ELSE still END AS s1 FROM (
            SELECT o.*, {before} AS c0, f.longest, f.still, f.vod_id IS DISTINCT FROM o.vod_id AS new, f.over AND f.vod_id IS NOT DISTINCT FROM o.vod_id AS was_over, o.st = 'reindex_requested' AND NOT (f.asked AND f.vod_id IS NOT DISTINCT FROM o.vod_id) AS afresh FROM f JOIN o ON o.streamer = f.streamer AND o.r = f.r + 1) a) b) c) e)"""
_LIVE_ALL = "WITH RECURSIVE x AS (SELECT 1)" + with_views("snapshots").replace("WITH ", ", ", 1) + _LIVE.format(before="f.cur", after="greatest(c1, safe)", done="(NOT is_live AND s2 >= 3)") + """, polled AS (SELECT * FROM f WHERE r > 0 AND NOT closed)
  SELECT streamer, vod_id, 0 AS start, 0 AS length, 'indexing' AS status FROM polled WHERE afresh
  UNION ALL SELECT streamer, vod_id, start, least(60, safe - start), 'chunk' FROM (SELECT streamer, vod_id, safe, unnest(range(began, safe, 60)) AS start FROM polled WHERE safe > began) t
  UNION ALL SELECT streamer, vod_id, cur, 0, 'searchable' FROM polled WHERE done"""
_LIVE_POLLS = "WITH RECURSIVE x AS (SELECT 1)" + with_views("snapshots").replace("WITH ", ", ", 1) + _LIVE.format(before="coalesce(f.under_way, f.cur)", after="c1", done="(safe <= c1 AND NOT is_live AND s2 >= 3)") + """
  SELECT streamer, ts, event_id, vod_id, began AS start, coalesce(under_way - began, 0) AS length, still, afresh, CASE WHEN under_way IS NOT NULL THEN 'chunk' WHEN done THEN 'searchable' ELSE 'waiting' END AS status FROM f WHERE r > 0 AND NOT closed"""


@query(_LIVE_POLLS)
def live_polls(v: Views) -> DataFrame:
    return monitor.live_polls(_live(v))


@query(_LIVE_POLLS)
def stream_live_polls(v: Views) -> DataFrame:
    return _streamed(_live(v), monitor.stream_live_polls, "ts")


@query("""SELECT vod_id, ts, event_id, "start", CASE WHEN "start" >= d THEN 0 ELSE least(60, d - "start") END AS length, CASE WHEN "start" >= d THEN 'searchable' ELSE 'chunk' END AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY vod_id, "start" >= d ORDER BY ts, event_id) AS r FROM (
      SELECT vod_id, ts, event_id, kind, d, greatest(s, least(s + 60 * (count(*) FILTER (kind = 'poll') OVER w - count(*) FILTER (kind = 'poll' AND fresh) OVER w), d)) AS "start" FROM (
        SELECT *, coalesce(lag(kind) OVER (PARTITION BY vod_id ORDER BY ts, event_id), 'stop') = 'stop' AS fresh FROM (
          SELECT user_id AS vod_id, created_at AS ts, id AS event_id, CASE event_type WHEN 'error' THEN 'stop' ELSE 'poll' END AS kind, user_id % 40 * 45 AS d, user_id % 3 * 60 AS s FROM requests) a) b
      WINDOW w AS (PARTITION BY vod_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) c WHERE kind = 'poll') e WHERE "start" < d OR r = 1""", "requests")
def archive_session(v: Views) -> DataFrame:
    user = F.col("user_id")
    events = v.requests.select(user.alias("vod_id"), F.col("created_at").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("event_type") == "error", "stop").otherwise("poll").alias("kind"), (user % 3 * 60).alias("saved"), (user % 40 * 45).alias("duration_seconds"))
    return P.archive_session(events)


@query(_LIVE_ALL)
def live_chunks(v: Views) -> DataFrame:
    return monitor.live_chunks(_live(v))


@query(_LIVE_ALL)
def stream_live_chunks(v: Views) -> DataFrame:
    return _streamed(_live(v), monitor.stream_live_chunks, "ts")


_FALLBACK = "WITH RECURSIVE x AS (SELECT 1)" + with_views("requests").replace("WITH ", ", ", 1) + """, admitted AS (SELECT DISTINCT streamer, ts FROM (SELECT p.streamer, p.ts, (SELECT arg_max(h.healthy, h.ts) FROM (SELECT user_id % 20 AS streamer, created_at AS ts, event_type <> 'error' AS healthy FROM requests WHERE event_type IN ('error', 'signup')) h WHERE h.streamer = p.streamer AND h.ts <= p.ts) AS ok FROM (SELECT user_id % 20 AS streamer, created_at AS ts FROM requests WHERE event_type = 'click') p) t WHERE NOT coalesce(ok, FALSE)),
  o AS (SELECT *, row_number() OVER (PARTITION BY streamer ORDER BY ts) AS r FROM admitted),
  f AS (SELECT streamer, r, ts, ts + INTERVAL 120 SECOND AS deadline, TRUE AS fresh FROM o WHERE r = 1 UNION ALL SELECT o.streamer, o.r, o.ts, CASE WHEN o.ts >= f.deadline THEN o.ts + INTERVAL 120 SECOND ELSE f.deadline END, o.ts >= f.deadline FROM f JOIN o ON o.streamer = f.streamer AND o.r = f.r + 1)
  SELECT streamer, ts FROM f WHERE fresh"""


@query(_FALLBACK)
def fallback_polls(v: Views) -> DataFrame:
    rows = v.requests.select((F.col("user_id") % 20).alias("streamer"), F.col("created_at").alias("ts"), "event_type")
    health = rows.where("event_type in ('error', 'signup')").select("streamer", "ts", (F.col("event_type") != "error").alias("healthy"))
    return monitor.fallback_polls(rows.where("event_type = 'click'").select("streamer", "ts"), health)


@query(_FALLBACK)
def stream_fallback_polls(v: Views) -> DataFrame:
    kinds = F.col("event_type")
    rows = v.requests.where("event_type in ('error', 'signup', 'click')").select((F.col("user_id") % 20).alias("streamer"), F.col("created_at").alias("ts"), F.when(kinds != "click", kinds != "error").alias("healthy"))
    return _streamed(rows, monitor.stream_fallback_polls, "ts")


def _files(v: Views, block_seconds: int = 2 * audio.CHUNK_SECONDS) -> DataFrame:
    return audio.wavs_from_values(v.requests.select((F.col("user_id") % 16).alias("k"), "id", "value"), "k", "id", "value", block_seconds=block_seconds)


#: Values of 400 samples each, in chunks of five seconds that are filled up with silence: a segment a second.
_HEARD = """, heard AS (SELECT user_id % 16 AS k, CAST(ceil(count(*) * 400 / 80000.0) AS BIGINT) * 5 AS n FROM requests GROUP BY 1)"""


@query(_HEARD + " SELECT concat(k, '.wav') AS path, n AS n_segments, CAST(64 AS INT) AS width, CAST(n - 1 AS DOUBLE) AS last_second FROM heard", "requests")
def audio_segments(v: Views) -> DataFrame:
    found = audio.embed_segments(audio.audio_chunks(_files(v), 5))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n_segments"), F.min(F.size("embedding")).alias("width"), F.max("timestamp_seconds").alias("last_second"))


def _embed(chunks: DataFrame) -> DataFrame:
    found = audio.embed_segments(chunks)
    path = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    return found.select((1000 + path).alias("video_id"), (path % 10 + 1).alias("creator_id"), "timestamp_seconds", "embedding")


@query(_HEARD + """, new AS (SELECT 1000 + k AS video_id, k % 10 + 1 AS creator_id, CAST(unnest(range(n)) AS DOUBLE) AS timestamp_seconds FROM heard),
  old AS (SELECT e.creator_id FROM vectors e JOIN fingerprints f USING (fingerprint_id) WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.video_id = f.video_id AND new.timestamp_seconds = f.timestamp_seconds))
  SELECT 'spectral' AS model_name, CAST(creator_id AS BIGINT) AS creator_id, count(*) AS n FROM new GROUP BY 2 UNION ALL SELECT NULL, creator_id, count(*) FROM old GROUP BY 2""", "requests", "vectors", "fingerprints")
def ingest_batch(v: Views) -> DataFrame:
    table = v.fingerprints.withColumnRenamed("fingerprint_id", "id")
    out = P.run_ingest(_embed(audio.audio_chunks(_files(v), 5)), table, v.vectors, v.videos, v.vod_state, "spectral")
    return out["vectors"].groupBy("model_name", "creator_id").agg(F.count(F.lit(1)).alias("n"))


@query(_HEARD + " SELECT CAST(1000 + k AS BIGINT) AS video_id, n, n AS n_seconds FROM heard", "requests")
def stream_ingest(v: Views) -> DataFrame:
    """Recordings come as WAVs of a chunk each, at most an hour of every recording a micro-batch, and a quarter of the longest."""
    from tessella.streaming.ingest import CELL_SECONDS, ingest_into, stored_vectors

    longest = v.requests.groupBy(F.col("user_id") % 16).count().agg(F.max("count")).first()[0] or 0
    hour = min(CELL_SECONDS, max(5, -(-longest * 400 // (4 * 5 * audio.RATE)) * 5))
    stream, base, arrivals = _source(_files(v, 5).withColumn("__part", F.floor(F.col("offset_seconds") / hour).cast("int")))
    for _ in arrivals:
        ingest_into(stream, lambda wavs: _embed(audio.audio_chunks(wavs, 5)), f"{base}/out", f"{base}/checkpoint", "spectral").awaitTermination()
    return stored_vectors(v.spark, f"{base}/out").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("timestamp_seconds").alias("n_seconds"))


@query("SELECT k, concat('Stream by ', streamer) AS archived, CASE WHEN k % 3 = 0 THEN concat('Live stream by ', streamer) ELSE trim(concat(' Vod ', vod_id)) END AS live FROM vods", "vods")
def default_titles(v: Views) -> DataFrame:
    return v.vods.select("k", X.default_title(F.lit(" "), F.col("streamer")).alias("archived"), X.default_title(F.when(F.col("k") % 3 > 0, F.concat(F.lit(" Vod "), "vod_id")), F.col("streamer"), live=True).alias("live"))


@query("""SELECT clip_id, CASE WHEN clip_id % 7 = 1 THEN 'stated' WHEN clip_id % 7 = 6 THEN NULL WHEN clip_id % 7 = 2 THEN 'width' WHEN clip_id % 7 = 3 THEN 'length' WHEN clip_id % 7 = 4 AND n > 1 THEN 'time' END AS problem FROM (SELECT clip_id, count(*) AS n FROM all_segments GROUP BY 1) t""", "all_segments")
def answer_checks(v: Views) -> DataFrame:
    """Embedders' answers a clip, some stating another width, some with a short row, a time too few, times turned round, or nothing at all."""
    i, at = F.col("clip_id") % 7, F.transform("rows", lambda r: r["q_time"])
    clips = v.all_segments.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("q_time", "embedding"))).alias("rows"))
    vectors = F.transform("rows", lambda r: F.when(i == 2, F.slice(r["embedding"], 1, 5)).otherwise(r["embedding"]))
    times = F.when(i == 3, F.slice(at, 1, F.size(at) - 1)).when(i == 4, F.reverse(at)).otherwise(at)
    none = F.slice("rows", 1, 0)
    answers = clips.select("clip_id", F.when(i == 6, F.transform(none, lambda r: r["embedding"])).otherwise(vectors).alias("vectors"), F.when(i == 6, F.transform(none, lambda r: r["q_time"])).otherwise(times).alias("times"), F.when(i == 1, 32).otherwise(64).alias("stated"))
    return answers.select("clip_id", R.answer_problem(F.col("vectors"), F.col("times"), F.col("stated"), 64).alias("problem"))


@query("SELECT fingerprint_id, CASE fingerprint_id % 11 WHEN 0 THEN 'length mismatch' WHEN 1 THEN 'creator_id is required' WHEN 2 THEN 'creator_id is required' WHEN 3 THEN 'width' END AS problem FROM vectors WHERE fingerprint_id % 11 < 4", "vectors")
def embedding_checks(v: Views) -> DataFrame:
    i = F.col("fingerprint_id") % 11
    batch = v.vectors.select("fingerprint_id", F.when(i > 0, F.when(i == 3, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))).alias("embedding"), F.when(i == 1, 0).when(i != 2, F.col("creator_id")).alias("creator_id"))
    return U.embedding_problems(batch, 64)


@query(f"""{_DECIDED}, plan AS (SELECT duration_seconds, unnest(range(cursor, duration_seconds, 600)) AS start FROM full_backlog WHERE decision = 'eligible' AND duration_seconds > 0 AND cursor < duration_seconds)
  SELECT 'backlog' AS stream, count(*) AS chunks, CAST(sum(least(600, duration_seconds - start)) AS BIGINT) AS seconds, 100.0 AS percent, TRUE AS rises FROM plan""", *_BACKLOG_VIEWS)
def ingest_progress(v: Views) -> DataFrame:
    """The backlog's chunks as a stream whose listener writes a row a micro-batch; summed up over those rows."""
    from tessella.streaming.ingest import into_table
    from tessella.streaming.progress import ProgressListener, observed_stream, progress_table, with_percent

    spark = v.spark
    stream, base, arrivals = _source(_ranged(P.chunk_plan(_backlog(v), 600).select("vod_id", "start", "length"), "start", PLAIN_BATCH_ROWS))
    chunks = observed_stream(stream, "backlog")
    listener = ProgressListener("backlog")
    spark.streams.addListener(listener)
    try:
        for _ in arrivals:
            into_table(chunks, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    table = progress_table(spark, f"{base}/progress")
    listener.flush(table)
    written_rows = spark.read.schema("vod_id string, start long, length long").option("recursiveFileLookup", True).parquet(f"{base}/out")
    rows = with_percent(table.read(), written_rows.agg(F.lit("backlog").alias("stream"), F.sum("length").alias("total")))
    risen = rows.withColumn("before", F.lag("percent").over(W.partitionBy("stream").orderBy("batch")))
    return risen.groupBy("stream").agg(F.sum("chunks").alias("chunks"), F.sum("seconds").alias("seconds"), F.max("percent").alias("percent"), F.min(F.col("percent") >= F.coalesce("before", F.lit(0.0))).alias("rises"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
