"""Registered queries over the index as it is stored: search that reads little, layouts, and tables in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.operators import align as A
from tessella.operators import ann as N
from tessella.operators import knn as K
from tessella.operators import writes as U
from tessella.operators.versions import VersionedTable
from tessella.plans.search import search_clips
from tessella.queries import _BEST, _NEIGHBOURS, _VOTES, Views, query  # noqa: F401
from tessella.shared import new_path
from tessella.sources.layout import in_scopes, read_scoped, write_scoped

#: Lists of the test tables' indexes, and the blocks' rows: they are small, so that there is something to skip.
LISTS, ROWS = 16, 64
_ROUNDED = "clip_id, seg_ord, rank, fingerprint_id, round(score, 6) AS score"


@query(f"{_NEIGHBOURS} SELECT {_ROUNDED} FROM neighbours", "segments", "vectors")
def knn_pruned(v: Views) -> DataFrame:
    found, _ = N.knn_pruned(v.segments, N.bounded_blocks(v.vectors, N.fit_centres(v.vectors, LISTS), size=ROWS))
    return found.withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- clustered vectors made from the table

_PULLED = """, anchors AS (SELECT row_number() OVER (ORDER BY fingerprint_id) - 1 AS place, embedding AS anchor FROM vectors ORDER BY fingerprint_id LIMIT 16),
  near AS (SELECT fingerprint_id, creator_id, list_transform(list_zip(embedding, anchor), lambda p: CAST(CAST(p[1] AS DOUBLE) * 0.5 + p[2] AS FLOAT)) AS embedding FROM vectors JOIN anchors ON fingerprint_id % 16 = place),
  asked AS (SELECT f.video_id AS clip_id, CAST(fingerprint_id // 100 AS INT) AS seg_ord, creator_id, embedding FROM near JOIN fingerprints f USING (fingerprint_id) WHERE fingerprint_id % 100 = 0),
  scored AS (SELECT s.clip_id, s.seg_ord, v.fingerprint_id, list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM asked s JOIN near v ON s.creator_id = v.creator_id),
  neighbours AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id, seg_ord ORDER BY score DESC, fingerprint_id) AS INT) AS rank FROM scored QUALIFY rank <= 10)"""


def clustered(v: Views) -> tuple[DataFrame, DataFrame]:
    """Vectors pulled to one of 16 of their own, and the segments among them: what real recordings look like, and random directions do not."""
    some = v.vectors.orderBy("fingerprint_id").limit(16).select((F.row_number().over(W.orderBy("fingerprint_id")) - 1).alias("place"), F.col("embedding").alias("anchor"))  # 16 rows
    pulled = v.vectors.withColumn("place", F.col("fingerprint_id") % 16).join(F.broadcast(some), "place")
    near = pulled.select("fingerprint_id", "creator_id", F.zip_with("embedding", "anchor", lambda x, a: (x.cast("double") * 0.5 + a).cast("float")).alias("embedding"))
    asked = near.where("fingerprint_id % 100 = 0").join(v.fingerprints, "fingerprint_id")
    return near, asked.select(F.col("video_id").alias("clip_id"), F.floor(F.col("fingerprint_id") / 100).cast("int").alias("seg_ord"), "creator_id", "embedding")


@query(f"{_PULLED} SELECT {_ROUNDED} FROM neighbours", "vectors", "fingerprints")
def knn_pruned_clustered(v: Views) -> DataFrame:
    near, asked = clustered(v)
    found, _ = N.knn_pruned(asked, N.bounded_blocks(near, N.fit_centres(near, LISTS), size=ROWS))
    return found.withColumn("score", F.round("score", 6))


@query()
def knn_pruned_cost(v: Views) -> DataFrame:
    near, asked = clustered(v)
    return N.knn_pruned(asked, N.bounded_blocks(near, N.fit_centres(near, LISTS), size=ROWS))[1]


@query()
def knn_pq(v: Views) -> DataFrame:
    near, asked = clustered(v)
    codes = N.fit_codes(near, LISTS)
    return N.knn_pq(asked, *N.build_pq(near, codes), codes)


# ---------------------------------------------------------------- layout

@query(f"{_NEIGHBOURS} SELECT {_ROUNDED} FROM neighbours JOIN (SELECT DISTINCT clip_id, seg_ord, creator_id FROM segments) s USING (clip_id, seg_ord) WHERE creator_id % 2 = 0", "segments", "vectors")
def knn_scoped(v: Views) -> DataFrame:
    path = new_path(v.spark, "scoped")
    write_scoped(v.vectors, path)
    asked = v.segments.where("creator_id % 2 = 0")
    return K.knn_join(asked, in_scopes(read_scoped(v.spark, path), asked)).withColumn("score", F.round("score", 6))


# ---------------------------------------------------------------- matches that are accepted

@query(f"""{_BEST} SELECT s.clip_id, votes IS NOT NULL AS found, video_id, "offset", votes, votes / n AS ratio, concat('Accepted with ', votes, ' votes (', printf('%.3f', round_even(votes / n, 3)), ' ratio)') AS reason FROM sizes s LEFT JOIN best b ON s.clip_id = b.clip_id""", "segments", "vectors", "fingerprints")
def best_alignment_lenient(v: Views) -> DataFrame:
    return A.align(K.knn_join(v.segments, v.vectors), v.segments, v.fingerprints, 1, 0.001)


@query(f"""{_BEST}, named AS (SELECT k.clip_id, lower(trim(k.streamer)) AS streamer, c.id AS creator_id FROM clips k LEFT JOIN creators c ON lower(c.name) = lower(trim(k.streamer))),
  judged AS (SELECT m.clip_id, m.streamer, b.video_id, b."offset", b.votes / z.n AS ratio, d.title, d.url, o.name AS creator_name, CASE WHEN z.n IS NULL THEN 'No embeddings generated for query clip' WHEN m.creator_id IS NULL OR b.votes IS NULL THEN concat('No indexed clips found for streamer: ', m.streamer) WHEN d.url IS NULL THEN 'Aligned video metadata not found' END AS reason, z.n
    FROM named m LEFT JOIN sizes z ON m.clip_id = z.clip_id LEFT JOIN best b ON m.clip_id = b.clip_id LEFT JOIN videos d ON b.video_id = d.id LEFT JOIN creators o ON d.creator_id = o.id)
  SELECT clip_id, CASE WHEN n IS NOT NULL THEN streamer END AS streamer, reason IS NULL AS found, CASE WHEN reason IS NULL THEN video_id END AS video_id, CASE WHEN reason IS NULL THEN title END AS title, CASE WHEN reason IS NULL THEN creator_name END AS creator_name,
    CASE WHEN reason IS NULL THEN "offset" END AS timestamp_seconds, CASE WHEN reason IS NULL THEN ratio END AS score, CASE WHEN reason IS NULL AND "offset" >= 0 THEN concat(url, '?t=', CASE WHEN "offset" >= 3600 THEN concat("offset" // 3600, 'h') ELSE '' END, CASE WHEN "offset" >= 60 THEN concat("offset" % 3600 // 60, 'm') ELSE '' END, "offset" % 60, 's') END AS url, reason FROM judged""",
       "segments", "vectors", "fingerprints", "clips")
def clip_search_lenient(v: Views) -> DataFrame:
    return search_clips(v.clips, v.segments.drop("creator_id"), v.creators, v.vectors, v.fingerprints, v.videos, min_votes=1, min_ratio=0.001)


# ---------------------------------------------------------------- tables in versions

def _store(v: Views) -> VersionedTable:
    schema = T._parse_datatype_string("fingerprint_id long, creator_id long, model_name string, embedding array<float>")
    return VersionedTable(v.spark, new_path(v.spark, "store"), schema, ["fingerprint_id"], F.pmod(F.xxhash64("fingerprint_id"), F.lit(8)))


@query("""SELECT fingerprint_id, CASE WHEN fingerprint_id % 4 = 0 THEN creator_id + 1 ELSE creator_id END AS creator_id, CASE WHEN fingerprint_id % 4 = 0 THEN 'm2' ELSE 'm1' END AS model_name, len(embedding) AS width FROM vectors
  UNION ALL SELECT 1000000 + fingerprint_id, creator_id, 'm2', len(embedding) FROM vectors WHERE fingerprint_id % 9 = 0""", "vectors")
def store_upserts(v: Views) -> DataFrame:
    """Three batches of one writer, the second replayed before and after compaction."""
    store, rows, i = _store(v), v.vectors, F.col("fingerprint_id")
    batches = [
        rows.withColumn("model_name", F.lit("m1")),
        rows.where(i % 4 == 0).withColumns({"model_name": F.lit("m2"), "creator_id": F.col("creator_id") + 1}),
        rows.where(i % 9 == 0).withColumns({"model_name": F.lit("m2"), "fingerprint_id": i + 1_000_000}),
    ]
    for n in (0, 1, 1, 2):
        store.add(batches[n], app="writer", batch=n)
    store.compact()
    store.add(batches[1].withColumn("model_name", F.lit("replayed")), app="writer", batch=1)
    return store.read().select("fingerprint_id", "creator_id", "model_name", F.size("embedding").cast("long").alias("width"))


@query("SELECT fingerprint_id, creator_id FROM vectors WHERE fingerprint_id NOT IN (SELECT fingerprint_id FROM fingerprints WHERE video_id IN (SELECT id FROM videos WHERE status = 'searchable' AND id % 3 = 0))", "vectors", "fingerprints", "videos")
def after_delete_tombstones(v: Views) -> DataFrame:
    store = _store(v)
    store.add(v.vectors)
    gone = v.videos.where("status = 'searchable' and id % 3 = 0").select(F.col("id").alias("video_id"))
    store.remove(v.fingerprints.join(gone, "video_id", "left_semi").select("fingerprint_id"))
    return store.read(columns=["fingerprint_id", "creator_id"])


@query("SELECT id, created_at, source_app, success, http_status FROM requests", "requests")
def request_log_appended(v: Views) -> DataFrame:
    """The requests logged in three numbered batches, two of them sent again."""
    rows, path = v.requests.select("id", "created_at", "source_app", "success", "http_status"), new_path(v.spark, "requests")
    for n in (0, 0, 1, 2, 1):
        U.append_request_log(rows.where(F.col("id") % 3 == n), path, "service", n)
    return U.request_log(v.spark, path, rows.schema).read()
