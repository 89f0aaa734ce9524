"""Centroid clustering of integer vectors with a distance matrix that is kept and patched.

Each row of the kept table holds its vector and its exact dot products with all centroids, as whole numbers. A round
sums the vectors of each cluster, takes the floor of the mean as new centroid and adds to each dot product the
vector's product with those components of the centroid that changed; an unchanged centroid costs nothing. The nearest
centroid follows from the dot products and the centroids' own lengths. No rows move: only sums of a batch leave a task.
Each round's table is written to the shared folder, and the one before it is removed.

Defined results: rows whose vector is null, has another width, or holds a null or a number that is not finite are
left out; a component beyond ``LIMIT`` in size counts as ``LIMIT`` (squared distances would not fit a long); a row
with a null id is assigned, but is never a first centroid; repeated rows count each, also as first centroids (ties of
the hash go by the vector); with fewer rows than centroids there are as many centroids as rows with an id; without
any, or with an empty table, there are no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 16, 3, 64, 64, 1
#: The largest size of a component: 64 squared differences of twice this still fit a long.
LIMIT = 1 << 27
#: Rows that numpy works on at a time.
BATCH = 4096


def integer_vectors(rows: DataFrame, width: int | None = WIDTH, scale: int = SCALE, limit: int = LIMIT) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that are whole, finite and ``width`` wide (any width: None)."""
    # NaN is above all limits in Spark's order, so one comparison finds all that is not finite
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    good = F.col("embedding").isNotNull() & finite
    if width is not None:
        good = good & (F.size("embedding") == width)
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(limit)), F.lit(-limit)).cast("long")
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", held).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def patched(table: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The table with its dot products brought from the centroids ``before`` to those ``after``, and the nearest one.

    Adds only the products with the components that changed: ``dots`` stay exact whole numbers.
    """
    changes = [(j, np.flatnonzero(d), d[d != 0]) for j, d in enumerate(after - before) if d.any()]
    lengths, k, width = (after * after).sum(axis=1), len(after), after.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x, dots = _matrix(b.column("x"), width), _matrix(b.column("dots"), k).copy()
            for j, at, by in changes:
                dots[:, j] += x[:, at] @ by
            far = lengths - 2 * dots  # the squared distance less the vector's own length
            cluster = far.argmin(axis=1)
            distance = (x * x).sum(axis=1) + far[np.arange(len(far)), cluster]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), _lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "x", "dots", "cluster", "distance"])

    return table.select("vec_id", "x", "dots").mapInArrow(run, "vec_id long, x array<long>, dots array<long>, cluster int, distance long")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; a centroid without vectors stays."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x, cluster = _matrix(b.column("x"), width), b.column("cluster").to_numpy()
            some = np.unique(cluster)
            sums = np.stack([x[cluster == j].sum(axis=0) for j in some]) if len(some) else np.empty((0, width), np.int64)
            at = np.tile(np.arange(width, dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, width)), pa.array(at), pa.array(sums.ravel()), pa.array(np.repeat(np.array([(cluster == j).sum() for j in some], np.int64), width))], ["cluster", "at", "s", "n"])

    sums = table.select("x", "cluster").mapInArrow(run, "cluster int, at int, s long, n long").groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # a row a centroid and component
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors of the ``k`` ids with the smallest hashes."""
    named = vectors.where(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    found = [r["x"] for r in named.orderBy("h", "x").limit(k).collect()]  # k rows
    return np.array(found, np.int64) if found else np.empty((0, 0), np.int64)


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, dots, cluster, distance) after ``rounds`` rounds and a last assignment, and the centroids."""
    vectors = integer_vectors(rows, width)
    table = materialise(vectors, "vectors")
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return table.where("false").selectExpr("vec_id", "x", "x AS dots", "0 AS cluster", "0L AS distance"), centroids
    zero = np.zeros_like(centroids)
    start = table.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(centroids)))
    held = materialise(patched(start, zero, centroids), "distances")
    discard(table)
    for _ in range(rounds):
        new = moved(held, centroids)
        if (new == centroids).all():
            break  # no round after this one changes anything
        before, held = held, materialise(patched(held, centroids, new), "distances")
        discard(before)
        centroids = new
    return held, centroids


def clustering_report(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    table, centroids = cluster(rows, k, rounds, width, seed)
    sums = {r["cluster"]: int(r["s"]) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(j, sums.get(j, 0), sum(sums.values()), name) for j, name in enumerate(names)]
    fixed = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(fixed), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The same rows in SQL: recomputes all distances each round.
CLUSTERING_SQL = """WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
   WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64),
 c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('1:', vec_id)), x) - 1 AS INT) AS j, x AS c FROM kept QUALIFY j < 16),
""" + "".join(
    f"""a{r} AS MATERIALIZED (SELECT vec_id, x, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, x, j, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r}) t GROUP BY vec_id, x),
 """ + (f"""m{r + 1} AS (SELECT j, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT j, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) r(i) GROUP BY j, i) t GROUP BY j),
 c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(m{r + 1}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r + 1} USING (j)),
 """ if r < 3 else "")
    for r in range(4)
) + """e AS (SELECT j, CAST(sum(d) AS BIGINT) AS s FROM a3 GROUP BY j)
 SELECT vec_id, j AS cluster, d AS distance, s AS cluster_inertia, (SELECT CAST(sum(s) AS BIGINT) FROM e) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a3 JOIN e USING (j) JOIN c3 USING (j)"""
