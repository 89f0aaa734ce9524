"""Nearest neighbours: exact within a scope, and approximate by inverted lists or random projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalars import cosine

#: Rows of a packed block.
BLOCK = 2048


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("clip_id", "seg_ord").orderBy(F.desc("score"), "fingerprint_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("clip_id", "seg_ord", "rank", "fingerprint_id", "score")


def _unit(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(rows), -1) if len(rows) else flat.reshape(0, 0)
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10)


def _packed(df: DataFrame, scope: str, ids: list[str]) -> DataFrame:
    """Blocks of rows of one scope value: their ids and their normalised vectors as one binary. No shuffle."""
    kinds = {"fingerprint_id": "long", "clip_id": "long", "seg_ord": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column("embedding")))
            scopes = b.column("scope").to_numpy(zero_copy_only=False)
            for s in np.unique(scopes):
                at = np.flatnonzero(scopes == s)
                for i in range(0, len(at), BLOCK):
                    part = b.take(pa.array(at[i : i + BLOCK]))
                    m = _unit(part.column("embedding"))
                    columns = [pa.array([s]), *(pa.array([part.column(c).to_pylist()], pa.list_(pa.int32() if kinds[c] == "int" else pa.int64())) for c in ids), pa.array([m.tobytes()])]
                    yield pa.RecordBatch.from_arrays(columns, ["scope", *ids, "matrix"])

    schema = "scope long, " + ", ".join(f"{c} array<{kinds[c]}>" for c in ids) + ", matrix binary"
    picked = df.where(F.col(scope).isNotNull()).select(F.col(scope).cast("long").alias("scope"), *[F.col(c).cast(kinds[c]).alias(c) for c in ids], "embedding")
    return picked.mapInArrow(run, schema)


def knn_join(segments: DataFrame, vectors: DataFrame, k: int = 10, scope: str = "creator_id", method: str = "block") -> DataFrame:
    """(clip_id, seg_ord, rank, fingerprint_id, score): the k vectors of the same scope nearest to each segment.

    ``block`` packs both sides into matrices, joins the blocks on the scope and keeps k rows of each product,
    so a large scope is spread over its blocks; ``expr`` scores row pairs with SQL functions. Ties go to the
    lower id. Spark picks the join: a broadcast of the segments where they are small, else a shuffle.
    """
    if method == "expr":
        v = vectors.select(F.col(scope), "fingerprint_id", F.col("embedding").alias("v"))
        pairs = v.join(segments.select(F.col(scope), "clip_id", "seg_ord", "embedding"), scope)
        return _top(pairs.select("clip_id", "seg_ord", "fingerprint_id", cosine(F.col("embedding"), F.col("v")).alias("score")), k)
    queries = _packed(segments, scope, ["clip_id", "seg_ord"])
    index = _packed(vectors, scope, ["fingerprint_id"]).withColumnRenamed("matrix", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                clips, segs, ids = np.array(r["clip_id"]), np.array(r["seg_ord"]), np.array(r["fingerprint_id"])
                scores = np.frombuffer(r["matrix"]).reshape(len(clips), -1) @ np.frombuffer(r["vectors"]).reshape(len(ids), -1).T
                n = min(k, len(ids))
                best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :n] if len(ids) <= 4 * k else _best(scores, ids, n)
                rows = np.repeat(np.arange(len(clips)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(clips[rows]), pa.array(segs[rows].astype(np.int32)), pa.array(ids[best.ravel()]), pa.array(scores[rows, best.ravel()])], ["clip_id", "seg_ord", "fingerprint_id", "score"]
                )

    met = index.join(queries, "scope").select("clip_id", "seg_ord", "fingerprint_id", "matrix", "vectors")
    return _top(met.mapInArrow(run, "clip_id long, seg_ord int, fingerprint_id long, score double"), k)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the n best scores of each row; all that tie with the last are weighed by id."""
    out = np.empty((len(scores), n), np.int64)
    for i, row in enumerate(scores):
        edge = np.partition(row, len(row) - n)[len(row) - n]
        some = np.flatnonzero(row >= edge)
        out[i] = some[np.lexsort((ids[some], -row[some]))[:n]]
    return out


def truncated(neighbours: DataFrame, segments: DataFrame) -> DataFrame:
    """Cut every segment's list to the shortest of its clip; a clip whose first segment has none keeps none."""
    counts = neighbours.groupBy("clip_id", "seg_ord").agg(F.count(F.lit(1)).alias("n"))
    lists = segments.select("clip_id", "seg_ord").distinct().join(counts, ["clip_id", "seg_ord"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shortest = lists.groupBy("clip_id").agg(F.min("n").alias("k"))
    return neighbours.join(shortest, "clip_id").where(F.col("rank") <= F.col("k")).drop("k")


def build_ivf(vectors: DataFrame, n_lists: int = 16, sample: int = 20_000, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vectors with list_id, centres). Centres are fitted on about ``sample`` vectors; every vector is listed."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / (F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))) + 1e-10))))
    n = vectors.count()
    picked = unit if n <= sample else unit.where(F.pmod(F.xxhash64(F.lit(seed), "fingerprint_id"), F.lit(n)) < sample)
    model = KMeans(k=n_lists, seed=seed, maxIter=10, featuresCol="features", predictionCol="list_id").fit(picked)
    return model.transform(unit).drop("features"), np.array(model.clusterCenters())


def knn_ivf(segments: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, nprobe: int = 4, scope: str = "creator_id") -> DataFrame:
    """Approximate neighbours: each segment looks into the lists of its ``nprobe`` nearest centres."""
    score = lambda c: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, map(float, c))), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    ranked = F.slice(F.sort_array(F.array(*[F.struct(score(c).alias("s"), F.lit(i).alias("list_id")) for i, c in enumerate(centres)]), asc=False), 1, nprobe)
    probes = segments.select(scope, "clip_id", "seg_ord", "embedding", F.explode(ranked).alias("p")).select(scope, "clip_id", "seg_ord", "embedding", "p.list_id")
    pairs = index.select(scope, "list_id", "fingerprint_id", F.col("embedding").alias("v")).join(probes, [scope, "list_id"])
    return _top(pairs.select("clip_id", "seg_ord", "fingerprint_id", cosine(F.col("embedding"), F.col("v")).alias("score")), k)


def knn_lsh(segments: DataFrame, vectors: DataFrame, k: int = 10, tables: int = 32, bits: int = 4, scope: str = "creator_id", seed: int = 9) -> DataFrame:
    """Approximate neighbours by sign projections: pairs that share the signs of one of the tables are scored."""
    width = len(vectors.select("embedding").first()[0])
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))

    def hashed(df: DataFrame, ids: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                signs = np.einsum("nd,tbd->ntb", _unit(b.column("embedding")), planes) > 0
                codes = (signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(codes), pa.list_(pa.int64()))], [*b.schema.names, "codes"])

        picked = df.select(scope, *ids, "embedding")
        return picked.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in picked.dtypes) + ", codes array<long>")

    left = hashed(segments, ["clip_id", "seg_ord"]).withColumn("code", F.explode("codes"))
    right = hashed(vectors, ["fingerprint_id"]).withColumnRenamed("embedding", "v").select(scope, "fingerprint_id", "v", F.col("codes").alias("theirs"), F.explode("codes").alias("code"))
    met = left.join(right, [scope, "code"])
    once = met.where(F.col("code") == F.element_at(F.array_intersect("codes", "theirs"), 1))  # a pair counts in its first table
    return _top(once.select("clip_id", "seg_ord", "fingerprint_id", cosine(F.col("embedding"), F.col("v")).alias("score")), k)
