"""Neighbours that read little: exact search that skips blocks by their bounds, and product-quantised inverted lists.

Both need centres that are fitted on a bounded sample of the vectors; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.scalars import cosine
from tessella.operators.knn import BLOCK, _best, _top, _unit
from tessella.shared import written

#: Vectors that centres and codes are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE, SEED = 20_000, 3
#: Rounding that a bound allows for.
SLACK = 1e-9


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """``k`` means of the rows of ``x`` (fewer if there are fewer different rows); an empty mean takes the farthest row."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    means = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        far = (means * means).sum(axis=1) - 2 * x @ means.T
        near = far.argmin(axis=1)
        n = np.bincount(near, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, near, x)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
        if (n == 0).any():
            worst = np.argsort(-(far.min(axis=1) + (x * x).sum(axis=1)))
            means[n == 0] = x[worst[: (n == 0).sum()]]
    return means


def fitting_sample(vectors: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    """Unit vectors of at most ``sample`` rows, the same for the same table."""
    some = vectors.where("embedding is not null").orderBy(F.xxhash64(F.lit(seed), "fingerprint_id")).select("embedding").limit(sample).toArrow()
    return _unit(some.column("embedding").combine_chunks()) if some.num_rows else np.zeros((0, 0))


def fit_centres(vectors: DataFrame, n: int, sample: int = SAMPLE, seed: int = SEED) -> np.ndarray:
    return lloyd(fitting_sample(vectors, sample, seed), n, seed=seed)


def nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * unit @ centres.T).argmin(axis=1)


def listed(vectors: DataFrame, centres: np.ndarray, scope: str = "creator_id") -> DataFrame:
    """(scope, list_id, fingerprint_id, embedding): each vector with its nearest centre. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column("embedding")))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nearest(_unit(b.column("embedding")), centres).astype(np.int32)), *b.columns[1:]], ["scope", "list_id", "fingerprint_id", "embedding"])

    rows = vectors.where(F.col(scope).isNotNull()).select(F.col(scope).cast("long").alias("scope"), F.col("fingerprint_id").cast("long").alias("fingerprint_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "scope long, list_id int, fingerprint_id long, embedding array<float>")


# ---------------------------------------------------------------- exact, with bounds

BOUNDED = "scope long, block string, n int, centre binary, radius double, ids array<long>, matrix binary"


def bounded_blocks(vectors: DataFrame, centres: np.ndarray, scope: str = "creator_id", size: int = BLOCK) -> DataFrame:
    """A written table of blocks of like vectors of one scope: a direction, the widest angle to it, ids and float32 vectors.

    Ranges over (scope, list, id) cut the rows, so a hot scope or list is spread over its ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def block(t: pa.Table) -> pa.RecordBatch:
            raw = t.column("embedding").combine_chunks()
            unit = _unit(raw)
            middle = unit.mean(axis=0)
            middle /= np.sqrt((middle * middle).sum()) + 1e-10
            radius = float(np.arccos(np.clip(unit @ middle, -1, 1)).max())
            ids = t.column("fingerprint_id").to_pylist()
            name = f"{t.column('scope')[0].as_py()}-{t.column('list_id')[0].as_py()}-{ids[0]}"
            return pa.RecordBatch.from_arrays([
                pa.array([t.column("scope")[0].as_py()]), pa.array([name]), pa.array([len(ids)], pa.int32()), pa.array([middle.tobytes()]), pa.array([radius]), pa.array([ids], pa.list_(pa.int64())),
                pa.array([raw.flatten().to_numpy(zero_copy_only=False).astype(np.float32).tobytes()]),
            ], ["scope", "block", "n", "centre", "radius", "ids", "matrix"])

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            group = held.column("scope").to_numpy() * (1 << 20) + held.column("list_id").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
            begin = 0
            for i, end in enumerate(ends):
                last = i == len(ends) - 1
                while end - begin >= size or (end > begin and not last):
                    step = min(size, end - begin)
                    yield block(held.slice(begin, step))
                    begin += step
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield block(held)

    rows = listed(vectors, centres, scope)
    ranged = rows.repartitionByRange("scope", "list_id", "fingerprint_id").sortWithinPartitions("scope", "list_id", "fingerprint_id")
    return written(ranged.mapInArrow(run, BOUNDED), "bounded")


def _queries(segments: DataFrame, scope: str) -> DataFrame:
    """(scope, clip_id, seg_ord, q): unit vectors of the segments, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.is_valid(b.column("embedding")))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v.tobytes() for v in _unit(b.column("embedding"))])], ["scope", "clip_id", "seg_ord", "q"])

    rows = segments.where(F.col(scope).isNotNull()).select(F.col(scope).cast("long").alias("scope"), F.col("clip_id").cast("long").alias("clip_id"), F.col("seg_ord").cast("int").alias("seg_ord"), "embedding")
    return rows.mapInArrow(run, "scope long, clip_id long, seg_ord int, q binary")


def _scored(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(clip_id, seg_ord, fingerprint_id, score): each pair's k best. The queries of a block meet it packed, a task at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in pa.compute.unique(b.column("block")):
                some = b.filter(pa.compute.equal(b.column("block"), name))
                columns = [pa.array([some.column(c).to_pylist()], kind) for c, kind in (("clip_id", pa.list_(pa.int64())), ("seg_ord", pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), *columns, pa.array([b"".join(some.column("q").to_pylist())])], ["block", "clip_id", "seg_ord", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                clips, segs, ids = np.array(r["clip_id"]), np.array(r["seg_ord"], np.int32), np.array(r["ids"])
                m = np.frombuffer(r["matrix"], np.float32).astype(np.float64).reshape(len(ids), -1)
                m = m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-10)
                scores = np.frombuffer(r["q"]).reshape(len(clips), -1) @ m.T
                n = min(k, len(ids))
                best, rows = _best(scores, ids, n).ravel(), np.repeat(np.arange(len(clips)), n)
                yield pa.RecordBatch.from_arrays([pa.array(clips[rows]), pa.array(segs[rows]), pa.array(ids[best]), pa.array(scores[rows, best])], ["clip_id", "seg_ord", "fingerprint_id", "score"])

    packed = pairs.select("block", "clip_id", "seg_ord", "q").mapInArrow(pack, "block string, clip_id array<long>, seg_ord array<int>, q binary")
    return blocks.select("block", "ids", "matrix").join(packed, "block").mapInArrow(run, "clip_id long, seg_ord int, fingerprint_id long, score double")


def pair_bounds(segments: DataFrame, blocks: DataFrame, scope: str = "creator_id") -> DataFrame:
    """(clip_id, seg_ord, q, block, n, bound): the best score that a block of the segment's scope can hold. Reads no vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = np.frombuffer(b"".join(b.column("q").to_pylist())).reshape(b.num_rows, -1)
            c = np.frombuffer(b"".join(b.column("centre").to_pylist())).reshape(b.num_rows, -1)
            angle = np.arccos(np.clip((q * c).sum(axis=1), -1, 1)) - b.column("radius").to_numpy()
            bound = np.cos(np.maximum(angle, 0)) + SLACK  # a vector is no nearer than the block's edge
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("clip_id", "seg_ord", "q", "block", "n")], pa.array(bound)], ["clip_id", "seg_ord", "q", "block", "n", "bound"])

    met = blocks.select("scope", "block", "n", "centre", "radius").join(_queries(segments, scope), "scope")
    return met.mapInArrow(run, "clip_id long, seg_ord int, q binary, block string, n int, bound double")


def knn_pruned(segments: DataFrame, blocks: DataFrame, k: int = 10, scope: str = "creator_id") -> tuple[DataFrame, DataFrame]:
    """The rows of ``knn_join``, exactly, and (clip_id, seg_ord, blocks, scored, vectors, touched): what each segment cost.

    A segment first meets its most promising blocks, enough for ``k`` vectors; of the others only those whose bound
    reaches the k-th score found there.
    """
    key = ["clip_id", "seg_ord"]
    bounds = written(pair_bounds(segments, blocks, scope), "bounds")
    ahead = W.partitionBy(*key).orderBy(F.desc("bound"), "block").rowsBetween(W.unboundedPreceding, -1)
    ranked = bounds.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)) < k)
    found = written(_top(_scored(ranked.where("first"), blocks, k), k), "found")
    least = found.groupBy(*key).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-2.0).alias("least"))
    wanted = written(ranked.join(least, key, "left").withColumn("more", ~F.col("first") & (F.col("bound") >= F.coalesce("least", F.lit(-2.0)))).select(*key, "q", "block", "n", "first", "more"), "wanted")
    rest = _scored(wanted.where("more"), blocks, k)
    met = F.col("first") | F.col("more")
    cost = wanted.groupBy(*key).agg(F.count(F.lit(1)).alias("blocks"), F.count_if(met).alias("scored"), F.sum("n").alias("vectors"), F.sum(F.when(met, F.col("n")).otherwise(0)).alias("touched"))
    return _top(found.select(*key, "fingerprint_id", "score").unionByName(rest), k), cost


# ---------------------------------------------------------------- approximate, by codes

@dataclass
class Codes:
    """List centres and, for each part of a residual, its code words."""

    centres: np.ndarray
    words: list[np.ndarray]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.words), axis=1)


def fit_codes(vectors: DataFrame, lists: int, parts: int = 8, words: int = 64, sample: int = SAMPLE, seed: int = SEED) -> Codes:
    """Centres, and words of what is left of a vector when its centre is taken off. ``words`` is 256 at most."""
    x = fitting_sample(vectors, sample, seed)
    if not len(x):
        return Codes(np.zeros((0, 0)), [])
    centres = lloyd(x, lists, seed=seed)
    rest = x - centres[nearest(x, centres)]
    return Codes(centres, [lloyd(p, words, seed=seed + 1 + i) for i, p in enumerate(np.array_split(rest, min(parts, x.shape[1]), axis=1))])


def build_pq(vectors: DataFrame, codes: Codes, scope: str = "creator_id", size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Two written tables, both laid out by list: packed codes (scope, list_id, ids, codes), and the vectors themselves."""
    rows = written(listed(vectors, codes.centres, scope), "listed", ["list_id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scopes, lists = b.column("scope").to_numpy(), b.column("list_id").to_numpy()
            for s, l in set(zip(scopes.tolist(), lists.tolist())):
                at = np.flatnonzero((scopes == s) & (lists == l))
                for i in range(0, len(at), size):
                    part = b.take(pa.array(at[i : i + size]))
                    rest = _unit(part.column("embedding")) - codes.centres[l]
                    coded = np.stack([nearest(p, w) for p, w in zip(codes.parts(rest), codes.words)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([part.column("fingerprint_id").to_pylist()], pa.list_(pa.int64())), pa.array([coded.tobytes()]), pa.array([l], pa.int32())], ["scope", "ids", "codes", "list_id"])

    packed = rows.select("scope", "list_id", "fingerprint_id", "embedding").mapInArrow(pack, "scope long, ids array<long>, codes binary, list_id int")
    return written(packed, "codes", ["list_id"]), rows


def _probes(segments: DataFrame, packed: DataFrame, codes: Codes, nprobe: int, least: int, scope: str) -> DataFrame:
    """(scope, list_id, clip_id, seg_ord, base, n): the lists that each segment looks into, nearest first: ``nprobe`` at least,
    and on until they hold ``least`` vectors of its scope, so that small scopes and small lists keep their recall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.frombuffer(b"".join(b.column("q").to_pylist())).reshape(b.num_rows, -1) @ codes.centres.T
            lists = np.argsort(-near, axis=1, kind="stable")
            again = pa.array(np.repeat(np.arange(b.num_rows), lists.shape[1]))
            place = np.tile(np.arange(lists.shape[1], dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("scope").take(again), pa.array(lists.ravel().astype(np.int32)), *[b.column(c).take(again) for c in ("clip_id", "seg_ord")], pa.array(np.take_along_axis(near, lists, axis=1).ravel()), pa.array(place)], ["scope", "list_id", "clip_id", "seg_ord", "base", "place"])

    sizes = packed.groupBy("scope", "list_id").agg(F.sum(F.size("ids")).alias("n"))
    every = _queries(segments, scope).mapInArrow(run, "scope long, list_id int, clip_id long, seg_ord int, base double, place int").join(sizes, ["scope", "list_id"])
    ahead = W.partitionBy("clip_id", "seg_ord").orderBy("place")
    held = every.withColumn("before", F.coalesce(F.sum("n").over(ahead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("nth", F.row_number().over(ahead))
    return held.where((F.col("nth") <= nprobe) | (F.col("before") < least)).select("scope", "list_id", "clip_id", "seg_ord", "base", "n")


def pq_candidates(segments: DataFrame, packed: DataFrame, codes: Codes, nprobe: int, depth: int, least: int, scope: str = "creator_id") -> DataFrame:
    """(clip_id, seg_ord, rank, fingerprint_id, score, list_id): the ``depth`` best of the probed lists by their codes.

    A segment's table of products with the code words is made where it meets codes: a score is a look-up a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.array(r["ids"])
                coded = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                q = np.frombuffer(r["q"]).reshape(1, -1)
                scores = np.full(len(ids), r["base"])
                for i, (part, words) in enumerate(zip(codes.parts(q), codes.words)):
                    scores += (words @ part[0])[coded[:, i]]
                best = _best(scores[None], ids, min(depth, len(ids)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), r["clip_id"])), pa.array(np.full(len(best), r["seg_ord"], np.int32)), pa.array(ids[best]), pa.array(scores[best]), pa.array(np.full(len(best), r["list_id"], np.int32))], ["clip_id", "seg_ord", "fingerprint_id", "score", "list_id"])

    asked = _probes(segments, packed, codes, nprobe, least, scope).join(_queries(segments, scope).select("clip_id", "seg_ord", "q"), ["clip_id", "seg_ord"])
    met = packed.join(asked, ["scope", "list_id"]).select("clip_id", "seg_ord", "q", "base", "ids", "codes", "list_id")
    scored = met.mapInArrow(run, "clip_id long, seg_ord int, fingerprint_id long, score double, list_id int")
    best = W.partitionBy("clip_id", "seg_ord").orderBy(F.desc("score"), "fingerprint_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth)


def knn_pq(segments: DataFrame, packed: DataFrame, rows: DataFrame, codes: Codes, k: int = 10, nprobe: int = 1, depth: int = 100, least: int | None = None, scope: str = "creator_id") -> DataFrame:
    """Approximate neighbours: codes choose ``depth`` vectors a segment, and these alone are read and scored exactly.

    ``least`` vectors are looked at by their codes, 4 ``k`` if it is not given.
    """
    chosen = pq_candidates(segments, packed, codes, nprobe, depth, 4 * k if least is None else least, scope).select("clip_id", "seg_ord", "fingerprint_id", "list_id")
    # the list is a folder of the vectors: Spark prunes those that no segment probes
    pairs = rows.select("list_id", "fingerprint_id", F.col("embedding").alias("v")).join(chosen, ["list_id", "fingerprint_id"])
    asked = pairs.join(segments.select("clip_id", "seg_ord", "embedding"), ["clip_id", "seg_ord"])
    return _top(asked.select("clip_id", "seg_ord", "fingerprint_id", cosine(F.col("embedding"), F.col("v")).alias("score")), k)


def pq_cost(segments: DataFrame, packed: DataFrame, codes: Codes, nprobe: int = 1, depth: int = 100, least: int = 40, scope: str = "creator_id") -> DataFrame:
    """(clip_id, seg_ord, vectors, coded, scored): vectors of the segment's scope, codes looked at, vectors read and scored."""
    sizes = packed.groupBy("scope").agg(F.sum(F.size("ids")).alias("vectors"))
    every = _queries(segments, scope).select("scope", "clip_id", "seg_ord").join(sizes, "scope")
    seen = _probes(segments, packed, codes, nprobe, least, scope).groupBy("clip_id", "seg_ord").agg(F.sum("n").alias("coded"))
    return every.join(seen, ["clip_id", "seg_ord"], "left").select("clip_id", "seg_ord", "vectors", F.coalesce("coded", F.lit(0)).alias("coded"), F.least(F.coalesce("coded", F.lit(0)), F.lit(depth)).alias("scored"))
