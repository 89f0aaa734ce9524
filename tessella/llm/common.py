"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.shared import discard, new_path, shared_dir  # noqa: F401  (given on)

#: Distinct words that a worker remembers at most, and bytes of a word that is remembered.
WORD_MEMO, MEMO_WORD = 200_000, 64
#: Bytes of text that one numpy pass handles at a time inside a task.
BLOCK_BYTES = 1 << 19


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Of a shuffle, and buckets of a table."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """A table of ``df`` in the shared folder, bucketed by ``key``: a join on it moves the other side alone."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    n = partitions(spark)
    df.repartition(n, key).write.option("path", new_path(spark, label)).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def order_buckets(df: DataFrame, key: str, per_partition: int = 4, out: str = "bucket") -> DataFrame:
    """Add ``out``: a bucket number that never falls as ``key`` rises; buckets hold about equal counts.

    The split points are approximate quantiles (as many as there are buckets). A null key counts as the
    smallest. Equal keys share a bucket.
    """
    spark = df.sparkSession
    n = per_partition * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    as_double = F.coalesce(F.col(key).cast("double"), F.lit(float(-(2**63))))
    keyed = df.withColumn("__key", as_double)
    found = keyed.approxQuantile("__key", [i / n for i in range(1, n)], 0.25 / n)
    splits = [-float("inf"), *sorted(set(found)), float("inf")]
    if len(splits) < 3:
        return keyed.drop("__key").withColumn(out, F.lit(0))
    made = Bucketizer(splits=splits, inputCol="__key", outputCol="__bucket").transform(keyed)
    return made.withColumn(out, F.col("__bucket").cast("int")).drop("__key", "__bucket")


def running_total(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ``key`` order.

    Each bucket is summed apart; only one number a bucket is added up in one place.
    """
    b = order_buckets(df, key, out="__b")
    offsets = (
        b.groupBy("__b").agg(F.sum(value).alias("__s"))
        .withColumn("__off", F.coalesce(F.sum("__s").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("__b", "__off")
    )
    before = W.partitionBy("__b").orderBy(F.col(key).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    summed = b.withColumn("__in", F.coalesce(F.sum(value).over(before), F.lit(0)))
    # one row a bucket, so the size has a bound: four times the shuffle partitions
    return summed.join(F.broadcast(offsets), "__b").withColumn(out, (F.col("__in") + F.col("__off")).cast("long")).drop("__b", "__in", "__off")


# --------------------------------------------------------------------------- numpy helpers, used inside tasks

_TABLE = np.random.default_rng(20240607).integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[:], down[:] = _BASES[which], pow(_BASES[which], -1, 2**64)
        up[0] = down[0] = 1
        _POWERS[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[which]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any ranges of a symbol array, from one pass over it."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        self.down = _powers(which, n + 1)[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers(which, n + 1)[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def byte_symbols(data: np.ndarray, which: int = 0) -> np.ndarray:
    return _TABLE[which][data]


_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    edge = np.flatnonzero(np.diff(_GAP[data].view(np.int8), prepend=1, append=1))
    return edge[::2], edge[1::2]


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts' bytes, each with a line feed after it, and where each begins (one more entry: the end)."""
    parts = [(t or "").encode() for t in texts]
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begins[1:])
    return b"\n".join([*parts, b""]), begins


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, each of about ``most`` text bytes, or one row if that is longer, and of ``rows`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(total, before + most, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def winnow(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of the least value, the leftmost on ties, in each window of ``width`` values.

    Returns the windows' choices (one for each window; they never fall) and the distinct choices. Equal
    windows choose alike, so repeated stretches always share a chosen place.
    """
    n = len(values)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = (values & np.uint64(0xFFFFFFFFFF000000)) >> np.uint64(24)
    blocks = -(-n // width)
    keyed = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    # 40 bits of the value above, the place inside two blocks below: a minimum is then leftmost
    keyed[:n] = rank
    place = np.arange(blocks * width, dtype=np.int64)

    def least(k: np.ndarray, p: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        k, p = k.reshape(blocks, width), p.reshape(blocks, width)
        if reverse:
            k, p = k[:, ::-1], p[:, ::-1]
        m = np.minimum.accumulate(k, axis=1)
        new = np.ones(k.shape, bool)
        new[:, 1:] = (k[:, 1:] <= m[:, :-1]) if reverse else (k[:, 1:] < m[:, :-1])
        at = np.maximum.accumulate(np.where(new, np.arange(width), 0), axis=1)
        at = np.take_along_axis(p, at, axis=1)
        if reverse:
            m, at = m[:, ::-1], at[:, ::-1]
        return np.ascontiguousarray(m).ravel(), np.ascontiguousarray(at).ravel()

    suffix, suffix_at = least(keyed, place, True)
    prefix, prefix_at = least(keyed, place, False)
    count = n - width + 1
    left, right = suffix[:count], prefix[width - 1 : width - 1 + count]
    choice = np.where(left <= right, suffix_at[:count], prefix_at[width - 1 : width - 1 + count])
    first = np.ones(count, bool)
    first[1:] = choice[1:] != choice[:-1]
    return choice, choice[first]


def winnow_parts(values: np.ndarray, width: int, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing of the parts [begin, end) of ``values``, each by itself: (part, choice, low, high) of each distinct choice.

    The windows that start from ``low`` to ``high`` - 1 choose it.
    """
    choice = winnow(values, width)[0]
    n = np.maximum(ends - begins - width + 1, 0)
    part = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(part)) + np.repeat(begins - np.cumsum(n) + n, n)
    chosen = choice[at]
    first = np.ones(len(at), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1])
    low = np.flatnonzero(first)
    return part[low], chosen[low], at[low], at[low] + np.diff(np.append(low, len(at)))


def chosen_by_lists(part: np.ndarray, place: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which (part, place) are in the list of their part."""
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.isin((part << 40) + place, (owner << 40) + pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False))


def digest(data: bytes | memoryview, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


class _Digests(dict):
    """The digests of words, each computed once."""

    def __missing__(self, word: bytes) -> bytes:
        found = digest(word)
        if len(word) <= MEMO_WORD:
            self[word] = found
        return found


_DIGESTS = _Digests()


def word_digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The digest of every word as two numbers, and the first word of each text (one more entry: the number of words)."""
    if len(_DIGESTS) > WORD_MEMO:
        _DIGESTS.clear()
    split = [(t or "").encode().split() for t in texts]  # bytes.split() cuts at ASCII white space alone
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=first[1:])
    digests = b"".join(map(_DIGESTS.__getitem__, itertools.chain.from_iterable(split)))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2), first


def run_digests(words: np.ndarray, size: int, half: int = 0) -> np.ndarray:
    """A 64-bit digest of each run of ``size`` words, from one half of the words' digests: runs of 1, 2, 4, ... words
    are made of two of half their length, and those that ``size`` is the sum of are joined."""
    n = max(0, len(words) - size + 1)
    pair = lambda a, b: mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    run, span, found, held = words[:, half].copy(), 1, None, 0
    while True:
        if size & span:
            found = run[:n] if found is None else pair(found, run[held : held + n])
            held += span
        span *= 2
        if span > size:
            return found
        run = pair(run[: -(span // 2)], run[span // 2 :])
