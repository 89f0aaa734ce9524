"""WAV files to chunks, chunks to one-second segments, segments to embeddings."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RATE, CHUNK_SECONDS, BATCH = 16_000, 60, 8


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def samples_of(content: bytes) -> np.ndarray:
    """Mono 16-bit samples as float32 in -1 to 1; the rate must be 16 kHz."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getframerate() != RATE:
            raise ValueError(f"sample rate must be {RATE}, not {w.getframerate()}")
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
    return (raw.mean(axis=1) / 32768).astype(np.float32)


def audio_chunks(files: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """(path, offset_seconds, duration_seconds, samples): chunks of equal length, the last filled with silence.

    A file may begin at an ``offset_seconds`` of its recording; without that column it begins at 0.
    """
    size = chunk_seconds * RATE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, content in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), b.column("content")):
                x = samples_of(content.as_py())
                for at in range(0, len(x), size):
                    part = np.zeros(size, np.float32)
                    part[: len(x[at : at + size])] = x[at : at + size]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start + at / RATE]), pa.array([float(chunk_seconds)]), pa.array([part.tobytes()])], ["path", "offset_seconds", "duration_seconds", "samples"])

    start = F.col("offset_seconds") if "offset_seconds" in files.columns else F.lit(0.0)
    return files.select("path", "content", start.cast("double").alias("start")).mapInArrow(run, "path string, offset_seconds double, duration_seconds double, samples binary")


def cut_segments(x: np.ndarray, rate: int, offset: float) -> tuple[np.ndarray, np.ndarray]:
    """One-second rows, the last filled with silence, and their times."""
    if rate != RATE:
        raise ValueError(f"sample rate must be {RATE}, not {rate}")
    n = -(-len(x) // RATE)
    out = np.zeros((n, RATE), np.float32)
    out.reshape(-1)[: len(x)] = x
    return out, (np.arange(n) + offset).astype(np.float32)


def spectral_embedding(segments: np.ndarray, width: int = 64) -> np.ndarray:
    """A plain embedding for tests: log energies of equal frequency bands, of length one."""
    power = np.abs(np.fft.rfft(segments, axis=1)) ** 2
    bands = np.add.reduceat(power, np.linspace(0, power.shape[1], width, endpoint=False).astype(int), axis=1)
    x = np.log1p(bands)
    return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)).astype(np.float32)


def embed_segments(chunks: DataFrame, embed: Callable[[np.ndarray], np.ndarray] = spectral_embedding, width: int = 64) -> DataFrame:
    """(path, timestamp_seconds, embedding) of all seconds of all chunks; ``embed`` gets a few segments at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset, samples in zip(b.column("path").to_pylist(), b.column("offset_seconds").to_pylist(), b.column("samples").to_pylist()):
                rows, times = cut_segments(np.frombuffer(samples, np.float32), RATE, offset)
                for at in range(0, len(rows), BATCH):
                    found = np.asarray(embed(rows[at : at + BATCH]), np.float32)
                    if found.shape != (len(rows[at : at + BATCH]), width):
                        raise ValueError(f"embeddings have shape {found.shape}, not (n, {width})")
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(times[at : at + BATCH].astype(float)), pa.array(list(found), pa.list_(pa.float32()))], ["path", "timestamp_seconds", "embedding"])

    return chunks.select("path", "offset_seconds", "samples").mapInArrow(run, "path string, timestamp_seconds double, embedding array<float>")


def numbered(rows: DataFrame, parts: int = 256) -> DataFrame:
    """Add ``pos``, from 0, to rows (k, o, v): the place in the order of (o, v) within k, nulls first.

    The rows of a key are numbered in up to ``parts`` ranges of ``o`` apart; one row a range is added up in one place.
    """
    cuts = sorted(set(rows.select(F.col("o").cast("double").alias("o")).approxQuantile("o", [i / parts for i in range(1, parts)], 0.25 / parts)))
    if cuts:
        ends = Bucketizer(splits=[-float("inf"), *cuts, float("inf")] if cuts[0] > -float("inf") else [*cuts, float("inf")], inputCol="__o", outputCol="__part")
        placed = ends.transform(rows.withColumn("__o", F.coalesce(F.col("o").cast("double"), F.lit(float("-inf"))))).withColumn("part", F.col("__part").cast("int")).drop("__o", "__part")
    else:
        placed = rows.withColumn("part", F.lit(0))
    sizes = placed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("k").alias("sk"), F.col("part").alias("sp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("k", "part").orderBy(F.col("o").asc_nulls_first(), F.col("v").asc_nulls_first()))
    joined = placed.withColumn("i", inside).join(starts, F.col("k").eqNullSafe(F.col("sk")) & (F.col("part") == F.col("sp")))
    return joined.select("k", "o", "v", (F.col("start") + F.col("i") - 1).alias("pos"))


def wavs_from_values(rows: DataFrame, key: str, order: str, value: str, samples_per_value: int = 400, block_seconds: int = 2 * CHUNK_SECONDS) -> DataFrame:
    """WAVs for each key, its tones set by the values in ``order``: (path, content, offset_seconds).

    A recording comes as WAVs of ``block_seconds`` (the last may be shorter) that follow one another without a
    break, so a task holds one block, however long the recording. Chunks that divide ``block_seconds`` are those of
    the whole recording.
    """
    per_block, left = divmod(block_seconds * RATE, samples_per_value)
    if left:
        raise ValueError(f"{samples_per_value} samples a value do not divide {block_seconds} seconds")

    def wav(k: str | None, block: int, phase: float, values: list[float]) -> pa.RecordBatch:
        pitch = np.repeat([200 + x % 3000 for x in values], samples_per_value)
        x = np.sin(2 * np.pi * (phase * samples_per_value + np.cumsum(pitch)) / RATE)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
            w.writeframes((x * 20000).astype("<i2").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([f"{k}.wav"]), pa.array([out.getvalue()]), pa.array([float(block * block_seconds)])], ["path", "content", "offset_seconds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, block and place."""
        at, values = None, []
        for b in batches:
            for k, block, phase, v in zip(*[b.column(c).to_pylist() for c in ("k", "block", "phase", "v")]):
                if at is None or at[:2] != (k, block):
                    if at is not None:
                        yield wav(*at, values)
                    at, values = (k, block, phase), []
                values.append(v or 0)
        if at is not None:
            yield wav(*at, values)

    placed = numbered(rows.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(value).alias("v")))
    placed = placed.withColumn("block", F.floor(F.col("pos") / per_block))
    pitches = placed.groupBy("k", "block").agg(F.sum(200 + F.pmod(F.coalesce(F.col("v"), F.lit(0)), F.lit(3000))).cast("double").alias("s"))
    before = W.partitionBy("k").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    phases = pitches.select(F.col("k").alias("pk"), F.col("block").alias("pb"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("phase"))
    whole = placed.join(phases, F.col("k").eqNullSafe(F.col("pk")) & (F.col("block") == F.col("pb"))).select("k", "block", "phase", "pos", "v")
    return whole.repartition("k", "block").sortWithinPartitions("k", "block", "pos").mapInArrow(run, "path string, content binary, offset_seconds double")
