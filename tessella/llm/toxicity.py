"""Toxicity by two Kneser-Ney models of four characters, one of toxic and one of ordinary texts.

A text is read as lower-case letters with one gap between words. Its score rests on the mean, over its runs of four
characters, of the log-likelihood under the toxic model less that under the ordinary one. Counts of runs are a class's
own; below them both models share one chain of continuation counts (three, two, one character) from all learned texts,
so that a run that one class has not seen is smoothed alike in both. The mean is turned into a probability by a
logistic regression fitted on learned documents that the counts did not use.

Nothing of the model is sent whole to a task: texts are written once, bucketed by blocks of a few megabytes; a block
asks the model for its distinct runs by a join, and meets the answers in one group of bounded size. Counts, continuation
counts and questions cover all rows and grow with them. Runs are told apart by 64-bit hashes when asked for.

Learned from: labels with a toxic value, of documents that are not held out (crc32 of the id modulo 5 is 0); remainder
1 is for the regression, the rest for the counts.

Defined results: a null or empty text, or one without letters, has a mean of 0; several labels of a document count as
toxic if one is; a null id is hashed as the text "null" and has no label; repeated rows get a score each and count
each; if only one class was learned all scores are 1 (toxic) or 0; if the regression's share has one class alone, its
slope is ``SLOPE`` and its intercept 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import discard, materialise, new_path, small_batches
from tessella.llm.language_id import _SPACE, _letters

ORDER = 4
#: Bytes of text of a block: one task holds one block (or one longer text) with its distinct runs.
BLOCK_BYTES = 8 << 20
FOLDS, HELD, TUNED = 5, 0, 1
SLOPE = 40.0


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points that are read, texts one after the other, and the text of each."""
    parts = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = _letters()[points]
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, bool)
    keep = letter | first | np.concatenate([[True], letter[:-1]])[: len(letter)]  # a row of gaps counts once
    return np.where(letter, points, _SPACE).astype(np.uint32)[keep], doc[keep]


def runs(points: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of ``n`` characters inside a text, and where it starts."""
    m = max(0, len(points) - n + 1)
    h, wide = np.full(m, n, np.uint64), points.astype(np.uint64)
    for i in range(n):
        h = (h ^ wide[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :][:m])
    return h[at].view(np.int64), at


def fold(key: Column) -> Column:
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % FOLDS).cast("int")


def _held(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, str, str]:
    """(block, doc_id, text) as a table bucketed by block, its name and its folder. No row moves: a task writes its own blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 24, 0
        for b in small_batches(batches, most=block_bytes // 8):
            size = pa.compute.sum(pa.compute.binary_length(b.column("text"))).as_py() or 0
            if held and held + size > block_bytes:
                at, held = at + 1, 0
            held += size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, at)), b.column("doc_id"), b.column("text")], ["block", "doc_id", "text"])

    spark, name, path = docs.sparkSession, f"texts_{uuid.uuid4().hex}", new_path(docs.sparkSession, "texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, "block long, doc_id long, text string").write.option("path", path).option("compression", "zstd").bucketBy(n, "block").saveAsTable(name)
    return spark.table(name), name, path


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, fold) of the documents that may be learned from."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one.withColumn("fold", fold(F.col("doc_id"))).where(F.col("fold") != HELD)


def run_counts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(gram, c0, c1): how often ordinary and toxic texts have each run."""
    mine = texts.select("block", "doc_id").distinct().join(labels.where(F.col("fold") != TUNED).select("doc_id", "toxic"), "doc_id").select(F.col("block").alias("of"), F.col("doc_id").alias("id"), "toxic")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        classes = np.array([], np.int32)
        if right.num_rows:
            ids, marks = right.column("id").to_numpy(), right.column("toxic").to_numpy()
            order = np.argsort(ids)
            chosen = left.filter(pa.compute.is_in(left.column("doc_id"), right.column("id")))
            for b in small_batches(chosen.to_batches()):
                classes = marks[order][np.searchsorted(ids[order], b.column("doc_id").to_numpy())]
                points, doc = characters(b.column("text").to_pylist())
                hashes, at = runs(points, doc, ORDER)
                for c in (0, 1):
                    some = at[classes[doc[at]] == c]
                    keys, first, times = np.unique(hashes[classes[doc[at]] == c], return_index=True, return_counts=True)
                    grams = np.ascontiguousarray(points[some[first][:, None] + np.arange(ORDER)]).view(f"<U{ORDER}").ravel()
                    found.append((grams, np.where(c == 0, times, 0), np.where(c == 1, times, 0)))
        if not found:
            return pa.table({"gram": pa.array([], pa.string()), "c0": pa.array([], pa.int64()), "c1": pa.array([], pa.int64())})
        grams, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([f[i] for f in found]), len(grams)).astype(np.int64) for i in (1, 2)]
        return pa.table({"gram": pa.array(grams.tolist(), pa.string()), "c0": sums[0], "c1": sums[1]})

    parts = texts.groupBy("block").cogroup(mine.groupBy("of")).applyInArrow(count, "gram string, c0 long, c1 long")
    return parts.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _discount(df: DataFrame, column: str) -> float:
    """Kneser-Ney's discount from the numbers of ones and twos."""
    r = df.agg(F.count_if(F.col(column) == 1).alias("one"), F.count_if(F.col(column) == 2).alias("two")).first()
    return min(0.95, max(0.1, r["one"] / (r["one"] + 2 * r["two"]))) if r["one"] else 0.5


def _tail(column: str, n: int) -> Column:
    return F.substring(column, 2, n - 1)


def shared_backoff(counts: DataFrame) -> DataFrame:
    """(gram, p): the probability of the last of three characters after the first two, by shared continuation counts."""
    levels = [counts.groupBy(_tail("gram", ORDER).alias("gram")).agg(F.count(F.lit(1)).alias("k"))]
    for n in range(ORDER - 1, 1, -1):
        levels.append(levels[-1].groupBy(_tail("gram", n).alias("gram")).agg(F.count(F.lit(1)).alias("k")))
    total = levels[-1].agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("v")).first()
    d = _discount(levels[-1], "k")
    lower = levels[-1].select("gram", ((F.greatest(F.col("k") - d, F.lit(0.0)) + d * total["v"] / (total["v"] + 1)) / total["k"]).alias("p"))
    for n, level in zip(range(2, ORDER), levels[-2::-1]):
        d = _discount(level, "k")
        same = W.partitionBy(F.substring("gram", 1, n - 1))
        level = level.withColumn("all", F.sum("k").over(same)).withColumn("types", F.count(F.lit(1)).over(same)).withColumn("tail", _tail("gram", n))
        below = lower.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
        lower = level.join(below, "tail").select("gram", ((F.greatest(F.col("k") - d, F.lit(0.0)) + d * F.col("types") * F.col("below")) / F.col("all")).alias("p"))
    return lower


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, value): the log ratio of runs of three characters as histories, and what a seen run of four adds to it."""
    d = [_discount(counts, "c0"), _discount(counts, "c1")]
    with_history = counts.withColumn("history", F.substring("gram", 1, ORDER - 1)).withColumn("tail", _tail("gram", ORDER))
    history = with_history.groupBy("history").agg(*[f(F.col(f"c{c}")).alias(f"{n}{c}") for c in (0, 1) for n, f in (("n", F.sum), ("t", lambda x: F.count_if(x > 0)))])
    share = [F.when(F.col(f"n{c}") > 0, d[c] * F.col(f"t{c}") / F.col(f"n{c}")).otherwise(1.0) for c in (0, 1)]
    history = history.withColumn("base", F.log(share[1]) - F.log(share[0])).withColumn("w0", share[0]).withColumn("w1", share[1])
    p = [F.coalesce(F.greatest(F.col(f"c{c}") - d[c], F.lit(0.0)) / F.nullif(F.col(f"n{c}"), F.lit(0)), F.lit(0.0)) + F.col(f"w{c}") * F.col("p") for c in (0, 1)]
    seen = with_history.join(history, "history").join(shared_backoff(counts).withColumnRenamed("gram", "tail"), "tail")
    return seen.select("gram", (F.log(p[1]) - F.log(p[0]) - F.col("base")).alias("value")).union(history.select(F.col("history").alias("gram"), F.col("base").alias("value")))


def _keyed(model: DataFrame) -> DataFrame:
    """(key, value): the model under the hashes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("gram").to_pylist()
            keys = np.zeros(len(grams), np.int64)
            for n in (ORDER - 1, ORDER):
                at = np.array([i for i, g in enumerate(grams) if len(g) == n], np.int64)
                points = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), np.uint32)
                keys[at] = runs(points, np.repeat(at, n), n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("value")], ["key", "value"])

    return model.mapInArrow(run, "key long, value double")


def log_ratios(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, n, total): a text's runs and the sum of their log ratios."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def rows() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], ["block", "key"])

        for batch in batches:
            numbers = batch.column("block").to_numpy()
            for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                if not len(part):
                    continue
                if held and numbers[part[0]] != block:
                    yield rows()
                    held = []
                block = numbers[part[0]]
                for b in small_batches([batch.slice(part[0], len(part))]):
                    points, doc = characters(b.column("text").to_pylist())
                    held += [np.unique(runs(points, doc, n)[0]) for n in (ORDER - 1, ORDER)]
                    if len(held) > 32:
                        held = [np.unique(np.concatenate(held))]
        if held:
            yield rows()

    answers = texts.select("block", "text").mapInArrow(ask, "block long, key long").join(_keyed(model), "key").select(F.col("block").alias("of"), "key", "value")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, first = np.unique(right.column("key").to_numpy(), return_index=True)
        values, n, total = right.column("value").to_numpy()[first], [], []
        for b in small_batches(left.to_batches()):
            points, doc = characters(b.column("text").to_pylist())
            sums = np.zeros(b.num_rows)
            for size in (ORDER - 1, ORDER):
                hashes, at = runs(points, doc, size)
                if size == ORDER - 1:  # a history is a run with a character after it
                    follows = at[at + size < len(doc)]
                    real = follows[doc[follows] == doc[follows + size]]
                    hashes, at = hashes[np.searchsorted(at, real)], real
                place = np.minimum(np.searchsorted(keys, hashes), max(0, len(keys) - 1))
                found = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
                sums += np.bincount(doc[at][found], values[place[found]], b.num_rows)
            n.append(np.bincount(doc[at], minlength=b.num_rows))
            total.append(sums)
        joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"doc_id": left.column("doc_id"), "n": joined(n, pa.int64()), "total": joined(total, pa.float64())})

    return texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(add, "doc_id long, n long, total double")


def _regression(scored: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the probability over the mean log ratio, from the fold kept for it."""
    known = labels.where(F.col("fold") == TUNED)
    rows = scored.where(fold(F.col("doc_id")) == TUNED).join(known.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")
    sides = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if sides["low"] is None or sides["low"] == sides["high"]:
        return SLOPE, 0.0
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.0, maxIter=100).fit(VectorAssembler(inputCols=["mean"], outputCol="features").transform(rows).select("features", "label"))
    return float(model.coefficients[0]), float(model.intercept)


def mean_log_ratios(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, list[int]]:
    """A written (doc_id, mean), the labels that may be learned from, and the classes among those of the counts."""
    texts, name, path = _held(docs, block_bytes)
    known = known_labels(labels)
    counts = materialise(run_counts(texts, known), "run_counts")
    sums = counts.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).first()
    classes = [c for c in (0, 1) if sums[f"c{c}"]]
    found = log_ratios(texts, ratios(counts)) if len(classes) == 2 else texts.select("doc_id", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))
    scored = materialise(found.select("doc_id", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("mean")), "log_ratios")
    discard(counts)
    discard(texts)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return scored, known, classes


def toxicity_report(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) of every row of ``docs``."""
    scored, known, classes = mean_log_ratios(docs, labels, block_bytes)
    if len(classes) < 2:
        score = F.lit(1.0 if classes == [1] else 0.0)
    else:
        slope, intercept = _regression(scored, known)
        score = 1 / (1 + F.exp(-(F.col("mean") * slope + intercept)))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"), F.col("mean").alias("log_ratio"))
