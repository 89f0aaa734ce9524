"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 letters or gaps, in lower case) as TF-IDF: log(1 + count) times
the inverse document frequency, scaled to length one. The weights are trained by follow-the-regularised-leader
(FTRL-proximal) with elastic-net penalties, then the scores are calibrated with one temperature.

Document frequencies are counted over all training documents. The regression is fitted on a bounded sample:
about ``per_language`` documents of each language, picked by a hash of their ids (documented parameter), a
fifth of them kept back for the temperature. Predictions read whole texts of all documents.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn
from; a null lang is not learned from; a null id is hashed as the text "null"; repeated rows get a prediction
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BLOCK_BYTES, small_batches

FEATURES, ORDERS = 8192, (1, 2, 3)
PER_LANGUAGE = 1500
UNKNOWN = "und"
#: Texts whose counts are held at once; each takes FEATURES numbers.
BLOCK_ROWS = 128
_SPACE = 32
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row a text, and how many letters each text has."""
    parts = [" " + (t or "").lower() + " " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = _letters()[points]
    points = np.where(letter, points, _SPACE).astype(np.uint64)
    held = np.bincount(doc[letter], minlength=len(parts))
    keep = letter | np.concatenate([[True], letter[:-1]])  # a run of gaps counts once
    points, doc, letter = points[keep], doc[keep], letter[keep]
    found = []
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ points[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        good = doc[:m] == doc[n - 1 :]
        if n == 1:
            good &= letter
        found.append((doc[:m] * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64))[good])
    all_found = np.concatenate(found) if found else np.empty(0, np.int64)
    return np.bincount(all_found, minlength=len(parts) * FEATURES).reshape(len(parts), FEATURES), held


def _scaled(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf).astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        tf, held = counts(texts)
        p = _softmax(_scaled(tf, self.idf) @ self.weights / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[i] if h else UNKNOWN for i, h in zip(best, held)]
        return names, np.where(held > 0, p.max(axis=1), 0.0).astype(float)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, classes: int, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 6, batch: int = 16) -> np.ndarray:
    """Weights (features x classes) by FTRL-proximal over sparse rows (feature, count), in mini-batches."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights() -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            tf = np.zeros((len(pick), FEATURES), np.float32)
            for r, i in enumerate(pick):
                tf[r, rows[i][0]] = rows[i][1]
            x, w = _scaled(tf, idf), weights()
            error = _softmax(x @ w)
            error[np.arange(len(pick)), labels[pick]] -= 1
            g = x.T @ error / len(pick)
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / alpha
            z, n = z + g - sigma * w, n + g * g
    return weights()


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(u: float) -> float:
        return -np.log(np.maximum(_softmax(logits / np.exp(u))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = np.log(0.25), 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 11) -> Model:
    """A model from the documents that are not held out and have a lang."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(FEATURES, np.float32), np.zeros((FEATURES, 0)), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES, np.int64)
        for b in small_batches(batches, rows=BLOCK_ROWS):
            total += (counts(b.column("text").to_pylist())[0] > 0).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["feature", "df"])

    df = known.select("text").mapInArrow(frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()  # FEATURES rows at most
    idf = np.full(FEATURES, 0.0)
    for r in df:
        idf[r["feature"]] = r["df"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + idf)) + 1).astype(np.float32)

    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / sizes[lang]))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(place < share).limit(2 * per_language * len(languages))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, rows=BLOCK_ROWS):
            tf, _ = counts(b.column("text").to_pylist())
            at = [np.flatnonzero(row) for row in tf]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), pa.array([a.astype("<u2").tobytes() for a in at]), pa.array([row[a].astype("<f4").tobytes() for a, row in zip(at, tf)])],
                ["doc_id", "lang", "at", "tf"],
            )

    # 2 * per_language rows a language at most, of some kilobytes each
    got = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(sparse, "doc_id long, lang string, at binary, tf binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"]))
    rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["tf"], "<f4")) for r in got]
    labels = np.array([languages.index(r["lang"]) for r in got], np.int64)
    fit = np.arange(len(rows)) % 5 != 0 if len(rows) >= 20 else np.ones(len(rows), bool)
    weights = ftrl([r for r, f in zip(rows, fit) if f], labels[fit], idf, len(languages)) if len(rows) else np.zeros((FEATURES, len(languages)))
    temperature = 1.0
    if not fit.all():
        logits = []
        for (at, tf) in (r for r, f in zip(rows, fit) if not f):
            x = np.zeros((1, FEATURES), np.float32)
            x[0, at] = tf
            logits.append((_scaled(x, idf) @ weights)[0])
        temperature = best_temperature(np.array(logits), labels[~fit])
    return Model(languages, idf, weights.astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added; from the text alone."""
    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores, at = [], [], 0
        values = [t if isinstance(t, str) else None for t in texts]
        while at < len(values):
            end, size = at, 0
            while end < min(len(values), at + BLOCK_ROWS) and (end == at or size + len(values[end] or "") <= BLOCK_BYTES):
                size, end = size + len(values[end] or ""), end + 1
            n, s = model.predict(values[at:end])
            names, scores, at = names + n, [*scores, *s], end
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("__guess", guess("text"))


def language_report(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    model = train(docs, per_language)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__guess.lang_pred", "__guess.score")


def keep_identified(docs: DataFrame, least: float = 0.0, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents whose language is found with a score of ``least`` or more; ``und`` ones go."""
    found = predict(docs, train(docs, per_language))
    return found.where((F.col("__guess.lang_pred") != UNKNOWN) & (F.col("__guess.score") >= least)).drop("__guess")
