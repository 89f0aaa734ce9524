"""Texts longer than one block of a pass, null ids and repeated rows; the language model against plain loops."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import common, language_id, packing, substring_dedup, suffix_dedup, token_store
from tessella.llm.queries import tokenizer

RNG = random.Random(41)


def words(n):
    return " ".join(RNG.choices("abcdefghijklmnop", k=1)[0] + str(RNG.randrange(10**6)) for _ in range(n))


def long_texts():
    passage = words(300)
    parts = []
    for _ in range(12):  # a passage that recurs on both sides of block ends
        parts += [words(9_000), passage]
    long = " ".join(parts)
    assert len(long) > 1.5 * common.BLOCK_BYTES
    return [long, words(50) + " " + passage + " " + words(50), "é" * 300_000, words(80), None, ""]


@pytest.fixture(scope="module")
def long(spark):
    texts = long_texts()
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def covered(count, items, length):
    gone = bytearray(len(items))
    for i in range(len(items) - length + 1):
        if count(i):
            gone[i : i + length] = b"\1" * length
    return gone


def test_long_suffix_dedup(long):
    texts, df = long
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(hash(t[i : i + 400]) for t in data for i in range(len(t) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.removal_report(df).collect()}
    for d, t in enumerate(data):
        gone = covered(lambda i: seen[hash(t[i : i + 400])] > 1, t, 400)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = len([p for p in bytes(gone).split(b"\0") if p])
        assert tuple(got[d])[1:5] == (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()), d
    assert got[0]["n_removed"] > 12 * 1000 and got[2]["n_removed"] == 600_000 and got[3]["n_removed"] == 0


def test_long_substring_dedup(long):
    texts, df = long
    got, seen = {r["doc_id"]: r for r in substring_dedup.removal_report(df).collect()}, set()
    for d, t in enumerate(texts):
        w = (t or "").split()

        def repeated(i):
            window = " ".join(w[i : i + 20])
            return window in seen or seen.add(window)

        gone = covered(repeated, w, 20)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert tuple(got[d])[1:4] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), d
    assert got[0]["n_removed"] == 11 * 300 and got[1]["n_removed"] == 300


def test_long_token_store(long):
    texts, df = long
    encode = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got, start = {r["doc_id"]: r for r in token_store.store_report(df, tokenizer("byte_bpe_50k.json")).collect()}, 0
    for d, t in enumerate(texts):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), d
        start += len(ids)


def test_long_packing(long):
    texts, df = long
    encode, pieces, rows = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), collections.defaultdict(list), packing.pack(df, tokenizer("word_bpe_49k.json")).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for d, t in enumerate(texts):
        ids, at = [*encode.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids), d


def test_null_ids_and_repeated_rows(spark):
    """Repeated rows are documents of their own; a null id comes first in the order of ids."""
    text = words(60)
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, words(60))], "doc_id long, text string")
    removed = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_removed"]) for r in substring_dedup.removal_report(df).collect())
    assert removed == [(-1, 0), (1, 60), (1, 60), (2, 0)]
    data = text.encode()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in suffix_dedup.removal_report(df).collect()) == [(-1, len(data)), (1, len(data)), (1, len(data)), (2, 0)]


def test_ftrl_against_plain_loops(monkeypatch):
    monkeypatch.setattr(language_id, "FEATURES", 12)
    rng, classes, settings = np.random.default_rng(2), 3, dict(alpha=0.7, beta=0.5, l1=0.02, l2=0.1, epochs=2, batch=4)
    rows, labels = [], rng.integers(0, classes, 10)
    for _ in range(10):
        at = np.sort(rng.choice(12, 4, replace=False))
        rows.append((at, rng.integers(1, 5, 4)))
    idf = rng.uniform(0.5, 2, 12).astype(np.float32)
    got = language_id.ftrl(rows, labels, idf, classes, **settings)

    z, n = [[0.0] * classes for _ in range(12)], [[0.0] * classes for _ in range(12)]

    def weight(f, c):
        if abs(z[f][c]) <= settings["l1"]:
            return 0.0
        return -(z[f][c] - math.copysign(settings["l1"], z[f][c])) / ((settings["beta"] + math.sqrt(n[f][c])) / settings["alpha"] + settings["l2"])

    deal = np.random.default_rng(5)
    for _ in range(settings["epochs"]):
        order = deal.permutation(10)
        for begin in range(0, 10, settings["batch"]):
            pick = order[begin : begin + settings["batch"]]
            w = [[weight(f, c) for c in range(classes)] for f in range(12)]
            g = [[0.0] * classes for _ in range(12)]
            for i in pick:
                x = {int(f): math.log1p(k) * float(idf[f]) for f, k in zip(*rows[i])}
                size = math.sqrt(sum(v * v for v in x.values()))
                x = {f: v / size for f, v in x.items()}
                e = [math.exp(sum(v * w[f][c] for f, v in x.items())) for c in range(classes)]
                for c in range(classes):
                    for f, v in x.items():
                        g[f][c] += v * (e[c] / sum(e) - (c == labels[i])) / len(pick)
            for f in range(12):
                for c in range(classes):
                    step = (math.sqrt(n[f][c] + g[f][c] ** 2) - math.sqrt(n[f][c])) / settings["alpha"]
                    z[f][c] += g[f][c] - step * w[f][c]
                    n[f][c] += g[f][c] ** 2
    want = np.array([[weight(f, c) for c in range(classes)] for f in range(12)])
    assert np.allclose(got, want, atol=1e-5) and (want == 0).any() and (want != 0).any()


def test_temperature_against_a_grid():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 4, 400)
    logits = rng.normal(size=(400, 4)) * 6
    logits[np.arange(400), labels] += 4

    def loss(t):
        e = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return -np.log(e[np.arange(400), labels] / e.sum(axis=1)).mean()

    grid = np.exp(np.linspace(np.log(0.25), 3, 4000))
    assert abs(math.log(language_id.best_temperature(logits, labels)) - math.log(min(grid, key=loss))) < 0.01
