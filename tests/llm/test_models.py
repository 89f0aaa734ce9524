"""Whitening, toxicity and centroid clustering against plain versions, over awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tessella.llm import centroids, toxicity, whitening

INF, NAN = float("inf"), float("nan")


def vectors(width, n, seed=4):
    rng = np.random.default_rng(seed)
    made = (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) / width).astype(np.float32).tolist()
    hot = made[0]
    bad = [None, [], [0.5] * (width - 1) + [None], [NAN] * width, [0.1] * (width - 1) + [-INF], [0.25] * (width + 1)]
    return made + [list(hot)] * (n // 2) + bad  # a third of the rows is one vector


def table(spark, rows):
    ids = [*range(len(rows))]
    ids[3], ids[5] = 4, None  # a repeated id, and none
    return spark.createDataFrame([(i, v, 0, [1], "r") for i, v in zip(ids, rows)], "vec_id long, embedding array<float>, label int, x array<int>, cluster string").repartition(7), list(zip(ids, rows))


def plain(v, width):
    return v is not None and (width is None or len(v) == width) and all(c is not None and math.isfinite(c) for c in v)


# ---------------------------------------------------------------- whitening

@pytest.mark.parametrize("slab", [whitening.SLAB, 3])
def test_whitening(spark, monkeypatch, slab):
    monkeypatch.setattr(whitening, "SLAB", slab)
    df, rows = table(spark, vectors(20, 60))
    got = whitening.whitening_report(df, block_bytes=20 * 8 * 7).collect()
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if plain(v, None) and v]
    expected = collections.Counter()
    for width in {len(x) for _, x in good}:
        mine = [(i, x) for i, x in good if len(x) == width]
        fit = sorted({tuple(x) for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        values, axes = np.linalg.eigh(np.cov(np.array(fit, float).T - 1e6, bias=True))
        values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
        for i, x in mine:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            for k, e in enumerate(values):
                real = e > 1e-9
                along = round(abs((np.array(x) - 1e6 - (np.array(sums) / n - 1e6)) @ axes[:, k]) / math.sqrt(e), 5) if real else None
                expected[i, k + 1, n, deviation, along, round(e / max(values.sum(), 1e-9), 2) if width != 20 else None] += 1
    found = collections.Counter((r["vec_id"], r["component"], r["n"], r["deviation"], None if r["whitened"] is None else round(abs(r["whitened"]), 5), None if r["n"] > 1 else round(r["explained"], 2)) for r in got)
    assert found == expected
    assert all(r["identity_error"] <= 1e-9 for r in got)
    wide = [r for r in got if r["n"] > 1]
    signs = collections.defaultdict(set)
    for r in wide:  # equal vectors fall on equal places, sign included
        signs[r["deviation"], r["component"]].add(round(r["whitened"], 6))
    assert max(map(len, signs.values())) == 1
    assert abs(sum({r["component"]: r["explained"] for r in wide}.values())) <= 1


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whitening_report(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitening_report(spark.createDataFrame([(1, None), (2, []), (3, [None])], kind)).count() == 0
    one = whitening.whitening_report(spark.createDataFrame([(1, [0.5, 0.25])] * 3, kind)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 6
    far = whitening.whitening_report(spark.createDataFrame([(1, [3e38, 0.0]), (2, [0.0, 1.0])], kind)).collect()
    assert {r["deviation"] for r in far} == {None}  # exact, but no long


def test_whitening_matrix():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)) * [5, 4, 3, 2, 1, 0]
    x -= x.mean(axis=0)
    by, values, shares = whitening.whitening_matrix(x.T @ x / 500, 6)
    assert (values[:5] > 0).all() and values[5] == 0 and not by[:, 5].any()
    assert np.allclose((x @ by).T @ (x @ by) / 500, np.diag([1, 1, 1, 1, 1, 0]))
    assert np.isclose(shares.sum(), 1)


# ---------------------------------------------------------------- centroids

def brute_clusters(rows, k, rounds, width):
    good = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(64 * c))) for c in v]) for i, v in rows if plain(v, width)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in good if i is not None)
    centres = [x for _, x in named[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def nearest(x):
        return min(range(len(centres)), key=lambda j: (far(x, centres[j]), j))

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, x in good:
            groups[nearest(x)].append(x)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else old for j, old in enumerate(centres)]
    found = [(i, nearest(x), far(x, centres[nearest(x)])) for i, x in good] if centres else []
    sums = collections.Counter()
    for _, j, d in found:
        sums[j] += d
    return collections.Counter((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize("k, rounds", [(5, 3), (16, 1), (200, 2), (3, 12)])
def test_centroids(spark, k, rounds):
    df, rows = table(spark, vectors(8, 50, seed=k) + [[1e9] * 8])
    got = collections.Counter(tuple(r) for r in centroids.clustering_report(df, k, rounds, 8).collect())
    assert got == brute_clusters(rows, k, rounds, 8)


def test_centroids_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    assert centroids.clustering_report(spark.createDataFrame([], kind)).count() == 0
    assert centroids.clustering_report(spark.createDataFrame([(None, [1.0] * 64), (2, [1.0])], kind)).count() == 0
    three = centroids.clustering_report(spark.createDataFrame([(7, [float(i)] * 64) for i in range(3)], kind)).collect()
    assert len(three) == 3 and {r["distance"] for r in three} == {0}  # one id, three vectors


def test_dot_products_stay_exact(spark):
    df, rows = table(spark, vectors(8, 40))
    held, centres = centroids.cluster(df, 6, 4, 8)
    for r in held.collect():
        assert r["dots"] == [sum(a * b for a, b in zip(r["x"], c)) for c in centres.tolist()]


# ---------------------------------------------------------------- toxicity

def characters(text):
    out = " "
    for c in (text or "").lower() + " ":
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return out


def plain_model(texts):
    """Log ratio of a run of four characters, from (text, toxic) pairs, with dictionaries."""
    cut = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    counts = [collections.Counter(g for t, c in texts if c == side for g in cut(characters(t), 4)) for side in (0, 1)]
    types = set(counts[0]) | set(counts[1])

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5

    levels, known = [], types
    for _ in range(3):
        levels.append(collections.Counter(g[1:] for g in known))
        known = set(levels[-1])
    lower = {"": 1 / (len(levels[-1]) + 1)}
    for level in levels[::-1]:
        d, total, kinds = discount(level.values()), collections.Counter(), collections.Counter()
        for g, v in level.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        lower = {g: (max(v - d, 0) + d * kinds[g[:-1]] * lower[g[1:]]) / total[g[:-1]] for g, v in level.items()}
    d = [discount(c.values()) for c in counts]

    def ratio(g):
        p = []
        for side in (0, 1):
            n = sum(v for x, v in counts[side].items() if x[:3] == g[:3])
            kinds = sum(x[:3] == g[:3] for x in counts[side])
            shared = lower.get(g[1:], 1e-9)
            p.append(max(counts[side][g] - d[side], 0) / n + d[side] * kinds / n * shared if n else shared)
        return math.log(p[1] / p[0])

    return lambda t: sum(map(ratio, cut(characters(t), 4))) / max(1, len(cut(characters(t), 4)))


@pytest.fixture(scope="module")
def forum(spark):
    rng = random.Random(12)
    say = ["the", "grey", "harbour", "opens", "étude", "late", "märz", "we", "walk"]
    rows, marks = [], []
    for i in range(160):
        bad = i % 4 == 0
        words = [rng.choice(say) for _ in range(rng.randint(3, 40))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vermin!", "SCOUNDREL", "Oaf"])
        rows.append((i, " ".join(words)))
        if i % 3 or bad:
            marks.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "12 -- 34"), (None, "you vermin"), (0, "grey harbour"), (0, "grey harbour"), (903, "the harbour opens. " * 3000), (904, "Ω≈ ж"), (905, "ab")]
    marks += [(4, 0), (4, 1), (None, 1), (7, None), (5000, 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", "b", 1) for i, t in rows], "doc_id long, text string, lang string, source string, block string, key int").repartition(6)
    return docs, spark.createDataFrame([(i, 0, m) for i, m in marks], "doc_id long, quality int, toxic int"), rows, marks


@pytest.mark.parametrize("block", [600, toxicity.BLOCK_BYTES])
def test_log_ratios(spark, forum, block):
    docs, labels, rows, marks = forum
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    toxic = {}
    for i, m in marks:
        if i is not None and m is not None:
            toxic[i] = max(m, toxic.get(i, 0))
    ratio = plain_model([(t, toxic[i]) for i, t in rows if i in toxic and fold(i) not in (0, 1)])
    scored, _, classes = toxicity.mean_log_ratios(docs, labels, block)
    assert classes == [0, 1]
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), round(r["mean"], 8)) for r in scored.collect())
    assert got == sorted(((-1 if i is None else i), round(ratio(t), 8)) for i, t in rows)


def test_toxicity(spark, forum):
    docs, labels, rows, marks = forum
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"null") % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 160]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) >= 0.9
    again = sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.toxicity_report(docs, labels, 900).collect())
    assert np.allclose([s for _, s in again], [s for _, s in sorted((r["doc_id"] or -1, r["score"]) for r in got)])


def test_toxicity_of_little(spark, forum):
    docs, labels = forum[0], forum[1]
    assert toxicity.toxicity_report(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_report(docs, labels.where("false")).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity_report(docs, labels.where("toxic = 1")).collect()} == {1.0}
