"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import os
import random

import pytest

import corpus_pipeline
from tessella.llm import near_dedup

SF = "/root/testdata/sf0.01"


def grams(text, size=5):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def kept(rows, least=0.8):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) * 10 >= 8 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {find(i) for i in ids}


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())


def test_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "one", "One", "a b c d e", "a b c d e f"]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(8, 250))
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    line = " ".join(rng.choices(vocabulary, k=30))
    texts += [line + " " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(60)]
    big = rng.choices(vocabulary, k=120)
    for _ in range(80):  # one large group of near copies
        copy = list(big)
        copy[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += texts[10:20]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert stage(spark, rows) == sorted(kept(rows))
    assert stage(spark, []) == []
    one, two = line, " ".join(rng.choices(vocabulary, k=30))
    of = lambda rows: sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, d string, __x int"), "").collect()), key=str)
    assert of([(4, one, "", 1), (None, one, "", 1), (2, one, "", 1), (2, one, "", 1)]) == [(2, one, "", 1)]
    assert of([(1, one, "", 1), (2, two, "", 1), (2, one, "", 1)]) == [(1, one, "", 1), (2, two, "", 1)]
    assert of([(None, one, "", 1), (None, two, "", 1), (None, one, "", 1)]) == sorted([(None, one, "", 1), (None, two, "", 1)], key=str)


def test_units_of_many_rows(spark):
    """Small tiles, so that a group is spread over units of work, and rows come as visitors."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(90), rng.randint(0, 6)):
            copy[at] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in near_dedup.one_of_each(docs, tile_rows=7, tile_grams=600).collect()) == sorted(kept(rows))


def test_recall_by_size(spark):
    """Pairs of sets of about ``n`` shingles with a similarity of just 0.8 or more: of 100 a size, one may be missed."""
    rng, rows, bands = random.Random(4), [], [1, 2, 4, 5, 6, 7, 9, 10, 18, 40, 64, 100, 128, 130, 160, 300, 1000]
    for band, n in enumerate(bands):
        for i in range(100):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            at = 10_000 * band + 2 * i
            rows += [(at, " ".join(words)), (at + 1, " ".join(words[: len(words) - n // 5]))]  # n - n // 5 of n shingles are shared
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = [r["doc_id"] // 10_000 for r in near_dedup.one_of_each(docs).select("doc_id").collect()]
    for band, n in enumerate(bands):
        found = 200 - left.count(band)
        print(f"about {n} shingles: {found} of 100 pairs found")
        assert found >= 99 and (n > near_dedup.SMALL_SET or found == 100)


def test_nine_and_ten_words(spark):
    rng = random.Random(77)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(10)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:9]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.one_of_each(docs).collect()) == list(range(0, 600, 2))


def test_parities():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, (k, 2)).astype(np.uint64) for k in rng.integers(0, 40, 3))
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        p = near_dedup.parities(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        assert np.bitwise_count(p[0] ^ p[1]).sum() <= len(a) + len(b)


def test_documents_without_an_id_link(spark):
    base = [f"w{i}" for i in range(400)]

    def within(text, other):
        return bin(near_dedup.fingerprint(text) ^ near_dedup.fingerprint(other)).count("1")

    rng, first = random.Random(1), " ".join(base)
    chain = [first]
    while len(chain) < 3:  # each two bits from the one before, the ends further apart
        copy = chain[-1].split()
        copy[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        text = " ".join(copy)
        if 1 <= within(text, chain[-1]) <= 2 and (len(chain) < 2 or within(text, chain[0]) > 2):
            chain.append(text)
    far = " ".join(f"y{i}" for i in range(50))
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (None, far), (None, far)]
    got = near_dedup.near_duplicate_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (1, 1), (3, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert stage(spark, rows) == sorted(kept(rows))
