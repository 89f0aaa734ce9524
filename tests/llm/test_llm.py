"""The training-data operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import common, decontamination, encoding, fingerprint, html_text, language_id, near_dedup, packing, sharding, substring_dedup, suffix_array, suffix_dedup, token_store
from tessella.llm.queries import tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"  # two names that clash with inner ones
random.seed(7)
VOCABULARY = ["".join(random.choices("abcdefgéü", k=random.randint(2, 7))) for _ in range(300)]


def words(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def texts():
    shared, long = words(60), words(3000)
    out = [None, "", " \n\t ", "one", "a b c", words(19), words(20), shared, shared, words(30) + "\n" + shared + " " + words(40), shared + " " + words(5), long, words(25) + " " + long[2000:9000]]
    out += [words(random.randint(20, 90)) for _ in range(20)]
    near = words(200).split()
    for i in range(8):  # near copies and copies of one of them
        w = list(near)
        w[i * 7] = "x"
        out.append(" ".join(w))
    out += [out[-1]] * 5
    block = words(40)
    return [*out, block + " " + block + " " + words(3) + " " + block, "z" * 1500, "ab" * 900, "É" * 300]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", "s", len(t or ""), "k", 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---------------------------------------------------------------- helpers

def test_suffix_array():
    rng = random.Random(3)
    for _ in range(600):
        s = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(0, 25))]
        assert suffix_array.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array.suffix_array(np.zeros(3000, np.int64)).tolist() == list(range(2999, -1, -1))


def test_winnow():
    rng = np.random.default_rng(0)
    for n, width, top in ((50, 7, 4), (9, 9, 100), (5, 6, 9), (200, 1, 3), (64, 8, 2)):
        v = rng.integers(0, top, n).astype(np.uint64) << np.uint64(40)
        choice, distinct = common.winnow(v, width)
        assert choice.tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(max(0, n - width + 1))]
        assert distinct.tolist() == sorted(set(choice.tolist()))


def test_running_total(spark):
    rows = [(random.randint(0, 50), random.randint(0, 9)) for _ in range(300)] + [(None, 4)]
    got = sorted((r["s"], r["v"]) for r in common.running_total(spark.createDataFrame(rows, "k long, v long"), "k", "v", "s").collect())
    total = 0
    for s, v in got:
        assert s <= total
        total = max(total, s + v)
    assert total == sum(v for _, v in rows)


# ---------------------------------------------------------------- 1

def brute_bytes(data, length):
    count = collections.Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len([p for p in bytes(gone).split(b"\0") if p]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,size,group_bytes", [(400, 128, 2 << 20), (120, 40, 2 << 20), (120, 40, 300), (400, 128, 1000)])
def test_suffix_dedup(docs, none, length, size, group_bytes):
    got = by_id(suffix_dedup.removal_report(docs, length, size, group_bytes))
    for i, expected in enumerate(brute_bytes([(t or "").encode() for t in TEXTS], length)):
        assert tuple(got[i * 3])[1:] == expected, i
    assert suffix_dedup.removal_report(none).count() == 0


def test_segments_that_differ():
    core = bytes(random.randbytes(500))
    bodies = [b"aaa" + core + b"x" * 20, b"bbbb" + core + b"y" * 9, bytes(random.randbytes(520))]
    assert suffix_dedup.repeated_runs(bodies, [3, 4, 100], [0, 0, 0], 400) == [(0, 3, 103), (1, 4, 104)]
    assert suffix_dedup.repeated_runs(bodies, [3, 4, 100], [0, 1, 2], 400) == []


@pytest.mark.parametrize("length", [400, 120, 35, 47])
def test_repeated_runs_against_brute_force(length):
    rng = random.Random(length)
    for _ in range(60):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(length // 2, length))) for _ in range(3)]
        anchor = rng.randbytes(16)
        bodies, offs, groups = [], [], []
        for g in range(3):
            for _ in range(rng.randint(1, 5)):
                left, right = rng.choice(parts)[-rng.randint(1, length) :], rng.choice(parts)[: rng.randint(length // 2, length)]
                bodies.append(left + anchor + right + bytes(max(0, length - len(left + anchor + right))))
                offs.append(len(left))
                groups.append(g)
        # strings that hold the whole anchor; equal ones hold it at the same place
        reach = [range(max(0, o + 16 - length), min(o, len(x) - length) + 1) for x, o in zip(bodies, offs)]
        count = collections.Counter((g, x[s : s + length]) for x, r, g in zip(bodies, reach, groups) for s in r)
        expected = {(i, s) for i, (x, r, g) in enumerate(zip(bodies, reach, groups)) for s in r if count[g, x[s : s + length]] > 1}
        got = {(i, s) for i, a, b in suffix_dedup.repeated_runs(bodies, offs, groups, length) for s in range(a, b + 1)}
        assert {(i, s) for i, s in got if s in reach[i]} == expected


def thue_morse(n, a, b):
    s = [a]
    while len(s) < n:
        s += [b if x == a else a for x in s]
    return s[:n]


def test_strings_that_collide_in_polynomial_hashes(spark):
    one, two = (b"".join(thue_morse(1024, *x)) for x in ((b"a", b"b"), (b"b", b"a")))
    fill = [random.Random(i).randbytes(128).hex() for i in range(2)]
    texts = [one[:400].decode() + fill[0], two[:400].decode() + fill[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for i, expected in enumerate(brute_bytes([t.encode() for t in texts], 400)):
        assert tuple(by_id(suffix_dedup.removal_report(df))[i])[1:] == expected
    shared = [words(20), words(20)]
    texts = [f"{shared[0]} {w.decode()} {shared[1]}" for w in (one, two)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[1:3] for r in substring_dedup.removal_report(df).orderBy("doc_id").collect()] == [(41, 0), (41, 40)]


def test_one_anchor_with_many_surroundings(spark):
    """A passage in many documents, each with its own text around it: the anchor's group is split again and again."""
    rng = random.Random(5)
    passage = rng.randbytes(450).hex()
    texts = [rng.randbytes(rng.randint(0, 300)).hex() + passage[: rng.choice([380, 410, 900])] + rng.randbytes(rng.randint(0, 300)).hex() for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffix_dedup.removal_report(df, group_bytes=4000))
    for i, expected in enumerate(brute_bytes([t.encode() for t in texts], 400)):
        assert tuple(got[i])[1:] == expected, i


def test_suffix_dedup_hands_small_batches_to_python(spark):
    """An executor's memory: Python workers get texts by the megabyte, and the last step, which reads all texts, needs none."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("text"), 1500).alias("text"))
    got = [r["n"] for r in suffix_dedup.in_small_batches(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) > 18_000_000 and max(got) < 1.5 * suffix_dedup.BATCH_BYTES and spark.conf.get(name) == before
    df = spark.createDataFrame([(i, "same text " * 60) for i in range(3)], "doc_id long, text string")
    last = suffix_dedup.removals(df)
    assert "InArrow" not in last._jdf.queryExecution().toString()
    assert [tuple(r) for r in last.orderBy("doc_id").collect()] == [(i, 600, 1, b"") for i in range(3)]


def test_runs_that_touch_are_one(spark):
    spans = spark.createDataFrame([(1, 7, 0, 0), (1, 7, 4, 5), (1, 7, 4, 5), (1, 7, 1, 2), (1, 7, 20, 20), (1, 8, 3, 3), (2, 7, 1, 1)], "key long, d long, a int, b int")
    got = {(r["key"], f["d"]): (f["n_spans"], [tuple(p) for p in f["pieces"]], f["last"]) for r in suffix_dedup.removed_runs(spans, 4).collect() for f in r["found"]}
    assert got == {(1, 7): (2, [(0, 0), (9, 20)], 24), (1, 8): (1, [(0, 3)], 7), (2, 7): (1, [(0, 1)], 5)}


# ---------------------------------------------------------------- 2

def test_sharding(spark, docs, none):
    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
        return b

    extra = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.assign_shards(extra).collect()
    assert len(rows) == len(TEXTS) + 4
    for r in rows:
        if r["doc_id"] is not None:
            key = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:16], 16)
            data = (TEXTS[r["doc_id"] // 3] or "").encode()
            assert (r["shard"], r["grown_shard"], r["size"], r["text_crc32"]) == (jump(key, 8), jump(key, 9), len(data) + 1, zlib.crc32(data))
            assert r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(none).count() == 0


# ---------------------------------------------------------------- 3

def test_html_rules():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav>menu</nav><div id="cookie-notice">We use</div>
    <article><header><h1>T&amp;itle</h1></header><p>Some <b>bold</b>  text<p>two &lt;3<ul><li>a<li>b</ul><script>var x="</p>";</script><div class="ad-box">buy</div><!-- x --><form>f</form></article>
    <section class="comments"><p>c</p></section><aside>s</aside><footer>&copy;</footer>"""
    assert html_text.Page(page).text() == "T&itle\nSome bold text\ntwo <3\na\nb"
    assert html_text.Page("").text() == "" and html_text.Page("plain < text").text() == "plain < text" and html_text.Page("<p>a<!-- b").text() == "a" and html_text.Page("<p>a<div class=x").text() == "a"


def test_style_tree(spark):
    schema = "page_id long, url string, html string, host string"
    page = lambda i: f"<body><div class=teaser>Subscribe today</div><div class=story><p>{words(30)} {i}</p></div></body>"
    rows = [(i, f"http://a.org/{i}", page(i), "x") for i in range(8)] + [(90, None, None, None), (91, "http://b.org/", "<div class=teaser>Subscribe today</div>", None)]
    rows += [(100 + i, "http://c.org/", "<div class=story><p>the same page</p></div>", None) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, schema)).collect()}
    assert all("Subscribe" not in got[i] and got[i].endswith(f" {i}") for i in range(8))
    assert got[90] == "" and got[91] == "Subscribe today"  # one page tells nothing
    assert {got[100 + i] for i in range(9)} == {"the same page"}  # copies of a page are no template
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0


def test_style_tree_without_names(spark):
    """Pages of div and p alone: a menu drawn from a stock of entries and a footer go, the article stays."""
    rng, stock = random.Random(3), [f"entry {i}" for i in range(5)]

    def page(i, host):
        menu = "".join(f"<p>{host} {e}</p>" for e in rng.sample(stock, 4))
        story = "".join(f"<p>{words(12)} {host}{i}-{j}</p>" for j in range(rng.randint(1, 5)))
        return f"<body><div>{menu}</div><div><div>{story}</div></div><div>all rights of {host}</div></body>", [b.removesuffix("</p>") for b in story.split("<p>")[1:]]

    rows, want = [], {}
    for h, host in enumerate(["a.org", "b.org"]):
        for i in range(30):
            source, blocks = page(i, host)
            rows.append((h * 100 + i, f"http://{host}/{i}", source))
            want[h * 100 + i] = "\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages = pages.unionAll(pages.where("page_id = 3"))  # a repeated row gets its text again
    got = html_text.main_text(pages).collect()
    assert len(got) == 61 and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    kept = html_text.main_text(pages, least_importance=-1.0).where("page_id = 0").first()["text"]
    assert "entry" in kept and "rights" in kept  # the tree alone took them


def test_style_tree_importance(spark):
    """The importance of each node against a plain count over the pages."""
    import math

    sources = [f"<div><p>same</p><p>{i % 3}</p>{'<p>more</p>' if i % 2 else ''}</div>" for i in range(6)]
    tree = html_text.style_tree(spark.createDataFrame([("h", x) for x in sources * 2 + [None]], "host string, html string")).collect()
    texts = [["same", str(i % 3)] + ["more"] * (i % 2) for i in range(6)]
    n = collections.Counter(t for page in texts for t in page)
    content = 1 - sum(v * math.log(v) for v in n.values()) / sum(n.values()) / math.log(6)
    shape = 1 - 2 * 3 * math.log(3) / 6 / math.log(6)  # two or three paragraphs, three pages each
    assert {r["pages"] for r in tree} == {6}
    assert sorted(round(r["importance"], 9) for r in tree) == sorted(round(html_text.CONTENT_WEIGHT * content + (1 - html_text.CONTENT_WEIGHT) * s, 9) for s in (0, shape))


def test_html_long_and_repeated(spark):
    long = "<article>" + "".join(f"<p>{i} &amp; {words(8)}</p>" for i in range(20_000)) + "</article>"  # over a megabyte
    rows = [(1, "u", long), (1, "u", long), (None, None, "<p>no id</p>"), (2, "u", ""), (3, "u", "<div>" * 3000 + "deep")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
    assert len(texts[1]) == 2 and len(set(texts[1])) == 1 and texts[1][0].count("\n") == 19_999 and texts[1][0].startswith("0 & ")
    assert texts[None] == ["no id"] and texts[2] == [""] and texts[3] == ["deep"]


# ---------------------------------------------------------------- 4

def test_fingerprints(spark, docs, none):
    got = by_id(fingerprint.fingerprint_report(docs))
    for i, t in enumerate(TEXTS):
        t, n = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        q = len(t) // 4
        r = got[i * 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest())
        assert r["fingerprint"] == got[TEXTS.index(TEXTS[i]) * 3]["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprint.fingerprint_report(none).count() == 0
    assert fingerprint.fingerprint_report(docs.limit(1)).first()["near_next"] == 1
    alone = fingerprint.fingerprints(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in alone} == {k: r["fingerprint"] for k, r in got.items()}


@pytest.mark.parametrize("radius,blocks", [(3, 5), (0, 2), (8, 9)])
def test_block_tables(spark, radius, blocks):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = {f"{b ^ sum(1 << k for k in rng.sample(range(128), n)):032x}" for b in base for n in (0, 1, 3, 4, 8)}
    df = spark.createDataFrame([(p,) for p in prints] + [(next(iter(prints)),)], "fingerprint string")
    got = {(r["a"], r["b"], r["differing"]) for r in fingerprint.near_fingerprints(df, radius, blocks).collect()}
    assert got == {(a, b, d) for a in prints for b in prints if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius}
    split = {(r["a"], r["b"], r["differing"]) for r in fingerprint.near_fingerprints(df, radius, blocks, most=2).collect()}
    assert split == got
    links = collections.Counter(x for a, b, _ in got for x in (a, b))
    for most in (2, 8192):
        assert {r["fingerprint"]: r["links"] for r in fingerprint.linked_fingerprints(df, radius, blocks, most=most).collect()} == links


def test_full_bucket(spark):
    """Fingerprints that all share a table's bucket are split into parts, and no link is lost or met twice."""
    rng = random.Random(2)
    near = {f"{sum(1 << k for k in rng.sample(range(32), rng.randint(0, 3))):032x}" for _ in range(700)}
    far = {f"{rng.getrandbits(32) << 96 | rng.getrandbits(20):032x}" for _ in range(300)}
    prints = sorted(near | far)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string").repartition(7)
    values = [int(p, 16) for p in prints]
    links = {p: n for p, a in zip(prints, values) if (n := sum((a ^ b).bit_count() <= 3 for b in values) - 1)}
    assert {r["fingerprint"]: r["links"] for r in fingerprint.linked_fingerprints(df, most=64).collect()} == links


def plain_simhash(text):
    """The votes of each term's hash one by one."""
    w = (text or "").encode().split()
    width = min(max(len(w) // 4, 1), fingerprint.TERM_WORDS)
    power = lambda base, n: pow(base, n, 2**64)
    scramble = lambda x: int(common.mix(np.array([x], np.uint64))[0])
    hashed = lambda symbols, base: scramble(sum(int(s) * power(base, i) for i, s in enumerate(symbols)) % 2**64)
    ids = [scramble(hashed([common._TABLE[0][c] for c in x], common._BASES[0])) for x in w]
    terms = collections.Counter(tuple(ids[i : i + width]) for i in range(len(ids) - width + 1 if ids else 0))
    out = ""
    for plane in (1, 2):
        votes = [0] * 64
        for term, weight in terms.items():
            h = scramble(hashed(term, common._BASES[1]) ^ (0xA0761D6478BD642F * plane) % 2**64)
            votes = [v + (weight if h >> k & 1 else -weight) for k, v in enumerate(votes)]
        out += f"{sum(1 << k for k, v in enumerate(votes) if v > 0):016x}"
    return out


def test_fingerprints_by_votes(docs):
    got = by_id(fingerprint.linked_report(docs))
    prints = [plain_simhash(t) for t in TEXTS]
    like = lambda a, b: max(0.0, np.cos(np.pi * (int(a, 16) ^ int(b, 16)).bit_count() / 128))
    for i, t in enumerate(TEXTS):
        r, n = got[i * 3], (i + 1) % len(TEXTS)
        changed = plain_simhash(fingerprint.edited(t or "", TEXTS[n] or ""))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (prints[i], changed)
        assert r["near_edited"] == pytest.approx(like(prints[i], changed)) and r["near_next"] == pytest.approx(like(prints[i], prints[n]))
        assert r["links"] == sum((int(p, 16) ^ int(prints[i], 16)).bit_count() <= 3 for p in set(prints)) - 1


# ---------------------------------------------------------------- 5

@pytest.mark.parametrize("length,start", [(20, 10), (20, 5), (8, 2)])
def test_substring_dedup(docs, none, length, start):
    got, seen = by_id(substring_dedup.removal_report(docs, length, start)), set()
    kept_texts = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert tuple(got[i * 3])[1:] == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i
        kept_texts[i * 3] = kept.decode() if any(gone) else t
    assert substring_dedup.removal_report(none).count() == 0
    if length == 20:
        after = by_id(substring_dedup.remove_repeats(docs))
        assert {k: r["text"] for k, r in after.items()} == {k: t for k, t in kept_texts.items() if t != "" or TEXTS[k // 3] == ""}
        assert all(r["n_chars"] == len(r["text"] or "") and r["key"] == "k" for r in after.values())


# ---------------------------------------------------------------- 6

@pytest.mark.parametrize("name,unit", [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "word"), ("word_bpe_49k.json", "text")])
def test_encoder(monkeypatch, name, unit):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 500)
    letters = [*"ab ceé  \n\t.,'0\0 ́ßİ中\x1c\x85", "<|endoftext|>", "'s", " the", "  "]
    rng = random.Random(4)
    samples = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500)] + [t or "" for t in TEXTS]
    enc = encoding.Encoder(tokenizer(name), unit)
    for at in range(0, len(samples), 400):
        part = samples[at : at + 400]
        assert [x.tolist() for x in enc.encode(part)] == [x.ids for x in enc.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_encoder_learns_words_once():
    """A word is given to the tokenizer once, whatever sign follows it or line it begins."""
    enc, given = encoding.Encoder(tokenizer("byte_bpe_50k.json"), "space"), []
    each = enc._each
    enc._each = lambda texts: given.extend(texts) or each(texts)
    rng = random.Random(9)
    words = ["".join(rng.choices("abdeghinorstué", k=12)) for _ in range(300)]
    text = "\n".join(" ".join(f"{w}{sign}" for w in words) for sign in ("", ",", ".", "###", "!?", ".***"))
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert enc.encode([text])[0].tolist() == want
    assert sum(map(len, given)) < 1.2 * len(" ".join(words))


@pytest.mark.parametrize("most,at_once", [(50, 37), (10_000, 1 << 18)])
def test_encoder_white_space(monkeypatch, most, at_once):
    """Beside every kind of white space, sign and letter, with pieces forgotten inside a text."""
    monkeypatch.setattr(encoding, "MEMO_PIECES", most)
    monkeypatch.setattr(encoding, "_PASS", at_once)
    odd = [chr(c) for c in (*range(0x180), *range(0x1670, 0x1690), *range(0x2000, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF, 0xFFFF, 0x1F600)]
    samples = [s for c in odd for s in (f"a{c} b", f"a {c}b", f"a{c},x", f"{c} {c}", f"a\n{c}b", f"{c}\nb", f"é{c}.é", f"internationalisation{c} internationalisation,")]
    enc = encoding.Encoder(tokenizer("byte_bpe_50k.json"), "space")
    for part in (samples, ["".join(samples[i : i + 500]) for i in range(0, len(samples), 500)], ["", None], []):
        assert [x.tolist() for x in enc.encode(part)] == [x.ids for x in enc.tokenizer.encode_batch([s or "" for s in part], add_special_tokens=False)]


def test_token_store(spark, docs, none):
    path, ids = common.new_path(spark, "store"), {}
    enc = encoding.Encoder(tokenizer("byte_bpe_50k.json"), "text")
    for i, t in enumerate(TEXTS):
        ids[i * 3] = [*enc.encode([t])[0].tolist(), 0]
    token_store.write_store(docs, tokenizer("byte_bpe_50k.json"), "space", path)
    got, start = by_id(token_store.read_report(spark, path)), 0
    whole = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path).collect()}
    for k in sorted(ids):
        assert tuple(got[k]) == (k, start, len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) and whole[k] == ids[k]
        start += len(ids[k])
    objects = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert objects.count() == objects.select("digest").distinct().count()
    bad = common.new_path(spark, "bad")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    spark.read.parquet(f"{path}/objects").withColumn("body", F.when((F.col("kind") == "chunk") & (F.col("n") > 64), F.concat(F.lit(b"\1\1"), F.substring(F.col("body"), F.lit(3), F.length("body")))).otherwise(F.col("body"))).write.partitionBy("kind").parquet(f"{bad}/objects")
    with pytest.raises(Exception, match="does not match"):
        token_store.read_report(spark, bad).count()
    assert token_store.store_report(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_crc_of_parts():
    groups = [[random.randbytes(n) for n in sizes] for sizes in ((0, 4, 400, 1, 77), (), (5,), (0,), (4096, 4096, 12))]
    parts = [d for g in groups for d in g]
    got = token_store.crc32_of_parts(np.array([zlib.crc32(d) for d in parts]), np.array([len(d) for d in parts]), np.cumsum([0, *map(len, groups)]))
    assert got.tolist() == [zlib.crc32(b"".join(g)) for g in groups]


# ---------------------------------------------------------------- 7

def test_language_id(spark, none):
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "αβγδ"}
    rows = []
    for i in range(600):
        lang = random.choice([*alphabets, "xx"])
        rows.append((i, " ".join("".join(random.choices(alphabets[lang], k=4)) for _ in range(random.randint(5, 40))), lang))
    rows += [(900, None, "xx"), (901, "123 ...", "yy"), (902, "", None), (903, "αβγδ αβ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__x", F.lit(1))
    got = by_id(language_id.language_report(df))
    held = [i for i, _, lang in rows if lang and got[i]["held_out"] and i < 900]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i]["lang_pred"] == dict((r[0], r[2]) for r in rows)[i] for i in held]) > 0.95
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902)) and got[903]["lang_pred"] == "zz"
    assert {r["doc_id"] for r in language_id.keep_identified(df).collect()} == {i for i, _, _ in rows} - {900, 901, 902}
    assert language_id.language_report(none).count() == 0
    assert {r["lang_pred"] for r in language_id.language_report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---------------------------------------------------------------- 8

@pytest.mark.parametrize("slots", [1 << 21, 3])
def test_decontamination(spark, docs, none, slots, monkeypatch):
    monkeypatch.setattr(decontamination, "SLOTS", slots)
    parts = TEXTS[11].split()
    items = [(1, " ".join(parts[5:25])), (20, "ONE"), (3, None), (4, "..."), (5, "a  B\nc"), (6, words(15)), (7, " ".join(parts[10:22]).upper()), (8, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontamination.contamination_report(docs, bench))
    norm = lambda t: [w for w in __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))]
    wins = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wins[tuple(w[s : s + n])].add(str(i))
    clean = set()
    for i, t in enumerate(TEXTS):
        w, hit, found = norm(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        assert tuple(got[i * 3]) == (i * 3, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)), i
        if not hit:
            clean.add(i * 3)
    assert {r["doc_id"] for r in decontamination.remove_contaminated(docs, bench).collect()} == clean
    assert decontamination.contamination_report(none, bench).count() == 0
    assert not decontamination.contamination_report(docs, bench.limit(0)).where("contaminated").count()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables are not here")
def test_decontamination_verifies_few(spark):
    """What passes the set and has to be verified is little more than what is true."""
    bench, docs = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("benchmark", "documents"))
    windows = decontamination.benchmark_windows(bench).cache()
    passed = decontamination.survivors(docs.select("doc_id", "text"), windows, 10).where("at >= 0").cache()
    true = passed.join(windows.select("length", "window").distinct(), ["length", "window"], "left_semi").count()
    print(f"{passed.count()} windows verified, {true} of them in the benchmark")
    assert 0 < true <= passed.count() <= 2 * true + 200


def test_decontamination_of_a_table_dealt_anew(spark):
    """Not cached, dealt at random, with repeated rows, null ids and clashing names; and more windows than slots."""
    rng = random.Random(8)
    texts = [words(rng.randint(0, 60)) for _ in range(120)] + [words(4000)]
    rows = [(rng.choice([i, 7, None]), t, "x", 1) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, window string, row long").repartition(7)
    bench = spark.createDataFrame([(i, " ".join(texts[i].split()[3:30]), 0) for i in range(0, 120, 3)], "item_id long, text string, length int").repartition(3)
    known = {}
    for w in (t.split() for t in (r["text"] for r in bench.collect())):
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            known.setdefault(n, set()).add(tuple(w[s : s + n]))
    def hits(t):
        w = t.split()
        return len({p for n, found in known.items() for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in found for p in range(s, s + n)})
    expected = sorted((-1 if i is None else i, len(t.split()), hits(t)) for i, t, *_ in rows)
    got = decontamination.contamination_report(df, bench)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"]) for r in got.collect()) == expected
    kept = decontamination.remove_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not h for *_, h in expected)


# ---------------------------------------------------------------- 9

def test_packing(docs, none):
    rows = packing.pack(docs, tokenizer("word_bpe_49k.json")).collect()
    enc = encoding.Encoder(tokenizer("word_bpe_49k.json"), "text")
    for i, t in enumerate(TEXTS):
        ids, at = np.append(enc.encode([t])[0], np.uint32(2)), 0
        for r in sorted((r for r in rows if r["doc_id"] == i * 3), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    for s in {r["sequence_id"] for r in rows}:
        own, at = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]), 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at == own[0]["tier"] <= 4096 and at & (at - 1) == 0
    assert packing.pack(none, tokenizer("word_bpe_49k.json")).count() == 0


@given(st.lists(st.lists(st.integers(0, 12), max_size=30), max_size=8))
def test_step_groups(flushes):
    """Over any flushes all groups but the last hold exactly a step's tokens, and no window is lost."""
    held, groups, i = [], [], 0
    for at, sizes in enumerate(flushes):
        found = [(1 << k, [i + j]) for j, k in enumerate(sizes)]
        held, i = held + found, i + len(found)
        groups += [list(g) for g in packing.step_groups(held, at == len(flushes) - 1, 8192)]
        assert sum(size for size, _ in held) < 8192
    assert sorted(n for g in groups for _, w in g for n in w) == list(range(i)) and not held
    totals = [sum(size for size, _ in g) for g in groups]
    assert all(t == 8192 for t in totals[:-1]) and (not totals or 0 < totals[-1] <= 8192)


def test_step_groups_of_a_table(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "of", "beta,", "the", "gamma"], k=rng.choice([1, 9, 300, 2500]))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = packing.pack(df, tokenizer("word_bpe_49k.json"), tiers=(256, 1024), step_tokens=4096).collect()
    sums, of = collections.Counter(), {}
    for r in rows:
        sums[r["step_id"]] += r["length"]
        assert of.setdefault(r["sequence_id"], r["step_id"]) == r["step_id"]
    for part in {g >> 36 for g in sums}:
        own = [sums[g] for g in sorted(g for g in sums if g >> 36 == part)]
        assert len(own) > 3 and set(own[:-1]) == {4096} and own[-1] <= 4096
    with pytest.raises(ValueError):
        packing.pack(df, tokenizer("word_bpe_49k.json"), step_tokens=5000)


# ---------------------------------------------------------------- 10

@pytest.mark.parametrize("parts,tile_rows,radius", [(4, 4096, 2), (2, 2, 2), (4, 3, 6)])
def test_near_dedup(spark, docs, none, parts, tile_rows, radius):
    prints = {}
    for i, t in enumerate(TEXTS):
        w = [x.lower() for x in (t or "").encode().split()]
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i * 3] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(docs, radius, parts=parts, tile_rows=tile_rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in prints}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == prints
    assert near_dedup.near_duplicate_report(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i + 1, i) for i in range(70)] + [(rng.randint(101, 160), 100) for _ in range(30)] + [(300, 200), (300, 250)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = near_dedup.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: find(n) for n in root} and len(got) == len(root)


# ---------------------------------------------------------------- pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    before = spark.read.parquet(f"{SF}/documents.parquet")
    docs, texts_before = before, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = common.materialise(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and {r["doc_id"] for r in docs.collect()} <= ids
        if name == "near_dedup":
            texts_before = docs.count()
            assert docs.select("text").distinct().count() == texts_before
    assert not decontamination.contamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()} == {tuple(r) for r in packed.select("doc_id", "start", "length", "ids_crc32").collect()}
