"""Removal of word runs that occur earlier, by level-wise doubling.

A window is ``length`` consecutive words of one document. Windows are looked for at ``start`` words first; only
where those repeat are they extended to twice the length, level by level, until ``length`` is reached or no
candidate survives. At the first level a document's windows are thinned by winnowing: the least hash of each
stretch of ``length - start + 1`` windows stands for it, so every window of ``length`` words holds a chosen one,
at the same place in all its copies, and nothing is lost.

The last doubling extends a survivor in all ways that stand for a window of ``length`` words. Those windows lie
together, so they are sent as one segment. Equal segments are settled as wholes: all but the first occurrence go.
Only where different segments share a survivor are their windows compared one by one.

Words are known by 128-bit digests (BLAKE2b) of their bytes and segments by 96-bit digests of those. A window is known
by 64 bits of its survivor's words and 64 other bits of all its words; the shorter levels only propose candidates.

Defined results: a null text has no words; documents of fewer than ``length`` words lose none; documents are
ordered by id (null first); rows with the same id and text are one document and get the same result; an empty
table gives no rows; other columns, whatever their names, are ignored by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bucketed, chosen_by_lists, digest, materialise, mix, run_digests, small_batches, winnow_parts, word_digests

LENGTH, START = 20, 10
#: Segments that a worker remembers at most, to send each once.
TASK_MEMO = 200_000


def _table(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, d, doc_id, text). ``key`` is a hash of id and text, and brings candidates back to their text; together
    with ``d``, the id with the least number for null, it names a document."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(*names_of(doc_id, F.col("text")), doc_id.alias("doc_id"), "text")


def names_of(doc_id: F.Column, text: F.Column) -> list[F.Column]:
    return [F.xxhash64(F.lit("document"), doc_id.isNull(), doc_id, text.isNull(), text).alias("key"), F.coalesce(doc_id, F.lit(-(2**63))).alias("d")]


def first_level(rows: DataFrame, length: int, start: int) -> DataFrame:
    """(h, key, at): the chosen windows of ``start`` words."""
    width = length - start + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            words, first = word_digests(b.column("text").to_pylist())
            grams = run_digests(words, start)
            doc, at, _, _ = winnow_parts(grams, width, first[:-1], first[1:] - start + 1)
            yield _table(["h", "key", "at"], [grams[at].view(np.int64), b.column("key").to_numpy()[doc], (at - first[doc]).astype(np.int32)], [pa.int64(), pa.int64(), pa.int32()])

    return rows.select("key", "text").mapInArrow(run, "h long, key long, at int")


def repeated(level: DataFrame) -> DataFrame:
    """(key, ats): where a document's windows of this level occur more than once."""
    level = materialise(level, "level")
    # a table of its own, so that the join can split a hot window
    twice = materialise(level.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    return materialise(level.join(twice, "h").groupBy("key").agg(F.collect_set("at").alias("ats")), "survivors")


def doubled(rows: DataFrame, survivors: DataFrame, size: int) -> DataFrame:
    """(h, key, at) at twice the length ``size``: what survives, extended to the right and to the left.

    A window of four times ``size`` words or more that holds a survivor holds one of its two extensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            words, first = word_digests(b.column("text").to_pylist())
            grams = run_digests(words, 2 * size)
            hs, keys, ats = [], [], []
            for key, found, s, e in zip(b.column("key").to_pylist(), b.column("ats").to_pylist(), first[:-1], first[1:]):
                at = np.array(found, np.int64)
                n = e - s
                both = [at[at + 2 * size <= n], at[(at >= size) & (at + size <= n)] - size]
                for where, shift in zip(both, (0, size)):
                    hs.append(mix(grams[where + s] ^ np.uint64(shift)))
                    ats.append(where + shift)
                    keys.append(np.full(len(where), key, np.int64))
            yield _table(["h", "key", "at"], [np.concatenate(hs).view(np.int64), np.concatenate(keys), np.concatenate(ats).astype(np.int32)], [pa.int64(), pa.int64(), pa.int32()])

    return rows.join(survivors.hint("shuffle_hash"), "key").select("key", "text", "ats").mapInArrow(run, "h long, key long, at int")


_SEGMENT = pa.schema([("kind", pa.string()), ("h", pa.int64()), ("sid", pa.binary()), ("key", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("wins", pa.binary())])


def doubled_last(rows: DataFrame, survivors: DataFrame, length: int, start: int) -> DataFrame:
    """The windows of ``length`` words around each survivor. Rows ``at``: the ``n`` windows from word ``lo`` on of a
    document are segment ``sid``. Rows ``body``: the survivor and the digests of those windows, once a task for each segment."""
    width = length - start + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in small_batches(batches):
            words, first = word_digests(b.column("text").to_pylist())
            grams, one, two = run_digests(words, start), run_digests(words, length), run_digests(words, length, 1)
            both, two = np.stack([one, two], axis=1).tobytes(), two.tobytes()
            doc, at, low, high = winnow_parts(grams, width, first[:-1], first[1:] - start + 1)
            keep = chosen_by_lists(doc, at - first[doc], b.column("ats"))
            doc, at, low, high = doc[keep], at[keep], low[keep], high[keep]
            h, n, m = grams[at].view(np.int64), (high - low).astype(np.int32), len(at)
            cut = list(zip(low.tolist(), high.tolist()))
            sids = [digest(both[16 * x : 16 * y], 12) for x, y in cut]
            of = lambda c: b.column(c).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(["at"] * m, pa.string()), pa.nulls(m, pa.int64()), pa.array(sids, pa.binary()), pa.array(of("key")), pa.array(of("d")), pa.array((low - first[doc]).astype(np.int32)), pa.array(n), pa.nulls(m, pa.binary())], schema=_SEGMENT)
            new = []
            for i, name in enumerate(sids):
                if name not in sent:
                    sent.add(name)
                    new.append(i)
            if len(sent) > TASK_MEMO:
                sent.clear()
            nothing = lambda kind: pa.nulls(len(new), kind)  # noqa: B023,E731
            columns = [pa.array(["body"] * len(new), pa.string()), pa.array(h[new]), pa.array([sids[i] for i in new], pa.binary()), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int32()), pa.array(n[new]), pa.array([two[8 * cut[i][0] : 8 * cut[i][1]] for i in new], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SEGMENT)

    schema = "kind string, h long, sid binary, key long, d long, lo int, n int, wins binary"
    return rows.join(survivors.hint("shuffle_hash"), "key").select("key", "d", "text", "ats").mapInArrow(run, schema)


def _windows(firsts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(h, w, key, d, start) of the windows of segments whose survivor ``h`` other segments share."""
    once = materialise(bodies.groupBy("sid").agg(F.min("h").alias("h"), F.min("wins").alias("wins")), "bodies")
    shared = once.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wins = b.column("wins").to_pylist()
            n = np.array([len(w) // 8 for w in wins], np.int64)
            each = np.repeat(np.arange(len(wins)), n)
            inside = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            of = lambda c: b.column(c).to_numpy()[each]
            columns = [of("h"), np.frombuffer(b"".join(wins), np.int64), of("key"), of("d"), (of("lo") + inside).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "w", "key", "d", "start"])

    some = once.join(shared, "h", "left_semi").join(firsts.select("sid", "first.*"), "sid")
    return some.select("h", "key", "d", "lo", "wins").mapInArrow(run, "h long, w long, key long, d long, start int")


def later_windows(rows: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """(key, spans): runs (a, b) of starts of windows whose words also start earlier, with the document ``d`` they are of."""
    sizes = [start]
    while sizes[-1] < length:
        sizes.append(2 * sizes[-1])
    if sizes[-1] != length:
        raise ValueError("length must be start doubled some times")
    survivors = repeated(first_level(rows, length, start))
    for size in sizes[1:-1]:
        survivors = repeated(doubled(rows, survivors, size // 2))
    made = materialise(doubled_last(rows, survivors, length, start), "segments")
    at, bodies = made.where("kind = 'at'").select("sid", "key", "d", "lo", "n"), made.where("kind = 'body'").select("h", "sid", "wins")
    # a table of its own, so that the joins below can split a hot segment
    firsts = materialise(at.groupBy("sid").agg(F.min(F.struct("d", "lo", "key")).alias("first"), F.count(F.lit(1)).alias("times")), "firsts")
    again = at.join(firsts.where("times > 1").select("sid", "first"), "sid")
    whole = again.where((F.col("d") > F.col("first.d")) | ((F.col("d") == F.col("first.d")) & (F.col("lo") > F.col("first.lo"))))
    whole = whole.select("key", "d", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1).alias("b"))
    windows = materialise(_windows(firsts, bodies), "windows")
    least = windows.groupBy("h", "w").agg(F.min(F.struct("d", "start")).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "w", "least")
    later = windows.join(least, ["h", "w"]).where((F.col("d") > F.col("least.d")) | ((F.col("d") == F.col("least.d")) & (F.col("start") > F.col("least.start"))))
    single = later.select("key", "d", F.col("start").alias("a"), F.col("start").alias("b"))
    return whole.unionByName(single).groupBy("key").agg(F.collect_list(F.struct("d", "a", "b")).alias("spans"))


def own_spans(spans: list[dict] | None, d: int) -> list[dict]:
    """Those of the document ``d``, should another have its key."""
    return [s for s in spans or () if s["d"] == d]


def kept_words(text: str | None, spans: list | None, length: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode().split()  # bytes.split() cuts at ASCII white space alone
    n = len(words)
    if spans:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, [s["a"] for s in spans], 1)
        np.add.at(edge, [s["b"] + length for s in spans], -1)
        gone = np.cumsum(edge)[:n] > 0
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return words, n


def removal_report(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    rows = bucketed(keyed(docs), "key", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            n_words, n_removed, sha = [], [], []
            for text, d, spans in zip(*(b.column(c).to_pylist() for c in ("text", "d", "spans"))):
                words, n = kept_words(text, own_spans(spans, d), length)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = rows.join(later_windows(rows, length, start).hint("shuffle_hash"), "key", "left").select("doc_id", "d", "text", "spans")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """``docs`` with the repeats taken out of ``text``: a document that loses words is its kept words joined by one
    space, one that loses all goes, and ``n_chars`` follows where there is such a column. Others stay as they are.
    Column names that begin with ``__`` are reserved."""

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts, columns = b.column("text").to_pylist(), {n: b.column(n) for n in names}
            spans = [own_spans(s, d) for s, d in zip(b.column("__spans").to_pylist(), b.column("__d").to_pylist())]
            cut = [None if not s else b" ".join(kept_words(t, s, length)[0]).decode() for t, s in zip(texts, spans)]
            columns["text"] = pa.array([t if c is None else c for t, c in zip(texts, cut)], pa.string())
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([o if c is None else len(c) for o, c in zip(old.to_pylist(), cut)], old.type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names).filter(pa.array([c != "" for c in cut]))

    key, d = names_of(F.col("doc_id").cast("long"), F.col("text"))
    rows = bucketed(docs.withColumns({"__key": key, "__d": d}), "__key", "texts")
    named = rows.select(F.col("__key").alias("key"), F.col("__d").alias("d"), "text")
    spans = later_windows(named, length, start).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    marked = rows.join(spans.hint("shuffle_hash"), "__key", "left")
    return marked.select(*[F.col(f"`{c}`") for c in names], "__d", "__spans").mapInArrow(run, docs.schema)


REMOVAL_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS text, count(gone.p) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
