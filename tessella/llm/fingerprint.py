"""SimHash document fingerprints and their search by permuted block tables.

Terms are runs of ``size`` words (of a quarter of the words in texts too short for that, but at least one),
each weighted by how often the document holds it; the bits of a term's hash
vote with that weight, and a fingerprint bit is set where over half of the weight is for it. The likeness of
two fingerprints is the cosine that their differing bits estimate, cos(pi * differing / bits), at least 0.

Defined results: a null text is empty; a wordless text has fingerprint zero;
equal texts have equal fingerprints; documents are ordered by id (null first), then text; a lone
document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BLOCK_BYTES, RangeHash, byte_symbols, joined, materialise, mix, order_buckets, word_spans

BITS, TERM_WORDS = 128, 5


def simhash(texts: list[str | None], bits: int = BITS, size: int = TERM_WORDS) -> np.ndarray:
    """The fingerprints as rows of bits / 64 unsigned numbers."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    raw, begins = joined(texts)
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return out
    words = mix(RangeHash(byte_symbols(data)).of(starts, ends))
    first = np.searchsorted(starts, begins)  # the first word of each document
    count = np.diff(first)
    width = np.clip(count // 4, 1, size)  # short texts have shorter terms
    terms = np.where(count > 0, count - width + 1, 0)
    has = np.flatnonzero(terms)
    low = np.zeros(len(has) + 1, np.int64)
    np.cumsum(terms[has], out=low[1:])
    at = np.arange(low[-1]) - np.repeat(low[:-1] - first[has], terms[has])
    end = at + np.repeat(width[has], terms[has])
    hashes = RangeHash(words, 1).of(at, end)
    for plane in range(bits // 64):
        h = mix(hashes ^ np.uint64(0xA0761D6478BD642F * (plane + 1) % 2**64))
        for d, (a, b) in zip(has, zip(low[:-1], low[1:])):
            votes = np.zeros(64, np.int64)
            for c in range(a, b, 1 << 15):
                part = h[c : min(c + (1 << 15), b)]
                votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            out[d, plane] = np.packbits(2 * votes > b - a, bitorder="little").view("<u8")[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = a.shape[1] * 64
    return np.maximum(0.0, np.cos(np.pi * np.bitwise_count(a ^ b).sum(axis=1) / bits))


def hexed(prints: np.ndarray) -> list[str]:
    return ["".join(f"{int(x):016x}" for x in row) for row in prints]


def fingerprints(docs: DataFrame, bits: int = BITS, size: int = TERM_WORDS) -> DataFrame:
    """(doc_id, fingerprint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessella.llm.common import small_batches

        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(hexed(simhash(b.column("text").to_pylist(), bits, size)), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


#: Fingerprints of one bucket that a task compares with as many others at most.
BUCKET_PART = 8192


def _masks(radius: int, blocks: int, bits: int) -> np.ndarray:
    """The masks of the tables, one row each: every choice of ``blocks - radius`` of the blocks."""
    out = []
    for chosen in itertools.combinations(range(blocks), blocks - radius):
        mask = 0
        for i in chosen:
            begin, end = bits * i // blocks, bits * (i + 1) // blocks
            mask |= (1 << end) - (1 << begin)
        out.append([mask >> 64 * p & (2**64 - 1) for p in reversed(range(bits // 64))])
    return np.array(out, np.uint64)


def _near(a: np.ndarray, b: np.ndarray, masks: np.ndarray, table: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index in a, index in b, differing bits) of what is near and what no table before ``table`` brings together."""
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        differing = np.zeros((len(part), len(b)), np.uint16)
        for plane in range(a.shape[1]):
            differing += np.bitwise_count(part[:, None, plane] ^ b[None, :, plane])
        i, j = np.nonzero(differing <= radius)
        if not len(i):
            continue
        apart = part[i] ^ b[j]
        held = (apart & masks[table] == 0).all(axis=1)
        for earlier in masks[:table]:
            held &= (apart & earlier != 0).any(axis=1)
        yield i[held] + at, j[held], differing[i[held], j[held]]


def _tiles(prints: DataFrame, radius: int, blocks: int, bits: int, most: int, schema: str, found: Callable) -> DataFrame:
    """``found(fingerprints a, fingerprints b or None, table)`` for all tiles of all buckets of the tables.

    A fingerprint alone in its bucket goes no further. A bucket of more than ``most`` is cut into parts by hash, and
    each pair of parts is a tile of its own, so that no task holds a bucket.
    """
    if blocks <= radius:
        raise ValueError("there must be more blocks than bits in the radius")
    planes, masks = bits // 64, _masks(radius, blocks, bits)
    names = [f"p{i}" for i in range(planes)]
    # conv with a negative base reads and writes signed numbers
    distinct = prints.select(*[F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("long").alias(c) for i, c in enumerate(names)]).distinct()
    key = lambda t: F.xxhash64(*[F.col(c).bitwiseAND(F.lit(int(m.astype(np.int64)))) for c, m in zip(names, masks[t])])
    tables = F.array(*[F.struct(F.lit(t).alias("table"), key(t).alias("key")) for t in range(len(masks))])
    rows = distinct.select(*names, F.explode(tables).alias("k")).select("k.table", "k.key", *names)
    parts = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = rows.join(parts, ["table", "key"]).withColumn("part", F.pmod(F.xxhash64(*names, F.lit(7)), "parts").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    tiles = dealt.select("table", "key", "part", *names, F.explode(pairs).alias("t")).select("table", "key", "t.i", "t.j", "part", *names)
    order = ["table", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(columns: np.ndarray, ends: list[int]) -> Iterator[pa.RecordBatch]:
            for begin, end in itertools.pairwise([0, *ends]):
                if end - begin < 2:
                    continue
                table, _, i, j = columns[:4, begin]
                group = np.ascontiguousarray(columns[5:, begin:end].T).view(np.uint64)
                own = columns[4, begin:end] == i
                yield from found(group if i == j else group[own], None if i == j else group[~own], int(table), masks)

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
            columns = np.concatenate(held, axis=1)
            ends = (np.flatnonzero((columns[:4, 1:] != columns[:4, :-1]).any(axis=0)) + 1).tolist()
            if ends:
                yield from settle(columns, ends)
            held = [columns[:, ends[-1] :] if ends else columns]
        if held:
            yield from settle(held[0], [held[0].shape[1]])

    return tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 5, bits: int = BITS, most: int = BUCKET_PART) -> DataFrame:
    """(a, b, differing), a < b: all pairs of distinct fingerprints within ``radius`` bits of each other.

    Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` whole blocks, so there is a
    table for each choice of that many blocks, keyed by their bits; a pair is compared where it shares a key
    and reported by the first table that holds it. The key is as long as the choice of ``blocks`` makes it:
    raise ``blocks`` with the number of fingerprints, to keep the tables' buckets short. Where near copies are many,
    take ``linked_fingerprints``: it counts the pairs without making them.
    """

    def found(a: np.ndarray, b: np.ndarray | None, table: int, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j, differing in _near(a, a if b is None else b, masks, table, radius):
            once = i < j if b is None else np.ones(len(i), bool)
            pair = [sorted(p) for p in zip(hexed(a[i[once]]), hexed((a if b is None else b)[j[once]]))]
            if pair:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*pair)] + [pa.array(differing[once].astype(np.int32))], ["a", "b", "differing"])

    return _tiles(prints, radius, blocks, bits, most, "a string, b string, differing int", found)


def linked_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 4, bits: int = BITS, most: int = BUCKET_PART) -> DataFrame:
    """(fingerprint, links): how many other distinct fingerprints are within ``radius`` bits, for those with any.

    The tables are those of ``near_fingerprints``; each tile counts its pairs, and only counts leave a task.
    """

    def found(a: np.ndarray, b: np.ndarray | None, table: int, masks: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = [np.zeros(len(x), np.int64) for x in (a, b) if x is not None]
        for i, j, _ in _near(a, a if b is None else b, masks, table, radius):
            if b is None:
                i = i[i != j]  # both orders of a pair are met
            else:
                links[1] += np.bincount(j, minlength=len(b))
            links[0] += np.bincount(i, minlength=len(a))
        for x, n in zip((a, b), links):
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array(hexed(x[n > 0])), pa.array(n[n > 0])], ["fingerprint", "links"])

    return _tiles(prints, radius, blocks, bits, most, "fingerprint string, links long", found).groupBy("fingerprint").agg(F.sum("links").alias("links"))


def linked_report(docs: DataFrame, radius: int = 3, blocks: int = 4, bits: int = BITS, size: int = TERM_WORDS) -> DataFrame:
    """``fingerprint_report`` with ``links``: other distinct fingerprints within ``radius`` bits of a document's own."""
    report = materialise(fingerprint_report(docs, bits, size), "fingerprints")
    found = linked_fingerprints(report, radius, blocks, bits)
    return report.join(found, "fingerprint", "left").select(*report.columns, F.coalesce("links", F.lit(0)).alias("links"))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprint_report(docs: DataFrame, bits: int = BITS, size: int = TERM_WORDS) -> DataFrame:
    """Fingerprints of each document and its edited text, and how near both and the next document are.

    Texts are shuffled once, by ranges of ids. The first document of a range also goes to the end of the
    range before it, as the next of that range's last document.
    """
    spark = docs.sparkSession
    ranged = order_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", 1)
    # as many rows as ranges: the shuffle partitions
    firsts = sorted((r["bucket"], r["first"]) for r in ranged.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).collect())
    before = [(b, f, firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)]
    if not before:
        before = [(0, 0, 0)]
    small = F.broadcast(spark.createDataFrame(before, "bucket int, first long, previous int"))
    joined_rows = ranged.join(small, "bucket")
    is_first = F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first")
    own, tail = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("role")), F.struct(F.col("previous").alias("b"), F.lit(1).alias("role"))
    spread = joined_rows.select("doc_id", "text", F.explode(F.when(is_first, F.array(own, tail)).otherwise(F.array(own))).alias("to")).select("doc_id", "text", "to.b", "to.role")
    ordered = spread.repartitionByRange(len(before), "b").sortWithinPartitions("b", "role", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column("b").to_pylist(), b.column("role").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist())

        def flush(block: list[tuple], following: str) -> pa.RecordBatch:
            """The documents of a block, in order; ``following`` comes after the last."""
            texts = [t for _, t in block]
            nexts = [*texts[1:], following]
            changed = [edited(t, n) for t, n in zip(texts, nexts)]
            prints = simhash([*texts, following, *changed], bits, size)
            a, b, c = prints[: len(texts)], prints[1 : len(texts) + 1], prints[len(texts) + 1 :]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in block], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                 pa.array(hexed(a)), pa.array(hexed(c)), pa.array(likeness(a, c)), pa.array(likeness(a, b))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        block, held, current = [], 0, None
        for bucket, role, doc_id, text in rows():
            text = text or ""
            if bucket != current:
                current, block, held = bucket, [], 0
            if role:
                if block:
                    yield flush(block, text)
                block, held = [], 0
            else:
                if held > BLOCK_BYTES // 4:
                    yield flush(block, text)
                    block, held = [], 0
                block.append((doc_id, text))
                held += len(text)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
