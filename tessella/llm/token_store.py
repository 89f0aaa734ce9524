"""A content-addressed store of token-id streams.

Layout of a store folder:

- ``objects/kind=chunk``: each distinct chunk once: ``digest`` (16 bytes of BLAKE2b over the ids as
  little-endian unsigned 32-bit integers), ``n`` ids, ``width`` (2 or 4 bytes an id) and ``body``;
- ``recipes``: one row a document, in ascending ``doc_id`` (a null id first): ``start`` (ids of all documents
  before it), ``n_tokens``, the concatenated ``digests`` of its chunks and the Merkle ``root`` over them;
- ``manifest``: for each range of documents the Merkle root over its recipes.

Chunks end where a rolling hash of the last ``WINDOW`` ids has its low bits clear, so an edit moves only the
chunks around it. Reading checks every chunk against its digest and every recipe and range against its root;
a mismatch fails the read.

Defined results: a null or empty text is the end id alone; repeated rows are separate recipes of the same
chunks; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import mix, new_path, order_buckets, running_total, small_batches
from tessella.llm.encoding import ENCODE_BYTES, encoder

WINDOW, LEAST, MEAN, MOST = 4, 64, 256, 1024
#: Pieces that an encoder remembers.
MEMO_PIECES = 900_000
#: Chunk digests that a task remembers, to send a repeated chunk's body once.
TASK_MEMO = 200_000
DIGEST = 16


def digest(wide: bytes | memoryview) -> bytes:
    """Of ids as little-endian unsigned 32-bit integers."""
    return hashlib.blake2b(wide, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; a lone node at the end of a level moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=DIGEST).digest() for x in leaves] or [b"\0" * DIGEST]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def marks(ids: np.ndarray) -> np.ndarray:
    """Places that a chunk may end at: where a rolling hash of the last ``WINDOW`` ids is 0 modulo ``MEAN``."""
    if len(ids) < WINDOW:
        return np.empty(0, np.int64)
    h, m = np.zeros(len(ids) - WINDOW + 1, np.uint64), len(ids) - WINDOW + 1
    for i in range(WINDOW):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[i : i + m]
        h ^= h >> np.uint64(29)
    return np.flatnonzero((h >> np.uint64(20)) % np.uint64(MEAN) == 0) + WINDOW


def cuts(good: list[int], begin: int, end: int) -> list[int]:
    """Where the chunks of the stream from ``begin`` to ``end`` end, given the sorted places they may end at."""
    out, at = [], begin
    i = bisect.bisect_left(good, at + LEAST)
    while end - at > LEAST:
        while i < len(good) and good[i] < at + LEAST:
            i += 1
        at = min(good[i] if i < len(good) else end, at + MOST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def unpack_ids(width: int, body: bytes) -> np.ndarray:
    return np.frombuffer(body, f"<u{width}").astype("<u4")


_OBJECTS = "kind string, place long, doc_id long, digest binary, n long, width int, body binary"
_NAMES = [x.split()[0] for x in _OBJECTS.split(", ")]


def write_store(docs: DataFrame, tokenizer_path: str, unit: str, path: str, end_id: int = 0) -> None:
    """Encode the documents and write the store. Texts are encoded once and ids are shuffled once."""
    spark = docs.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(tokenizer_path, unit, MEMO_PIECES), set()
        for b in small_batches(batches, most=ENCODE_BYTES):
            found, ends = enc.encode_flat(b.column("text").to_pylist())
            ids = np.insert(found, ends, end_id).astype("<u4")
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            width = 2 if int(ids.max()) < 65536 else 4
            wide, narrow = memoryview(ids).cast("B"), memoryview(ids.astype(f"<u{width}")).cast("B")
            good, begin = marks(ids).tolist(), 0
            new_names, sizes, bodies, roots, lists = [], [], [], [], []
            for end in ends:
                names = []
                for to in cuts(good, begin, end):
                    names.append(name := digest(wide[4 * begin : 4 * to]))
                    if name not in sent:
                        sent.add(name)
                        new_names.append(name)
                        sizes.append(to - begin)
                        bodies.append(bytes(narrow[width * begin : width * to]))
                    begin = to
                roots.append(merkle(names))
                lists.append(b"".join(names))
            if len(sent) > TASK_MEMO:
                sent.clear()
            n, m = len(new_names), b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(["chunk"] * n, pa.string()), pa.array(np.frombuffer(b"".join(x[:8] for x in new_names), np.int64)), pa.nulls(n, pa.int64()), pa.array(new_names, pa.binary()), pa.array(sizes, pa.int64()), pa.array([width] * n, pa.int32()), pa.array(bodies, pa.binary())], _NAMES
            )
            place = mix(b.column("doc_id").fill_null(0).to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["recipe"] * m), pa.array(place), b.column("doc_id"), pa.array(roots, pa.binary()), pa.array(np.diff(ends, prepend=0)), pa.array([0] * m, pa.int32()), pa.array(lists, pa.binary())], _NAMES
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by kind and digest: a chunk passes once, each recipe passes."""
        last = None
        for b in batches:
            keep = []
            for kind, name in zip(b.column("kind").to_pylist(), b.column("digest").to_pylist()):
                keep.append(kind == "recipe" or name != last)
                last = name if kind == "chunk" else last
            yield b.filter(pa.array(keep))

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(chunks, _OBJECTS)
    dealt = made.repartition("place").sortWithinPartitions("kind", "digest").mapInArrow(once, _OBJECTS)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")

    raw = spark.read.schema(_OBJECTS).parquet(f"{path}/objects").where("kind = 'recipe'")
    recipes = running_total(raw.select("doc_id", F.col("n").alias("n_tokens"), F.col("digest").alias("root"), F.col("body").alias("digests")), "doc_id", "n_tokens", "start")
    ranged = order_buckets(recipes, "doc_id", 1, "range")
    ranged.repartitionByRange("range", "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _range_roots(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, root binary, digests binary, start long, range int").parquet(f"{path}/recipes")


def _range_roots(recipes: DataFrame) -> DataFrame:
    """A Merkle root for each range: over blocks of recipes first, so that no task gathers a range of any size."""
    leaf = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root")), 256)
    blocks = recipes.groupBy("range", F.floor(F.col("start") / 1_000_000).alias("block")).agg(
        F.min("start").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("start").cast("string"), 20, "0"), leaf))), ","), 256).alias("h"),
    )
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("block").cast("string"), 20, "0"), "h"))), ",")
    return blocks.groupBy("range").agg(F.min("first").alias("start"), F.sum("n").alias("n_docs"), F.sum("t").alias("n_tokens"), F.sha2(listed, 256).alias("root"))


#: Fixed value: the CRC-32 polynomial in reflected form.
_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the CRC polynomial, bits reflected, for arrays of 32-bit numbers."""
    product, b, one = np.zeros_like(b), b.copy(), np.uint32(1)
    for bit in range(31, -1, -1):
        product ^= b * ((a >> np.uint32(bit)) & one)
        b = (b >> one) ^ (np.uint32(_POLYNOMIAL) * (b & one))
    return product


def _shifts(n_bytes: np.ndarray) -> np.ndarray:
    """x ** (8 * n) modulo the polynomial, for each n."""
    out, square, n = np.full(len(n_bytes), 1 << 31, np.uint32), np.full(1, 1 << 23, np.uint32), n_bytes.astype(np.int64)
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = _times(np.broadcast_to(square, int(odd.sum())), out[odd])
        square, n = _times(square, square), n >> 1
    return out


def crc32_of_parts(crc: np.ndarray, n_bytes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The CRC-32 of each concatenation, from the CRCs and sizes of its parts; ``begins`` cuts the parts into
    concatenations and has one more entry, the number of parts."""
    sizes, which = np.unique(n_bytes, return_inverse=True)
    shift, crc = _shifts(sizes)[which], crc.astype(np.uint32)
    count, out = np.diff(begins), np.zeros(len(begins) - 1, np.uint32)
    for k in range(int(count.max(initial=0))):  # the k-th part of all that have one
        rows = np.flatnonzero(count > k)
        at = begins[rows] + k
        out[rows] = _times(shift[at], out[rows]) ^ crc[at]
    return out


def verified_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc) of the stored chunks, each checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for name, width, body in zip(b.column("digest").to_pylist(), b.column("width").to_pylist(), b.column("body").to_pylist()):
                wide = unpack_ids(width, body).tobytes()
                if digest(wide) != name:
                    raise ValueError(f"chunk {name.hex()} does not match its digest")
                n.append(len(wide) // 4)
                crc.append(zlib.crc32(wide))
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    stored = spark.read.schema(_OBJECTS).parquet(f"{path}/objects").where("kind = 'chunk'").select("digest", "width", "body")
    return stored.mapInArrow(run, "digest binary, n long, crc long")


def _listed(recipes: DataFrame) -> DataFrame:
    """One row a chunk of a document, in order; ``row`` tells repeated documents apart by where they start."""
    at = F.explode(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1))
    rows = recipes.select("doc_id", "start", "n_tokens", "root", "digests", at.alias("seq"))
    return rows.select("doc_id", "start", "n_tokens", "root", "seq", F.substring(F.col("digests"), F.col("seq") * DIGEST + 1, F.lit(DIGEST)).alias("digest"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; chunk bodies stay where they are stored."""
    recipes = _recipes(spark, path)
    bad = _range_roots(recipes).withColumnRenamed("root", "again").join(spark.read.parquet(f"{path}/manifest").select("range", "root"), "range", "full").where("not (root <=> again)")
    if not bad.isEmpty():
        raise ValueError("a range of recipes does not match its manifest")
    joined = _listed(recipes).join(verified_chunks(spark, path), "digest", "left")
    gathered = joined.groupBy("start", "doc_id", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "n", "crc"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("parts").flatten()
            begins = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(b.column("parts")).to_numpy())])
            if parts.field("n").null_count:
                raise ValueError("a document does not match its recipe: a chunk is missing")
            n, names = parts.field("n").to_numpy(), parts.field("digest").to_pylist()
            total = np.concatenate([[0], np.cumsum(n)])[begins]
            cut = begins.tolist()
            whole = [merkle(names[x:y]) for x, y in zip(cut, cut[1:])]
            if whole != b.column("root").to_pylist() or (np.diff(total) != b.column("n_tokens").to_numpy()).any():
                raise ValueError("a document does not match its recipe")
            crc = crc32_of_parts(parts.field("crc").to_numpy(), 4 * n, begins)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return gathered.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the whole id streams, put together again."""
    stored = spark.read.schema(_OBJECTS).parquet(f"{path}/objects").where("kind = 'chunk'").select("digest", "width", "body")
    joined = _listed(_recipes(spark, path)).join(stored, "digest")
    gathered = joined.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "width", "body"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.concatenate([unpack_ids(p["width"], p["body"]) for p in parts]).astype(np.int64).tolist() for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return gathered.mapInArrow(run, "doc_id long, start long, ids array<long>")


def store_report(docs: DataFrame, tokenizer_path: str, unit: str = "space", end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write_store(docs, tokenizer_path, unit, path, end_id)
    return read_report(spark, path)
