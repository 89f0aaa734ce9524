"""Removal of byte strings that start in more than one place, by suffix arrays.

A string of ``length`` bytes is removed wherever it occurs if it also starts anywhere else in the corpus.
Winnowing picks one anchor (``ANCHOR`` bytes) for each such string, by its content alone, so equal strings
have equal anchors at equal places. Only strings whose anchor repeats are looked at further: the stretch that
all strings with one anchor occurrence cover is cut out as a segment, named by a 128-bit digest of its bytes, and
the different segments of one anchor meet in one task. There each is written as a string of 16-byte symbols aligned
to the anchor; a suffix array over them, built by linear grouping, brings the suffixes with enough common symbols
together, and the bytes before and after those symbols, compared as they are, tell which strings are equal.

Segments that are equal as wholes are counted before they meet: all their strings repeat. An anchor whose different
segments hold more than ``GROUP_BYTES`` is split by content, as often as needed: its strings are halved by how
far before the anchor they start, and each half is dealt anew by the bytes that all its strings cover, so equal
strings stay together and no task gathers a hot anchor. Hashes bring candidates together; bytes or
128-bit digests decide.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; copies of a text that is
long enough lose all; repeated rows are copies of each other; rows without an id are documents like others; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import RangeHash, bucketed, byte_symbols, chosen_by_lists, discard, joined, materialise, partitions, small_batches, winnow_parts
from tessella.llm.substring_dedup import keyed
from tessella.llm.suffix_array import suffix_array

LENGTH, ANCHOR, CHUNK = 400, 128, 16
#: Bytes of one anchor's segments that are sorted together at most; beyond, they are split by content.
GROUP_BYTES = 2 << 20
#: Bytes of segments from which a task sorts what it holds.
ARRAY_BYTES = 2 << 20
#: Bytes of text that one numpy pass takes: each needs some 60 bytes of memory meanwhile.
BLOCK = 1 << 18
#: Bytes of a batch that Spark hands to a Python worker; without it, a batch has 10,000 texts.
BATCH_BYTES = 2 << 20
#: Segment bodies that a task remembers, to send each once.
TASK_MEMO = 200_000


def in_small_batches(df: DataFrame, label: str) -> DataFrame:
    """``materialise``, with Arrow batches of about ``BATCH_BYTES``: a batch stands whole outside the heap and in the Python worker."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH_BYTES)
    try:
        return materialise(df, label)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _grams(texts: list[str | None], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes, where each begins, and the hash of each run of ``size`` bytes."""
    raw, begins = joined(texts)
    at = np.arange(max(0, len(raw) - size + 1))
    return raw, begins, RangeHash(byte_symbols(np.frombuffer(raw, np.uint8))).of(at, at + size)


def anchors(rows: DataFrame, length: int, size: int) -> DataFrame:
    """(h, key, at): the chosen anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, most=BLOCK):
            _, begins, grams = _grams(b.column("text").to_pylist(), size)
            doc, at, _, _ = winnow_parts(grams, length - size + 1, begins[:-1], begins[1:] - size)
            columns = [grams[at].view(np.int64), b.column("key").to_numpy()[doc], (at - begins[doc]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "key", "at"])

    return rows.select("key", "text").mapInArrow(run, "h long, key long, at int")


_SEGMENT = pa.schema([("kind", pa.string()), ("h", pa.int64()), ("sid", pa.binary()), ("key", pa.int64()), ("d", pa.int64()), ("lo", pa.int32()), ("starts", pa.int32()), ("off", pa.int32()), ("body", pa.binary())])


def segments(rows: DataFrame, survivors: DataFrame, length: int, size: int) -> DataFrame:
    """Rows ``at``: an occurrence (key, d, lo, starts) of a segment. Rows ``body``: a segment's bytes, and where its anchor is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in small_batches(batches, most=BLOCK):
            raw, begins, grams = _grams(b.column("text").to_pylist(), size)
            out: list[tuple] = []
            doc, at, low, high = winnow_parts(grams, length - size + 1, begins[:-1], begins[1:] - size)
            keep = chosen_by_lists(doc, at - begins[doc], b.column("found"))
            doc, at, low, high = doc[keep], at[keep], low[keep], high[keep]
            keys, ds = b.column("key").to_numpy()[doc], b.column("d").to_numpy()[doc]
            for h, key, d, p, x, lo, hi in zip(*(c.tolist() for c in (grams[at].view(np.int64), keys, ds, at, low - begins[doc], low, high))):
                body = raw[lo : hi - 1 + length]
                sid = hashlib.blake2b(body, digest_size=16).digest()
                out.append(("at", h, sid, key, d, x, hi - lo, None, None))
                if sid not in sent:
                    sent.add(sid)
                    out.append(("body", h, sid, None, None, None, hi - lo, p - lo, body))
            if len(sent) > TASK_MEMO:
                sent.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENT)], schema=_SEGMENT)

    schema = "kind string, h long, sid binary, key long, d long, lo int, starts int, off int, body binary"
    return rows.join(survivors.hint("shuffle_hash"), "key").select("key", "d", "text", "found").mapInArrow(run, schema)


def repeated_runs(bodies: list[bytes], offs: list[int], groups: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first, last): runs of starts of strings that another place in the segments of its group holds too.

    ``offs`` has where the group's anchor lies in each segment. Symbols are ``CHUNK`` bytes: a string holds at least
    ``need`` whole ones, wherever it starts, and at most 15 bytes before them.
    """
    data = b"".join(bodies)
    sizes = np.array([len(x) for x in bodies], np.int64)
    begins = np.cumsum(sizes) - sizes
    lead = np.array(offs, np.int64) % CHUNK
    count = (sizes - lead) // CHUNK
    total = int(count.sum())
    if not total:
        return []
    padded = bytes(CHUNK) + data + bytes(length)
    # the eight bytes from each place on
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    eight_at = lambda at: eight[at + CHUNK]
    seg = np.repeat(np.arange(len(bodies)), count)
    at = begins[seg] + lead[seg] + (np.arange(total) - np.repeat(np.cumsum(count) - count, count)) * CHUNK
    one, two = eight_at(at), eight_at(at + 8)
    by = np.lexsort((two, one))
    new = np.ones(total, bool)
    new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    symbols = np.empty(total, np.int64)
    symbols[by] = np.cumsum(new)
    # an end mark, 0, after each segment
    where = np.arange(total) + seg
    text = np.zeros(total + len(bodies), np.int64)
    text[where] = symbols
    back = np.full(len(text), -1, np.int64)
    back[where] = np.arange(total)
    need = length // CHUNK - 1
    order = suffix_array(text)
    ends = np.concatenate([text, np.zeros(need, np.int64)])
    same = np.ones(len(order) - 1, bool)
    for i in range(need):
        x, y = ends[order[:-1] + i], ends[order[1:] + i]
        same &= (x == y) & (x > 0)
    # neighbours in the order that share ``need`` symbols are of one class
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    if not member.any():
        return []
    of_class = np.cumsum(np.concatenate([[True], ~same]))[member]
    suffixes = back[order[member]]
    owner, first = seg[suffixes], at[suffixes]
    of_class = of_class * (max(groups) + 1) + np.array(groups, np.int64)[owner]
    core = need * CHUNK
    rest = length - core - CHUNK  # bytes of a string beyond its core and 16 more
    before, after = (eight_at(first - 16), eight_at(first - 8)), (eight_at(first + core), eight_at(first + core + 8))
    low = lambda n: np.uint64((1 << 8 * n) - 1)  # noqa: E731  the first n of eight bytes
    found_owner, found_start = [], []
    for k in range(CHUNK):  # the string starts k bytes before the class's symbols
        good = np.flatnonzero((first - k >= begins[owner]) & (first - k + length <= begins[owner] + sizes[owner]))
        if k <= 8:
            columns = [after[0][good], (before[1][good] & ~low(8 - k)) | (after[1][good] & low(8 - k))]
        else:
            columns = [before[1][good], (before[0][good] & ~low(16 - k)) | (after[0][good] & low(16 - k))]
        if rest:
            tail = first[good] + core + CHUNK - k
            columns += [eight_at(tail) & low(min(rest, 8)), eight_at(tail + 8) & low(max(rest - 8, 0))]
        columns.append(of_class[good])
        by = np.lexsort(columns)
        equal = np.ones(max(len(by) - 1, 0), bool)
        for c in columns:
            equal &= c[by][1:] == c[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        hit = good[by[twice]]
        found_owner.append(owner[hit])
        found_start.append(first[hit] - k)
    starts = np.unique(np.concatenate(found_start))  # places in ``data``: those of a segment lie together
    if not len(starts):
        return []
    owners = np.searchsorted(begins, starts, "right") - 1
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(owners) != 0))
    a, b = np.r_[0, cut + 1], np.r_[cut, len(starts) - 1]
    return list(zip(owners[a].tolist(), (starts[a] - begins[owners[a]]).tolist(), (starts[b] - begins[owners[b]]).tolist()))


def matched_segments(nodes: DataFrame, length: int, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(sid, a, b): runs of starts in a segment that occur elsewhere in its group ``g`` too.

    A node is the part of segment ``sid`` from its start ``x0`` on; its anchor lies at ``lead`` there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal kept, held
            if len(kept) > 1:
                numbers = {g: i for i, g in enumerate(dict.fromkeys(k[0] for k in kept))}
                found = repeated_runs([k[5] for k in kept], [k[3] for k in kept], [numbers[k[0]] for k in kept], length)
                rows = [(kept[i][1], kept[i][2] + a, kept[i][2] + b) for i, a, b in found if not kept[i][4]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int32()))], ["sid", "a", "b"])
            kept, held = [], 0

        group: list[tuple] = []  # the distinct segments of the anchor at hand
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("g", "sid", "x0", "lead", "known", "body"))):
                if group and row[0] != group[-1][0]:
                    if len(group) > 1:
                        kept += group
                        held += sum(len(g[5]) for g in group)
                    group = []
                    if held > array_bytes:
                        yield from flush()
                if not group or row[1] != group[-1][1]:
                    group.append(row)
        if len(group) > 1:
            kept += group
        yield from flush()

    dealt = nodes.select("g", "sid", "x0", "lead", "known", "body").repartition("g").sortWithinPartitions("g", "sid")
    return dealt.mapInArrow(run, "sid binary, a int, b int")


def halved(nodes: DataFrame, length: int) -> DataFrame:
    """Each node cut in two: the strings that start less than, and at least, half way before the anchor.

    ``la`` and ``lb`` bound how far before the anchor a group's strings start. All strings of a half cover the bytes
    from ``la`` before the anchor to ``length`` after the farthest start; the half's group is named by those bytes.
    """
    middle = F.floor((F.col("la") + F.col("lb")) / 2).cast("int")
    bands = F.array(F.struct(F.col("la").alias("ca"), middle.alias("cb")), F.struct(middle.alias("ca"), F.col("lb").alias("cb")))
    cut = nodes.where("lb - la > 1").withColumn("band", F.explode(bands)).select("*", "band.ca", "band.cb")
    cut = cut.withColumn("n0", F.greatest("x0", F.expr("off - cb + 1"))).withColumn("n1", F.least("x1", F.expr("off - ca + 1"))).where("n0 < n1")
    core = F.expr(f"substring(body, off - ca - x0 + 1, {length} + ca - cb + 1)")
    part = F.expr(f"substring(body, n0 - x0 + 1, n1 - n0 - 1 + {length})")
    return cut.select(F.xxhash64("g", "ca", "cb", core).alias("g"), "sid", F.col("n0").alias("x0"), F.col("n1").alias("x1"), "off", F.col("ca").alias("la"), F.col("cb").alias("lb"), part.alias("body"), "known")


def split_groups(nodes: DataFrame, length: int, group_bytes: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Split groups until each is small: (nodes of small groups, whole runs found on the way).

    The half of a string's span is halved in each round, so there are at most as many rounds as its bits; at the
    end a group's nodes are one string, and equal.
    """
    small, found = [], []
    nodes = materialise(nodes, "groups")
    while not nodes.isEmpty():
        halves = materialise(halved(nodes, length).withColumn("name", F.sha2("body", 256)), "halves")
        once = halves.groupBy("g", "name").agg(F.first(F.struct("sid", "x0", "x1", "off", "la", "lb", "body")).alias("r"), F.count(F.lit(1)).alias("n"), F.max("known").alias("known"))
        once = materialise(once.select("g", "name", "r.*", "n", (F.col("known") | (F.col("n") > 1)).alias("known")), "once")
        again = once.where("n > 1").select("g", "name")
        found.append(halves.where("not known").join(again, ["g", "name"]).select("sid", F.col("x0").alias("a"), (F.col("x1") - 1).alias("b")))
        sizes = once.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("body")).alias("bytes")).where("m > 1")
        kept = once.drop("n", "name").join(sizes, "g")
        small.append(kept.where(F.col("bytes") <= group_bytes).drop("m", "bytes"))
        nodes = materialise(kept.where(F.col("bytes") > group_bytes).drop("m", "bytes"), "groups")
    return small, found


def repeated_starts(rows: DataFrame, length: int = LENGTH, size: int = ANCHOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(key, d, a, b): for each text, runs of starts of strings that start elsewhere too."""
    level = in_small_batches(anchors(rows, length, size), "anchors")
    # a table of its own, so that the join can split a hot anchor
    twice = materialise(level.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    survivors = level.join(twice, "h").groupBy("key").agg(F.collect_list("at").alias("found"))
    made = in_small_batches(segments(rows, survivors, length, size), "segments")
    discard(level)
    at = made.where("kind = 'at'").select("sid", "key", "d", "lo", "starts")
    bodies = made.where("kind = 'body'").select(F.col("h").alias("g"), "sid", "starts", "off", "body")
    distinct = made.where("kind = 'at'").groupBy("h", "sid").agg(F.count(F.lit(1)).alias("n"), F.max("starts").alias("starts"))
    distinct = materialise(distinct, "distinct")
    equal = distinct.where("n > 1").select("sid", F.lit(0).alias("a"), (F.col("starts") - 1).alias("b"))
    large = distinct.groupBy(F.col("h").alias("g")).agg(F.sum(F.col("starts").cast("long") + (length - 1)).alias("bytes"), F.count(F.lit(1)).alias("m")).where((F.col("m") > 1) & (F.col("bytes") > group_bytes)).select("g")
    large = materialise(large, "large")
    as_node = lambda df: df.select("g", "sid", F.lit(0).alias("x0"), F.col("starts").alias("x1"), "off", F.lit(0).alias("la"), F.lit(length - size + 1).alias("lb"), "body", F.lit(False).alias("known"))
    small, whole = split_groups(as_node(bodies.join(large, "g", "left_semi").dropDuplicates(["sid"])), length, group_bytes)
    nodes = as_node(bodies.join(large, "g", "left_anti"))
    for more in small:
        nodes = nodes.unionByName(more)
    found = equal.unionByName(matched_segments(nodes.withColumn("lead", F.col("off") - F.col("x0")), length))
    for more in whole:
        found = found.unionByName(more)
    spans = at.join(found.distinct(), "sid").select("key", "d", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    spans = in_small_batches(spans, "spans")
    discard(made)
    return spans


def removed_runs(spans: DataFrame, length: int) -> DataFrame:
    """(key, found): of each text of that key its ``d``, its maximal removed runs, counted, the pieces (from, to) that stay before them, and where the last run ends."""
    # dealt as the table of texts is: one exchange for all that follows
    places = spans.select("key", "d", F.col("a").alias("begin"), (F.col("b") + length).alias("end")).repartition(partitions(spans.sparkSession), "key")
    so_far = W.partitionBy("key", "d").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    opens = places.withColumn("before", F.max("end").over(so_far)).withColumn("opens", F.expr("before is null or begin > before"))
    piece = F.when(F.col("opens"), F.struct(F.coalesce("before", F.lit(0)).alias("from"), F.col("begin").alias("to")))
    runs = opens.groupBy("key", "d").agg(F.count_if("opens").alias("n_spans"), F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("end").alias("last"))
    return runs.groupBy("key").agg(F.collect_list(F.struct("d", "n_spans", "pieces", "last")).alias("found"))


def removals(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_removed, n_spans, kept); ``kept`` is binary, as a cut may split a character."""
    rows = bucketed(keyed(docs), "key", "texts")
    runs = removed_runs(repeated_starts(rows, length, size, group_bytes), length)
    data = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    own = F.expr("filter(found, x -> x.d = d)[0]")
    marked = rows.join(runs.hint("shuffle_hash"), "key", "left").select("doc_id", data.alias("data"), own.alias("own"))
    # joined as hexadecimal text: array_join takes no binary, and a fold would copy what it has at each piece
    left = F.expr("unhex(concat(array_join(transform(own.pieces, p -> hex(substring(data, p.from + 1, p.to - p.from))), ''), hex(substring(data, own.last + 1))))")
    kept = marked.select("doc_id", F.octet_length("data").alias("size"), F.coalesce("own.n_spans", F.lit(0)).cast("long").alias("n_spans"), F.when(F.col("own").isNull(), F.col("data")).otherwise(left).alias("kept"))
    return kept.select("doc_id", (F.col("size") - F.octet_length("kept")).cast("long").alias("n_removed"), "n_spans", "kept")


def removal_report(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    found = removals(docs, length, size, group_bytes)
    return found.select("doc_id", F.octet_length("kept").cast("long").alias("__n"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).select(
        "doc_id", (F.col("__n") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"
    )
