"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are compared as 64-bit numbers with numpy: exclusive-or, then a bit count. Two fingerprints
that differ in r bits differ by at most r in the bit counts of their parts, so distinct fingerprints are
laid into tiles by the bit counts of ``parts`` equal parts, and a pair of tiles is compared only if those
counts differ by r in all at most. A tile with more than ``tile_rows`` fingerprints is cut into blocks.
The groups of similar texts (``one_of_each``) are found the same way; for small sets of shingles, whose SimHash bits
say little, the fingerprint is the parity of 128 buckets, which differs by no more bits than the sets by shingles.
Links join into components by alternating large and small stars; nothing goes through the driver but counts.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer than three
words are one shingle; equal texts share a fingerprint; a document without an id takes part and links others, and
its group's id is the smallest id that is not null (null if there is none; ids over 2^63 - 2^52 are reserved); repeated rows are each reported; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, run_digests, small_batches, word_digests

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Fingerprints, and shingle digests of sets, in a block of a tile.
TILE_ROWS, TILE_GRAMS = 4096, 1 << 20
#: Ids above this stand for fingerprints that only documents without an id have.
NAMELESS = 2**63 - 2**52
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of a text's word shingles: a bit is set if over half of the shingles' hashes have it."""
    words = WORD.findall((text or "").encode().lower())  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = map(join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [join(words)]
    votes, n = np.zeros(64, np.int64), 0
    while part := list(itertools.islice(shingles, 1 << 16)) if len(words) >= size else (shingles if not n else []):
        hashes = np.array([digest(s, SEED) for s in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _weights(digits: int) -> list[int]:
    return [128 ** (digits - 1 - i) for i in range(digits)]


def _steps(reaches: list[int], most: int) -> list[int]:
    """Differences of packed tile keys, over zero, whose digits differ by their reach at most and by ``most`` in all."""
    found = set()
    for d in itertools.product(*[range(-r, r + 1) for r in reaches]):
        if 0 < sum(map(abs, d)) <= most and (step := sum(w * x for w, x in zip(_weights(len(d)), d))) > 0:
            found.add(step)
    return sorted(found)


def tiled_pairs(
    classes: DataFrame, planes: list[str], digits: list[Column], reaches: list[int], most: int, radius: int, tile_size: int, weight: str | None = None,
    least: Fraction | None = None, only_first: bool = False,
) -> DataFrame:
    """(a, b), a > b: the ``rep`` of each pair of rows whose fingerprints differ by ``radius`` bits at most.

    A fingerprint is the columns ``planes``. Rows are laid into tiles by small whole numbers, ``digits``; a pair of
    tiles is compared if those differ by ``reaches`` at most, and by ``most`` in all. Tiles are cut into blocks of about
    ``tile_size`` rows, or of that sum of ``weight``; a block and what comes to it are a unit of work.

    With ``least``, the sizes ``n`` of two rows' sets must allow that Jaccard similarity. If the sets are there, as the
    column ``grams``, they must have it, and what a unit has joined already is not compared again: the pairs then
    tell all components, but not all pairs. With ``only_first``, a row is paired with the first near it in a unit alone:
    every row that has a pair is then still in one. Rows whose column ``by_size`` is 1 must also differ by no more bits
    than sets of their sizes with that similarity differ by members.
    """
    key = F.lit(0).cast("long")
    for w, d in zip(_weights(len(digits)), digits):
        key = key + F.lit(w) * d
    more = [c for c in ("n", "by_size", "grams") if c in classes.columns]
    columns = [*planes, "rep", *more]
    tiled = classes.select(*columns, key.cast("long").alias("tile"))
    # as many tiles as the digits have values, whatever the input
    total = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = F.broadcast(tiled.groupBy("tile").agg(F.ceil(total / tile_size).cast("int").alias("blocks")))
    placed = tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64(*planes), F.col("blocks")).cast("int"))
    unit = lambda tile, block: (tile * F.lit(1 << 24) + block).alias("unit")
    home = placed.select(unit(F.col("tile"), F.col("block")), F.lit(0).alias("role"), *columns)
    to_blocks = lambda upto: F.explode(F.when(upto > 0, F.sequence(F.lit(0), upto - 1)))
    same = placed.where("block > 0").select("tile", *columns, to_blocks(F.col("block")).alias("to"))
    steps = placed.select(*columns, F.explode(F.array(*[F.col("tile") - F.lit(d) for d in _steps(reaches, most)])).alias("tile"))
    near = steps.join(sizes, "tile").select("tile", *columns, to_blocks(F.col("blocks")).alias("to"))
    visits = same.unionByName(near).select(unit(F.col("tile"), F.col("to")), F.lit(1).alias("role"), *columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, its own first; visitors are compared as they stream by."""
        unit_of = _Unit(planes, radius, least, only_first)
        for b in batches:
            units, roles = b.column("unit").to_numpy(), b.column("role").to_numpy()
            values = {c: b.column(c).to_numpy() for c in columns if c != "grams"}
            if "grams" in more:
                lists = b.column("grams")
                ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
                flat = pa.compute.list_flatten(lists).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(roles) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(units)]):
                if s == e:
                    continue
                if units[s] != unit_of.name:
                    unit_of = _Unit(planes, radius, least, only_first, units[s])
                rows = {c: v[s:e] for c, v in values.items()}
                if "grams" in more:
                    rows["grams"] = [flat[x:y] for x, y in zip(ends[s:e], ends[s + 1 : e + 1])]
                for x, y in unit_of.take(rows, own=roles[s] == 0):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    rows = home.unionByName(visits)
    return rows.repartition("unit").sortWithinPartitions("unit", "role").mapInArrow(compare, "a long, b long")


class _Unit:
    """A block of fingerprints and what it has found so far."""

    def __init__(self, planes: list[str], radius: int, least: Fraction | None, only_first: bool, name: int | None = None):
        self.planes, self.radius, self.least, self.only_first, self.name = planes, radius, least, only_first, name
        self.own: dict = {}
        self.paired, self.roots = np.zeros(0, bool), np.zeros(0, np.int64)

    def take(self, rows: dict, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the rows with the unit's own; own rows are added, and each is compared with those before it."""
        before, n = len(self.roots), len(rows["rep"])
        if not own and not before:
            return  # no row fell into this block
        if own:
            join = lambda c, v: self.own[c] + v if isinstance(v, list) else np.concatenate([self.own[c], v])
            self.own = {c: join(c, v) if before else v for c, v in rows.items()}
            self.paired = np.concatenate([self.paired, np.zeros(n, bool)])
            self.roots = np.arange(before + n) if not before else np.concatenate([self.roots, np.arange(before, before + n)])
        for at in range(0, n, 256):
            part = {c: v[at : at + 256] for c, v in rows.items()}
            apart = sum(np.bitwise_count(part[p].view(np.uint64)[:, None] ^ self.own[p].view(np.uint64)[None, :]) for p in self.planes)
            i, j = np.nonzero(apart <= self.radius)
            if own:
                earlier = j < i + at + before
                i, j = i[earlier], j[earlier]
            if self.least is not None:
                x, y = part["n"][i], self.own["n"][j]
                up, down = self.least.numerator, self.least.denominator
                fits = np.minimum(x, y) * down >= np.maximum(x, y) * up
                if "by_size" in part:  # |A ^ B| <= (|A| + |B|) (1 - least) / (1 + least)
                    fits &= (part["by_size"][i] == 0) | (apart[i, j] * (down + up) <= (x + y) * (down - up))
                i, j = i[fits], j[fits]
            if "grams" in part:
                yield from self._joined(part, apart, i, j, before + at if own else None)
                continue
            if self.only_first and len(i):
                keep = np.zeros(len(i), bool)
                keep[np.unique(i, return_index=True)[1]] = True
                which, first = np.unique(j, return_index=True)
                keep[first[~self.paired[which]]] = True
                self.paired[which] = True
                i, j = i[keep], j[keep]
            yield part["rep"][i], self.own["rep"][j]

    def _joined(self, part: dict, apart: np.ndarray, i: np.ndarray, j: np.ndarray, place: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs with the similarity, the nearest first; of what is joined in this unit already, one pair is enough.

        ``place`` is where the part's first row is among the unit's own, or None for visitors.
        """
        begins = np.searchsorted(i, np.arange(len(part["rep"]) + 1))
        up, down = self.least.numerator, self.least.denominator
        found_x, found_y = [], []
        for row, (s, e) in enumerate(zip(begins[:-1], begins[1:])):
            if s == e:
                continue
            near, x = j[s:e], part["grams"][row]
            near = near[np.argsort(apart[row, near], kind="stable")]
            joined = [] if place is None else [self.roots[place + row]]
            step = 4
            while len(near := near[~np.isin(self.roots[near], joined)] if joined else near):
                some, near, step = near[:step], near[step:], min(256, 2 * step)
                sets = [self.own["grams"][k] for k in some.tolist()]
                sizes = np.array([len(v) for v in sets])
                values = np.concatenate(sets)
                hit = x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
                shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                for k in some[shared * down >= up * (len(x) + sizes - shared)].tolist():
                    if self.roots[k] not in joined:
                        joined.append(self.roots[k])
                        found_x.append(part["rep"][row])
                        found_y.append(self.own["rep"][k])
            if len(joined) > 1:
                self.roots[np.isin(self.roots, joined)] = min(joined)
        yield np.array(found_x, np.int64), np.array(found_y, np.int64)


def links(classes: DataFrame, radius: int = 2, parts: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b), a > b: the ``rep`` of each pair of distinct fingerprints within ``radius`` bits of each other.

    ``classes`` has one row (fp, rep) a distinct fingerprint. The bit counts of ``parts`` equal parts are the tiles.
    """
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]
    return tiled_pairs(classes, ["fp"], counts, [radius] * parts, radius, radius, tile_rows)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge table (a, b) with a > b."""
    edges = materialise(edges.where("a != b").distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(least, "a")
        small = kept.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "edges")
        # stars: each node hangs on one centre, and no centre hangs on another
        doubled = edges.groupBy("a").count().where("count > 1").select("a")
        chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
        if doubled.unionByName(chained).isEmpty():
            centres = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
    raise RuntimeError(f"no stars after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, parts: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = materialise(fingerprints(docs, size), "prints")
    nameless = F.lit(2**63 - 1) - F.monotonically_increasing_id()  # larger than all ids, so that it names no group that has one
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("rep", F.coalesce("rep", nameless)), "classes")
    stars = components(links(classes, radius, parts, tile_rows))
    named = F.coalesce("component", "rep")
    found = classes.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.when(named <= NAMELESS, named).alias("component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --------------------------------------------------------------------------- groups of similar texts

#: Of the 128 bits of a similarity fingerprint, how many two texts of a similarity of 0.8 differ in at most. In
#: simulations of 100 to 1,000 shingles a side, 5 to 10 pairs of 10,000 at just that similarity differ in more.
WIDE_RADIUS = 32
#: Sets of up to this many shingles are compared by parities instead, where no pair is missed.
SMALL_SET = 128
PRINTS = ["f0", "f1", "p0", "p1"]


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as two digests, sorted, and where each text's begin (one more entry: the end).

    Words are cut at ASCII white space and A-Z are folded; a text of fewer than ``size`` words is one shingle.
    """
    words, first = word_digests([t.lower() if t and t.isascii() else t and t.translate(FOLD) for t in texts])
    n = np.diff(first)
    long = np.flatnonzero(n >= size)
    runs = np.stack([run_digests(words, size, half) for half in (0, 1)], axis=1) if len(long) else np.empty((0, 2), np.uint64)
    doc = [np.repeat(long, n[long] - size + 1)]
    at = np.arange(len(doc[0])) + np.repeat(first[long] - np.cumsum(n[long] - size + 1) + n[long] - size + 1, n[long] - size + 1)
    values = [runs[at]]
    for i in np.flatnonzero((n > 0) & (n < size)).tolist():
        doc.append(np.array([i]))
        values.append(np.stack([run_digests(words[first[i] : first[i + 1]], int(n[i]), half) for half in (0, 1)], axis=1))
    owner, value = np.concatenate(doc), np.concatenate(values)
    by = np.lexsort((value[:, 1], value[:, 0], owner))
    owner, value = owner[by], value[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]).any(axis=1)
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def votes(hashes: np.ndarray) -> int:
    """A 64-bit SimHash; where the votes are even, the first hash decides."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        total += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    lead = np.unpackbits(hashes[:1].view(np.uint8), bitorder="little").astype(bool)
    return int(np.packbits((2 * total > n) | ((2 * total == n) & lead), bitorder="little").view("<u8")[0])


def parities(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """128 bits a set, as two numbers: whether an odd number of its members fall into each bucket.

    Two sets' bits differ in as many places, at most, as members are in one of them alone.
    """
    out = []
    for at in range(0, len(begins) - 1, 1024):
        edges = begins[at : at + 1025]
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        bucket = (values[edges[0] : edges[-1], 0] >> np.uint64(57)).astype(np.int64)
        odd = np.bincount(owner * 128 + bucket, minlength=128 * (len(edges) - 1)).reshape(-1, 128) & 1
        out.append(np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8"))
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def text_classes(docs: DataFrame, size: int) -> DataFrame:
    """(d, text_key, name, n, f0, f1, p0, p1) for each row: its text's digest, that of its shingle set, its fingerprint and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            values, begins = shingle_sets(b.column("text").to_pylist(), size)
            cut = list(zip(begins[:-1].tolist(), begins[1:].tolist()))
            names = [hashlib.blake2b(values[s:e].tobytes(), digest_size=16).digest() for s, e in cut]
            prints = [np.array([votes(np.ascontiguousarray(values[s:e, half])) if e > s else 0 for s, e in cut], np.uint64).view(np.int64) for half in (0, 1)]
            odd = parities(values, begins).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("text_key"), pa.array(names, pa.binary()), pa.array(np.diff(begins).astype(np.int64)), *map(pa.array, prints), pa.array(odd[:, 0]), pa.array(odd[:, 1])], ["d", "text_key", "name", "n", *PRINTS])

    return docs.select(*row_names(), "text").mapInArrow(run, "d long, text_key string, name binary, n long, f0 long, f1 long, p0 long, p1 long")


def row_names() -> list[Column]:
    """``d``, the id with the greatest number for null, and ``text_key``, the text's digest: rows that agree in both
    are repeated rows."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key")]


def with_sets(classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``classes`` with ``grams``, the sorted shingle digests of a text of each; ``texts`` is (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            values, begins = shingle_sets(b.column("text").to_pylist(), size)
            grams = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values[:, 0].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rep"), grams], ["rep", "grams"])

    return classes.join(texts.mapInArrow(run, "rep long, grams array<long>"), "rep")


def similar_classes(classes: DataFrame, texts: DataFrame, least: Fraction, size: int, radius: int, tile_rows: int, tile_grams: int, small: int = SMALL_SET) -> DataFrame:
    """(node, component) of the classes (rep, n, PRINTS) that links of ``least`` similarity or more join.

    Sets of up to ``small`` shingles are compared by their parities, which differ by (n + n') (1 - least) / (1 + least)
    bits at most; larger ones by SimHash. Sets whose sizes can have a partner on the other side are compared both ways.

    The first pass over the tiles tells which fingerprints have another near them. The second carries the sets of
    those, and checks each pair where it is found, so that no pairs but links leave a task.
    """
    way = lambda by_size, planes: F.struct(F.lit(by_size).cast("long").alias("by_size"), *[F.col(p).alias(q) for p, q in zip(planes, "pq")])
    ways = F.filter(F.array(F.when(F.col("n") <= small, way(1, ["p0", "p1"])), F.when(F.col("n") > int(small * least), way(0, ["f0", "f1"]))), lambda w: w.isNotNull())
    compared = classes.select("rep", "n", F.explode(ways).alias("w")).select("rep", "n", "w.*")
    # two sets of that similarity are of one band of sizes or of neighbouring ones; bit counts lie in bands of the radius
    digits = [F.col("by_size"), F.floor(F.log("n") / float(-np.log(float(least)))).cast("int"), F.floor((F.bit_count("p") + F.bit_count("q")) / (radius + 1)).cast("int")]
    tiles = (["p", "q"], digits, [0, 1, 1], 2, max(radius, int(2 * small * (1 - least) / (1 + least))))
    near = tiled_pairs(compared, *tiles, tile_rows, least=least, only_first=True)
    near = materialise(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "near")
    some = with_sets(compared.join(near, "rep", "left_semi"), texts.join(near, "rep", "left_semi"), size)
    return components(tiled_pairs(materialise(some, "sets"), *tiles, tile_grams, weight="n", least=least))


def one_of_each(docs: DataFrame, least: float = 0.8, size: int = 5, radius: int = WIDE_RADIUS, tile_rows: int = TILE_ROWS, tile_grams: int = TILE_GRAMS) -> DataFrame:
    """One row of each group of similar texts: that with the smallest id (null last), and of those the least digest.

    Texts are linked where the Jaccard similarity of their sets of ``size``-word shingles is ``least`` or more: all such
    pairs of sets of up to ``SMALL_SET`` shingles, and of larger ones those whose SimHash fingerprints differ by
    ``radius`` of 128 bits at most. Wordless texts are alike.
    Of repeated rows of that document one stays.
    """
    rows = materialise(text_classes(docs, size), "prints")
    by_name = rows.groupBy("name", "n", *PRINTS).agg(F.min(F.struct("d", "text_key")).alias("best"))
    classes = materialise(by_name.select(F.monotonically_increasing_id().alias("rep"), "name", "n", *PRINTS, "best"), "classes")
    keys = classes.where("n > 0").select("rep", "best.d", "best.text_key")
    texts = docs.select(*row_names(), "text").join(keys, ["d", "text_key"]).select("rep", "text").dropDuplicates(["rep"])
    stars = similar_classes(classes.where("n > 0").select("rep", "n", *PRINTS), texts, Fraction(str(least)), size, radius, tile_rows, tile_grams)
    placed = classes.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select("name", "best", F.coalesce("component", "rep").alias("component"))
    placed = materialise(placed, "placed")
    best = placed.groupBy("component").agg(F.min("best").alias("kept"))
    named = rows.groupBy("name", "d", "text_key").agg(F.count(F.lit(1)).alias("times"))
    judged = materialise(named.join(placed.join(best, "component").select("name", "kept"), "name").select("d", "text_key", "times", (F.struct("d", "text_key") == F.col("kept")).alias("stays")), "judged")
    columns, key = [F.col(f"`{c}`") for c in docs.columns], ["__d", "__text_key"]
    of = lambda where: judged.where(where).select(F.col("d").alias("__d"), F.col("text_key").alias("__text_key"))
    d, text_key = row_names()
    kept = docs.withColumns({"__d": d, "__text_key": text_key}).join(of("not stays"), key, "left_anti")
    again = of("stays and times > 1")
    once = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return once.select(*columns)
