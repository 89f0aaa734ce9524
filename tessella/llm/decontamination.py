"""Benchmark decontamination by a set of normalised test n-grams. SQL functions only.

Text is put in lower case (A-Z alone) and cut into words; a window is ``n`` consecutive words of an item, or
all of them in a shorter item. A hash of all words of a window gives a number below ``SLOTS``; the set of those
numbers goes to all tasks, so it has a bound whatever the benchmark's size. Documents are scanned with it in one
generated loop, and the text of what passes is verified by a join with the windows' texts. Of windows that are not in
the benchmark, a share of (windows / ``SLOTS``) passes at most. A document word inside any occurrence of a window is hit.

Defined results: a null or wordless text has no words and no hits; wordless items are skipped; repeated rows
and equal or null ids are each reported; equal texts share their result; empty tables give no rows or no hits; other
columns, whatever their names, are ignored by the report and kept by ``remove_contaminated``, but for ``__digest``,
which is reserved there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The broadcast set has so many numbers at most. More windows than that only let more through to be verified.
SLOTS = 1 << 21


def words_of(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # the two agree on ASCII, where ``lower`` is much the faster
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _slot(words: Column, at: Column, length: Column) -> Column:
    """The number of the window of ``length`` words from ``at`` (from 0) on; null where it would pass the end."""
    whole = F.get(words, at + length - 1).isNotNull()
    return F.when(whole, F.pmod(F.xxhash64(F.slice(words, at + 1, length)), F.lit(SLOTS)))


def _window(words: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct (length, window, slot, item_id)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    sized = items.where(F.size("words") > 0).select("item_id", "words", F.least(F.size("words"), F.lit(n)).alias("length"))
    at = sized.select("item_id", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    place = (F.col("words"), F.col("at"), F.col("length"))
    return at.select("item_id", "length", _window(*place).alias("window"), _slot(*place).alias("slot")).distinct()


def survivors(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """What the set lets through, (at, length, window), beside the columns of ``docs`` but its text; and for every
    document a row with ``at`` -1 and no window. ``n_words`` is the document's count."""
    names = [c for c in docs.columns if c != "text"]
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect()) or [n]  # n numbers at most
    base = docs.select(*names, words_of(F.col("text")).alias("words"))
    places = base.select(*names, "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "word")).drop("word")
    places = places.withColumn("length", F.explode(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else places.withColumn("length", F.lit(lengths[0]))
    at, length = F.col("place") - 1, F.col("length")
    marked = places.withColumn("of", F.when(at >= 0, _slot(F.col("words"), at, length)))
    slots = F.broadcast(windows.select(F.col("slot").alias("hit")).distinct())  # SLOTS numbers at most
    passed = marked.join(slots, F.col("of") == F.col("hit"), "left").where(F.col("hit").isNotNull() | ((at < 0) & (length == lengths[0])))
    window = F.when(at >= 0, _window(F.col("words"), at, length))
    return passed.select(*names, F.size("words").cast("long").alias("n_words"), at.alias("at"), "length", window.alias("window"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row a document: how many words it has, how many are hit, and by which items."""
    windows = materialise(benchmark_windows(benchmark, n), "windows")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # row numbers are given once: both sides below read them from this table
    found = materialise(survivors(rows, windows, n), "survivors")
    hits = found.where("at >= 0").select("row", "at", "length", "window").join(windows.select("length", "window", "item_id"), ["length", "window"])
    places = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("at", "length")), lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))))
    per_row = hits.groupBy("row").agg(F.size(places).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    joined = found.where("at < 0").select("row", "doc_id", "n_words").join(per_row, "row", "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without any hit, all columns kept. A document that holds a test passage goes whole.

    Documents are known by a digest of their text, as equal texts share their fate.
    """
    windows = materialise(benchmark_windows(benchmark, n), "windows")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = survivors(docs.select(digest.alias("digest"), "text"), windows, n).where("at >= 0")
    hit = found.join(windows.select("length", "window").distinct(), ["length", "window"], "left_semi").select(F.col("digest").alias("__digest")).distinct()
    return docs.withColumn("__digest", digest).join(hit, "__digest", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


CONTAMINATION_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM item WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, lengths WHERE len(w) >= k)),
hit AS (SELECT doc_id, dwin.k, i, item_id FROM dwin JOIN win USING (k, win)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN place ON doc.doc_id = place.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
"""
