"""Hierarchical packing of token streams into windows of several lengths.

Documents are routed to the shortest tier (512, 1024, 2048 or 4096 tokens) that holds them; longer ones are
first cut into whole windows of the longest tier. Each tier is packed, longest first: a window opens with the
longest waiting piece and its gap is filled with the longest pieces that fit, from its own and shorter tiers;
the last gap is closed by cutting one piece. So every window is full, and windows are powers of two. What is
left at the end of a task is packed into shorter powers of two. Windows wait until a step group is full: the
largest waiting ones first, which fill it exactly, as all sizes are powers of two. Only a task's last group may be short.

Packing is local to a task (a split of the input), and needs no shuffle; ``sequence_id`` joins the number of
the split to a count.

Defined results: a null or empty text is its end id alone; repeated rows are packed one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches
from tessella.llm.encoding import ENCODE_BYTES, encoder

TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group.
STEP_TOKENS = 16 * 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


class Packer:
    """Pieces wait in a sorted list of (length, number); windows come out as lists of (number, take)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.waiting, self.total, self.count = tiers, [], 0, 0
        self.pieces: dict[int, tuple] = {}

    def add(self, doc_id: int | None, ids: np.ndarray, start: int, doc_tokens: int) -> None:
        self.pieces[self.count] = (doc_id, ids, start, doc_tokens)
        bisect.insort(self.waiting, (len(ids), self.count))
        self.total, self.count = self.total + len(ids), self.count + 1

    def _take(self, at: int, most: int) -> tuple:
        """Remove a waiting piece, or its first ``most`` tokens; the rest waits on."""
        length, number = self.waiting.pop(at)
        doc_id, ids, start, doc_tokens = self.pieces.pop(number)
        self.total -= length
        if length > most:
            self.add(doc_id, ids[most:], start + most, doc_tokens)
        return doc_id, ids[:most], start, doc_tokens

    def window(self, size: int) -> list[tuple]:
        """A full window of ``size`` tokens; as many must wait."""
        out, gap = [], size
        while gap:
            at = bisect.bisect_right(self.waiting, (gap, self.count)) - 1
            if at >= 0:
                out.append(self._take(at, gap))
            else:  # all that waits is longer than the gap: cut the shortest
                out.append(self._take(0, gap))
            gap -= len(out[-1][1])
        return out

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple]]]:
        longest = self.tiers[-1]
        for i in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[i], self.tiers[i - 1] if i else 0
            while self.waiting and self.waiting[-1][0] > below and self.total >= (tier if last else max(tier, 2 * longest)):
                yield tier, self.window(tier)
        if last:
            size = longest
            while self.total:
                while size > self.total:
                    size //= 2
                yield size, self.window(size)


def step_groups(waiting: list[tuple[int, list[tuple]]], last: bool, step_tokens: int = STEP_TOKENS) -> Iterator[list[tuple[int, list[tuple]]]]:
    """Take groups of exactly ``step_tokens`` tokens out of the ``waiting`` windows; ``last`` gives the rest as one more.

    Every size is a power of two that divides ``step_tokens``, so the largest windows first fill a group without a gap.
    """
    waiting.sort(key=lambda w: -w[0])  # stable: equal sizes keep their order
    tokens, begin = 0, 0
    for i, (size, _) in enumerate(waiting):
        tokens += size
        if tokens == step_tokens:
            yield waiting[begin : i + 1]
            tokens, begin = 0, i + 1
    del waiting[:begin]
    if last and waiting:
        yield waiting[:]
        waiting.clear()


def pack(docs: DataFrame, tokenizer_path: str, unit: str = "word", end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence."""
    if step_tokens % tiers[-1] or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two, and a step group a multiple of the longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path, unit), Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        made, groups, held = 0, 0, []

        def out(found: list[tuple[int, list[tuple]]], last: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal made, groups
            held.extend(found)
            cols: list[list] = [[] for _ in range(9)]
            for group in step_groups(held, last, step_tokens):
                for size, window in group:
                    offset = 0
                    for doc_id, ids, start, doc_tokens in window:
                        row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, base + made, offset, size, base + groups)
                        for c, v in zip(cols, row):
                            c.append(v)
                        offset += len(ids)
                    made += 1
                groups += 1
            if cols[0]:
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        for b in small_batches(batches, most=ENCODE_BYTES // 2):
            whole = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                ids, at = np.append(ids, np.uint32(end_id)), 0
                while len(ids) - at > tiers[-1]:
                    whole.append((tiers[-1], [(doc_id, ids[at : at + tiers[-1]], at, len(ids))]))
                    at += tiers[-1]
                packer.add(doc_id, ids[at:], at, len(ids))
            yield from out(whole + list(packer.windows(False)))
        yield from out(list(packer.windows(True)), True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
