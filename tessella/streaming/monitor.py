"""Per-streamer status over typed events, live chunking over snapshots, and fallback polls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.streaming.webhook import ttl_dedup

CHUNK_SECONDS, LAG_SECONDS, FINAL_CHECKS, POLL_SECONDS = 60, 120, 3, 120
STATUS = "streamer string, ts timestamp, event_id long, kind string, state string, is_live boolean, active boolean"


@lru_cache(maxsize=1024)
def next_status(state: str, is_live: bool, active: bool, kind: str) -> tuple[str, bool, bool]:
    """One step: online starts a session if none runs; offline lets a running one go on; done and failed end it."""
    if kind == "online":
        return "ingesting", True, True
    if kind == "offline":
        return ("ingesting" if active else "polling"), False, active
    if kind == "failed":
        return "error", is_live, False
    if kind == "done":
        return "polling", is_live, False
    if kind == "degraded" and state == "idle":
        return "idle", is_live, active
    return state, is_live, active


def status_fold(events: DataFrame) -> DataFrame:
    """The status after each of ``events(streamer, ts, event_id, kind)``, in time order.

    Rows are sorted by streamer and time in their task and streamed, so a busy streamer needs no memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, ("polling", False, False)
        for frame in frames:
            out = []
            for streamer, kind in zip(frame["streamer"].tolist(), frame["kind"].tolist()):
                if streamer != current:
                    current, held = streamer, ("polling", False, False)
                held = next_status(*held, kind)
                out.append(held)
            yield frame.assign(state=[o[0] for o in out], is_live=[o[1] for o in out], active=[o[2] for o in out])

    rows = events.where("streamer is not null").select("streamer", "ts", "event_id", "kind").repartition("streamer").sortWithinPartitions("streamer", "ts", "event_id")
    return rows.mapInPandas(run, STATUS)


def stream_status(events: DataFrame) -> DataFrame:
    """Streaming: as ``status_fold``; the state of each streamer is kept between micro-batches."""
    kept = T.StructType([T.StructField("state", T.StringType()), T.StructField("is_live", T.BooleanType()), T.StructField("active", T.BooleanType())])

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(held.get) if held.exists else ("polling", False, False)
        rows, out = pd.concat(list(frames)).sort_values(["ts", "event_id"]), []
        for kind in rows["kind"].tolist():
            now = next_status(*now, kind)
            out.append(now)
        held.update(now)
        yield rows[["streamer", "ts", "event_id", "kind"]].assign(state=[o[0] for o in out], is_live=[o[1] for o in out], active=[o[2] for o in out])

    return events.groupBy("streamer").applyInPandasWithState(run, STATUS, kept, "append", GroupStateTimeout.NoTimeout)


CHUNKS = "streamer string, vod_id string, start long, length long, status string"
POLLS = "streamer string, ts timestamp, event_id long, vod_id string, start long, length long, still long, afresh boolean, status string"
_PLACE = ("vod_id", "cursor", "longest", "still", "over", "asked")


def _enter(held: dict, row: dict) -> bool | None:
    """Take a snapshot's recording and status into ``held``: whether it starts afresh, or None if the recording is over.

    A new recording goes on from its saved place. One that is deleted or searchable is over. One that is to be
    reindexed starts afresh, once, until its status says something else.
    """
    status, new = row.get("video_status"), row["vod_id"] != held.get("vod_id")
    if new:
        saved = {c: 0 if pd.isna(row.get(c)) else int(row[c]) for c in ("saved_seconds", "saved_longest")}
        held.clear()
        held.update(vod_id=row["vod_id"], cursor=saved["saved_seconds"], longest=saved["saved_longest"], still=0, over=False, asked=False)
    afresh = status == "reindex_requested" and not held["asked"]
    held["asked"] = status == "reindex_requested"
    if afresh:
        held.update(cursor=0, longest=0, over=False)
    held["over"] = held["over"] or status in ("deleted", "searchable")
    return None if held["over"] else afresh


def _grow(held: dict, row: dict, lag: int) -> int:
    """Where the snapshot lets chunks end. Growth alone resets the count of still checks; checks while live do not count."""
    if row["duration_seconds"] > held["longest"]:
        held.update(longest=row["duration_seconds"], still=0)
    elif not row["is_live"]:
        held["still"] += 1
    return held["longest"] - (lag if row["is_live"] else 0)


def live_step(held: dict, row: dict, seconds: int, lag: int, checks: int) -> list[tuple]:
    """All chunks that one snapshot allows, ``indexing`` when it starts afresh, and ``searchable`` when the recording is over."""
    afresh = _enter(held, row)
    if afresh is None:
        return []
    out = [(row["streamer"], row["vod_id"], 0, 0, "indexing")] if afresh else []
    end = _grow(held, row, lag)
    while end > held["cursor"]:
        length = min(seconds, end - held["cursor"])
        out.append((row["streamer"], row["vod_id"], held["cursor"], length, "chunk"))
        held["cursor"] += length
    if not row["is_live"] and held["still"] >= checks:
        held["over"] = True
        out.append((row["streamer"], row["vod_id"], held["cursor"], 0, "searchable"))
    return out


def poll_step(held: dict, under_way: int | None, row: dict, seconds: int, lag: int, checks: int) -> tuple[int | None, tuple | None]:
    """One poll: it commits the chunk under way and brings at most one new one. The end of that, and the poll's row if the recording is not over.

    A chunk that no later poll commits is not counted as ingested: after a restart from the saved place it comes again.
    """
    if under_way is not None and held:
        held["cursor"] = under_way
    afresh = _enter(held, row)
    if afresh is None:
        return None, None
    end, start = _grow(held, row, lag), held["cursor"]
    length = max(0, min(seconds, end - start))
    held["over"] = not length and not row["is_live"] and held["still"] >= checks
    status = "chunk" if length else "searchable" if held["over"] else "waiting"
    return (start + length if length else None), (row["streamer"], row["ts"], row["event_id"], row["vod_id"], start, length, held["still"], afresh, status)


_NAMES = ["streamer", "vod_id", "start", "length", "status"]
_POLL_NAMES = ["streamer", "ts", "event_id", "vod_id", "start", "length", "still", "afresh", "status"]
PLACE = T.StructType([T.StructField("vod_id", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("cursor", "longest", "still")], *[T.StructField(n, T.BooleanType()) for n in ("over", "asked")]])


def _place(held: dict) -> tuple:
    return held["vod_id"], int(held["cursor"]), int(held["longest"]), int(held["still"]), bool(held["over"]), bool(held["asked"])


_SAVED = {"video_status": "string", "saved_seconds": "long", "saved_longest": "long"}


def _snapshots(rows: DataFrame) -> DataFrame:
    """Snapshots with the columns that may be left out: the video's status and where its recording was left."""
    may = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _SAVED.items()]
    return rows.select("streamer", "ts", "event_id", "vod_id", "is_live", "duration_seconds", *may)


def _records(rows: pd.DataFrame) -> Iterator[dict]:
    """The rows as dictionaries of plain values, one at a time; the names and the columns are taken once."""
    names = list(rows.columns)
    return (dict(zip(names, values)) for values in zip(*(rows[c].tolist() for c in names)))


def live_chunks(snapshots: DataFrame, seconds: int = CHUNK_SECONDS, lag: int = LAG_SECONDS, checks: int = FINAL_CHECKS) -> DataFrame:
    """Batch: chunks over ``snapshots(streamer, ts, event_id, vod_id, is_live, duration_seconds)`` in time order.

    ``video_status``, ``saved_seconds`` and ``saved_longest`` may follow: see ``live_step``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, {}
        for frame in frames:
            out = []
            for row in _records(frame):
                if row["streamer"] != current:
                    current, held = row["streamer"], {}
                out += live_step(held, row, seconds, lag, checks)
            yield pd.DataFrame(out, columns=_NAMES)

    rows = _snapshots(snapshots).repartition("streamer").sortWithinPartitions("streamer", "ts", "event_id")
    return rows.mapInPandas(run, CHUNKS)


def stream_live_chunks(snapshots: DataFrame, seconds: int = CHUNK_SECONDS, lag: int = LAG_SECONDS, checks: int = FINAL_CHECKS) -> DataFrame:
    """Streaming: as ``live_chunks``. Chunks may be replayed after a failure; the keyed writes take that."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(_PLACE, state.get)) if state.exists else {}
        rows, out = pd.concat(list(frames)).sort_values(["ts", "event_id"]), []
        for row in _records(rows):
            out += live_step(held, row, seconds, lag, checks)
        state.update(_place(held))
        yield pd.DataFrame(out, columns=_NAMES)

    return _snapshots(snapshots).groupBy("streamer").applyInPandasWithState(run, CHUNKS, PLACE, "append", GroupStateTimeout.NoTimeout)


def live_polls(snapshots: DataFrame, seconds: int = CHUNK_SECONDS, lag: int = LAG_SECONDS, checks: int = FINAL_CHECKS) -> DataFrame:
    """Batch: what each poll of ``snapshots`` (as in ``live_chunks``) brings and commits; see ``poll_step``. ``start`` is where the recording is committed to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, under_way = None, {}, None
        for frame in frames:
            out = []
            for row in _records(frame):
                if row["streamer"] != current:
                    current, held, under_way = row["streamer"], {}, None
                under_way, found = poll_step(held, under_way, row, seconds, lag, checks)
                out += [found] if found else []
            yield pd.DataFrame(out, columns=_POLL_NAMES)

    rows = _snapshots(snapshots).repartition("streamer").sortWithinPartitions("streamer", "ts", "event_id")
    return rows.mapInPandas(run, POLLS)


class LivePolls(StatefulProcessor):
    """``poll_step`` over a stream: the place of each streamer's recording, and the chunk under way as a list of its own."""

    def __init__(self, seconds: int, lag: int, checks: int):
        self.how = (seconds, lag, checks)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE)
        self.under_way = handle.getListState("under_way", T.StructType([T.StructField("end", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(_PLACE, self.place.get())) if self.place.exists() else {}
        ends = [r[0] for r in self.under_way.get()] if self.under_way.exists() else []
        end, out = (int(ends[0]) if ends else None), []
        for row in _records(pd.concat(list(rows)).sort_values(["ts", "event_id"])):
            end, found = poll_step(held, end, row, *self.how)
            out += [found] if found else []
        self.place.update(_place(held))
        if end is None:
            self.under_way.clear()
        else:
            self.under_way.put([(int(end),)])
        yield pd.DataFrame(out, columns=_POLL_NAMES)

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """The state store that processors with several states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_live_polls(snapshots: DataFrame, seconds: int = CHUNK_SECONDS, lag: int = LAG_SECONDS, checks: int = FINAL_CHECKS) -> DataFrame:
    """Streaming: as ``live_polls``."""
    stateful(snapshots.sparkSession)
    return _snapshots(snapshots).groupBy("streamer").transformWithStateInPandas(LivePolls(seconds, lag, checks), POLLS, "append", "none")


def fallback_polls(polls: DataFrame, health: DataFrame, every: int = POLL_SECONDS) -> DataFrame:
    """Polls ``(streamer, ts)`` admitted where the feed was not healthy: the last of ``health(streamer, ts, healthy)`` before them.

    After an admitted poll of a streamer, none is admitted for ``every`` seconds (5 at least).
    """
    both = polls.select("streamer", "ts", F.lit(None).cast("boolean").alias("healthy"), F.lit(1).alias("poll")).unionByName(health.select("streamer", "ts", "healthy", F.lit(0).alias("poll")))
    w = W.partitionBy("streamer").orderBy("ts", "poll").rowsBetween(W.unboundedPreceding, 0)
    judged = both.withColumn("last", F.last("healthy", ignorenulls=True).over(w)).where((F.col("poll") == 1) & ~F.coalesce("last", F.lit(False)))
    return ttl_dedup(judged.select("streamer", "ts"), "streamer", "ts", max(5, every))


class FallbackPolls(StatefulProcessor):
    """``fallback_polls`` over a stream: whether the feed was last healthy, and when the next poll may come."""

    def __init__(self, every: int):
        self.every = max(5, every)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", T.StructType([T.StructField("healthy", T.BooleanType()), T.StructField("next", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        healthy, after = tuple(self.now.get()) if self.now.exists() else (False, None)
        batch, out = pd.concat(list(rows)), []
        batch["poll"] = batch["healthy"].isna()
        for r in batch.sort_values(["ts", "poll"], kind="stable").itertuples(index=False):
            at = r.ts.value // 1000
            if not r.poll:
                healthy = bool(r.healthy)
            elif not healthy and (after is None or at >= after):
                after = at + self.every * 1_000_000
                out.append((r.streamer, r.ts))
        self.now.update((healthy, after))
        yield pd.DataFrame(out, columns=["streamer", "ts"])

    def close(self) -> None:
        pass


def stream_fallback_polls(events: DataFrame, every: int = POLL_SECONDS) -> DataFrame:
    """Streaming: as ``fallback_polls`` over ``events(streamer, ts, healthy)``, polls being rows whose ``healthy`` is null."""
    stateful(events.sparkSession)
    kinds = ", ".join(f"{c} {dict(events.dtypes)[c]}" for c in ("streamer", "ts"))
    return events.select("streamer", "ts", "healthy").groupBy("streamer").transformWithStateInPandas(FallbackPolls(every), kinds, "append", "none")
