"""The message feed as one stream: signatures, duplicates within a time to live, routing, then health and status of each streamer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessella.streaming.monitor import next_status, stateful
from tessella.streaming.webhook import TTL, routed, ttl_dedup, verified

FEED = "streamer string, arrival_ts timestamp, message_id string, kind string, state string, is_live boolean, active boolean, health string, error string"
_NAMES = ["streamer", "arrival_ts", "message_id", "kind", "state", "is_live", "active", "health", "error"]
_START = ("polling", False, False, "unsubscribed", None)


def feed_step(held: tuple, kind: str, detail: str | None) -> tuple:
    """(state, is_live, active, health, error) after an accepted message: it shows first that the feed is healthy; a revocation then degrades it."""
    health, error = ("degraded", detail) if kind == "degraded" else ("healthy", None)
    return (*next_status(*held[:3], kind), health, error)


def _accepted(messages: DataFrame, secret: str) -> DataFrame:
    return verified(messages, secret).where("problem is null").select("message_id", "message_type", "body", "arrival_ts")


def feed_status(messages: DataFrame, secret: str, ttl: int = TTL) -> DataFrame:
    """Batch: health and status of each streamer after each accepted message, in the order of arrival (then message_id).

    ``messages`` as in ``webhook.verified``. A message without a streamer changes no streamer's status.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, _START
        for frame in frames:
            out = []
            for streamer, at, name, kind, detail in frame.itertuples(index=False):
                if streamer != current:
                    current, held = streamer, _START
                held = feed_step(held, kind, detail)
                out.append((streamer, at, name, kind, *held))
            yield pd.DataFrame(out, columns=_NAMES)

    events = routed(ttl_dedup(_accepted(messages, secret), "message_id", "arrival_ts", ttl)).where("streamer is not null")
    rows = events.select("streamer", "arrival_ts", "message_id", "kind", "detail").repartition("streamer").sortWithinPartitions("streamer", "arrival_ts", "message_id")
    return rows.mapInPandas(run, FEED)


class Fresh(StatefulProcessor):
    """Messages that are no duplicate of one less than ``ttl`` seconds older; a timer drops a key's deadline when it has passed."""

    def __init__(self, columns: list[str], ttl: int):
        self.columns, self.ttl = columns, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deadline = handle.getValueState("deadline", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        deadline = self.deadline.get()[0] if self.deadline.exists() else None
        before, batch, keep = deadline, pd.concat(list(rows)).sort_values("arrival_ts", kind="stable"), []
        for t in batch["arrival_ts"].astype("datetime64[us]").astype("int64"):
            fresh = deadline is None or t >= deadline
            deadline = int(t) + self.ttl * 1_000_000 if fresh else deadline
            keep.append(fresh)
        if deadline != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            self.handle.registerTimer(deadline // 1000 + 1)
            self.deadline.update((deadline,))
        yield batch[keep][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.deadline.clear()
        return iter([])

    def close(self) -> None:
        pass


class Feed(StatefulProcessor):
    """``feed_step`` over a stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"state": T.StringType(), "is_live": T.BooleanType(), "active": T.BooleanType(), "health": T.StringType(), "error": T.StringType()}
        self.now = handle.getValueState("now", T.StructType([T.StructField(n, k) for n, k in kinds.items()]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = (tuple(self.now.get()) if self.now.exists() else _START), []
        for r in pd.concat(list(rows)).sort_values(["arrival_ts", "message_id"]).to_dict("records"):
            held = feed_step(held, r["kind"], r["detail"])
            out.append((r["streamer"], r["arrival_ts"], r["message_id"], r["kind"], *held))
        self.now.update(held)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def stream_feed(messages: DataFrame, secret: str, ttl: int = TTL, lateness: str = "10 minutes") -> DataFrame:
    """Streaming: as ``feed_status``, all of it in one query. Messages that arrive more than ``lateness`` after newer ones are dropped."""
    stateful(messages.sparkSession)
    accepted = _accepted(messages, secret).withWatermark("arrival_ts", lateness)
    columns = accepted.columns
    fresh = accepted.groupBy("message_id").transformWithStateInPandas(Fresh(columns, ttl), accepted.schema, "append", "eventTime", eventTimeColumnName="arrival_ts")
    events = routed(fresh).where("streamer is not null")
    return events.groupBy("streamer").transformWithStateInPandas(Feed(), FEED, "append", "eventTime")
