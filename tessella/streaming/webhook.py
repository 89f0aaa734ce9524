"""Webhook messages: signature, lateness, duplicates within a time to live, routing. Batch or streaming."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL, SKEW = 600, 600


def signature(secret: str, message_id: Column, message_ts: Column, body: Column) -> Column:
    """sha256= and the hex HMAC over id, timestamp and body."""

    @F.pandas_udf("string")
    def sign(text: pd.Series) -> pd.Series:
        key = secret.encode()
        return text.map(lambda t: "sha256=" + hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return sign(F.concat(F.coalesce(message_id, F.lit("")), F.coalesce(message_ts, F.lit("")), F.coalesce(body, F.lit(""))))


def verified(messages: DataFrame, secret: str, skew: int = SKEW) -> DataFrame:
    """``messages(message_id, message_type, message_ts, signature, body, arrival_ts)`` with ``problem``, null where all is well."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    sent = F.try_to_timestamp(F.col("message_ts"))
    gap = F.abs(F.unix_micros("arrival_ts") - F.unix_micros(sent)) / 1e6
    problem = (
        F.when(blank("message_id") | blank("message_ts") | blank("signature"), "missing header")
        .when(sent.isNull(), "bad timestamp").when(gap > skew, "outside the allowed skew")
        .when(F.col("signature") != signature(secret, F.col("message_id"), F.col("message_ts"), F.col("body")), "bad signature")
    )
    return messages.withColumn("problem", problem)


def ttl_dedup(messages: DataFrame, key: str, ts: str, ttl: int = TTL, then: str | None = None) -> DataFrame:
    """Batch: messages that are no duplicate of an accepted one less than ``ttl`` seconds older.

    A dropped duplicate does not extend the time; a blank key is never a duplicate. Each key's messages are
    sorted by time (and ``then``, which decides between messages of one time) in its task and streamed past the
    last accepted time, so a hot key needs no memory.
    """
    schema = messages.schema
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, deadline = None, None
        for frame in frames:
            keep = []
            for k, t in zip(frame[key], frame[ts]):
                fresh = k != current or t >= deadline
                if fresh:
                    current, deadline = k, t + pd.Timedelta(seconds=ttl)
                keep.append(fresh)
            yield frame[keep]

    rest = messages.where(~blank).repartition(key).sortWithinPartitions(key, ts, *([then] if then else []))
    return rest.mapInPandas(run, schema).unionByName(messages.where(blank))


def _fresh(times: pd.Series, deadline: int | None, ttl: int) -> tuple[np.ndarray, int]:
    """Which of one key's sorted ``times`` are no duplicates, and the deadline after them, in microseconds.

    It goes from one accepted time to the first that is not before its deadline, not over all rows. Missing times come last.
    """
    at, n = times.astype("datetime64[us]").astype("int64").to_numpy(), int(times.notna().sum())
    keep, i = np.zeros(len(at), dtype=bool), 0
    while True:
        if deadline is not None:
            i = max(i, int(np.searchsorted(at[:n], deadline)))
        if i >= (n if deadline is not None else len(at)):
            return keep, deadline
        keep[i], deadline, i = True, int(at[i]) + ttl, i + 1


def stream_ttl_dedup(messages: DataFrame, key: str, ts: str, ttl: int = TTL, then: str | None = None) -> DataFrame:
    """Streaming: as ``ttl_dedup``, with the deadline of each key as state that expires with the watermark of ``ts``.

    ``messages`` has a watermark on ``ts``; rows of a micro-batch are taken in the order of time and ``then``. A blank key is never a
    duplicate.
    """
    schema = messages.schema
    state = T.StructType([T.StructField("deadline", T.LongType())])

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        deadline = held.get[0] if held.exists else None
        rows = pd.concat(list(frames)).sort_values([ts, then] if then else ts, kind="stable")
        keep, deadline = _fresh(rows[ts], deadline, ttl * 1_000_000)
        held.update((deadline,))
        held.setTimeoutTimestamp(max(deadline // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    rest = messages.where(~blank).groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    return rest.unionByName(messages.where(blank))


_BODY = "challenge string, subscription struct<type:string,status:string>, event struct<broadcaster_user_login:string>"


def routed(messages: DataFrame) -> DataFrame:
    """Accepted messages as typed events: (message_id, arrival_ts, kind, streamer, detail)."""
    rows = messages.withColumn("j", F.from_json("body", _BODY))
    kind = (
        F.when(F.col("message_type") == "webhook_callback_verification", "challenge")
        .when((F.col("message_type") == "notification") & (F.col("j.subscription.type") == "stream.online"), "online")
        .when((F.col("message_type") == "notification") & (F.col("j.subscription.type") == "stream.offline"), "offline")
        .when(F.col("message_type") == "revocation", "degraded").otherwise("ignored")
    )
    typed = rows.withColumn("kind", kind)
    detail = F.when(F.col("kind") == "challenge", F.coalesce("j.challenge", F.lit(""))).when(F.col("kind") == "degraded", F.coalesce(F.nullif(F.col("j.subscription.status"), F.lit("")), F.lit("revoked")))
    return typed.select("message_id", "arrival_ts", "kind", F.nullif(F.lower(F.trim("j.event.broadcaster_user_login")), F.lit("")).alias("streamer"), detail.alias("detail"))
