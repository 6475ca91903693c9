"""Structured Streaming forms of the operators that keep state over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions.text import content_hash


def dedup_stream(events: DataFrame, seconds: int = 300, by: str = "user_id", text: str = "text", at: str = "ts", late: str = "10 minutes", shards: int = 1024) -> DataFrame:
    """Events of which an equal text of the user was accepted no more than ``seconds`` of event time before are left out.

    As ``governance.dedup_window``: rejected repeats don't prolong the wait. The state is
    the time of the last accepted row of a text; it goes once the watermark has
    passed the wait. Rows later than the watermark are dropped; those of one batch
    are taken in order of time. A user's text is a key of 16 bytes, and ``shards``
    groups of keys have a state each: a call of Python a group, not a key.
    """
    names, wait = list(events.columns), seconds * 1_000_000

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], dtype=[("key", "V16"), ("last", "i8")]) if state.exists else None
        last = dict(zip(map(bytes, held["key"].tolist()), held["last"].tolist())) if held is not None else {}
        passed = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("__us", kind="stable")
            taken = []
            for k, us in zip(map(bytes, rows["__k"].tolist()), rows["__us"].tolist()):
                before = last.get(k)
                taken.append(before is None or us - before > wait)
                if taken[-1]:
                    last[k] = us
            yield rows.loc[np.array(taken), names]
        last = {k: us for k, us in last.items() if us + wait >= passed}
        if not last:
            state.remove()
            return
        out = np.zeros(len(last), dtype=[("key", "V16"), ("last", "i8")])
        out["key"], out["last"] = np.frombuffer(b"".join(last), dtype="V16"), np.fromiter(last.values(), np.int64, len(last))
        state.update((out.tobytes(),))
        state.setTimeoutTimestamp(max((min(last.values()) + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    user = F.coalesce(F.concat(F.lit("+"), F.col(by).cast("string")), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.coalesce(content_hash(F.trim(text)), F.lit("")), F.lit("|"), user).cast("binary")))
    keyed = events.withWatermark(at, late).withColumns({"__us": F.unix_micros(F.col(at).cast("timestamp")), "__k": key}).withColumn("__s", F.pmod(F.xxhash64("__k"), F.lit(shards)))
    return keyed.groupBy("__s").applyInPandasWithState(keep, events.schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def access_counts(logs: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Accesses by type in tumbling or sliding windows of event time."""
    w = F.window("accessed_at", width, slide) if slide else F.window("accessed_at", width)
    out = logs.withWatermark("accessed_at", late).groupBy(w, "access_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "access_type", "n")


def access_sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of an app: runs of accesses without a pause of ``gap``."""
    out = logs.withWatermark("accessed_at", late).groupBy(F.session_window("accessed_at", gap), "app_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "app_id", "n")


def strength_stream(logs: DataFrame, half_life: float = 7.0) -> DataFrame:
    """(memory_id, access_count, last_us, least, strength) after each batch of accesses, in order of time.

    Strength decays by half in ``half_life`` days and reading brings it back to 1.
    ``least`` is the lowest that it had come to when the memory was read, ``strength``
    what it has at ``now`` (a column of the logs; without it, at the last access).
    """
    day = 86400e6

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, least = state.get if state.exists else (0, None, 1.0)
        rows = pd.concat(list(batches))
        for us in sorted(rows["us"].tolist()):
            if last is not None:
                least = min(least, 0.5 ** (max(us - last, 0) / (half_life * day)))
            count, last = count + 1, us if last is None else max(last, us)
        state.update((count, last, least))
        now = int(rows["now_us"].max())
        yield pd.DataFrame({"memory_id": [key[0]], "access_count": [count], "last_us": [last], "least": [round(least, 9)], "strength": [round(0.5 ** (max(now - last, 0) / (half_life * day)), 9)]})

    us = F.unix_micros(F.col("accessed_at").cast("timestamp"))
    rows = logs.select("memory_id", us.alias("us"), (F.unix_micros(F.col("now").cast("timestamp")) if "now" in logs.columns else us).alias("now_us"))
    return rows.groupBy("memory_id").applyInPandasWithState(update, "memory_id long, access_count long, last_us long, least double, strength double", "n long, last long, least double", "update", GroupStateTimeout.NoTimeout)


def rule_stream(outcomes: DataFrame) -> DataFrame:
    """(rule_id, helpful_count, harmful_count, deprecated) after each batch; deprecation sticks. Outcomes of a batch count in order of ``seq``."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        h, m, bad = state.get if state.exists else (0, 0, False)
        for helpful in pd.concat(list(batches)).sort_values("seq")["helpful"]:
            h, m = (h + 1, m) if helpful else (h, m + 1)
            bad = bad or (m > h and m >= 3)
        state.update((h, m, bool(bad)))
        yield pd.DataFrame({"rule_id": [key[0]], "helpful_count": [h], "harmful_count": [m], "deprecated": [bool(bad)]})

    return outcomes.select("rule_id", "seq", "helpful").groupBy("rule_id").applyInPandasWithState(update, "rule_id long, helpful_count long, harmful_count long, deprecated boolean", "h long, m long, bad boolean", "update", GroupStateTimeout.NoTimeout)
