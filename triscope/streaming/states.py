"""Streams of events: the state of each process, rates within a window, repeated deliveries.

``process_states`` is the streaming twin of ``triscope.operators.sequences.fold_states`` for events that arrive in order within
a key; both give the same end states. A process that is silent for ``timeout`` of event time fails; an ended one is remembered for as
long and then removed, so that the state holds recent processes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "process string, state string, n_events bigint, n_failed int"
_HELD = "state string, n_events bigint, n_failed int"
ENDED = ("DONE", "FAILED")


def step(state: str, n_failed: int, kind: str, retries: int) -> tuple[str, int]:
    """The state after one event; ended processes stay as they are."""
    if state in ENDED:
        return state, n_failed
    if kind == "done":
        return "DONE", n_failed
    if kind == "failed":
        n_failed += 1
        return ("FAILED" if n_failed > retries else "PARSING"), n_failed
    return "PARSING", n_failed


def process_states(events: DataFrame, delay: str = "1 hour", timeout_ms: int = 30 * 60 * 1000, retries: int = 2) -> DataFrame:
    """Updates of each process' state. ``events`` streams process, ts, event_id, kind; those without process or time fall away."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, n, failed = held.get if held.exists else ("PENDING", 0, 0)
        if held.hasTimedOut:
            if state in ENDED:
                held.remove()
                return
            state = "FAILED"
        else:
            rows = sorted(x for f in frames for x in zip(f["ts"].tolist(), f["event_id"].tolist(), f["kind"].tolist()))
            for _, _, kind in rows:
                state, failed = step(state, failed, kind, retries)
            n += len(rows)
        held.update((state, n, failed))
        last = 0 if held.hasTimedOut else int(rows[-1][0].timestamp() * 1000)
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + timeout_ms)  # ended ones are kept as long, then removed
        yield pd.DataFrame([(key[0], state, n, failed)], columns=["process", "state", "n_events", "n_failed"])

    once = delivered_once(events.where("process is not null and ts is not null"), delay)
    return once.groupBy("process").applyInPandasWithState(update, STATES, _HELD, "update", GroupStateTimeout.EventTimeTimeout)


def delivered_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, however often it is delivered within ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["process", "event_id"])


def rates(events: DataFrame, key: str, window: str = "5 minutes", slide: str = "1 minute", least: int = 10, delay: str = "10 minutes") -> DataFrame:
    """Keys with ``least`` or more events in a sliding window; late events count up to ``delay``."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, gap: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    counted = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def progress_lines(stream: DataFrame, value: str = "value") -> DataFrame:
    """Lines of a worker's output: JSON events as such, anything else as a log line."""
    kind = "struct<type:string,process_id:string,message:string,progress:double,error:string>"
    parsed = F.from_json(value, kind)
    is_event = F.col(value).rlike(r"^\s*\{") & parsed["type"].isNotNull()
    return stream.select(F.when(is_event, parsed["type"]).otherwise(F.lit("log")).alias("type"), parsed["process_id"].alias("process_id"), F.when(is_event, parsed["message"]).otherwise(F.col(value)).alias("message"), F.when(parsed["progress"] > 1.0, 1.0).otherwise(parsed["progress"]).alias("progress"), parsed["error"].alias("error"))
