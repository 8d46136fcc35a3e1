"""Stateful operators over streams of progress events and listings.

State is small and bounded per key: the meter keeps one rate window (at most a few dozen samples), the estimator two
numbers. Events later than ``delay`` behind the newest one are dropped, and a transfer without events for an hour of
event time beyond that is forgotten. Checkpoints belong in the folder the caller names when starting the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediacat.operators.archive import not_in_archive
from mediacat.operators.telemetry import GATE_SECONDS, NEW_WEIGHT, WARMUP_SHARE, WINDOW_SECONDS, job_status


#: Milliseconds of event time after which a silent transfer's state goes.
IDLE_MS = 3_600_000


def let_through(micros: np.ndarray, last: int | None) -> np.ndarray:
    """Places of the accepted ones of sorted samples: each a gate's width or more after the one accepted before it."""
    gate, places = int(GATE_SECONDS * 1e6), []
    at = 0 if last is None else int(np.searchsorted(micros, last + gate))
    while at < len(micros):
        places.append(at)
        at = int(np.searchsorted(micros, micros[at] + gate))
    return np.array(places, np.int64)


def _forget_later(state: GroupState, last_us: int) -> None:
    """Keep the state until the watermark has passed an hour beyond the key's last event."""
    state.setTimeoutTimestamp(max(last_us // 1000, state.getCurrentWatermarkMs()) + IDLE_MS)


def _in_order(batches: Iterator[pd.DataFrame], tie: str) -> pd.DataFrame:
    """The rows of one key in one micro-batch, by time."""
    rows = pd.concat(list(batches), ignore_index=True)
    return rows.sort_values(["ts_us", tie], kind="stable")


def speed_meter_stream(progress: DataFrame, by: str = "transfer_id", tie: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """The smoothed rate after every sample, as the batch operator gives it; events must come in order per transfer."""
    rows = progress.withWatermark("ts", delay).select(by, tie, "ts", F.unix_micros("ts").alias("ts_us"), "cumulative_bytes")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _in_order(batches, tie)
        last, smoothed, kept_us, kept_total = state.get if state.exists else (None, None, [], [])
        micros = pdf["ts_us"].to_numpy(np.int64)
        places = let_through(micros, last)
        # The window kept from before, then what the gate lets through; each one's frame begins at ``first``.
        us = np.concatenate([np.array(kept_us, np.int64), micros[places]])
        total = np.concatenate([np.array(kept_total, np.int64), pdf["cumulative_bytes"].to_numpy(np.int64)[places]])
        first = np.searchsorted(us, us - int(WINDOW_SECONDS * 1e6))
        averages = [smoothed]
        for i in range(len(kept_us), len(us)):
            rate = max(total[i] - total[first[i]], 0) / ((us[i] - us[first[i]]) / 1e6) if first[i] < i else None
            old = averages[-1]
            averages.append(rate if rate is None or old is None else NEW_WEIGHT * rate + (1 - NEW_WEIGHT) * old)
        speeds = [averages[n] for n in np.searchsorted(places, np.arange(len(micros)), "right")]
        begin = first[-1] if len(us) else 0
        state.update((int(us[-1]), averages[-1], us[begin:].tolist(), total[begin:].tolist()))
        _forget_later(state, int(micros[-1]))
        yield pd.DataFrame({by: key[0], tie: pdf[tie].to_numpy(), "speed": pd.array(speeds, dtype="Float64")})

    kinds = {n: rows.schema[n].dataType.simpleString() for n in (by, tie)}
    return rows.groupBy(by).applyInPandasWithState(
        update,
        f"{by} {kinds[by]}, {tie} {kinds[tie]}, speed double",
        "last long, smoothed double, us array<long>, total array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def eta_stream(progress: DataFrame, by: str = "transfer_id", tie: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """The smoothed remaining seconds after every sample."""
    rows = progress.withWatermark("ts", delay).select(by, tie, "ts", F.unix_micros("ts").alias("ts_us"), F.col("frac").cast("double").alias("frac"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = _in_order(batches, tie)
        start, smoothed = state.get if state.exists else (None, None)
        out = []
        for t, frac in zip(pdf["ts_us"], pdf["frac"]):
            start = int(t) if start is None else start
            if not WARMUP_SHARE <= frac < 1.0:
                out.append(None)
                continue
            raw = (t - start) / 1e6 * (1.0 - frac) / frac
            smoothed = raw if smoothed is None else NEW_WEIGHT * raw + (1 - NEW_WEIGHT) * smoothed
            out.append(smoothed)
        state.update((start, smoothed))
        _forget_later(state, int(pdf["ts_us"].max()))
        yield pd.DataFrame({by: key[0], tie: pdf[tie].to_numpy(), "eta": pd.array(out, dtype="Float64")})

    kinds = {n: rows.schema[n].dataType.simpleString() for n in (by, tie)}
    return rows.groupBy(by).applyInPandasWithState(
        update,
        f"{by} {kinds[by]}, {tie} {kinds[tie]}, eta double",
        "start long, smoothed double",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_not_in_archive(media: DataFrame, archive: DataFrame, key: Column | None = None) -> DataFrame:
    """Media of a stream that a static archive does not have."""
    return not_in_archive(media, archive, key)


def stream_first_seen(
    listings: DataFrame, by: str = "query_id", url: str = "video_url", *, delay: str, ts: str = "ts"
) -> DataFrame:
    """The first sight of every URL per query; state older than ``delay`` behind the newest event is dropped."""
    return listings.withWatermark(ts, delay).dropDuplicatesWithinWatermark([by, url])


def job_status_stream(events: DataFrame, by: str = "job_id") -> DataFrame:
    """The latest status of each job; run it in update mode."""
    return job_status(events, by)
