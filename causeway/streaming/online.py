"""Estimators on streams: state of fixed size per series, updated as event time passes the watermark.

Rows that come out of order wait in state, keyed by time, until the watermark has passed them; the
updates are then those of the batch functions on the same rows. Late rows behind the watermark are
dropped by Spark. State is keyed by series; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from causeway.functions import matrices as M
from causeway.sources.series import channels


class _Ordered(StatefulProcessor):
    """Buffers rows until the watermark passes them, then hands them on in order of time."""

    buffer_schema = "us long, t long, v array<double>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.buffer_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def _release(self, limit_us: int) -> list[tuple]:
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= limit_us]
        left = [r for r in rows if r[0] > limit_us]
        if left:
            self.waiting.put(left)
        elif rows:
            self.waiting.clear()
        return ready

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for pdf in rows:
            us = pdf["event_time"].astype("datetime64[us]").astype("int64")
            new += [(int(u), int(t), [float(x) for x in v]) for u, t, v in zip(us, pdf["t"], pdf[self.names].to_numpy(), strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(u for u, _, _ in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [self.update(t, np.array(v)) for _, t, v in self._release(timerValues.getCurrentWatermarkInMs() * 1000)]
        out = [r for r in out if r is not None]
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["series_id", *self.outputs])

    def close(self) -> None:
        pass


class OnlineRLS(_Ordered):
    """Recursive least squares: the last ``order`` samples, coefficients and inverse moments are the state."""

    state_schema = "past array<double>, theta array<double>, p array<double>"
    outputs = ("t", "theta")

    def __init__(self, names: list[str], order: int, forgetting: float):
        self.names, self.order, self.forgetting = names, order, forgetting

    def update(self, t: int, y: np.ndarray) -> tuple | None:
        n, k = len(self.names), len(self.names) * self.order
        kept = self.state.get() if self.state.exists() else None
        past, theta, p = map(np.array, kept) if kept is not None else (np.zeros(0), np.zeros(n * k), (1000.0 * np.eye(k)).ravel())
        done = None
        if len(past) == k:
            theta, p = M.rls_step(theta.reshape(n, k), p.reshape(k, k), past, y, self.forgetting)
            done = (t, theta.ravel().tolist())
        self.state.update((np.concatenate([y, past])[:k].tolist(), np.ravel(theta).tolist(), np.ravel(p).tolist()))
        return done


class OnlineKalman(_Ordered):
    """The filter for given parameters; inputs u0.. follow the observations y0.. in a row."""

    state_schema = "mean array<double>, cov array<double>"
    outputs = ("t", "x_filt", "p_filt")

    def __init__(self, names: list[str], a, b, q, r, c=None, d=None):
        self.names = names
        self.a, self.b, self.q, self.r = (np.asarray(m, float) for m in (a, b, q, r))
        self.c = np.eye(len(self.a)) if c is None else np.asarray(c, float)
        self.d = np.zeros((len(self.c), self.b.shape[1])) if d is None else np.asarray(d, float)

    def update(self, t: int, v: np.ndarray) -> tuple:
        n, y, u = len(self.a), v[: len(self.c)], v[len(self.c) :]
        if self.state.exists():
            mean, cov = (np.array(x) for x in self.state.get())
            mean, cov = self.a @ mean + self.b @ u, self.a @ cov.reshape(n, n) @ self.a.T + self.q
        else:
            mean, cov = np.zeros(n), 100.0 * np.eye(n)
        one = M.kalman(y[None], u[None], self.a, self.b, self.q, self.r, self.c, self.d, mean, cov)
        mean, cov = one["x_filt"][0], one["p_filt"][0]
        self.state.update((mean.tolist(), cov.ravel().tolist()))
        return t, mean.tolist(), cov.ravel().tolist()


def _run(stream: DataFrame, processor: _Ordered, schema: str, delay: str) -> DataFrame:
    """``stream``: (series_id, event_time timestamp, t, channels)."""
    rows = stream.withWatermark("event_time", delay)
    return rows.groupBy("series_id").transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_rls(stream: DataFrame, order: int = 1, forgetting: float = 0.99, delay: str = "1 hour") -> DataFrame:
    """(series_id, t, theta) after each update, as causeway.operators.adaptive.rls() gives it."""
    return _run(stream, OnlineRLS(channels(stream), order, forgetting), "series_id string, t long, theta array<double>", delay)


def stream_kalman(stream: DataFrame, a, b, q, r, c=None, d=None, delay: str = "1 hour") -> DataFrame:
    """(series_id, t, x_filt, p_filt) of each sample, as causeway.operators.ssm.kalman_smoother() gives it."""
    names = [*sorted(x for x in stream.columns if x[:1] == "y" and x[1:].isdigit()), *sorted(x for x in stream.columns if x[:1] == "u" and x[1:].isdigit())]
    return _run(stream, OnlineKalman(names, a, b, q, r, c, d), "series_id string, t long, x_filt array<double>, p_filt array<double>", delay)


def stream_series(events: DataFrame, channel: str, names: list, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Regular sums by channel of a stream of events (series_id, event_time, ...): (series_id, event_time, t in seconds, x0, ...), each bucket once the watermark has passed it."""
    sums = [F.coalesce(F.sum(F.when(F.col(channel) == n, F.col(value))), F.lit(0.0)).alias(f"x{k}") for k, n in enumerate(names)]
    out = events.withWatermark("event_time", delay).groupBy("series_id", F.window("event_time", width).alias("w")).agg(*sums)
    return out.select("series_id", F.col("w.start").alias("event_time"), F.unix_timestamp("w.start").alias("t"), *(f"x{k}" for k in range(len(names))))


def stream_moments(stream: DataFrame, names: list[str], width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Sums of products of lagged columns in windows of event time: what a windowed causality is computed from by the closed forms."""
    from causeway.operators.lags import Moments

    m = Moments(names)
    out = stream.withWatermark("event_time", delay).groupBy("series_id", F.window("event_time", width).alias("w")).agg(m.column().alias("moments"))
    return out.select("series_id", F.col("w.start").alias("window_start"), "moments")
