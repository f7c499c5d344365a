"""Causality in the time domain: ln of the residual variances without and with the source's past."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions import matrices as M
from causeway.operators.lags import KEYS, Moments, lag_names, lagged
from causeway.sources.series import channels


def _gc(df: DataFrame, m: Callable[[str, str], Column], target: str, own: list[str], full: list[str], ridge: float = 0.0) -> DataFrame:
    """``df`` with sigma_full, sigma_reduced and gc, step by step in columns; gc is null where a variance is zero."""
    both = [G.elimination(m, target, r, F.col, c, ridge) for c, r in (("sigma_full", full), ("sigma_reduced", own))]
    for a, b in zip_longest(*both, fillvalue={}):
        df = df.withColumns(a | b)
    return df.withColumn("gc", F.when((F.col("sigma_full") > 0) & (F.col("sigma_reduced") > 0), F.log(F.col("sigma_reduced") / F.col("sigma_full"))))


def conditional_gc(df: DataFrame, source: str, target: str, conditioning: Sequence[str] = (), order: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_obs, sigma_full, sigma_reduced, gc) of source -> target given the conditioning channels.

    Up to three regressors are solved in columns; more of them on one row per series. Redundant regressors (zero, repeated or collinear
    channels) change nothing; where the target has no residual variance, gc is null.
    """
    names = [target, source, *conditioning]
    full, own = lag_names(names, order), lag_names([target, *conditioning], order)
    m = Moments([target, *full])
    rows = m.of(lagged(df, names, order, keys), keys)
    if len(full) <= 3:
        return _gc(rows, m, target, own, full).select(*keys, m("1", "1").cast("long").alias("n_obs"), "sigma_full", "sigma_reduced", "gc")
    return _solved(rows, m, [(source, target, own, full)], keys).drop("source", "target")


def pairwise_gc(df: DataFrame, source: str, target: str, order: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    return conditional_gc(df, source, target, (), order, keys)


time_domain_gc = pairwise_gc


def _solved(rows: DataFrame, m: Moments, pairs: list[tuple], keys: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """A row for each pair from each row of moments."""
    size, at = len(m.names), {c: k for k, c in enumerate(m.names)}
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def spread(s: np.ndarray, target: str, regressors: list[str]) -> float:
        y, x = [at[target]], [at[r] for r in regressors]
        b = M.solve_moments(s[np.ix_(x, x)] + ridge * np.eye(len(x)), s[np.ix_(x, y)])
        value = float(M.residual_covariance(s, y, x, b)[0, 0])
        return value if value > s[y[0], y[0]] / s[0, 0] * G.NOTHING else 0.0

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = M.moment_matrix(row["moments"], size)
                for source, target, own, full in pairs:
                    a, b = spread(s, target, full), spread(s, target, own)
                    out.append((*(row[k] for k in keys), source, target, int(s[0, 0]), a, b, float(np.log(b / a)) if a > 0 and b > 0 else None))
            yield pd.DataFrame(out, columns=[*keys, "source", "target", "n_obs", "sigma_full", "sigma_reduced", "gc"])

    return rows.mapInPandas(solve, f"{types}, source string, target string, n_obs long, sigma_full double, sigma_reduced double, gc double")


def all_pairs_gc(df: DataFrame, order: int = 1, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every ordered pair of channels, from one window and one aggregate over all of them."""
    names = channels(df)
    m = Moments([*names, *lag_names(names, order)])
    rows = m.of(lagged(df, names, order, keys), keys)
    pairs = [(s, t, lag_names([t], order), lag_names([t, s], order)) for t in names for s in names if s != t]
    if order > 1:
        out = _solved(rows, m, pairs, keys)
        return out.withColumns({c: F.substring(c, 2, 9).cast("int") for c in ("source", "target")})
    # one row for each pair, and one closed form over the places of its sums
    roles = {"y": lambda s, t: t, "y_1": lambda s, t: f"{t}_1", "s_1": lambda s, t: f"{s}_1", "1": lambda s, t: "1"}
    cells = [(a, b) for k, a in enumerate(roles) for b in list(roles)[k:]]
    places = [F.struct(F.lit(int(s[1:])).alias("source"), F.lit(int(t[1:])).alias("target"), *(F.lit(m.index(roles[a](s, t), roles[b](s, t))).alias(f"i_{a}_{b}") for a, b in cells)) for s, t, _, _ in pairs]
    each = rows.select(*keys, "moments", F.explode(F.array(*places)).alias("p"))
    each = each.select(*keys, "p.source", "p.target", *(F.col("moments")[F.col(f"p.i_{a}_{b}")].alias(f"m_{a}_{b}") for a, b in cells))
    of = lambda a, b: F.col(f"m_{a}_{b}" if (a, b) in cells else f"m_{b}_{a}")
    return _gc(each, of, "y", ["y_1"], ["y_1", "s_1"]).select(*keys, "source", "target", of("1", "1").cast("long").alias("n_obs"), "sigma_full", "sigma_reduced", "gc")


def sliding_gc(df: DataFrame, source: str, target: str, window: int, step: int, order: int = 1) -> DataFrame:
    """(series_id, w, window_start, center, gc) on windows of a grid t = 0, 1, ...; lags stay within their window.

    A row belongs to the windows whose usable part holds its time: it is repeated for these, and
    one aggregate by window follows. No window is fitted on its own.
    """
    names = [target, source]
    full, own = lag_names(names, order), lag_names([target], order)
    m = Moments([target, *full])
    rows = lagged(df, names, order)
    low = F.greatest(F.ceil((F.col("t") - window + 1) / step), F.lit(0))
    high = F.floor((F.col("t") - order) / step)
    rows = rows.withColumns({"low": low, "high": high}).where("low <= high").withColumn("w", F.explode(F.sequence("low", "high")))
    sums = rows.groupBy("series_id", "w").agg(m.column().alias("moments"), F.max("t").alias("until"))
    # windows that the series doesn't fill go; its last time is that of its last window
    end = F.max("until").over(Window.partitionBy("series_id"))
    sums = sums.withColumn("end", end).where((F.col("w") * step + window) <= F.col("end") + 1).select("series_id", "w", "moments")
    if len(full) <= 3:
        out = _gc(sums, m, target, own, full).select("series_id", "w", "gc")
    else:
        out = _solved(sums, m, [(source, target, own, full)], ["series_id", "w"]).select("series_id", "w", "gc")
    start = (F.col("w") * step).cast("long")
    return out.select("series_id", "w", start.alias("window_start"), (start + window // 2).alias("center"), "gc")


def varx_gc(df: DataFrame, inputs: Sequence[str], source: str, target: str, na: int = 1, nb: int = 1, ridge: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Causality given all other channels and the exogenous ``inputs`` at lags 0 to nb - 1; ``ridge`` is added to the diagonal of the sums of products."""
    names = channels(df)
    longest = max(na, nb - 1)
    rows = lagged(df, [*names, *inputs], longest, keys)
    outer = [*inputs, *lag_names(inputs, nb - 1)] if nb else []
    full = [*lag_names(names, na), *outer]
    own = [*lag_names([c for c in names if c != source], na), *outer]
    m = Moments([target, *full])
    sums = m.of(rows, keys)
    if len(full) <= 3:
        return _gc(sums, m, target, own, full, ridge).select(*keys, m("1", "1").cast("long").alias("n_obs"), "sigma_full", "sigma_reduced", "gc")
    return _solved(sums, m, [(source, target, own, full)], keys, ridge).drop("source", "target")


ordinary_gc = pairwise_gc


def with_inputs(df: DataFrame, inputs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` with the input columns u0, ... of another table at the same times; times that one of them lacks are left out."""
    return df.join(inputs.select(*keys, "t", *(c for c in inputs.columns if c[:1] == "u" and c[1:].isdigit())), [*keys, "t"])


def fit_varx(df: DataFrame, inputs: Sequence[str], na: int = 1, nb: int = 1, ridge: float = 0.0, sources: Sequence[str] | None = None, include_exogenous: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_obs, a array<double>, b array<double>, sigma array<double>): coefficients lag by lag of all targets on ``sources`` and inputs, and residual covariance."""
    names, sources = channels(df), list(sources or channels(df))
    longest = max(na, nb - 1)
    rows = lagged(df, [*names, *inputs], longest, keys)
    outer = [*inputs, *lag_names(inputs, nb - 1)] if nb and include_exogenous else []
    regressors = [*lag_names(sources, na), *outer]
    m = Moments([*names, *regressors])
    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = list(range(1, len(names) + 1)), list(range(len(names) + 1, len(m.names)))
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                s = M.moment_matrix(row["moments"], len(m.names))
                b = M.solve_moments(s[np.ix_(x, x)] + ridge * np.eye(len(x)), s[np.ix_(x, y)])
                cut = na * len(sources)
                a_part = b[:cut].reshape(na, len(sources), len(names)).transpose(0, 2, 1)
                b_part = b[cut:].reshape(-1, max(1, len(inputs)), len(names)).transpose(0, 2, 1)
                out.append((*(row[k] for k in keys), int(s[0, 0]), a_part.ravel().tolist(), b_part.ravel().tolist(), M.residual_covariance(s, y, x, b).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*keys, "n_obs", "a", "b", "sigma"])

    return m.of(rows, keys).mapInPandas(solve, f"{types}, n_obs long, a array<double>, b array<double>, sigma array<double>")
