"""Linear state-space models: filter, smoother, expectation-maximization, causality of a model.

A recursion over time is sequential: a series is a task, and series run side by side. Observations
are y0.., inputs u0..
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions import matrices as M

STATES = "series_id string, t long, x_pred array<double>, p_pred array<double>, x_filt array<double>, p_filt array<double>, x_smooth array<double>, p_smooth array<double>, p_lag_one array<double>, log_likelihood double"
PARAMETERS = "series_id string, a array<double>, b array<double>, q array<double>, r array<double>, log_likelihoods array<double>"


def _named(df: DataFrame, letter: str) -> list[str]:
    return sorted((c for c in df.columns if c[:1] == letter and c[1:].isdigit()), key=lambda c: int(c[1:]))


def _inputs(pdf: pd.DataFrame, y: list[str], u: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("t")
    return pdf, pdf[y].to_numpy(float), pdf[u].to_numpy(float) if u else np.zeros((len(pdf), 1))


def _states(pdf: pd.DataFrame, f: dict) -> pd.DataFrame:
    t = len(pdf)
    columns = {k: list(f[k].reshape(t, -1)) for k in ("x_pred", "p_pred", "x_filt", "p_filt", "x_smooth", "p_smooth", "p_lag_one")}
    return pd.DataFrame({"series_id": pdf["series_id"].to_numpy(), "t": pdf["t"].to_numpy()} | columns | {"log_likelihood": f["log_likelihood"]})


def kalman_smoother(df: DataFrame, a, b, q, r, c=None, d=None, mean0=None, cov0=None) -> DataFrame:
    """Predicted, filtered and smoothed states of each series for given parameters."""
    y, u = _named(df, "y"), _named(df, "u")
    a, b, q, r = (np.asarray(m, float) for m in (a, b, q, r))
    c, d = (None if m is None else np.asarray(m, float) for m in (c, d))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, obs, drive = _inputs(pdf, y, u)
        f = M.kalman(obs, drive, a, b, q, r, c, d, mean0, cov0)
        return _states(pdf, f | M.smooth(f, a))

    return df.select("series_id", "t", *y, *u).groupBy("series_id").applyInPandas(run, STATES)


def em(df: DataFrame, c=None, d=None, most: int = 50, tolerance: float = 1e-4, **floors: float) -> DataFrame:
    """Parameters of each series and the log-likelihood of each iteration; with ``c`` the observation matrix is known and may mix states."""
    y, u = _named(df, "y"), _named(df, "u")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, obs, drive = _inputs(pdf, y, u)
        e = M.em(obs, drive, c, d, most, tolerance, **floors)
        return pd.DataFrame([[pdf["series_id"].iloc[0], *(e[k].ravel().tolist() for k in "abqr"), e["log_likelihoods"]]], columns=["series_id", "a", "b", "q", "r", "log_likelihoods"])

    return df.select("series_id", "t", *y, *u).groupBy("series_id").applyInPandas(run, PARAMETERS)


def em_states(df: DataFrame, c=None, d=None, most: int = 50, tolerance: float = 1e-4, **floors: float) -> DataFrame:
    """The states under the parameters that em() finds."""
    y, u = _named(df, "y"), _named(df, "u")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, obs, drive = _inputs(pdf, y, u)
        return _states(pdf, M.em(obs, drive, c, d, most, tolerance, **floors))

    return df.select("series_id", "t", *y, *u).groupBy("series_id").applyInPandas(run, STATES)


def latent_proxy(df: DataFrame, c, d=None) -> DataFrame:
    """(series_id, t, x0..): the pseudo-inverse of C applied to y - D u, in columns."""
    y, u = _named(df, "y"), _named(df, "u")
    inverse = np.linalg.pinv(np.asarray(c, float))
    d = np.zeros((len(y), len(u))) if d is None else np.asarray(d, float)
    rest = [F.col(v) - sum((float(d[k, j]) * F.col(w) for j, w in enumerate(u)), F.lit(0.0)) for k, v in enumerate(y)]
    return df.select("series_id", "t", *(sum((float(inverse[i, k]) * rest[k] for k in range(len(y))), F.lit(0.0)).alias(f"x{i}") for i in range(len(inverse))))


def mean_squared_error(df: DataFrame, truth: list[str], estimate: list[str]) -> DataFrame:
    """(series_id, mse) over all channels."""
    gap = sum(((F.col(a) - F.col(b)) ** 2 for a, b in zip(truth, estimate, strict=True)), F.lit(0.0)) / len(truth)
    return df.groupBy("series_id").agg(F.avg(gap).alias("mse"))


def stationary_pair(models: DataFrame) -> DataFrame:
    """(series_id, p00, p01, p11): the stationary covariance of two-state models of order 1, in columns."""
    p = G.stationary_2x2(lambda r, c: F.col("coef")[r * 2 + c], lambda r, c: F.col("sigma")[r * 2 + c])
    return models.select("series_id", *(v.alias(n) for v, n in zip(p, ("p00", "p01", "p11"), strict=True)))


def stationary_covariance(models: DataFrame, n: int) -> DataFrame:
    """(series_id, covariance array<double>) of models of order 1 with any number of states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"series_id": pdf["series_id"], "covariance": [M.lyapunov(np.reshape(a, (n, n)), np.reshape(q, (n, n))).ravel().tolist() for a, q in zip(pdf["coef"], pdf["sigma"], strict=True)]})

    return models.select("series_id", "coef", "sigma").mapInPandas(run, "series_id string, covariance array<double>")


def model_gc_matrix(models: DataFrame, n: int, as_coded: bool = False) -> DataFrame:
    """(series_id, target, source, gc) that order-1 models imply, every ordered pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for series_id, a, q in zip(pdf["series_id"], pdf["coef"], pdf["sigma"], strict=True):
                a, q = np.reshape(a, (n, n)), np.reshape(q, (n, n))
                out += [(series_id, t, s, M.model_gc(a, q, s, t, as_coded=as_coded)) for t in range(n) for s in range(n) if s != t]
            yield pd.DataFrame(out, columns=["series_id", "target", "source", "gc"])

    return models.select("series_id", "coef", "sigma").mapInPandas(run, "series_id string, target int, source int, gc double")


def model_gc(models: DataFrame, n: int, source: int, target: int, conditioning: list[int] | None = None, as_coded: bool = False) -> DataFrame:
    """(series_id, gc) of one pair, given other states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gc = [M.model_gc(np.reshape(a, (n, n)), np.reshape(q, (n, n)), source, target, conditioning, as_coded=as_coded) for a, q in zip(pdf["coef"], pdf["sigma"], strict=True)]
            yield pd.DataFrame({"series_id": pdf["series_id"], "gc": gc})

    return models.select("series_id", "coef", "sigma").mapInPandas(run, "series_id string, gc double")
