"""Vector autoregressions: fits, residuals, criteria, order selection, stability.

A model is a row (series_id, p, n_obs, coef array<double> of order x n x n, sigma array<double> of
n x n); coefficients come from sums of products, or from an orthogonal factorization of the
series itself where these are too near to singular.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import matrices as M
from causeway.operators.lags import BLOCK, KEYS, Moments, lag_names, lagged
from causeway.sources.series import channels

MODEL = "p int, n_obs long, coef array<double>, sigma array<double>"


def _key_types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def fit_var(df: DataFrame, order: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """One model for each series. Rows of collinear series are few and take the second, exact path."""
    names = channels(df)
    n = len(names)
    m = Moments([*names, *lag_names(names, order)])
    rows = m.of(lagged(df, names, order, keys), keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = list(range(1, n + 1)), list(range(n + 1, n + 1 + n * order))
        for pdf in batches:
            out = []
            for flat in pdf["moments"]:
                s = M.moment_matrix(flat, len(m.names))
                g = s[np.ix_(x, x)]
                b = M.solve_moments(g, s[np.ix_(x, y)])
                coef = b.reshape(order, n, n).transpose(0, 2, 1)
                out.append((order, int(s[0, 0]), coef.ravel().tolist(), M.residual_covariance(s, y, x, b).ravel().tolist(), M.ill_conditioned(g)))
            yield pd.concat([pdf[list(keys)], pd.DataFrame(out, columns=["p", "n_obs", "coef", "sigma", "singular"], index=pdf.index)], axis=1)

    return rows.mapInPandas(solve, f"{_key_types(df, keys)}, {MODEL}, singular boolean")


def fit_var_exact(df: DataFrame, order: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same by an orthogonal factorization of each whole series, which must fit in a task's memory."""
    names = channels(df)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values("t")[names].to_numpy()
        coef, sigma, r = M.fit_var(data, order)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), order, len(r), coef.ravel().tolist(), sigma.ravel().tolist(), False]], columns=[*keys, "p", "n_obs", "coef", "sigma", "singular"])

    return df.select(*keys, "t", *names).groupBy(*keys).applyInPandas(solve, f"{_key_types(df, keys)}, {MODEL}, singular boolean")


def fit_var_safe(df: DataFrame, order: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """fit_var(), with fit_var_exact() for the series that it finds singular."""
    quick = fit_var(df, order, keys)
    again = df.join(quick.where("singular").select(*keys), list(keys), "left_semi")
    return quick.where("not singular").unionByName(fit_var_exact(again, order, keys))


def coefficients(models: DataFrame, n: int) -> DataFrame:
    """(series_id, lag, row, col, value) of each model."""
    i = F.col("i")
    out = models.select("series_id", F.posexplode("coef").alias("i", "value"))
    return out.select("series_id", (F.floor(i / (n * n)) + 1).cast("int").alias("lag"), (F.floor(i / n) % n).cast("int").alias("row"), (i % n).cast("int").alias("col"), "value")


def stacked(models: DataFrame, n: int) -> DataFrame:
    """(series_id, theta): the matrices of all lags side by side, row by row."""
    at = lambda r, k, c: F.col("coef")[F.lit(n * n) * k + r * n + c]
    row = lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: F.array(*(at(r, k, c) for c in range(n)))))
    return models.select("series_id", "p", F.concat(*(row(r) for r in range(n))).alias("theta"))


def residuals(df: DataFrame, models: DataFrame, order: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """(series_id, t, r0, r1, ...)."""
    names = channels(df)
    n = len(names)
    rows = lagged(df, names, order, keys).join(models.select(*keys, "coef"), list(keys))

    def rest(r: int):
        return F.col(names[r]) - sum(F.col("coef")[(k - 1) * n * n + r * n + c] * F.col(f"{names[c]}_{k}") for k in range(1, order + 1) for c in range(n))

    return rows.select(*keys, "t", *(rest(r).alias(f"r{r}") for r in range(n)))


def count_parameters(n: int, order: int) -> int:
    return n * n * order


def criteria(models: DataFrame, n: int, n_obs) -> DataFrame:
    """aic and bic of each model; ``n_obs`` is the column with the number of samples."""

    def logdet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(log_det=[float(np.linalg.slogdet(np.reshape(s, (n, n)))[1]) for s in pdf["sigma"]])[["series_id", "p", "n_obs", "log_det"]]

    rows = models.withColumn("n_obs", n_obs).select("series_id", "p", "n_obs", "sigma").mapInPandas(logdet, "series_id string, p int, n_obs long, log_det double")
    k = F.col("p") * (n * n)
    return rows.select("series_id", "p", (F.col("log_det") + 2 * k / F.col("n_obs")).alias("aic"), (F.col("log_det") + F.log("n_obs") * k / F.col("n_obs")).alias("bic"))


def select_order(df: DataFrame, most: int = 20) -> DataFrame:
    """(series_id, p, aic, bic) for p from 1 to ``most``; each p has its own usable rows, and samples count as all of the series.

    Sums of products of the channels at distances 0 to ``most`` (a block of a series is a task), and the first and last ``most`` samples, give the sums of
    every order. Times are a grid without gaps; null samples are an error. Orders without as many rows as regressors are left out.
    """
    names = channels(df)
    n, block = len(names), BLOCK
    home = F.floor(F.col("t") / block)
    halo = F.when(F.pmod(F.col("t"), F.lit(block)) >= block - most, F.array(home, home + 1)).otherwise(F.array(home))
    rows = df.select("series_id", "t", *names).withColumn("_block", F.explode(halo))
    kind = df.schema["series_id"].dataType.simpleString()

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, t, blk = pdf[names].to_numpy(float), pdf["t"].to_numpy(), int(pdf["_block"].iloc[0])
        if np.isnan(x).any() or (np.diff(t) != 1).any():
            raise ValueError("order selection needs series without gaps and nulls")
        own = int(np.searchsorted(t, blk * block))
        sums = [x[max(own, h) :].T @ x[max(own, h) - h : len(x) - h] if h < len(x) else np.zeros((n, n)) for h in range(most + 1)]
        return pd.DataFrame([[pdf["series_id"].iloc[0], blk, len(x) - own, x[own:].sum(axis=0).tolist(), np.ravel(sums).tolist(), x[own:][:most].ravel().tolist(), x[-most:].ravel().tolist()]], columns=["series_id", "blk", "n", "total", "sums", "head", "tail"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["n"] > 0].sort_values("blk")
        size, total = int(pdf["n"].sum()), np.sum(np.stack(pdf["total"].to_list()), axis=0)
        sums = np.sum(np.stack(pdf["sums"].to_list()), axis=0).reshape(most + 1, n, n)
        head = np.concatenate(pdf["head"].to_list()).reshape(-1, n)[:most]
        tail = np.concatenate([*pdf["head"].to_list()[:1], pdf["tail"].iloc[-1]]).reshape(-1, n)[-min(most, size) :]
        out = []
        for p, s in M.order_moments(size, total, sums, head, tail):
            y, x = list(range(1, n + 1)), list(range(n + 1, n + 1 + n * p))
            sigma = M.residual_covariance(s, y, x, M.solve_moments(s[np.ix_(x, x)], s[np.ix_(x, y)]))
            det, k = float(np.linalg.slogdet(sigma)[1]), count_parameters(n, p)
            out.append((pdf["series_id"].iloc[0], p, det + 2 * k / size, det + np.log(size) * k / size))
        return pd.DataFrame(out, columns=["series_id", "p", "aic", "bic"])

    parts = rows.groupBy("series_id", "_block").applyInPandas(partial, f"series_id {kind}, blk long, n long, total array<double>, sums array<double>, head array<double>, tail array<double>")
    return parts.groupBy("series_id").applyInPandas(solve, f"series_id {kind}, p int, aic double, bic double")


def best_order(table: DataFrame, criterion: str = "bic") -> DataFrame:
    """The row with the smallest criterion of each series, the smallest order among equal ones."""
    w = Window.partitionBy("series_id").orderBy(criterion, "p")
    return table.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def autocorrelation(resid: DataFrame, lags: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """(series_id, channel, lag, acf): Pearson's correlation of each residual with itself ``lag`` samples before."""
    names = sorted(c for c in resid.columns if c[:1] == "r" and c[1:].isdigit())
    w = Window.partitionBy(*keys).orderBy("t")
    rows = resid.withColumns({f"{c}_{k}": F.lag(c, k).over(w) for c in names for k in range(1, lags + 1)})
    pair = [F.struct(F.lit(int(c[1:])).alias("channel"), F.lit(k).alias("lag"), F.col(f"a_{c}_{k}").alias("acf")) for c in names for k in range(1, lags + 1)]
    both = lambda c, k: F.corr(F.when(F.col(f"{c}_{k}").isNotNull(), F.col(c)), F.col(f"{c}_{k}"))
    sums = rows.groupBy(*keys).agg(*(both(c, k).alias(f"a_{c}_{k}") for c in names for k in range(1, lags + 1)))
    return sums.select(*keys, F.explode(F.array(*pair)).alias("v")).select(*keys, "v.channel", "v.lag", "v.acf")


def stability(models: DataFrame, n: int) -> DataFrame:
    """(series_id, spectral_radius, stable, eigen_re, eigen_im) of the companion matrices."""

    def radius(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = [np.linalg.eigvals(M.companion(np.reshape(c, (-1, n, n)))) for c in pdf["coef"]]
            yield pd.DataFrame({"series_id": pdf["series_id"], "spectral_radius": [float(np.abs(v).max()) for v in e], "stable": [bool(np.abs(v).max() < 1) for v in e], "eigen_re": [v.real.tolist() for v in e], "eigen_im": [v.imag.tolist() for v in e]})

    return models.select("series_id", "coef").mapInPandas(radius, "series_id string, spectral_radius double, stable boolean, eigen_re array<double>, eigen_im array<double>")
