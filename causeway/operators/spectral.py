"""Spectra as rows (series_id, f_idx, omega, row, col, re, im), and what is read off them.

Two channels are computed in columns; more of them in batches of models. A grid is generated
by ``sequence`` and exploded, so no cross join is planned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions import matrices as M

SPECTRUM = "series_id string, f_idx int, omega double, row int, col int, re double, im double"


def on_grid(df: DataFrame, n_freqs: int | Sequence[float] = 512) -> DataFrame:
    """``df`` with f_idx and omega: ``n_freqs`` points from 0 to pi, both included, or the caller's own frequencies."""
    if not isinstance(n_freqs, int):
        return df.select("*", F.posexplode(F.array(*(F.lit(float(w)) for w in n_freqs))).alias("f_idx", "omega"))
    out = df.withColumn("f_idx", F.explode(F.sequence(F.lit(0), F.lit(n_freqs - 1))))
    return out.withColumn("omega", F.col("f_idx") * (math.pi / (n_freqs - 1)))


def coef_of(k: int, r: int, c: int) -> Column:
    """An entry of a two-channel model's array of coefficients."""
    return F.col("coef")[(k - 1) * 4 + r * 2 + c]


def sigma_of(r: int, c: int) -> Column:
    return F.col("sigma")[r * 2 + c]


def _named(prefix: str) -> list[list[G.Complex]]:
    return [[G.Complex(F.col(f"{prefix}{r}{c}_re"), F.col(f"{prefix}{r}{c}_im")) for c in range(2)] for r in range(2)]


def _columns(prefix: str, m: list[list[G.Complex]]) -> dict[str, Column]:
    real = lambda v: v if isinstance(v, Column) else F.lit(v)
    return {f"{prefix}{r}{c}_{part}": real(getattr(m[r][c], part)) for r in range(2) for c in range(2) for part in ("re", "im")}


def transfer_pair(models: DataFrame, order: int, n_freqs: int = 512) -> DataFrame:
    """Models of two channels on a grid, with A(w) and H(w) as columns a00_re, ..., h11_im."""
    out = on_grid(models, n_freqs)
    out = out.withColumns(_columns("a", G.lag_polynomial(coef_of, order, F.col("omega"))))
    return out.withColumns(_columns("h", G.inverse(_named("a"))))


def density_pair(models: DataFrame, order: int, n_freqs: int = 512) -> DataFrame:
    """The same with S(w) = H Sigma H* as columns s00_re, ..."""
    return transfer_pair(models, order, n_freqs).withColumns(_columns("s", G.density(_named("h"), sigma_of)))


def long_form(wide: DataFrame, prefix: str, n: int = 2) -> DataFrame:
    """Columns of entries as rows of a spectrum."""
    parts = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.col(f"{prefix}{r}{c}_re").alias("re"), F.col(f"{prefix}{r}{c}_im").alias("im")) for r in range(n) for c in range(n)))
    return wide.select("series_id", "f_idx", "omega", F.explode(parts).alias("v")).select("series_id", "f_idx", "omega", "v.row", "v.col", "v.re", "v.im")


def spectrum_rows(series_id, omega: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    f, n, _ = s.shape
    i = np.indices(s.shape).reshape(3, -1)
    return pd.DataFrame({"series_id": series_id, "f_idx": i[0], "omega": omega[i[0]], "row": i[1], "col": i[2], "re": s.real.ravel(), "im": s.imag.ravel()})


def matrices(spectrum: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequencies and matrices (F, n, n) of one series' rows."""
    s = spectrum.sort_values(["f_idx", "row", "col"])
    n = int(s["row"].max()) + 1
    return s["omega"].to_numpy()[:: n * n], (s["re"].to_numpy() + 1j * s["im"].to_numpy()).reshape(-1, n, n)


def _of_models(models: DataFrame, n: int, n_freqs: int, kind: str) -> DataFrame:
    omega = np.arange(n_freqs) * (math.pi / (n_freqs - 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for series_id, coef, sigma in zip(pdf["series_id"], pdf["coef"], pdf["sigma"], strict=True):
                coefs = np.reshape(coef, (-1, n, n))
                a, h = M.transfer(coefs, omega)
                yield spectrum_rows(series_id, omega, {"a": a, "h": h}.get(kind) if kind != "s" else M.spectral_density(coefs, np.reshape(sigma, (n, n)), omega))

    return models.select("series_id", "coef", "sigma").mapInPandas(run, SPECTRUM)


def lag_polynomials(models: DataFrame, n: int, n_freqs: int = 512) -> DataFrame:
    return _of_models(models, n, n_freqs, "a")


def transfer_functions(models: DataFrame, n: int, n_freqs: int = 512) -> DataFrame:
    return _of_models(models, n, n_freqs, "h")


def spectral_densities(models: DataFrame, n: int, n_freqs: int = 512) -> DataFrame:
    return _of_models(models, n, n_freqs, "s")


def power(spectrum: DataFrame, channel: int) -> DataFrame:
    """(series_id, f_idx, omega, value): the real diagonal entry."""
    return spectrum.where((F.col("row") == channel) & (F.col("col") == channel)).select("series_id", "f_idx", "omega", F.col("re").alias("value"))


def submatrix(spectrum: DataFrame, kept: list[int]) -> DataFrame:
    """The rows and columns ``kept``, numbered anew in this order."""
    new = F.create_map(*(F.lit(v) for k, c in enumerate(kept) for v in (c, k)))
    out = spectrum.where(F.col("row").isin(kept) & F.col("col").isin(kept))
    return out.withColumns({"row": new[F.col("row")], "col": new[F.col("col")]})


def dominant(curve: DataFrame, value: str = "value") -> DataFrame:
    """The first of the highest points of each series."""
    w = Window.partitionBy("series_id").orderBy(F.desc(value), "f_idx")
    return curve.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def integral(curve: DataFrame, value: str = "gc") -> DataFrame:
    """(series_id, integral): trapezoids over omega, divided by pi."""
    w = Window.partitionBy("series_id").orderBy("f_idx")
    part = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col("omega") - F.lag("omega").over(w))
    return curve.select("series_id", part.alias("part")).groupBy("series_id").agg((F.sum("part") / math.pi).alias("integral"))


def normalized(curve: DataFrame, value: str = "value") -> DataFrame:
    """``curve`` divided by its largest value."""
    return curve.withColumn(value, F.col(value) / F.max(value).over(Window.partitionBy("series_id")))


def two_sided(spectrum: DataFrame) -> DataFrame:
    """With the mirror of all points but the first and the last; right for even numbers of samples only.

    A mirrored matrix is the conjugate, which of a Hermitian one is the transpose.
    """
    last = F.max("f_idx").over(Window.partitionBy("series_id"))
    rows = spectrum.withColumn("_n", last * 2)
    mirror = rows.where((F.col("f_idx") > 0) & (F.col("f_idx") * 2 < F.col("_n")))
    mirror = mirror.select("series_id", (F.col("_n") - F.col("f_idx")).alias("f_idx"), (2 * math.pi - F.col("omega")).alias("omega"), "row", "col", "re", (-F.col("im")).alias("im"))
    return rows.drop("_n").unionByName(mirror)


def one_sided(spectrum: DataFrame, n: int) -> DataFrame:
    """The first half of ``n`` two-sided points."""
    return spectrum.where(F.col("f_idx") < n // 2 + 1)


def _with_transpose(spectrum: DataFrame) -> DataFrame:
    t = spectrum.select("series_id", "f_idx", F.col("row").alias("col"), F.col("col").alias("row"), F.col("re").alias("re_t"), F.col("im").alias("im_t"))
    return spectrum.join(t, ["series_id", "f_idx", "row", "col"])


def hermitian(spectrum: DataFrame, epsilon: float = 0.0) -> DataFrame:
    """(S + S*) / 2 + epsilon I."""
    out = _with_transpose(spectrum)
    load = F.when(F.col("row") == F.col("col"), epsilon).otherwise(0.0)
    return out.select("series_id", "f_idx", "omega", "row", "col", ((F.col("re") + F.col("re_t")) / 2 + load).alias("re"), ((F.col("im") - F.col("im_t")) / 2).alias("im"))


def hermitian_error(spectrum: DataFrame) -> DataFrame:
    """(series_id, hermitian_error): the largest modulus in S - S*."""
    gap = F.hypot(F.col("re") - F.col("re_t"), F.col("im") + F.col("im_t"))
    return _with_transpose(spectrum).groupBy("series_id").agg(F.max(gap).alias("hermitian_error"))


def eigenvalues(spectrum: DataFrame, n: int = 2) -> DataFrame:
    """(series_id, f_idx, omega, min_eigenvalue, max_eigenvalue, condition); columns alone for two channels."""
    if n == 2:
        entry = lambda r, c, part: F.max(F.when((F.col("row") == r) & (F.col("col") == c), F.col(part)))
        e = spectrum.groupBy("series_id", "f_idx", "omega").agg(entry(0, 0, "re").alias("a"), entry(1, 1, "re").alias("d"), entry(0, 1, "re").alias("b"), entry(0, 1, "im").alias("c"))
        low, high = G.eigen_hermitian(F.col("a"), F.col("d"), F.col("b"), F.col("c"))
        out = e.select("series_id", "f_idx", "omega", low.alias("min_eigenvalue"), high.alias("max_eigenvalue"))
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            omega, s = matrices(pdf)
            v = np.linalg.eigvalsh(s)
            return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "f_idx": np.sort(pdf["f_idx"].unique()), "omega": omega, "min_eigenvalue": v[:, 0], "max_eigenvalue": v[:, -1]})

        out = spectrum.groupBy("series_id").applyInPandas(run, "series_id string, f_idx int, omega double, min_eigenvalue double, max_eigenvalue double")
    return out.withColumn("condition", F.greatest("max_eigenvalue", F.lit(1e-15)) / F.greatest("min_eigenvalue", F.lit(1e-15)))


def median_condition(diagnostics: DataFrame) -> DataFrame:
    """(series_id, condition): the median over frequencies of eigenvalues()' condition numbers."""
    return diagnostics.groupBy("series_id").agg(F.median("condition").alias("condition"))


def regularized(spectrum: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """S + epsilon I."""
    return spectrum.withColumn("re", F.col("re") + F.when(F.col("row") == F.col("col"), epsilon).otherwise(0.0))


def regularized_relative(spectrum: DataFrame, relative: float = 1e-6, as_coded: bool = False) -> DataFrame:
    """S + relative tr(S) / n I; ``as_coded`` adds that number to all entries and a whole identity besides."""
    w = Window.partitionBy("series_id", "f_idx")
    diagonal = F.col("row") == F.col("col")
    load = relative * F.sum(F.when(diagonal, F.col("re"))).over(w) / (F.max("row").over(w) + 1)
    added = load + F.when(diagonal, 1.0).otherwise(0.0) if as_coded else F.when(diagonal, load).otherwise(0.0)
    return spectrum.withColumn("re", F.col("re") + added)


def max_relative_error(s: DataFrame, other: DataFrame) -> DataFrame:
    """(series_id, error): the largest relative Frobenius distance over frequencies."""
    o = other.select("series_id", "f_idx", "row", "col", F.col("re").alias("re_o"), F.col("im").alias("im_o"))
    rows = s.join(o, ["series_id", "f_idx", "row", "col"])
    gap = F.sqrt(F.sum((F.col("re") - F.col("re_o")) ** 2 + (F.col("im") - F.col("im_o")) ** 2))
    size = F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2))
    return rows.groupBy("series_id", "f_idx").agg((gap / (size + 1e-12)).alias("e")).groupBy("series_id").agg(F.max("e").alias("error"))


def multitaper_csd(df: DataFrame, fs: float = 1.0, time_bandwidth: float = 3.0, tapers: int | None = None, n_fft: int | None = None, demean: bool = True, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Cross-spectra of each series averaged over Slepian tapers; ``keys`` may add trial_id. One task holds one series."""
    from causeway.sources.series import channels

    names = channels(df)
    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        omega, s = M.multitaper(pdf.sort_values("t")[names].to_numpy(float), fs, time_bandwidth, tapers, n_fft, demean)
        out = spectrum_rows(pdf["series_id"].iloc[0], omega, s)
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "f_idx", "omega", "row", "col", "re", "im"]]

    return df.select(*keys, "t", *names).groupBy(*keys).applyInPandas(run, f"{head}, f_idx int, omega double, row int, col int, re double, im double")


def multitaper_csd_trials(df: DataFrame, **options) -> DataFrame:
    """The mean of the trials' cross-spectra."""
    each = multitaper_csd(df, keys=("series_id", "trial_id"), **options)
    return each.groupBy("series_id", "f_idx", "omega", "row", "col").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))


def wilson_factor(spectrum: DataFrame, most: int = 200, tolerance: float = 1e-5, regularization: float = 1e-8) -> DataFrame:
    """H of each series as a spectrum, with factor (psi), covariance, error, converged and n_iter on every row.

    An iteration needs all frequencies at once: a series is a task, and series run side by side.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        omega, s = matrices(pdf)
        w = M.wilson(s, most, tolerance, regularization)
        out = spectrum_rows(pdf["series_id"].iloc[0], omega, w["transfer"])
        psi = w["factor"]
        return out.assign(psi_re=psi.real.ravel(), psi_im=psi.imag.ravel(), covariance=[w["covariance"].ravel().tolist()] * len(out), error=w["errors"][-1], converged=w["converged"], n_iter=w["iterations"])

    return spectrum.groupBy("series_id").applyInPandas(run, f"{SPECTRUM}, psi_re double, psi_im double, covariance array<double>, error double, converged boolean, n_iter int")


def product_with_adjoint(left: DataFrame, n: int, covariance: Column | None = None) -> DataFrame:
    """M C M* of a spectrum-shaped table; C is the identity or a column array<double> of n x n."""
    key = ["series_id", "f_idx", "omega"]
    rows = left.withColumn("_c", covariance) if covariance is not None else left.withColumn("_c", F.array(*(F.lit(float(i % (n + 1) == 0)) for i in range(n * n))))
    a = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "col", "re", "im"))).alias("m"), F.first("_c").alias("c"))  # n x n entries at most
    entry = lambda r, c: G.Complex(F.col("m")[r * n + c]["re"], F.col("m")[r * n + c]["im"])

    def cell(r: int, c: int) -> G.Complex:
        out = None
        for i in range(n):
            for j in range(n):
                part = (entry(r, i) * entry(c, j).conj()).times(F.col("c")[i * n + j])
                out = part if out is None else out + part
        return out

    parts = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), (v := cell(r, c)).re.alias("re"), v.im.alias("im")) for r in range(n) for c in range(n)))
    return a.select(*key, F.explode(parts).alias("v")).select(*key, "v.row", "v.col", "v.re", "v.im")


def reconstruct_from_factor(factored: DataFrame, n: int = 2) -> DataFrame:
    psi = factored.select("series_id", "f_idx", "omega", "row", "col", F.col("psi_re").alias("re"), F.col("psi_im").alias("im"))
    return product_with_adjoint(psi, n)


def reconstruct_from_transfer(factored: DataFrame, n: int = 2) -> DataFrame:
    return product_with_adjoint(factored, n, F.col("covariance"))
