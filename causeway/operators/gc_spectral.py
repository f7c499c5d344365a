"""Causality by frequency: from models, from factorized cross-spectra, and over time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import algebra as G
from causeway.functions import matrices as M
from causeway.operators import spectral as S
from causeway.operators.var import fit_var
from causeway.sources.series import channels

CURVE = ["series_id", "f_idx", "omega", "gc"]


def spectral_gc(models: DataFrame, order: int, n_freqs: int = 512) -> DataFrame:
    """Channel 1 -> 0 of two-channel models, their innovations taken as uncorrelated."""
    out = S.transfer_pair(models, order, n_freqs)
    return out.withColumn("gc", G.plain_spectral_gc(S._named("h"), S.sigma_of)).select(*CURVE)


def geweke_gc(models: DataFrame, order: int, n_freqs: int = 512) -> DataFrame:
    """Geweke's measure (1982) of channel 1 -> 0."""
    out = S.transfer_pair(models, order, n_freqs)
    return out.withColumn("gc", G.geweke_gc(S._named("h"), S.sigma_of)).select(*CURVE)


def conditional_spectral_gc(df: DataFrame, source: str, target: str, conditioning: Sequence[str], order: int, n_freqs: int = 512) -> DataFrame:
    """ln of the target's autospectrum in the model of all channels over that in the model without the source.

    Both estimate the same autospectrum: the curve shows how far a model of this order misfits, it
    is not Geweke's conditional measure. Kept for parity.
    """
    names = channels(df)
    kept = [target, *conditioning]
    whole = S.power(S.spectral_densities(fit_var(df, order), len(names), n_freqs), names.index(target))
    few = df.select("series_id", "t", *(F.col(c).alias(f"x{k}") for k, c in enumerate(kept)))
    part = S.power(S.spectral_densities(fit_var(few, order), len(kept), n_freqs), 0).select("series_id", "f_idx", F.col("value").alias("reduced"))
    return whole.join(part, ["series_id", "f_idx"]).select("series_id", "f_idx", "omega", F.log(F.col("value") / F.col("reduced")).alias("gc"))


def nonparametric_gc(spectrum: DataFrame, target: int, source: int, most: int = 300, tolerance: float = 5e-3, regularization: float = 1e-10, clip: bool = True) -> DataFrame:
    """Geweke's measure source -> target out of cross-spectra: submatrix, factorization, measure; one task for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        omega, s = S.matrices(pdf)
        w = M.wilson(s, most, tolerance, regularization)
        gc = M.geweke_from_factor(s, w["transfer"], w["covariance"], clip)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "f_idx": np.arange(len(gc)), "omega": omega, "gc": gc, "converged": w["converged"]})

    pair = S.submatrix(spectrum, [target, source])
    return pair.groupBy("series_id").applyInPandas(run, "series_id string, f_idx int, omega double, gc double, converged boolean")


def factor_gc(factored: DataFrame, spectrum: DataFrame, direction: str = "1->0", clip: bool = True) -> DataFrame:
    """The same from a table of wilson_factor(), in columns: the empirical autospectrum over the target's own part."""
    if direction != "1->0":
        raise NotImplementedError("only 1->0; choose the order of the channels by submatrix()")
    h = factored.where("row = 0").groupBy("series_id", "f_idx").agg(
        *(F.max(F.when(F.col("col") == c, F.col(part))).alias(f"h{c}_{part}") for c in range(2) for part in ("re", "im")), F.first("covariance").alias("sigma")
    )
    rows = S.power(spectrum, 0).join(h, ["series_id", "f_idx"])
    own = G.Complex(F.col("h0_re"), F.col("h0_im")) + G.Complex(F.col("h1_re"), F.col("h1_im")).times(F.col("sigma")[1] / F.col("sigma")[0])
    gc = F.log(F.col("value") / (F.col("sigma")[0] * own.square()))
    return rows.select("series_id", "f_idx", "omega", (F.when((gc > -1e-8) & (gc < 0), 0.0).otherwise(gc) if clip else gc).alias("gc"))


def adaptive_surface(histories: DataFrame, order: int, stride: int = 20, n_freqs: int | Sequence[float] = 128) -> DataFrame:
    """(series_id, t, f_idx, omega, gc) of every ``stride``-th two-channel coefficient estimate, innovations of unit covariance.

    ``histories``: (series_id, k, t, coef) of :func:`causeway.operators.adaptive.rls_coefficients`; ``n_freqs`` may be the frequencies themselves.
    """
    some = histories.where(F.col("k") % stride == 0).withColumn("sigma", F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 1.0))))
    out = S.transfer_pair(some, order, n_freqs)
    return out.withColumn("gc", G.plain_spectral_gc(S._named("h"), S.sigma_of)).select("series_id", "t", "f_idx", "omega", "gc")
