"""Tidy tables for charts: what each kind of figure shows, without drawing it.

Every function returns the rows of one chart: (chart, series, x, y), and z for surfaces.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points(df: DataFrame, chart: str, series: Column | str, x: Column, y: Column) -> DataFrame:
    name = F.lit(series) if isinstance(series, str) else series
    return df.select(F.lit(chart).alias("chart"), name.alias("series"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def _curve(chart: str, value: str) -> Callable[[DataFrame], DataFrame]:
    return lambda curve: points(curve, chart, F.col("series_id"), F.col("omega") / math.pi, F.col(value))


spectral_gc, power_spectrum = _curve("spectral_gc", "gc"), _curve("power_spectrum", "value")


def residual_acf(acf: DataFrame) -> DataFrame:
    return points(acf, "residual_acf", F.concat(F.lit("channel "), F.col("channel")), F.col("lag"), F.col("acf"))


def information_criteria(table: DataFrame) -> DataFrame:
    return points(table, "information_criteria", "aic", F.col("p"), F.col("aic")).union(points(table, "information_criteria", "bic", F.col("p"), F.col("bic")))


def gc_evolution(sliding: DataFrame) -> DataFrame:
    return points(sliding, "gc_evolution", F.col("series_id"), F.col("center"), F.col("gc"))


def true_vs_estimated(sliding: DataFrame, truth: DataFrame) -> DataFrame:
    """Estimates at their centres, and the true coupling (t, coupling) at its own times."""
    return points(truth, "true_vs_estimated", "true", F.col("t"), F.col("coupling")).union(points(sliding, "true_vs_estimated", "estimated", F.col("center"), F.col("gc")))


def parameter_convergence(history: DataFrame, place: int) -> DataFrame:
    return points(history, "parameter_convergence", F.col("series_id"), F.col("t"), F.col("theta")[place])


def adaptive_coupling(history: DataFrame, truth: DataFrame, place: int) -> DataFrame:
    return points(truth, "adaptive_coupling", "true", F.col("t"), F.col("coupling")).union(points(history, "adaptive_coupling", "estimated", F.col("t"), F.col("theta")[place]))


def gc_surface(surface: DataFrame) -> DataFrame:
    return points(surface, "gc_surface", F.col("series_id"), F.col("t"), F.col("omega")).withColumn("z", F.lit(None).cast("double")) if "gc" not in surface.columns else surface.select(F.lit("gc_surface").alias("chart"), F.col("series_id").alias("series"), F.col("t").cast("double").alias("x"), F.col("omega").alias("y"), F.col("gc").alias("z"))


def comparison(chart: str, value: str, scaled: bool = False, **curves: DataFrame) -> DataFrame:
    """Some curves (omega, value) under their names, each divided by its largest value if ``scaled``."""
    out = None
    for name, curve in curves.items():
        y = F.col(value) / F.max(value).over(Window.partitionBy("series_id")) if scaled else F.col(value)
        part = points(curve.withColumn("_y", y), chart, name, F.col("omega") / math.pi, F.col("_y"))
        out = part if out is None else out.union(part)
    return out


def spectrum_comparison(**curves: DataFrame) -> DataFrame:
    return comparison("spectrum_comparison", "value", True, **curves)


def gc_comparison(**curves: DataFrame) -> DataFrame:
    return comparison("gc_comparison", "gc", False, **curves)


def traces(chart: str, n: int | None = None, **series: tuple[DataFrame, str]) -> DataFrame:
    """Columns of tables over time under their names, the first ``n`` times of each."""
    out = None
    for name, (df, column) in series.items():
        part = points(df if n is None else df.where(F.col("t") < n), chart, name, F.col("t"), F.col(column))
        out = part if out is None else out.union(part)
    return out


def latent_vs_observed(latent: DataFrame, observed: DataFrame, factor: int, column: str = "x0", n: int | None = None) -> DataFrame:
    from causeway.operators.signal import downsample

    return traces("latent_vs_observed", n, latent=(downsample(latent, factor), column), observed=(observed, column))


def smoothing(truth: DataFrame, observed: DataFrame, smoothed: DataFrame, n: int | None = None) -> DataFrame:
    return traces("smoothing", n, true=(truth, "x0"), observed=(observed, "y0"), smoothed=(smoothed, "x0"))


def mixed_observation(truth: DataFrame, proxy: DataFrame, smoothed: DataFrame, n: int | None = None) -> DataFrame:
    return traces("mixed_observation", n, true=(truth, "x0"), proxy=(proxy, "x0"), smoothed=(smoothed, "x0"))


def log_likelihood(parameters: DataFrame) -> DataFrame:
    rows = parameters.select("series_id", F.posexplode("log_likelihoods").alias("k", "v"))
    return points(rows, "log_likelihood", F.col("series_id"), F.col("k"), F.col("v"))


def method_bars(table: DataFrame, label: str, value: str) -> DataFrame:
    return points(table, "method_bars", F.col(label).cast("string"), F.lit(0), F.col(value))


def coupled(df: DataFrame) -> DataFrame:
    """A target that channel 1 drives with a known strength, falling from .8 to .1: x0 = coupling * x1 one step before + u0."""
    w = Window.partitionBy("series_id")
    strength = 0.8 - 0.7 * F.col("t") / F.max("t").over(w)
    driven = F.coalesce(F.lag("x1").over(w.orderBy("t")), F.lit(0.0))
    return df.withColumn("coupling", strength).select("series_id", "t", (F.col("coupling") * driven + F.col("u0")).alias("x0"), "x1", "coupling")


#: What the chart of mixed observations sees: y = MIXING x + 0.5 u in channel 0; the noise is mixed like the states.
MIXING = [[1.0, 0.35], [0.25, 1.0]]


def register(query: Callable, pair: Callable, pair_model: Callable, oracles: dict[str, str]) -> None:
    """Queries for the charts that tables can feed; what is true in them is known by construction."""
    from causeway.operators import adaptive, gc_spectral, gc_time, signal, spectral, ssm, var

    plain = lambda spark, d: pair(spark, d).drop("u0")
    density = lambda spark, d: spectral.long_form(spectral.density_pair(pair_model(spark, d), 1, 48), "s")
    driven = lambda spark, d: coupled(pair(spark, d))
    estimates = lambda df: adaptive.rls(df.drop("u0", "coupling"), 1, 0.99)
    # the state is channel 0, the other two columns are what disturbs its observation
    noisy = lambda spark, d: pair(spark, d).select("series_id", "t", (F.col("x0") + F.col("x1") - F.col("u0")).alias("y0"), "u0")
    smooth = lambda spark, d: ssm.kalman_smoother(noisy(spark, d), [[0.8]], [[0.1]], [[1.0]], [[4.0]]).select("series_id", "t", F.col("x_smooth")[0].alias("x0"))
    (a, b), (c, e) = MIXING
    mixed = lambda spark, d: pair(spark, d).select("series_id", "t", (a * F.col("x0") + b * F.col("x1") + 0.5 * F.col("u0")).alias("y0"), (c * F.col("x0") + e * F.col("x1")).alias("y1"))
    noise = [[0.6 * (a * a + b * b), 0.6 * (a * c + b * e)], [0.6 * (a * c + b * e), 0.6 * (c * c + e * e)]]
    unmixed = lambda spark, d: ssm.kalman_smoother(mixed(spark, d), [[0.6, 0.0], [0.0, 0.55]], [[0.0], [0.0]], [[0.15, 0.0], [0.0, 0.15]], noise, MIXING).select("series_id", "t", F.col("x_smooth")[0].alias("x0"))

    def bold(spark, d):
        """What a scanner would see of channel 0."""
        seen = signal.convolve(pair(spark, d).select("series_id", "t", "x0"), signal.hrf_kernel(spark, 1.0), ["x0"])
        return signal.zscore(signal.downsample(seen, 6), ["x0"]).select("series_id", "t", F.col("x0_z").alias("x0"))

    def methods(spark, d):
        """One direction by several estimators."""
        both = pair(spark, d)
        found = {"var": gc_time.pairwise_gc(both, "x1", "x0"), "varx": gc_time.varx_gc(both, ["u0"], "x1", "x0"), "varx ridge": gc_time.varx_gc(both, ["u0"], "x1", "x0", ridge=10.0), "model": ssm.model_gc(pair_model(spark, d), 2, 1, 0)}
        out = None
        for name, table in found.items():
            part = table.select(F.lit(name).alias("method"), "gc")
            out = part if out is None else out.union(part)
        return out

    charts = {
        "spectral_gc": lambda s, d: spectral_gc(gc_spectral.spectral_gc(pair_model(s, d), 1, 48)),
        "residual_acf": lambda s, d: residual_acf(var.autocorrelation(var.residuals(plain(s, d), pair_model(s, d), 1), 5)),
        "information_criteria": lambda s, d: information_criteria(var.select_order(plain(s, d), 5)),
        "power_spectrum": lambda s, d: power_spectrum(spectral.power(density(s, d), 0)),
        "gc_evolution": lambda s, d: gc_evolution(gc_time.sliding_gc(plain(s, d), "x1", "x0", 240, 48)),
        "true_vs_estimated": lambda s, d: true_vs_estimated(gc_time.sliding_gc(driven(s, d), "x1", "x0", 240, 48), driven(s, d)),
        "adaptive_coupling": lambda s, d: adaptive_coupling(estimates(driven(s, d)), driven(s, d), 1),
        "parameter_convergence": lambda s, d: parameter_convergence(estimates(pair(s, d)), 1),
        "gc_surface": lambda s, d: gc_surface(gc_spectral.adaptive_surface(adaptive.rls_coefficients(estimates(pair(s, d)), 2, 1), 1, 40, 17)),
        "spectrum_comparison": lambda s, d: spectrum_comparison(target=spectral.power(density(s, d), 0), source=spectral.power(density(s, d), 1)),
        "gc_comparison": lambda s, d: gc_comparison(plain=gc_spectral.spectral_gc(pair_model(s, d), 1, 48), geweke=gc_spectral.geweke_gc(pair_model(s, d), 1, 48)),
        "latent_vs_observed": lambda s, d: latent_vs_observed(pair(s, d), bold(s, d), 6),
        "smoothing": lambda s, d: smoothing(pair(s, d), noisy(s, d), smooth(s, d), 200),
        "mixed_observation": lambda s, d: mixed_observation(pair(s, d), ssm.latent_proxy(mixed(s, d), MIXING), unmixed(s, d), 200),
        "log_likelihood": lambda s, d: log_likelihood(ssm.em(noisy(s, d))),
        "method_bars": lambda s, d: method_bars(methods(s, d), "method", "gc"),
    }
    for name, chart in charts.items():

        def run(spark, sf_dir, chart=chart):
            out = chart(spark, sf_dir)
            return out.withColumns({c: F.round(c, 4) + 0.0 for c in ("x", "y", "z") if c in out.columns})

        run.__name__ = f"chart_{name}"
        query(oracles.get(name))(run)
