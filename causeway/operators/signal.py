"""Transforms of regularly sampled series: haemodynamic response, convolution, sampling, scaling, interpolation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _gamma(x: Column, delay: float, dispersion: float) -> Column:
    """The density of the gamma distribution of shape delay / dispersion and this scale."""
    shape = delay / dispersion
    return F.pow(x, shape - 1) * F.exp(-x / dispersion) / (math.gamma(shape) * dispersion**shape)


def hrf_kernel(spark: SparkSession, tr: float, duration: float = 32.0, dt: float = 0.1, peak_delay: float = 6, undershoot_delay: float = 16, peak_dispersion: float = 1, undershoot_dispersion: float = 1, ratio: float = 6) -> DataFrame:
    """(k, weight): the difference of two gamma densities, scaled to sum 1 on the fine grid, interpolated every ``tr`` and scaled again."""
    steps, n = math.ceil(duration / dt - 1e-9), math.ceil(duration / tr - 1e-9)
    x = F.col("i") * dt
    fine = spark.range(steps).select(F.col("id").alias("i")).withColumn("v", _gamma(x, peak_delay, peak_dispersion) - _gamma(x, undershoot_delay, undershoot_dispersion) / ratio)
    fine = fine.crossJoin(fine.agg(F.sum("v").alias("total"))).select("i", (F.col("v") / F.col("total")).alias("v"))  # one row
    at = F.col("k") * tr / dt
    coarse = spark.range(n).select(F.col("id").alias("k")).withColumns({"low": F.least(F.floor(at + 1e-9), F.lit(steps - 1)), "part": at - F.floor(at + 1e-9)})
    coarse = coarse.withColumn("high", F.least(F.col("low") + 1, F.lit(steps - 1)))
    low, high = fine.select(F.col("i").alias("low"), F.col("v").alias("v0")), fine.select(F.col("i").alias("high"), F.col("v").alias("v1"))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * F.when(F.abs("part") < 1e-6, 0.0).otherwise(F.col("part"))
    out = coarse.join(low, "low").join(high, "high").select("k", value.alias("w"))
    return out.crossJoin(out.agg(F.sum("w").alias("total"))).select("k", (F.col("w") / F.col("total")).alias("weight"))


def convolve(df: DataFrame, kernel: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``names`` convolved causally with ``kernel`` (k, weight), cut to the series' own times.

    Each sample is sent to the times that it reaches: one aggregate by time, combined before its
    shuffle, and no window over unbounded history.
    """
    taps = kernel.agg(F.array_sort(F.collect_list(F.struct("k", "weight"))).alias("taps"))  # as long as the kernel
    spread = df.crossJoin(F.broadcast(taps)).select("series_id", "t", *names, F.explode("taps").alias("tap"))
    sums = spread.groupBy("series_id", (F.col("t") + F.col("tap.k")).alias("t")).agg(*(F.sum(F.col(c) * F.col("tap.weight")).alias(c) for c in names))
    return df.drop(*names).join(sums, ["series_id", "t"])


def downsample(df: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th row of each series from its first on, with times counted anew."""
    first = F.min("t").over(Window.partitionBy("series_id"))
    out = df.withColumn("_t", F.col("t") - first).where(F.col("_t") % factor == 0)
    return out.withColumn("t", F.floor(F.col("_t") / factor).cast("long")).drop("_t")


def zscore(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with ``<name>_z``: centred and divided by the population's deviation plus 1e-12."""
    stats = df.groupBy("series_id").agg(*(f(c).alias(f"{c}_{s}") for c in names for f, s in ((F.avg, "m"), (F.stddev_pop, "s"))))
    out = df.join(stats, "series_id")
    return out.withColumns({f"{c}_z": (F.col(c) - F.col(f"{c}_m")) / (F.col(f"{c}_s") + 1e-12) for c in names}).drop(*(f"{c}_{s}" for c in names for s in "ms"))


def interpolate(curve: DataFrame, at: DataFrame, x: str, value: str, key: str = "series_id") -> DataFrame:
    """``at`` (key, x) with the linear interpolation of ``curve`` (key, x, value); clamped outside its ends.

    Both are laid on one line and brackets are carried over it by windows: no range join.
    """
    both = curve.select(key, x, F.col(value).alias("_v"), F.lit(0).alias("_q")).unionByName(at.select(key, x, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_q")))
    w = Window.partitionBy(key).orderBy(x, "_q")
    # both frames only grow, so that each row is visited once in each direction
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key).orderBy(F.desc(x), "_q").rowsBetween(Window.unboundedPreceding, 0)
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_v").alias("v")))
    rows = both.withColumns({"_a": F.last(point, True).over(back), "_b": F.last(point, True).over(ahead)}).where("_q = 1")
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])
    return rows.select(key, x, F.when(a.isNull(), b["v"]).when(b.isNull() | (b["x"] == a["x"]), a["v"]).otherwise(between).alias(value))


def prefix(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` samples of each series."""
    w = Window.partitionBy("series_id").orderBy("t")
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
